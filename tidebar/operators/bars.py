"""Ticks to order-flow bars: classification against the tick before, price ladders, bars, points of control, imbalance runs.

Ladders are summed per (contract, bar, level) before bars are, and both sums are partial before the shuffle, so that a contract with a third of all ticks is
no task of its own. The tick before is looked up within chunks of a contract's time, whose last ticks are carried over (`previous_tick`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_INTEREST_START = 100_000


def ladder_of(ticks: DataFrame, order: tuple[str, ...], keys: tuple[str, ...] = ("contract", "datetime", "level")) -> DataFrame:
    """Per level of a bar: bought, sold and unclassified quantity, and the first and last trade. Needs price, level, qty, side, oi."""
    when = F.struct(*order)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0))
    return ticks.groupBy(*keys).agg(
        side(1).alias("buy"), side(-1).alias("sell"), side(0).alias("other"), F.sum("oi").alias("oi"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.min(F.struct(when.alias("at"), F.col("price"))).alias("first"), F.max(F.struct(when.alias("at"), F.col("price"))).alias("last"),
    )


def bars_of(ladder: DataFrame) -> DataFrame:
    """contract, datetime, open, high, low, close, volume, poc, delta, open_interest. The point of control is the level with the most classified
    quantity, the lowest of those that tie."""
    bars = ladder.groupBy("contract", "datetime").agg(
        F.min("first").getField("price").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").getField("price").alias("close"),
        F.sum(F.col("buy") + F.col("sell") + F.col("other")).alias("volume"), (-F.max(F.struct(F.col("buy") + F.col("sell"), -F.col("level"))).getField("col2")).alias("poc"),
        F.sum(F.col("buy") - F.col("sell")).alias("delta"), F.sum("oi").alias("_oi"),
    )
    running = F.sum("_oi").over(Window.partitionBy("contract").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("open_interest", running + OPEN_INTEREST_START).drop("_oi")


def _place(step: float) -> Column:
    """A level's number on the grid of its bar, whose lowest level is 0."""
    return F.round((F.col("level") - F.min("level").over(Window.partitionBy("contract", "datetime"))) / step).cast("long")


def price_grid(ladder: DataFrame, step: float = 1.0) -> DataFrame:
    """contract, datetime, level, buy, sell of every tick level between a bar's lowest and highest; levels without trades have none of either."""
    span = ladder.groupBy("contract", "datetime").agg(F.min("level").alias("_low"), F.round((F.max("level") - F.min("level")) / step).cast("long").alias("_last"))
    grid = span.select("contract", "datetime", "_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_place"))
    known = ladder.select("contract", "datetime", "buy", "sell", _place(step).alias("_place"))
    j = grid.join(known, ["contract", "datetime", "_place"], "left")
    return j.select("contract", "datetime", F.round(F.col("_low") + F.col("_place") * step, 10).alias("level"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("buy", "sell")])


def heavy(own: Column, other: Column, ratio: float, least: float) -> Column:
    """Whether a side of a level outweighs the other: `ratio` times as much, or at least `least` against nothing."""
    return F.when(other > 0, own >= ratio * other).otherwise(own >= least)


def imbalance_runs(ladder: DataFrame, ratio: float = 3.0, run: int = 3, step: float = 1.0, least: float = 1.0) -> DataFrame:
    """Runs of at least `run` neighbouring tick levels whose own sides are out of balance: contract, datetime, side, low_level, high_level, levels, from_level.

    A level counts for a side that has `ratio` times the other's quantity at that level, or at least `least` where the other has none. A level without trades
    ends a run. from_level is where the run is first `run` levels long; the published range of a run is from_level to high_level.
    """
    marked = ladder.select("contract", "datetime", "level", _place(step).alias("_place"), *[heavy(F.col(a), F.col(b), ratio, least).alias(f"_{a}") for a, b in (("buy", "sell"), ("sell", "buy"))])
    sides = marked.select("contract", "datetime", "level", "_place", F.explode(F.array(F.when(F.col("_buy"), "buy"), F.when(F.col("_sell"), "sell"))).alias("side")).where("side is not null")
    island = F.col("_place") - F.row_number().over(Window.partitionBy("contract", "datetime", "side").orderBy("_place"))
    runs = sides.withColumn("_island", island).groupBy("contract", "datetime", "side", "_island")
    found = runs.agg(F.min("level").alias("low_level"), F.max("level").alias("high_level"), F.count(F.lit(1)).alias("levels")).where(F.col("levels") >= run)
    return found.withColumn("from_level", F.round(F.col("low_level") + (run - 1) * step, 10)).drop("_island")


def previous_tick(ticks: DataFrame, order: tuple[str, ...], columns: list[str], chunk: Column, prefix: str = "prev_") -> DataFrame:
    """Columns of the tick before in the same contract. `chunk` must not fall as order rises: each chunk is sorted alone, and only its last tick
    is passed on, so no task holds a whole contract."""
    t = ticks.withColumn("_chunk", chunk)
    w = Window.partitionBy("contract", "_chunk").orderBy(*order)
    row = F.struct(*columns)
    last = t.groupBy("contract", "_chunk").agg(F.max(F.struct(F.struct(*order).alias("at"), row.alias("row"))).getField("row").alias("_end"))
    carried = last.select("contract", "_chunk", F.lag("_end").over(Window.partitionBy("contract").orderBy("_chunk")).alias("_carried"))
    t = t.withColumn("_prev", F.lag(row).over(w)).join(carried, ["contract", "_chunk"])
    prev = F.coalesce("_prev", "_carried")
    return t.select(*ticks.columns, *[prev.getField(c).alias(prefix + c) for c in columns])


#: The class of a change in open interest and a direction that make a buy or a sell.
BUY_TYPES, SELL_TYPES = ("OPENLONG", "CLOSESHORT", "EXCHANGELONG"), ("OPENSHORT", "CLOSELONG", "EXCHANGESHORT")


def interest_class(d_volume: Column, d_interest: Column) -> Column:
    """NONE, EXCHANGE, DOUBLEOPEN, OPEN, DOUBLECLOSE or CLOSE."""
    return (
        F.when((d_interest == 0) & (d_volume == 0), "NONE").when(d_interest == 0, "EXCHANGE")
        .when((d_interest > 0) & (d_interest == d_volume), "DOUBLEOPEN").when(d_interest > 0, "OPEN")
        .when(d_interest + d_volume == 0, "DOUBLECLOSE").otherwise("CLOSE")
    )


def direction(last: Column, bid: Column, ask: Column, prev_bid: Column, prev_ask: Column) -> Column:
    """UP, DOWN or MIDDLE: the price against the quotes before, then against its own."""
    return F.when(last >= prev_ask, "UP").when(last <= prev_bid, "DOWN").when(last >= ask, "UP").when(last <= bid, "DOWN").otherwise("MIDDLE")


def tick_type(interest: Column, way: Column) -> Column:
    """One of 13 names, such as OPENLONG or EXCHANGEUNKNOWN."""
    up, down = way == "UP", way == "DOWN"
    of = lambda a, b, c: F.when(up, a).when(down, b).otherwise(c)
    return (
        F.when(interest == "OPEN", of("OPENLONG", "OPENSHORT", "OPENUNKNOWN")).when(interest == "CLOSE", of("CLOSESHORT", "CLOSELONG", "CLOSEUNKNOWN"))
        .when(interest == "EXCHANGE", of("EXCHANGELONG", "EXCHANGESHORT", "EXCHANGEUNKNOWN")).otherwise(interest)
    )


def side_of(kind: Column) -> Column:
    return F.when(kind.isin(*BUY_TYPES), 1).when(kind.isin(*SELL_TYPES), -1).otherwise(0)


NEW_DAY_MS = 600_000


def volume_change(volume: Column, prev_volume: Column, ms: Column, prev_ms: Column) -> Column:
    """Traded since the tick before; a fall means a new day after a break of over ten minutes, else nothing."""
    d = volume - prev_volume
    return F.when(d >= 0, d).when(ms - prev_ms > NEW_DAY_MS, volume).otherwise(F.lit(0))


PAIRED = ["volume", "open_interest", "bid_price1", "ask_price1", "datetime_nano"]


def classified(ticks: DataFrame, prefix: str = "prev_") -> DataFrame:
    """Ticks that have PAIRED columns of the tick before, with qty, oi_change, interest, way, tick_type, side, price and level."""
    prev = {c: F.col(prefix + c) for c in PAIRED}
    qty = volume_change(F.col("volume"), prev["volume"], F.col("datetime_nano") / 1e6, prev["datetime_nano"] / 1e6)
    t = ticks.withColumns({"qty": qty, "oi_change": F.col("open_interest") - prev["open_interest"]})
    t = t.withColumn("interest", interest_class(F.col("qty"), F.col("oi_change")))
    t = t.withColumn("way", direction(F.col("last_price"), F.col("bid_price1"), F.col("ask_price1"), prev["bid_price1"], prev["ask_price1"]))
    t = t.withColumn("tick_type", tick_type(F.col("interest"), F.col("way")))
    return t.withColumns({"side": side_of(F.col("tick_type")), "price": F.col("last_price"), "level": F.col("last_price")})


def classified_ticks(ticks: DataFrame) -> DataFrame:
    """Level-1 ticks inside sessions (see sources.ticks), classified. The first tick of a contract only primes."""
    prev = previous_tick(ticks, ("datetime_nano", "seq"), PAIRED, F.col("trading_day"))
    return classified(prev.where("prev_datetime_nano is not null"))
