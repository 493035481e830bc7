"""Trades from signals: exits by fixed holding or triple barrier, and the greedy choice of trades that do not overlap.

Exits of all candidates are plain window columns. Only the greedy pass is sequential: it runs per (case, contract) over candidates alone, a few columns wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.kernels import flag, lead, per_contract
from tidebar.operators.fit import Fitted, attach


def greedy(candidates: DataFrame, keys: list[str], first: str = "i", free: str = "next_i") -> DataFrame:
    """From left to right within keys, accept a candidate whose `first` is at least the `free` of the one accepted before.

    Rows stream through in order of keys and `first`, so no group is held as a whole.
    """

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, allowed = None, 0
        for b in batches:
            names = b.schema.names
            owners = zip(*(b.column(names.index(k)).to_pylist() for k in keys), strict=True)
            chosen = []
            for at, (owner, i, after) in enumerate(zip(owners, b.column(names.index(first)).to_pylist(), b.column(names.index(free)).to_pylist(), strict=True)):
                if owner != group or i >= allowed:
                    chosen.append(at)
                    group, allowed = owner, after
            yield b.take(pa.array(chosen, pa.int64()))

    return candidates.repartition(*keys).sortWithinPartitions(*keys, first).mapInArrow(accept, candidates.schema)


def fixed_exits(df: DataFrame, hold: int = 5) -> DataFrame:
    """df with row number i, entry at the next open, and exit at the close `hold` rows on."""
    return df.withColumns({"i": F.row_number().over(per_contract()) - 1, "entry_time": lead("datetime", 1), "entry_price": lead("open", 1), "exit_time": lead("datetime", hold), "exit_price": lead("close", hold)})


def gross_return(side: Column, entry: Column, exit_: Column, mirror: bool = False) -> Column:
    """Long: exit / entry - 1. Short: 1 - exit / entry, or entry / exit - 1 where `mirror`."""
    short = F.try_divide(entry, exit_) - 1 if mirror else 1 - F.try_divide(exit_, entry)
    return F.when(side == "long", F.try_divide(exit_, entry) - 1).otherwise(short)


def fixed_hold_trades(scored: DataFrame, cuts: Fitted, split: Fitted, hold: int = 5, cost: float = 2.0, mirror: bool = False, cross: bool = False) -> DataFrame:
    """Trades of rows whose signal_score is at a threshold or beyond it (long first) and whose risk_pass holds.

    A trade from the training into the test part is skipped unless `cross`, and does not block others; a new one may begin on the exit bar.
    """
    side = F.when(F.col("signal_score") >= F.col("long_threshold"), "long").when(F.col("signal_score") <= F.col("short_threshold"), "short")
    t = attach(attach(fixed_exits(scored, hold), cuts), split).withColumn("side", F.when(F.col("risk_pass"), side))
    named = F.when(F.col("datetime") <= F.col("train_end"), "train").when(F.col("datetime") >= F.col("test_start"), "test")
    t = t.where("side is not null and exit_price is not null and entry_price > 0").withColumn("split", named).where("split is not null")
    if not cross:
        t = t.where(~((F.col("datetime") <= F.col("train_end")) & (F.col("exit_time") >= F.col("test_start"))))
    gross = gross_return(F.col("side"), F.col("entry_price"), F.col("exit_price"), mirror)
    t = t.select("contract", "side", F.col("datetime").alias("signal_time"), "entry_time", "exit_time", "entry_price", "exit_price", gross.alias("gross_return"), "split", "i", (F.col("i") + hold).alias("next_i"))
    t = t.withColumn("net_return", F.col("gross_return") - cost / F.col("entry_price"))
    return greedy(t, ["contract"]).drop("next_i")


def ahead_of(df: DataFrame, horizon: int) -> DataFrame:
    """df with row number i, the next entry_time and entry_price, and _ahead: up to `horizon` bars that follow the row."""
    bars = F.collect_list(F.struct("open", "high", "low", "close", "datetime")).over(per_contract().rowsBetween(1, horizon))
    return df.withColumns({"i": F.row_number().over(per_contract()) - 1, "_ahead": bars, "entry_price": lead("open", 1), "entry_time": lead("datetime", 1)})


def barrier_exits(rows: DataFrame, side: str, bars: Column, stop_atr: Column, take: Column, tick: float = 1.0) -> DataFrame:
    """Rows of `ahead_of` with the triple-barrier exit of an entry at the next open; those whose horizon is not all there drop out.

    The stop lies the greatest of the signal's stop distance, stop_atr ranges and one tick away, the target `take` times as far. The first bar that touches either ends
    the trade, the stop first; a stop that opens beyond fills at the open; else the close of the last bar ends it. bars, stop_atr and take are columns, so rows of
    many settings are resolved in one pass.
    """
    long = side == "long"
    stop_at = F.col("stop_price_signal" if long else "short_stop_price_signal")
    positive = lambda x: F.when(x > 0, x)
    d = rows.where((F.size("_ahead") >= bars) & (F.col("entry_price") > 0)).withColumn("_ahead", F.slice("_ahead", F.lit(1), bars))
    by_signal = positive((F.col("entry_price") - stop_at) if long else (stop_at - F.col("entry_price")))
    by_range = positive(stop_atr * F.col("atr20_ticks") * tick)
    distance = F.greatest(by_signal, by_range, F.lit(float(tick)))
    source = F.when(by_signal == distance, "signal").when(by_range == distance, "atr").otherwise("tick")
    way = 1.0 if long else -1.0
    d = d.withColumns({"stop_distance": distance, "stop_distance_source": source})
    d = d.withColumns({"stop_price": F.col("entry_price") - way * F.col("stop_distance"), "take_profit_price": F.col("entry_price") + way * take * F.col("stop_distance")})
    stops = (lambda b: b["low"] <= F.col("stop_price")) if long else (lambda b: b["high"] >= F.col("stop_price"))
    takes = (lambda b: b["high"] >= F.col("take_profit_price")) if long else (lambda b: b["low"] <= F.col("take_profit_price"))
    place = F.transform("_ahead", lambda b, k: F.when(stops(b) | takes(b), k + 1))
    d = d.withColumn("_hit", F.array_min(F.filter(place, lambda k: k.isNotNull())))
    d = d.withColumn("_step", F.coalesce("_hit", F.size("_ahead"))).withColumn("_bar", F.try_element_at("_ahead", F.col("_step")))
    bar = F.col("_bar")
    reason = F.when(F.col("_hit").isNull(), "time_barrier").when(stops(bar), "stop_loss").otherwise("take_profit")
    filled = F.least(bar["open"], F.col("stop_price")) if long else F.greatest(bar["open"], F.col("stop_price"))
    d = d.withColumn("exit_reason", reason)
    price = F.when(F.col("exit_reason") == "stop_loss", filled).when(F.col("exit_reason") == "take_profit", F.col("take_profit_price")).otherwise(bar["close"])
    return d.withColumns({"exit_price": price, "exit_time": bar["datetime"], "holding_bars": F.col("_step"), "exit_i": F.col("i") + F.col("_step")}).drop("_ahead", "_hit", "_step", "_bar")


TRADE = ["contract", "side", "signal_time", "entry_time", "exit_time", "entry_price", "exit_price", "gross_return", "holding_bars", "exit_reason", "stop_price", "take_profit_price", "stop_distance_source", "split", "i", "net_return"]


def closed_trades(exits: DataFrame, keys: list[str], split: Fitted, side: str, cost: float) -> DataFrame:
    """Non-overlapping trades per keys and contract: the next may begin after the exit bar, and none runs from the training into the test part."""
    named = F.when(F.col("datetime") <= F.col("train_end"), "train").when(F.col("datetime") >= F.col("test_start"), "test")
    t = attach(exits, split).withColumn("split", named).where("split is not null").where(~((F.col("datetime") <= F.col("train_end")) & (F.col("exit_time") >= F.col("test_start"))))
    gross = gross_return(F.lit(side), F.col("entry_price"), F.col("exit_price"))
    t = t.withColumns({"side": F.lit(side), "signal_time": F.col("datetime"), "gross_return": gross, "next_i": F.col("exit_i") + 1}).withColumn("net_return", F.col("gross_return") - cost / F.col("entry_price"))
    return greedy(t.select(*keys, *TRADE, "next_i"), [*keys, "contract"]).drop("next_i")


def barrier_trades(df: DataFrame, signal: Column, split: Fitted, side: str, bars: int = 5, stop_atr: float = 1.0, take: float = 2.0, tick: float = 1.0, cost: float = 2.0) -> DataFrame:
    """Trades of the rows where signal holds."""
    rows = ahead_of(df, bars).where(flag(signal))
    return closed_trades(barrier_exits(rows, side, F.lit(bars), F.lit(stop_atr), F.lit(take), tick), [], split, side, cost * tick)


def named_barrier_trades(df: DataFrame, signals: dict[str, Column], split: Fitted, side: str, bars: int = 5, stop_atr: float = 1.0, take: float = 2.0, tick: float = 1.0, cost: float = 2.0) -> DataFrame:
    """barrier_trades of several signals by combo_name: exits are resolved once per row, and each signal picks its own trades of them."""
    held = F.filter(F.array(*[F.when(flag(s), F.lit(name)) for name, s in signals.items()]), lambda x: x.isNotNull())
    rows = ahead_of(df, bars).withColumn("_names", held).where(F.size("_names") > 0)
    exits = barrier_exits(rows, side, F.lit(bars), F.lit(stop_atr), F.lit(take), tick).withColumn("combo_name", F.explode("_names"))
    return closed_trades(exits, ["combo_name"], split, side, cost * tick)
