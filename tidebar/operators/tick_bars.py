"""Raw level-1 ticks to bars of any width, in two reads of the ticks.

A chunk is a stretch of a contract's rows (a file split, a day). The first read takes each chunk's last known numbers. The second fills, checks, places and pairs ticks within chunks, over
one exchange and one sort, and adds them up into price ladders of short slots; what a chunk cannot know, the tick before its first one, travels in the ladder as the chunk's edges
(two ticks a chunk). All that follows reads the ladder: edges of neighbouring chunks are paired, and the few heads so classified join the sums.

A window lasts until the first tick at or after its end, so where it begins depends on the windows before. Ends are multiples of a slot, the greatest common part of the
width, the sessions' begins and a quarter of an hour, so a slot is never cut and windows are found over slots: a break at least as long as a window begins a new one for certain,
and between such breaks a fold over slots gives each its window. A contract has as many slots as its life has, however many ticks it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.bars import PAIRED, classified
from tidebar.sources import calendar
from tidebar.sources.shared import written
from tidebar.sources.ticks import filled_forward, in_session, symbol_of

QUARTER_S = 900


def slot_seconds(minutes: int) -> int:
    return math.gcd(minutes * 60, QUARTER_S, *(b for s, _, _, _, day, night in calendar.INSTRUMENTS for _, b, _ in calendar.session_rows(s, (*day, *night))))


def sticky_windows(slots: list[int], begins: list[int], width: int) -> list[int]:
    """Where the window of each slot begins: at the multiple of width or the session's begin before it, whichever is later, unless the last window still lasts."""
    out, end, begin = [], None, 0
    for slot, session in zip(slots, begins, strict=True):
        if end is None or slot >= end:
            begin = max(slot // width * width, session)
            end = begin + width
        out.append(begin)
    return out


def with_windows(slots: DataFrame, width_ms: int) -> DataFrame:
    """(contract, slot, session_ms, window) of distinct (contract, slot, session_ms)."""
    w = Window.partitionBy("contract").orderBy("slot", "session_ms")
    breaks = F.coalesce((F.col("slot") - F.lag("slot").over(w) >= width_ms).cast("int"), F.lit(1))
    runs = slots.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = runs.groupBy("contract", "_run").agg(F.array_sort(F.collect_list(F.struct("slot", "session_ms"))).alias("_slots"))

    @F.pandas_udf("array<long>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, begins in batches:
            yield pd.Series([sticky_windows(list(map(int, a)), list(map(int, b)), width_ms) for a, b in zip(at, begins, strict=True)])

    listed = listed.withColumn("_windows", found(F.col("_slots.slot"), F.col("_slots.session_ms")))
    return listed.select("contract", F.explode(F.arrays_zip("_slots", "_windows")).alias("_s")).select("contract", "_s._slots.slot", "_s._slots.session_ms", F.col("_s._windows").alias("window"))


EDGE = [*PAIRED, "last_price", "_chunk", "seq", "wall_ms", "slot", "session_ms"]
LADDER_KEYS = ("contract", "slot", "session_ms", "level")


def _ladder(t: DataFrame, counted: Column) -> list[Column]:
    """Aggregates of the counted rows of (contract, ..., level)."""
    at = F.struct("_chunk", "seq")
    own = lambda c: F.when(counted, c)
    side = lambda s: F.coalesce(F.sum(own(F.when(F.col("side") == s, F.col("qty")))), F.lit(0.0)).cast("long")
    return [
        side(1).alias("buy"), side(-1).alias("sell"), side(0).alias("other"),
        F.min(own(F.struct(at.alias("at"), F.col("level").alias("price"), "wall_ms"))).alias("first"), F.max(own(F.struct(at.alias("at"), F.col("level").alias("price"), F.col("open_interest").alias("oi")))).alias("last"),
    ]


def placed_ticks(ticks: DataFrame, minutes: int, zone: str) -> DataFrame:
    """Ticks in sessions, filled, with their slot and session begin as epoch ms, and the tick before and whether another follows within the chunk."""
    t = in_session(filled_forward(ticks, keep_chunk=True), zone)
    slot_ms = slot_seconds(minutes) * 1000
    ms = F.floor(F.col("datetime_nano") / 1e6)
    t = t.withColumns({"slot": F.floor(ms / slot_ms).cast("long") * slot_ms, "session_ms": F.col("session_begin_ms") - F.col("wall_ms") + ms.cast("long")})
    w = Window.partitionBy("contract", "_chunk").orderBy("seq")
    return t.withColumns({**{f"prev_{c}": F.lag(c).over(w) for c in PAIRED}, "_tail": F.lead("seq").over(w).isNull()}).withColumn("level", F.col("last_price"))


def slot_ladder(ticks: DataFrame, minutes: int, zone: str) -> DataFrame:
    """The written ladder: per (contract, slot, session, level) its sums, and `edges`: heads (without a tick before) and tails of chunks."""
    t = classified(placed_ticks(ticks, minutes, zone))
    inner = F.col("prev_datetime_nano").isNotNull()
    edge = F.when(~inner | F.col("_tail"), F.struct((~inner).alias("head"), *EDGE))
    return written(t.groupBy(*LADDER_KEYS).agg(*_ladder(t, inner), F.collect_list(edge).alias("edges")), "tick-ladder")


def head_ladder(ladder: DataFrame) -> DataFrame:
    """The heads of chunks, paired with the tail of the chunk before, as ladder rows. A contract's first tick only primes."""
    e = ladder.where(F.size("edges") > 0).select("contract", F.explode("edges").alias("e")).select("contract", "e.*")
    w = Window.partitionBy("contract").orderBy("_chunk", "seq")
    e = e.withColumns({f"prev_{c}": F.lag(c).over(w) for c in PAIRED}).where("head and prev_datetime_nano is not null")
    h = classified(e)
    return h.groupBy(*LADDER_KEYS).agg(*_ladder(h, F.lit(True)))


def decimals(symbols: Column) -> Column:
    """Places of a symbol's tick size, at least one."""
    of = lambda tick: max(len(f"{tick:.6f}".rstrip("0").partition(".")[2]), 1)
    places = {s.lower(): of(tick) for s, _, _, tick, _, _ in calendar.INSTRUMENTS}
    out = F.lit(1)
    for n in sorted(set(places.values()) - {1}):
        out = F.when(symbols.isin(*[s for s, k in places.items() if k == n]), n).otherwise(out)
    return out


def rounded(price: Column, places: Column) -> Column:
    """price to `places` places (1 to 3), halves to even."""
    return F.when(places == 1, F.bround(price, 1)).when(places == 2, F.bround(price, 2)).otherwise(F.bround(price, 3))


def bars_of_ticks(ticks: DataFrame, minutes: int = 5, zone: str = "Asia/Shanghai") -> DataFrame:
    """contract, datetime, open, high, low, close, volume, poc, delta, open_interest of raw ticks (see sources.ticks), whose rows are in time order within a contract.

    A bar is labelled by its first tick's minute. Its point of control is the price with the most classified quantity, the lowest of those that tie. Prices are
    rounded to the places of their symbol's tick size. Ticks in no session, without valid prices, and a contract's first valid tick make no bar; no ticks, no bars.
    """
    ladder = slot_ladder(ticks, minutes, zone)
    both = ladder.drop("edges").where("first is not null").unionByName(head_ladder(ladder))
    windows = with_windows(both.select("contract", "slot", "session_ms").distinct(), minutes * 60_000)
    levels = both.join(windows, ["contract", "slot", "session_ms"]).groupBy("contract", "window", "level").agg(*[F.sum(c).alias(c) for c in ("buy", "sell", "other")], F.min("first").alias("first"), F.max("last").alias("last"))
    bars = levels.groupBy("contract", "window").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("level").alias("high"), F.min("level").alias("low"), F.sum(F.col("buy") + F.col("sell") + F.col("other")).alias("volume"),
        (-F.max(F.struct((F.col("buy") + F.col("sell")).alias("v"), (-F.col("level")).alias("p"))).getField("p")).alias("poc"), F.sum(F.col("buy") - F.col("sell")).alias("delta"),
    )
    places = decimals(symbol_of(F.col("contract")))
    price = {"open": F.col("first.price"), "high": F.col("high"), "low": F.col("low"), "close": F.col("last.price")}
    return bars.select(
        "contract", F.date_trunc("minute", F.timestamp_millis("first.wall_ms")).alias("datetime"), *[rounded(x, places).alias(c) for c, x in price.items()],
        "volume", rounded(F.col("poc"), places).alias("poc"), "delta", F.col("last.oi").cast("long").alias("open_interest"),
    )
