"""Raw level-1 ticks as a stream, to bars of any width: the rules of `operators.tick_bars` with a contract's state in place of its rows.

A contract's state is its last known numbers, its last valid tick, and the open bar with its quantities by price. Ticks wait until the watermark has passed them, so they are
taken in time order however files and partitions deal them; a timer wakes the contract for what waits and for the end of its open window. Ticks later than the watermark are
left out, as anywhere in Spark. State is kept by RocksDB, so what waits need not fit in memory, and a query goes on from its checkpoint where it stopped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.operators.bars import BUY_TYPES, NEW_DAY_MS, SELL_TYPES
from tidebar.operators.tick_bars import decimals, rounded
from tidebar.sources import calendar
from tidebar.sources.ticks import NUMERIC, symbol_of

DAY_MS = 86_400_000
OUT = "contract string, label_ms long, open double, high double, low double, close double, volume long, poc double, delta long, open_interest long"
BAR = ["label_ms", "open", "high", "low", "close", "volume", "delta", "open_interest"]


class Fold:
    """One contract's rules over ticks in time order. Its state is plain lists of numbers."""

    def __init__(self, contract: str, width_ms: int, zone: str, state: tuple | None = None):
        symbol = contract.rpartition(".")[2].rstrip("0123456789").lower()
        listed = {s.lower(): (*day, *night) for s, _, _, _, day, night in calendar.INSTRUMENTS}
        self.sessions = [(b * 1000, e * 1000) for _, b, e in calendar.session_rows(symbol, listed.get(symbol, calendar.DEFAULT_SESSIONS))]
        self.width, self.zone = width_ms, ZoneInfo(zone)
        fill, prev, end, bar, prices, quantities = state or ([0.0] * len(NUMERIC), [], None, [], [], [])
        self.fill, self.prev, self.end, self.bar = list(fill), list(prev), end, list(bar)
        self.levels = dict(zip(prices, quantities, strict=True))

    def state(self) -> tuple:
        return self.fill, self.prev, self.end, self.bar, list(self.levels), list(self.levels.values())

    def close(self) -> Iterator[tuple]:
        """The open bar, if there is one, as a row of OUT without its contract."""
        if self.bar:
            label, first, high, low, last, volume, delta, interest = self.bar
            poc = min(self.levels, key=lambda p: (-self.levels[p], p))
            yield int(label), first, high, low, last, int(volume), poc, int(delta), int(interest)
        self.bar, self.levels, self.end = [], {}, None

    def offset(self, ms: float) -> float:
        return pd.Timestamp(int(ms), unit="ms", tz="UTC").tz_convert(self.zone).utcoffset().total_seconds() * 1000

    def take(self, numbers: Iterable[float | None]) -> Iterator[tuple]:
        """One more tick; gives the bar that it ends."""
        self.fill = [old if new is None or math.isnan(new) else new for old, new in zip(self.fill, numbers, strict=True)]
        v = dict(zip(NUMERIC, self.fill, strict=True))
        if not (v["datetime_nano"] > 0 and v["volume"] >= 0 and v["highest"] >= v["lowest"] and all(v[c] for c in ("last_price", "highest", "lowest", "bid_price1", "ask_price1"))):
            return
        ms = v["datetime_nano"] / 1e6
        offset = self.offset(ms)
        day = (ms + offset) // DAY_MS * DAY_MS
        day -= DAY_MS if ms + offset - day < 8 * 3_600_000 else 0
        begins = [day + b - offset for b, e in self.sessions if b <= ms + offset - day <= e]
        if not begins:
            return
        now = [v["volume"], v["open_interest"], v["bid_price1"], v["ask_price1"], ms]
        before, self.prev = self.prev, now
        if not before:
            return
        if self.end is not None and ms >= self.end:
            yield from self.close()
        if self.end is None:
            self.end = max(ms // self.width * self.width, begins[0]) + self.width
        self.add(v["last_price"], before, now, ms + offset)

    def add(self, price: float, before: list[float], now: list[float], wall: float) -> None:
        traded, interest = now[0] - before[0], now[1] - before[1]
        if traded < 0:
            traded = now[0] if now[4] - before[4] > NEW_DAY_MS else 0.0
        kind = ("NONE" if traded == 0 else "EXCHANGE") if interest == 0 else ("" if interest == traded else "OPEN") if interest > 0 else ("" if interest + traded == 0 else "CLOSE")
        up = price >= before[3] or before[2] < price and price >= now[3]
        down = not up and (price <= before[2] or price <= now[2])
        name = kind + ({"OPEN": "LONG", "CLOSE": "SHORT", "EXCHANGE": "LONG"} if up else {"OPEN": "SHORT", "CLOSE": "LONG", "EXCHANGE": "SHORT"} if down else {}).get(kind, "")
        side = (name in BUY_TYPES) - (name in SELL_TYPES)
        if not self.bar:
            self.bar = [wall // 60_000 * 60_000, price, price, price, price, 0.0, 0.0, 0.0]
        label, first, high, low, _, volume, delta, _ = self.bar
        self.bar = [label, first, max(high, price), min(low, price), price, volume + traded, delta + side * traded, now[1]]
        self.levels[price] = self.levels.get(price, 0.0) + abs(side) * traded


class TickBars(StatefulProcessor):
    """Holds ticks until the watermark has passed them, then folds them in the order of (ts, seq)."""

    def __init__(self, minutes: int, zone: str):
        self.width, self.zone = minutes * 60_000, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "fill array<double>, prev array<double>, end double, bar array<double>, prices array<double>, quantities array<double>")
        self.waiting = handle.getListState("waiting", "ts_ms long, seq long, numbers array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            numbers = part[NUMERIC].astype(float).to_numpy().tolist()
            ticks = [(int(t), int(s), [None if math.isnan(x) else x for x in n]) for t, s, n in zip(part["ts_ms"], part["seq"], numbers, strict=True)]
            first = min(t for t, *_ in ticks) if first is None else min(first, *(t for t, *_ in ticks))
            self.waiting.appendList(ticks)
        self.wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def wake(self, at: float | None, passed: float) -> None:
        """A timer for what waits or for the open window's end; those that come later are set again when it rings. One that rings just now is still listed."""
        if at is not None and not any(passed < t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        fold = Fold(key[0], self.width, self.zone, self.fold.get() if self.fold.exists() else None)
        waiting = sorted(self.waiting.get(), key=lambda t: (t[0], t[1]))
        ready = [t for t in waiting if t[0] <= passed]
        bars = [b for _, _, numbers in ready for b in fold.take(numbers)]
        if fold.end is not None and fold.end <= passed:
            bars += fold.close()
        rest = waiting[len(ready) :]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.fold.update(fold.state())
        ahead = [t for t in ([rest[0][0]] if rest else []) + ([fold.end] if fold.end is not None else []) if t > passed]
        self.wake(min(ahead, default=None), passed)
        if bars:
            yield pd.DataFrame([(key[0], *b) for b in bars], columns=[c.split()[0] for c in OUT.split(", ")])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_tick_bars(ticks: DataFrame, minutes: int = 5, zone: str = "Asia/Shanghai", delay: str = "10 minutes") -> DataFrame:
    """The columns of `bars_of_ticks` of a stream of raw ticks with contract, ts (event time), seq (order among equal times) and NUMERIC columns.

    A bar is given out when the watermark, `delay` behind the latest tick, has passed its window's end. Contracts may be any number; each needs its last numbers and open
    bar alone. The bars at a stream's end stay in its state until later ticks pass them.
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    t = ticks.withWatermark("ts", delay).select("contract", "ts", F.unix_millis("ts").alias("ts_ms"), "seq", *NUMERIC)
    bars = t.groupBy("contract").transformWithStateInPandas(TickBars(minutes, zone), OUT, "Append", "EventTime")
    places = decimals(symbol_of(F.col("contract")))
    price = lambda c: rounded(F.col(c), places).alias(c)
    return bars.select("contract", F.timestamp_millis("label_ms").alias("datetime"), price("open"), price("high"), price("low"), price("close"), "volume", price("poc"), "delta", "open_interest")
