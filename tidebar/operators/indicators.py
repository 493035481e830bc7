"""Classic indicators per contract. All are windows but the adaptive mean, whose every step is rounded and so runs by rows in a grouped function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.kernels import ema as ema_value
from tidebar.functions.kernels import ema_within, lag, per_contract, rolling
from tidebar.operators.evaluate import correlation

_ROW = "contract string, datetime timestamp"


def _per_contract(bars: DataFrame, columns: list[str], step, out: str) -> DataFrame:
    """step(frame in time order) -> array, as column `out`. Bars of one contract are a bounded life of some ten thousand rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("datetime")
        return pd.DataFrame({"contract": group["contract"], "datetime": group["datetime"], out: pd.Series(step(group), index=group.index).astype(object).where(lambda s: s.notna(), None)})

    return bars.select("contract", "datetime", *columns).groupBy("contract").applyInPandas(run, f"{_ROW}, {out} double")


def kama_values(close: np.ndarray, n: int = 3, fast: int = 10, slow: int = 50) -> np.ndarray:
    """Adaptive mean: the smoothing constant follows |change over n| / sum of |changes|; each step is rounded to two places; 0 before the first n rows."""
    quick, lazy = 2 / (fast + 1), 2 / (slow + 1)
    step = np.abs(np.diff(close, prepend=close[:1]))
    out = np.zeros(len(close))
    for i in range(n, len(close)):
        noise = step[i - n + 1 : i + 1].sum()
        ratio = abs(close[i] - close[i - n]) / noise if noise else 0.0
        smooth = (ratio * (quick - lazy) + lazy) ** 2
        before = out[i - 1] if i > n else close[i - 1]
        out[i] = round(before + smooth * (close[i] - before), 2)
    return out


def kama(bars: DataFrame, n: int = 3, fast: int = 10, slow: int = 50) -> DataFrame:
    return _per_contract(bars, ["close"], lambda g: kama_values(g["close"].to_numpy(float), n, fast, slow), "kama")


def kama_interval(bars: DataFrame, n: int = 3, fast: int = 10, slow: int = 50, period: int = 20) -> DataFrame:
    """kama with the highest and lowest close of the row and `period` rows before."""
    rows = bars.withColumns({"upper": rolling(F.max, "close", period + 1), "lower": rolling(F.min, "close", period + 1)}).select("contract", "datetime", "upper", "lower")
    return kama(bars, n, fast, slow).join(rows, ["contract", "datetime"])


def _numbered(bars: DataFrame) -> DataFrame:
    """Bars with their number within the contract from 1, and the true range of rows that have a close before."""
    before = lag("close")
    ranges = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.select("contract", "datetime", "close", F.row_number().over(per_contract()).alias("_n"), F.when(before.isNotNull(), ranges).alias("_range"))


def _smoothed(numbered: DataFrame, x: str, span: int, first: int, seed: int, out: str) -> DataFrame:
    """(contract, datetime, out): an exponential mean with weight 2 / (span + 1), which begins at row `seed` with the plain mean of rows first..seed.

    The recursion y = q y + a x is affine, so pieces of a contract are summed alone and only what the last piece ended with is carried on.
    """
    head = F.avg(F.when(F.col("_n").between(first, seed), F.col(x))).over(per_contract().rowsBetween(Window.unboundedPreceding, 0))
    started = numbered.withColumn("_x", F.when(F.col("_n") == seed, head).otherwise(F.col(x))).where(F.col("_n") >= seed).withColumn("_row", F.col("_n") - (seed - 1))
    done = started.withColumn("_within", ema_within("_x", span)).select("contract", "datetime", ema_value("_within", span, least=1).alias(out))
    return numbered.select("contract", "datetime").join(done, ["contract", "datetime"], "left")


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Average true range: the mean of the first `period` ranges that have a close before, then Wilder's smoothing (weight 1 / period)."""
    return _smoothed(_numbered(bars), "_range", 2 * period - 1, 2, period + 1, "atr")


def wilder_weights(rows: int, period: int) -> list[float]:
    """The weights, oldest first, that Wilder's smoothing over `rows` rows gives to their rows - 1 true ranges; none if there are too few."""
    ranges, q = rows - 1, (period - 1) / period
    return [q ** (ranges - max(j + 1, period)) / period for j in range(ranges)] if ranges >= period else []


def kama_atr(bars: DataFrame, n: int = 3, fast: int = 10, slow: int = 50, period: int = 30, width: float = 2.0) -> DataFrame:
    """kama with bands of `width` average ranges, taken over the 2 * slow rows before each: a sum with fixed weights over a fixed frame."""
    weights = wilder_weights(2 * slow, period)
    before = per_contract().rowsBetween(-(2 * slow - 1), -1)
    numbered = _numbered(bars)
    if weights:
        terms = F.zip_with(F.collect_list("_range").over(before), F.array(*map(F.lit, weights)), lambda v, w: v * w)
        band = F.when((F.col("_n") > 2 * slow) & (F.count("_range").over(before) == len(weights)), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
    else:
        band = F.lit(None).cast("double")
    bands = numbered.select("contract", "datetime", band.alias("atr"))
    j = kama(bars, n, fast, slow).join(bands, ["contract", "datetime"])
    return j.withColumns({"upper": F.bround(F.col("kama") + width * F.col("atr"), 2), "lower": F.bround(F.col("kama") - width * F.col("atr"), 2)})


def ema(bars: DataFrame, period: int = 20) -> DataFrame:
    """Exponential mean of closes that starts at the mean of the first `period`."""
    return _smoothed(_numbered(bars), "close", period, 1, period, "ema")


def keltner(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """ema with bands of `width` average true ranges."""
    j = ema(bars, period).join(atr(bars, period), ["contract", "datetime"])
    return j.withColumns({"upper": F.col("ema") + width * F.col("atr"), "lower": F.col("ema") - width * F.col("atr")})


def donchian(bars: DataFrame, period: int = 20) -> DataFrame:
    """Highest and lowest close of the `period` rows before the row."""
    before = per_contract().rowsBetween(-period, -1)
    full = F.count("close").over(before) == period
    return bars.select("contract", "datetime", F.when(full, F.max("close").over(before)).alias("upper"), F.when(full, F.min("close").over(before)).alias("lower"))


def trend_correlation(bars: DataFrame, n: int = 20) -> DataFrame:
    """Per contract: the correlation of the last n closes with their order, to four places."""
    left = F.row_number().over(Window.partitionBy("contract").orderBy(F.desc("datetime")))
    last = bars.withColumn("_left", left).where(F.col("_left") <= n)
    return last.groupBy("contract").agg(F.when(F.count("close") == n, F.bround(correlation(-F.col("_left").cast("double"), F.col("close")), 4)).alias("correlation"))
