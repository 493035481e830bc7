"""Exact order statistics and running figures of groups that no task has to hold.

Quantiles are selected in two passes: a mergeable sketch gives each wanted quantile an interval that holds it, and a second pass counts what lies between the intervals and
the values within them, a small share of the rows. Running sums and peaks compose over chunks (stretches of a group in order, such as days): each chunk gives its sum, its highest and lowest
running sum and its deepest fall, and a table of a row a chunk carries them on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketch: its rank is off by at most 1 / ACCURACY of a group's rows.
ACCURACY = 4000


def quantiles(df: DataFrame, keys: list[str], x: str | Column, probabilities: Sequence[float], into: str = "q", accuracy: int = ACCURACY) -> DataFrame:
    """(keys..., `into`): the exact quantiles of x in each group, in the order of probabilities, interpolating as lo * (1 - d) + hi * d (other engines may differ in the last bit). Missing values are left out;
    a group without any has no row, nor has an empty df without keys."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    rows = df.select(*keys, x.alias("_x")).where("_x is not null")
    wide = 2.0 / accuracy
    ends = [p for q in probabilities for p in (max(q - wide, 0.0), min(q + wide, 1.0))]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_cuts"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    # an interval that reaches a group's end is open there
    cuts = [F.when(F.lit(p <= wide), F.col("_least")).when(F.lit(p >= 1 - wide), F.col("_most")).otherwise(F.get("_cuts", F.lit(i))) for i, p in enumerate(ends)]
    sketch = sketch.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_n", *[c.alias(f"_cut_{i}") for i, c in enumerate(cuts)])
    held = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)], F.lit(True))
    j = rows.join(sketch, held) if keys else rows.crossJoin(F.broadcast(sketch))  # one row
    bounds = [F.col(f"_cut_{i}") for i in range(len(ends))]
    inside = reduce(lambda a, b: a | b, [F.col("_x").between(a, b) for a, b in zip(bounds[::2], bounds[1::2], strict=True)])
    zone = reduce(lambda a, b: a + b, [(b < F.col("_x")).cast("int") for b in bounds])
    counted = j.groupBy(*keys, zone.alias("_zone"), F.when(inside, F.col("_x")).alias("_value")).agg(F.count(F.lit(1)).alias("_here"), F.min("_x").alias("_at"), F.max("_x").alias("_top"), F.first("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0)))
    found = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        # of what lies between intervals, the ends are known: the neighbours of an interval's values
        known = lambda rank: F.coalesce(F.col("_value"), F.when(rank == F.col("_before"), F.col("_at")).when(rank == F.col("_before") + F.col("_here") - 1, F.col("_top")))
        at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_here")), known(rank)))
        found += [at(F.floor(place)).alias(f"_lo_{i}"), at(F.ceil(place)).alias(f"_hi_{i}")]
    out = placed.groupBy(*keys).agg(F.first("_n").alias("_n"), *found).where("_n is not null")
    parts = [F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1)) for p in probabilities]
    values = [F.when(d == 0, F.col(f"_lo_{i}")).otherwise(F.col(f"_lo_{i}") * (1 - d) + F.col(f"_hi_{i}") * d) for i, d in enumerate(parts)]
    # the sketch's bound makes this impossible; a wrong number would be worse than an error
    checked = [F.when(v.isNull(), F.raise_error(F.lit("a quantile lies outside its interval"))).otherwise(v) for v in values]
    return out.select(*keys, F.array(*checked).alias(into))


def attached(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with the other columns of right (a row for each of keys, which may be missing)."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)  # one row
    names = [f"_right_{i}" for i in range(len(keys))]
    other = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in right.columns if c not in keys])
    held = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return left.join(other, held, how).drop(*names)


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], x: str | Column, probabilities: dict[str, float]) -> DataFrame:
    """grouped (a row a group) with the exact quantiles of x in df under their names; missing for groups without values."""
    q = quantiles(df, keys, x, list(probabilities.values()), "_q")
    return attached(grouped, q.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(probabilities)]), keys)


CHUNK = "_chunk"


def _within(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, into: str = "running", number: str | None = None) -> DataFrame:
    """df with the sum of value over the rows of its keys so far, and, with `number`, the row's number from 1. `chunk` must not fall as order rises."""
    t = df.withColumn(CHUNK, chunk)
    sums = t.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    w = _earlier(keys)
    carried = sums.select(*keys, CHUNK, F.coalesce(F.sum("_sum").over(w), F.lit(0.0)).alias("_sum"), F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_rows"))
    j = attached(t, carried, [*keys, CHUNK], "inner")
    local = _within(keys, order)
    numbers = [(F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)) + F.col("_rows")).alias(number)] if number else []
    return j.select(*df.columns, (F.sum(value).over(local) + F.col("_sum")).alias(into), *numbers)


def deepest_fall(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, into: str = "max_drawdown") -> DataFrame:
    """(keys..., `into`): how far the running sum of value fell at most below its highest so far (at most 0). The first row's sum is the first peak."""
    t = df.withColumn(CHUNK, chunk)
    w = _within(keys, order)
    t = t.withColumn("_sum", F.sum(value).over(w))
    t = t.withColumn("_fall", F.col("_sum") - F.max("_sum").over(w))
    parts = t.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_total"), F.max("_sum").alias("_high"), F.min("_sum").alias("_low"), F.min("_fall").alias("_fall"))
    before = _earlier(keys)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    parts = parts.withColumn("_peak", F.max(F.col("_base") + F.col("_high")).over(before))
    carried = F.when(F.col("_peak").isNotNull(), F.col("_base") + F.col("_low") - F.col("_peak"))
    return parts.groupBy(*keys).agg(F.min(F.least("_fall", carried)).alias(into))  # least passes over what is missing
