"""Feature evaluation: quality, quintiles, information coefficients, correlations. Features are unpivoted once, so each is a group of its own
and no rank is taken over a single partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.kernels import average_rank, bucket_of, distinct_edges
from tidebar.functions.ordered import quantiles, with_quantiles
from tidebar.sources.shared import written

LEAST = 20


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, x): one row per row and feature."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keep, features, "feature", "x")


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of complete pairs; missing where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def infinite(x: str | Column) -> Column:
    return F.abs(F.col(x) if isinstance(x, str) else x) == float("inf")


def quality(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: counts, coverage, distinct values, extremes and quantiles."""
    rows = long_form(df, features, []).withColumn("inf", F.coalesce(infinite("x"), F.lit(False))).withColumn("x", F.when(~F.col("inf"), F.col("x")))
    found = rows.groupBy("feature").agg(
        F.count("x").alias("non_null_count"), F.count_if(F.col("x").isNull()).alias("missing_count"), F.count_if("inf").alias("inf_count"), F.count(F.lit(1)).alias("row_count"), (F.count("x") / F.count(F.lit(1))).alias("coverage"),
        F.count_distinct("x").alias("unique_count"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    found = with_quantiles(found, rows, ["feature"], "x", {"p001": 0.001, "p01": 0.01, "median": 0.5, "p99": 0.99, "p999": 0.999})
    return found.select(*[c for c in found.columns if c != "max"], "max")


def _below(column: str):
    return lambda cut: cut < F.col(column)


def ranks(df: DataFrame, columns: list[str], keys: list[str], pieces: int = 64) -> DataFrame:
    """df with r<column>, the average rank of each of columns within keys; they must not be missing.

    A key may hold all rows of a feature, so no task sorts a key as a whole: its values are cut at approximate quantiles, ranks are taken within a piece, and
    the rows of lower pieces are added from a table of a row per key and piece. Equal values are always in one piece.
    """
    shares = F.array(*[F.lit(k / pieces) for k in range(1, pieces)])
    cuts = df.groupBy(*keys).agg(*[F.percentile_approx(c, shares, 2000).alias(f"_cuts_{c}") for c in columns])
    out = df.join(cuts, keys)
    for c in columns:
        piece = f"_piece_{c}"
        out = out.withColumn(piece, F.size(F.filter(f"_cuts_{c}", _below(c))))
        below = out.groupBy(*keys, piece).agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
        below = below.select(*keys, piece, F.coalesce(before, F.lit(0)).alias(f"_below_{c}"))
        out = out.join(below, [*keys, piece]).withColumn(f"r{c}", F.col(f"_below_{c}") + average_rank(c, *keys, piece))
    return out.select(*df.columns, *[f"r{c}" for c in columns])


def ranked(df: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """Complete pairs (x, y) of each feature and the target with their average ranks rx, ry within keys and feature."""
    pairs = long_form(df, features, [*keys, target]).where(F.col("x").isNotNull() & F.col(target).isNotNull()).withColumnRenamed(target, "y")
    return ranks(pairs.select(*keys, "feature", "x", "y"), ["x", "y"], [*keys, "feature"])


def information_coefficients(df: DataFrame, features: list[str], target: str = "future_return_5", keys: list[str] | None = None) -> DataFrame:
    """Pearson and Spearman (ranks over complete pairs) of each feature with the target, within keys; groups of fewer than LEAST pairs have none."""
    keys = keys or []
    enough = F.count(F.lit(1)) >= LEAST
    return ranked(df, features, target, keys).groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("count"), F.when(enough, correlation("x", "y")).alias("pearson_ic"), F.when(enough, correlation("rx", "ry")).alias("spearman_ic"))


def periodic_ic(df: DataFrame, features: list[str], pattern: str = "yyyy-MM", target: str = "future_return_5") -> DataFrame:
    """information_coefficients per period of the rows' time, where a period has at least LEAST pairs. Periods are short: each is ranked in one task."""
    d = df.withColumn("period", F.date_format("datetime", pattern))
    pairs = long_form(d, features, ["period", target]).where(F.col("x").isNotNull() & F.col(target).isNotNull()).withColumnRenamed(target, "y")
    r = pairs.withColumns({"rx": average_rank("x", "period", "feature"), "ry": average_rank("y", "period", "feature")})
    found = r.groupBy("period", "feature").agg(F.count(F.lit(1)).alias("count"), correlation("x", "y").alias("pearson_ic"), correlation("rx", "ry").alias("spearman_ic"))
    return found.where(F.col("count") >= LEAST)


def quintiles(df: DataFrame, features: list[str], target: str = "future_return_5", keys: list[str] | None = None, median: bool = True) -> DataFrame:
    """Per keys, feature and quintile of its own values (edges deduplicated, so ties can leave fewer): count, means, and the target's median where asked."""
    keys = [*(keys or []), "feature"]
    rows = long_form(df, features, [*keys[:-1], target, "mfe_10_long", "mae_10_long"]).where(F.col("x").isNotNull() & F.col(target).isNotNull())
    edges = written(quantiles(rows, keys, "x", [k / 5 for k in range(6)]).select(*keys, distinct_edges("q").alias("edges")), "edges")  # a row a feature
    placed = rows.join(edges, keys).where(F.size("edges") > 1).withColumn("quintile", bucket_of(F.col("x"), F.col("edges")))
    found = placed.groupBy(*keys, "quintile").agg(
        F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean_feature"), F.avg(target).alias("mean_return"), F.avg((F.col(target) > 0).cast("double")).alias("win_rate"), F.avg("mfe_10_long").alias("mean_mfe_10_long"), F.avg("mae_10_long").alias("mean_mae_10_long"),
    )
    return with_quantiles(found, placed, [*keys, "quintile"], target, {"median_return": 0.5}) if median else found


def summary(df: DataFrame, features: list[str], target: str = "future_return_5", keys: list[str] | None = None) -> DataFrame:
    """Per keys and feature: coverage and distinct values over rows with feature and target, coefficients, the spread of mean returns between the fifth
    and the first quintile, and the fifth's figures."""
    keys = [*(keys or []), "feature"]
    x, valid = F.col("x"), F.col("x").isNotNull() & F.col(target).isNotNull()
    facts = long_form(df, features, [*keys[:-1], target]).groupBy(*keys).agg(
        F.count("x").alias("non_null_count"), F.count_if(valid).alias("valid_count"), (F.count_if(valid) / F.count(F.lit(1))).alias("coverage"),
        F.count_distinct(F.when(valid, x)).alias("unique_count"), F.count_if(infinite("x")).alias("inf_count"),
    )
    ic = information_coefficients(df, features, target, keys[:-1]).drop("count")
    of = lambda q, c: F.max(F.when(F.col("quintile") == q, F.col(c)))
    fifth = quintiles(df, features, target, keys[:-1], median=False).groupBy(*keys).agg(
        (of(5, "mean_return") - of(1, "mean_return")).alias("quintile_spread"), of(5, "win_rate").alias("top_quintile_win_rate"), of(5, "mean_mfe_10_long").alias("top_quintile_mean_mfe"), of(5, "mean_mae_10_long").alias("top_quintile_mean_mae"),
    )
    fifth = fifth.select(*keys, *[F.when(F.col("quintile_spread").isNotNull(), F.col(c)).alias(c) for c in fifth.columns[len(keys) :]])
    out = facts.join(ic, keys, "left").join(fifth, keys, "left")
    return out.withColumns({"abs_spearman_ic": F.abs("spearman_ic"), "ic_direction": F.coalesce(F.signum("spearman_ic"), F.lit(0.0))})


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "rx", "ry", "rxx", "ryy", "rxy")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature_a, feature_b, pearson_corr, spearman_corr) of all pairs over rows that have both; Spearman ranks each feature over all its own values.

    Ranks are taken per feature after unpivoting and brought back to rows. Each task multiplies its rows into one table of sums for all pairs, so what moves
    is a row per pair and task. Values are moved to their means first, which keeps the sums exact enough.
    """
    keys = ["contract", "datetime"]
    known = long_form(df, features, keys).where("x is not null")
    r = ranks(known, ["x"], ["feature"])
    wide = r.groupBy(*keys).pivot("feature", features).agg(F.first("x").alias("x"), F.first("rx").alias("r"))
    n = len(features)
    row = df.agg(*[F.struct(F.avg(F.col(f).cast("double")), F.count(f)).alias(f"c{k}") for k, f in enumerate(features)]).first()
    middle = np.array([[c[0] or 0.0 for c in row], [(c[1] + 1) / 2 for c in row]])  # of values, of ranks
    first, second = np.triu_indices(n, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), n, n))
        for b in batches:
            x, r = (np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[k::2]]) - middle[k] for k in (0, 1))
            has = ~np.isnan(x)
            x, r, m = np.where(has, x, 0.0), np.where(has, r, 0.0), has.astype(float)
            total += [m.T @ m, *(z for v in (x, r) for z in (v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first))), *(pa.array(t[first, second]) for t in total)], ["pair", *SUMS])

    cells = wide.select(*[F.col(f"{f}_{k}") for f in features for k in ("x", "r")])
    found = cells.mapInArrow(sums, "pair long, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("pair").agg(*[F.sum(c).alias(c) for c in SUMS])

    def corr(a: str, b: str, aa: str, bb: str, ab: str) -> Column:
        spread = [F.col("n") * F.col(z) - F.col(v) * F.col(v) for v, z in ((a, aa), (b, bb))]
        varies = [s > 1e-12 * F.col("n") * F.col(z) for s, z in zip(spread, (aa, bb), strict=True)]
        return F.when((F.col("n") >= LEAST) & varies[0] & varies[1], (F.col("n") * F.col(ab) - F.col(a) * F.col(b)) / F.sqrt(spread[0]) / F.sqrt(spread[1]))

    name = lambda at: F.element_at(F.array(*[F.lit(f) for f in features]), F.element_at(F.array(*[F.lit(int(i) + 1) for i in at]), F.col("pair").cast("int") + 1))
    return found.select(name(first).alias("feature_a"), name(second).alias("feature_b"), corr(*SUMS[1:6]).alias("pearson_corr"), corr(*SUMS[6:]).alias("spearman_corr"))
