"""Quantities fitted on the training part only: the time split, winsor bounds, centres and scales, scores, risk limits, thresholds, and the greedy selections."""

from __future__ import annotations

import math
import statistics
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.ordered import quantiles, with_quantiles
from tidebar.sources.shared import written

GLOBAL = "__GLOBAL__"


#: Fitted values: a table of one row, or the same values as constants.
Fitted = DataFrame | dict[str, Column]


def constants(fitted: DataFrame) -> dict[str, Column]:
    """The values of a one-row table. One small job gets them, and later plans hold constants where they would hold a join."""
    times = [f.name for f in fitted.schema if f.dataType.typeName().startswith("timestamp")]
    row = fitted.select(*[F.col(f.name).cast("string").alias(f.name) if f.name in times else F.col(f.name) for f in fitted.schema]).first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in fitted.schema}


def attach(df: DataFrame, fitted: Fitted) -> DataFrame:
    """df with the fitted values as columns."""
    return df.withColumns(fitted) if isinstance(fitted, dict) else df.crossJoin(F.broadcast(fitted))  # one row


def time_split(bars: DataFrame, ratio: float = 0.8) -> DataFrame:
    """One row (train_end, test_start): the last bar up to `ratio` of the time span, and the first bar after it."""
    ratio = min(max(ratio, 0.1), 0.9)
    micros = F.unix_micros(F.col("datetime").cast("timestamp"))
    span = bars.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).select((F.col("lo") + (F.col("hi") - F.col("lo")) * ratio).alias("cut"))
    ends = bars.select("datetime", micros.alias("t")).crossJoin(F.broadcast(span)).groupBy().agg(F.max(F.when(F.col("t") <= F.col("cut"), F.col("datetime"))).alias("train_end"), F.min(F.when(F.col("t") > F.col("cut"), F.col("datetime"))).alias("test_start"))
    return ends


def with_split(df: DataFrame, split: Fitted, time: str = "datetime") -> DataFrame:
    """df with split: train, test, or missing for rows between the two."""
    named = F.when(F.col(time) <= F.col("train_end"), "train").when(F.col(time) >= F.col("test_start"), "test")
    return attach(df, split).withColumn("split", named).drop("train_end", "test_start")


def transform_params(long_train: DataFrame) -> DataFrame:
    """(contract, feature, lower, upper, center, scale, scale_type) from (contract, feature, x): per contract, and over all contracts under GLOBAL.

    Bounds are the 1st and 99th percentile; centre and scale are the median and 1.4826 times the median deviation of the clipped values, else mean and
    deviation, else a constant's 1. Clipping leaves the median where it is, so one selection gives bounds and median and a second the deviation.
    """
    keys = ["contract", "feature"]
    both = long_train.where("x is not null").select("feature", "x", F.explode(F.array("contract", F.lit(GLOBAL))).alias("contract"))
    fitted = quantiles(both, keys, "x", [0.01, 0.5, 0.99]).select(*keys, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("lower", "median", "upper"))])
    fitted = written(fitted, "quantiles")  # a row a contract and feature, which two passes use
    clipped = both.join(fitted, keys).withColumn("x", F.greatest("lower", F.least("x", "upper")))
    spread = clipped.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    out = with_quantiles(fitted.join(spread, keys), clipped, keys, F.abs(F.col("x") - F.col("median")), {"mad": 0.5})
    by_mad, by_std = F.col("mad") > 1e-12, F.col("std") > 1e-12
    return out.select(
        *keys, "lower", "upper", F.when(by_mad, F.col("median")).otherwise(F.col("mean")).alias("center"),
        F.when(by_mad, 1.4826 * F.col("mad")).when(by_std, F.col("std")).otherwise(1.0).alias("scale"), F.when(by_mad, "mad").when(by_std, "std").otherwise("constant").alias("scale_type"),
    )


def standardised(long: DataFrame, params: DataFrame) -> DataFrame:
    """long with x clipped and z = (x - centre) / scale, by the contract's own parameters or, where it has none, the global ones."""
    own = params.where(F.col("contract") != GLOBAL)
    all_ = params.where(F.col("contract") == GLOBAL).drop("contract")
    names = ["lower", "upper", "center", "scale"]
    j = long.join(own.select("contract", "feature", *[F.col(n).alias(f"own_{n}") for n in names]), ["contract", "feature"], "left")
    j = j.join(all_.select("feature", *[F.col(n).alias(f"all_{n}") for n in names]), "feature", "left")
    pick = {n: F.when(F.col("own_lower").isNotNull(), F.col(f"own_{n}")).otherwise(F.col(f"all_{n}")) for n in names}
    clipped = F.when(F.col("x").isNotNull(), F.greatest(pick["lower"], F.least("x", pick["upper"])))
    return j.select(*long.columns, clipped.alias("clipped"), F.try_divide(clipped - pick["center"], pick["scale"]).alias("z"))


def with_z(df: DataFrame, params: DataFrame, names: list[str], clipped: bool = False) -> DataFrame:
    """df with z_<name> of each feature, as `standardised` but on wide rows: the parameters become one row per contract. `clipped` clips the features as well."""
    values = ["lower", "upper", "center", "scale"]
    wide = params.groupBy("contract").pivot("feature", names).agg(*[F.first(v).alias(v) for v in values])
    cells = [f"{n}_{v}" for n in names for v in values]
    own = wide.where(F.col("contract") != GLOBAL).select("contract", *[F.col(f"`{c}`").alias(f"_own_{c}") for c in cells])
    all_ = wide.where(F.col("contract") == GLOBAL).select(*[F.col(f"`{c}`").alias(f"_all_{c}") for c in cells])
    j = df.join(own, "contract", "left").join(F.broadcast(all_), F.lit(True), "left")  # one row
    pick = lambda n, v: F.when(F.col(f"_own_{n}_lower").isNotNull(), F.col(f"_own_{n}_{v}")).otherwise(F.col(f"_all_{n}_{v}"))
    bounded = {n: F.when(F.col(n).isNotNull(), F.greatest(pick(n, "lower"), F.least(F.col(n).cast("double"), pick(n, "upper")))) for n in names}
    kept = [bounded[c].alias(c) if clipped and c in bounded else F.col(c) for c in df.columns]
    return j.select(*kept, *[F.try_divide(bounded[n] - pick(n, "center"), pick(n, "scale")).alias(f"z_{n}") for n in names])


def weighted_score(features: dict[str, list[tuple[str, float, float]]]) -> Column:
    """Mean over groups of the signed, weighted sums of z columns: {group: [(z column, sign, weight)]}.

    A missing z counts nothing in its group; a group without any value, and a row without any group, is missing.
    """
    sums = []
    for parts in features.values():
        any_ = F.coalesce(*[F.col(c) for c, _, _ in parts]).isNotNull()
        sums.append(F.when(any_, sum((F.coalesce(F.col(c) * s * w, F.lit(0.0)) for c, s, w in parts), F.lit(0.0))))
    known = sum((s.isNotNull().cast("int") for s in sums), F.lit(0))
    return F.try_divide(sum((F.coalesce(s, F.lit(0.0)) for s in sums), F.lit(0.0)), known)


def risk_limits(train: DataFrame) -> DataFrame:
    """One row (max_range, max_poc_shift): the 99.5th percentiles over training rows."""
    sizes = train.select(F.col("true_range_ticks").cast("double").alias("max_range"), F.abs("poc_shift_ticks").cast("double").alias("max_poc_shift")).unpivot([], ["max_range", "max_poc_shift"], "limit", "x")
    found = quantiles(sizes, ["limit"], "x", [0.995])
    return found.agg(*[F.max(F.when(F.col("limit") == n, F.get("q", F.lit(0)))).alias(n) for n in ("max_range", "max_poc_shift")])


def risk_pass(limits: Fitted, df: DataFrame, score: str = "signal_score") -> DataFrame:
    """df with risk_pass: a score, some volume, no extreme range or shift, and an entry and exit to come."""
    ok = F.col(score).isNotNull() & (F.col("volume") > 0) & (F.col("true_range_ticks") <= F.col("max_range")) & (F.abs("poc_shift_ticks") <= F.col("max_poc_shift")) & F.col("entry_open_next").isNotNull() & F.col("exit_close_after_5").isNotNull()
    return attach(df, limits).withColumn("risk_pass", F.coalesce(ok, F.lit(False))).drop("max_range", "max_poc_shift")


def thresholds(train: DataFrame, score: str = "signal_score", high: float = 0.85, low: float = 0.15) -> DataFrame:
    found = quantiles(train, [], score, [high, low])
    return found.agg(*[F.max(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("long_threshold", "short_threshold"))])


def select_features(summary: list[dict], corr: dict[tuple[str, str], float], groups: dict[str, str], most: int = 18, corr_cap: float = 0.85, group_share: float = 0.45, coverage: float = 0.70, unique: int = 10, spread: float = 0.15, penalty: float = 0.8) -> list[dict]:
    """Greedy choice by relevance less redundancy over at most some dozens of candidates, whose table is collected before.

    First the best of each group in order of group names, then one at a time the candidate with the greatest |IC| - penalty * s * mean correlation to the chosen
    + spread * s if its group is empty, where s is the median |IC|. No chosen pair may correlate above corr_cap, and no group may hold over group_share of all.
    """
    ic = {r["feature"]: abs(r["spearman_ic"]) for r in summary if r["coverage"] >= coverage and r["unique_count"] >= unique and not r.get("inf_count") and r["spearman_ic"]}
    order = sorted(ic, key=lambda f: (-ic[f], f))
    if not order:
        return []
    scale = statistics.median(ic.values())
    between = lambda a, b: abs(corr.get((a, b), corr.get((b, a))) or 0.0)
    cap, chosen, scores = max(1, math.floor(most * group_share)), [], []

    def allowed(f: str) -> bool:
        return f not in chosen and Counter(groups[c] for c in chosen)[groups[f]] < cap and all(between(f, c) <= corr_cap for c in chosen)

    def gain(f: str) -> float:
        mean = sum(between(f, c) for c in chosen) / len(chosen) if chosen else 0.0
        return ic[f] - penalty * mean * scale + (spread * scale if groups[f] not in {groups[c] for c in chosen} else 0.0)

    for g in sorted({groups[f] for f in order}):
        best = next((f for f in order if groups[f] == g and allowed(f)), None)
        if best and len(chosen) < most:
            scores.append(gain(best))
            chosen.append(best)
    while len(chosen) < most and (left := [f for f in order if allowed(f)]):
        best = max(left, key=lambda f: (gain(f), ic[f]))
        scores.append(gain(best))
        chosen.append(best)
    return [{"selection_order": i + 1, "feature": f, "group": groups[f], "abs_spearman_ic": ic[f], "mrmr_score": s} for i, (f, s) in enumerate(zip(chosen, scores, strict=True))]


def select_dimension(summary: list[dict], corr: dict[tuple[str, str], float], features: list[str], most: int = 4, corr_cap: float = 0.85, coverage: float = 0.70, unique: int = 10) -> list[str]:
    """The features of one dimension by |IC|, leaving out those that correlate above the cap with one chosen before."""
    rows = [r for r in summary if r["feature"] in features and r["coverage"] >= coverage and r["unique_count"] >= unique and r["spearman_ic"]]
    chosen: list[str] = []
    for r in sorted(rows, key=lambda r: (-abs(r["spearman_ic"]), r["feature"])):
        if len(chosen) < most and all(abs(corr.get((r["feature"], c), corr.get((c, r["feature"]))) or 0.0) <= corr_cap for c in chosen):
            chosen.append(r["feature"])
    return chosen
