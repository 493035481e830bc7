"""Checks of bars, labels, trades and files as finding tables: one row per check, all of a table in one aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.kernels import per_contract
from tidebar.functions.ordered import quantiles
from tidebar.operators.fit import Fitted, attach, constants

FINDING = ["severity", "category", "check_id", "status", "affected_rows"]


def findings(df: DataFrame, category: str, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """checks: {check_id: (severity, aggregate that counts offending rows)}. No offence is PASS, else FAIL for blockers and WARN for the rest."""
    agg = df.agg(*[c.cast("long").alias(k) for k, (_, c) in checks.items()])
    long = agg.unpivot([], list(checks), "check_id", "affected_rows")
    severity = F.create_map(*[x for k, (s, _) in checks.items() for x in (F.lit(k), F.lit(s))])[F.col("check_id")]
    status = F.when(F.col("affected_rows") == 0, "PASS").when(severity == "BLOCKER", "FAIL").when(severity == "WARNING", "WARN").otherwise("INFO")
    return long.select(severity.alias("severity"), F.lit(category).alias("category"), "check_id", status.alias("status"), F.coalesce("affected_rows", F.lit(0)).alias("affected_rows"))


CORE = ["contract", "datetime", "open", "high", "low", "close", "volume", "poc", "delta", "open_interest"]


def bar_integrity(bars: DataFrame) -> DataFrame:
    """The whole list of checks of bars (or of features with their bars): a check whose columns are not there counts every row."""
    there = set(bars.columns)
    w = per_contract()
    again = F.coalesce(F.lag("datetime").over(w) == F.col("datetime"), F.lit(False)) if {"contract", "datetime"} <= there else F.lit(True)
    b = bars.withColumn("_again", again)
    infinite = [f.name for f in bars.schema if f.dataType.typeName() in ("double", "float")]
    null = lambda c: F.col(c).isNull() | (F.isnan(c) if c in infinite else F.lit(False))
    bad = lambda columns, condition: F.count_if(condition()) if set(columns) <= there else F.count(F.lit(1))
    total = lambda columns, of: sum((F.count_if(of(c)) for c in columns if c in there), F.lit(0))
    body = [F.col("open"), F.col("close")]
    prices = ["open", "high", "low", "close"]
    return findings(
        b, "integrity",
        {
            "core_columns": ("BLOCKER", F.max(F.lit(len(set(CORE) - there)))), "invalid_time": ("BLOCKER", bad(["datetime"], lambda: F.col("datetime").isNull())), "duplicate_key": ("BLOCKER", F.count_if("_again")),
            "time_order": ("BLOCKER", F.count_distinct(F.when(F.col("_again"), F.col("contract"))) if "contract" in there else F.count(F.lit(1))), "null_price": ("BLOCKER", bad(prices, lambda: null("open") | null("high") | null("low") | null("close"))),
            "core_nulls": ("BLOCKER", total(CORE, null)), "infinite_values": ("BLOCKER", total(infinite, lambda c: F.abs(c) == float("inf"))),
            "ohlc_order": ("BLOCKER", bad(prices, lambda: (F.col("high") < F.greatest(*body)) | (F.col("low") > F.least(*body)) | (F.col("high") < F.col("low")))),
            "negative_volume": ("BLOCKER", bad(["volume"], lambda: F.col("volume") < 0)), "zero_volume": ("OBSERVATION", bad(["volume"], lambda: F.col("volume") == 0)), "negative_open_interest": ("BLOCKER", bad(["open_interest"], lambda: F.col("open_interest") < 0)),
            "delta_bound": ("BLOCKER", bad(["delta", "volume"], lambda: F.abs("delta") > F.col("volume"))), "poc_in_range": ("BLOCKER", bad(["poc", "low", "high"], lambda: (F.col("poc") > F.col("high")) | (F.col("poc") < F.col("low")))),
        },
    )


def column_report(df: DataFrame) -> DataFrame:
    """Per numeric column: field, null_count, null_rate, inf_count, unique_count, zero_variance, min and max (of finite values)."""
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer")]
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers]).unpivot([], numbers, "field", "x")
    none, inf = F.col("x").isNull() | F.isnan("x"), F.coalesce(F.abs("x") == float("inf"), F.lit(False))
    finite = F.when(~none & ~inf, F.col("x"))
    n = F.count_distinct(finite)
    return long.groupBy("field").agg(F.count_if(none).alias("null_count"), (F.count_if(none) / F.count(F.lit(1))).alias("null_rate"), F.count_if(inf).alias("inf_count"), n.alias("unique_count"), (n == 1).alias("zero_variance"), F.min(finite).alias("min"), F.max(finite).alias("max"))


def differences(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Per value column: keys only expected, keys only actual, values that differ, and those missing on one side."""
    e = expected.select(*keys, *[F.col(v).alias(f"e_{v}") for v in values], F.lit(1).alias("_e"))
    a = actual.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    j = e.join(a, keys, "full_outer")
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    row = lambda v: F.struct(
        F.lit(v).alias("column_name"), count(F.col("_a").isNull()).alias("only_expected"), count(F.col("_e").isNull()).alias("only_actual"),
        count(both & (F.abs(F.col(f"e_{v}") - F.col(f"a_{v}")) > tolerance)).alias("mismatch_count"), count(both & (F.col(f"e_{v}").isNull() != F.col(f"a_{v}").isNull())).alias("null_mismatch_count"),
    )
    agg = j.agg(*[row(v).alias(f"c{k}") for k, v in enumerate(values)])
    return agg.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(values))])).alias("r")).select("r.*")


def tail_nulls(df: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Per label: non-null values among the last `horizon` rows of a contract (leaks), and nulls before them."""
    left = F.row_number().over(Window.partitionBy("contract").orderBy(F.desc("datetime")))
    d = df.withColumn("_left", left)
    row = lambda v, h: F.struct(F.lit(v).alias("label"), F.lit(h).alias("horizon"), F.count_if((F.col("_left") <= h) & F.col(v).isNotNull()).alias("leaked_rows"), F.count_if((F.col("_left") > h) & F.col(v).isNull()).alias("missing_rows"))
    agg = d.agg(*[row(v, h).alias(f"c{k}") for k, (v, h) in enumerate(horizons.items())])
    return agg.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(horizons))])).alias("r")).select("r.*")


def head_nulls(df: DataFrame, warm_up: dict[str, int]) -> DataFrame:
    """Per feature: non-null values among the first `rows` of a contract, which its window cannot fill."""
    d = df.withColumn("_row", F.row_number().over(per_contract()))
    return findings(d, "isolation", {f"head_null_{v}": ("BLOCKER", F.count_if((F.col("_row") <= n) & F.col(v).isNotNull())) for v, n in warm_up.items()})


def trade_checks(trades: DataFrame, bars: DataFrame, split: Fitted, cost: float = 2.0) -> DataFrame:
    """Trades against the bars they name: entry at the open, returns by formula, no crossing from train to test, barriers on the right sides."""
    at = bars.select("contract", F.col("datetime").alias("entry_time"), F.col("open").alias("_open"))
    t = attach(trades.join(at, ["contract", "entry_time"], "left"), split)
    gross = F.when(F.col("side") == "long", F.col("exit_price") / F.col("entry_price") - 1).otherwise(1 - F.col("exit_price") / F.col("entry_price"))
    off = lambda a, b: F.coalesce(F.abs(a - b) > 1e-10, F.lit(True))
    return findings(
        t, "trades",
        {
            "entry_price": ("BLOCKER", F.count_if(off(F.col("entry_price"), F.col("_open")))), "gross_return": ("BLOCKER", F.count_if(off(F.col("gross_return"), gross))),
            "net_return": ("BLOCKER", F.count_if(off(F.col("net_return"), F.col("gross_return") - cost / F.col("entry_price")))),
            "boundary": ("BLOCKER", F.count_if((F.col("signal_time") <= F.col("train_end")) & (F.col("exit_time") >= F.col("test_start")))), "time_order": ("BLOCKER", F.count_if((F.col("entry_time") <= F.col("signal_time")) | (F.col("exit_time") < F.col("entry_time")))),
        },
    )


def score_again(features: DataFrame, chosen: list[tuple[str, float]], split: Fitted) -> DataFrame:
    """features with `_score`: the mean over chosen (feature, sign) of the signed z-scores by training mean and deviation that there are."""
    f = attach(features, split)
    train = F.col("datetime") <= F.col("train_end")
    moments = f.where(train).agg(*[x.alias(f"_{k}{i}") for i, (n, _) in enumerate(chosen) for k, x in (("m", F.avg(n)), ("s", F.stddev_pop(n)))])
    z = [F.when(F.col(f"_s{i}") != 0, sign * (F.col(n) - F.col(f"_m{i}")) / F.col(f"_s{i}")) for i, (n, sign) in enumerate(chosen)]
    known = sum((x.isNotNull().cast("int") for x in z), F.lit(0))
    score = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0)), known)
    return attach(f, constants(moments)).withColumn("_score", score).drop(*moments.columns)


def strategy_replay(features: DataFrame, trades: DataFrame, selected: DataFrame, summary: DataFrame, split: Fitted, cost: float = 2.0, hold: int = 5, top: int = 5, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """The whole first-stage strategy made again and held against what was reported, a finding per rule.

    selected (feature, in order) must be the `top` of the training summary by |coefficient|; each trade's signal_score must be that of its bar, beyond the training thresholds on its
    side; entry and exit must be the first and the `hold`-th bar after the signal by number, at their open and close; returns must follow from those prices; trades of a
    contract must not overlap, and none may run from the training into the test part. The few selected features are read by the driver; bars and trades are joined once.
    """
    best = summary.where("spearman_ic is not null and coverage >= 0.5 and spearman_ic <> 0").orderBy(F.desc(F.abs("spearman_ic")), "feature").limit(top).select("feature", "spearman_ic").collect()
    named = [r["feature"] for r in selected.collect()]  # a handful
    sign = {r["feature"]: r["spearman_ic"] for r in summary.where(F.col("feature").isin(named)).select("feature", "spearman_ic").collect()}
    chosen = [(n, math.copysign(1.0, sign[n])) for n in named if sign.get(n)]
    scored = score_again(features, chosen, split)
    cuts = quantiles(scored.where(F.col("datetime") <= F.col("train_end")), [], "_score", [low, high]).agg(F.max(F.get("q", F.lit(0))).alias("_low"), F.max(F.get("q", F.lit(1))).alias("_high"))
    at = lambda c, n: F.lead(c, n).over(per_contract())
    rows = scored.select("contract", F.col("datetime").alias("signal_time"), "_score", "train_end", "test_start", at("datetime", 1).alias("_entry_time"), at("open", 1).alias("_open"), at("datetime", hold).alias("_exit_time"), at("close", hold).alias("_close"))
    t = attach(trades.withColumn("_next", F.lead("entry_time").over(Window.partitionBy("contract").orderBy("entry_time", "signal_time"))).join(rows, ["contract", "signal_time"], "left"), constants(cuts))
    long = F.col("side") == "long"
    gross = F.when(long, F.try_divide(F.col("_close"), F.col("_open")) - 1).otherwise(F.try_divide(F.col("_open"), F.col("_close")) - 1)
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - b) > 1e-10, F.lit(True))
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(True))
    beyond = F.when(long, F.col("signal_score") >= F.col("_high") - 1e-12).otherwise(F.col("signal_score") <= F.col("_low") + 1e-12)
    found = findings(
        t, "strategy",
        {
            "signal_score": ("BLOCKER", F.count_if(off("signal_score", F.col("_score")))), "threshold_side": ("BLOCKER", F.count_if(~F.coalesce(beyond, F.lit(False)))),
            "bars_by_number": ("BLOCKER", F.count_if(differs("entry_time", "_entry_time") | differs("exit_time", "_exit_time") | off("entry_price", F.col("_open")) | off("exit_price", F.col("_close")))),
            "returns": ("BLOCKER", F.count_if(off("gross_return", gross) | off("net_return", gross - F.try_divide(F.lit(cost), F.col("_open"))))), "overlap": ("BLOCKER", F.count_if(F.col("_next") < F.col("exit_time"))),
            "boundary": ("BLOCKER", F.count_if((F.col("split") == "train") & (F.col("exit_time") >= F.col("test_start")))),
        },
    )
    wrong = int(named != [r["feature"] for r in best])
    top_list = trades.sparkSession.createDataFrame([("BLOCKER", "strategy", "selected_top", "FAIL" if wrong else "PASS", wrong)], found.schema)
    return top_list.unionByName(found)


def path_replay(trades: DataFrame, bars: DataFrame, keys: tuple[str, ...] = (), bucket: int = 16) -> DataFrame:
    """All stop and target trades whose first touching bar is not the exit bar, and timed ones that touch before it.

    Bars are numbered per contract and dealt into buckets of `bucket` numbers. A trade finds the numbers of its entry and exit bars by their times, and goes to each bucket between them, so the interval join is
    one on (contract, bucket); the first touch is a partial minimum. `keys` (a case, a combination) tell trades of one contract, side and signal time apart.
    """
    n = F.row_number().over(Window.partitionBy("contract").orderBy("datetime"))
    numbered = bars.select("contract", "datetime", "high", "low", n.alias("_n"))
    ids = [*keys, "contract", "side", "signal_time"]
    t = trades.where("stop_price is not null").select(*ids, "entry_time", "exit_time", "stop_price", "take_profit_price", "exit_reason")
    at = lambda name: numbered.select("contract", F.col("datetime").alias(f"{name}_time"), F.col("_n").alias(f"_{name}"))
    t = t.join(at("entry"), ["contract", "entry_time"], "left").join(at("exit"), ["contract", "exit_time"], "left")
    first, last = (F.floor(F.col(c) / bucket).cast("long") for c in ("_entry", "_exit"))
    spans = t.where("_entry <= _exit").select(*ids, "_entry", "_exit", "stop_price", "take_profit_price", F.explode(F.sequence(first, last)).alias("_bucket"))
    j = spans.join(numbered.withColumn("_bucket", F.floor(F.col("_n") / bucket).cast("long")), ["contract", "_bucket"]).where("_n between _entry and _exit")
    long = F.col("side") == "long"
    touch = F.when(long, (F.col("low") <= F.col("stop_price")) | (F.col("high") >= F.col("take_profit_price"))).otherwise((F.col("high") >= F.col("stop_price")) | (F.col("low") <= F.col("take_profit_price")))
    touched = j.where(touch).groupBy(*ids).agg(F.min("datetime").alias("first_touch"))
    checked = t.join(touched, ids, "left")
    timed = F.col("exit_reason") == "time_barrier"
    wrong = F.when(F.coalesce(F.col("_entry") > F.col("_exit"), F.lit(True)), True).when(timed, F.col("first_touch").isNotNull()).otherwise(F.coalesce(F.col("first_touch") != F.col("exit_time"), F.lit(True)))
    return findings(checked, "trades", {"path_replay": ("BLOCKER", F.count_if(wrong))})


def finding_summary(found: DataFrame) -> DataFrame:
    """Counts by severity and category, and over all."""
    g = found.rollup("category", "severity").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"), F.sum("affected_rows").alias("affected_rows"))
    return g.select(F.coalesce("category", F.lit("__OVERALL__")).alias("category"), F.coalesce("severity", F.lit("ALL")).alias("severity"), "checks", "passed", "affected_rows")


def golden_diff(generated: DataFrame, reference: DataFrame, floats: list[str], ints: list[str], texts: list[str]) -> DataFrame:
    """Per contract: rows of two bar tables compared by place, with the first mismatch.

    Rows pair by contract and number in time order. Floats may differ by 1e-6, integers not at all, texts after trimming.
    """
    columns = [*floats, *ints, *texts]
    n = F.row_number().over(per_contract())
    side = lambda df, p: df.select("contract", n.alias("row_no"), *[F.col(c).alias(f"{p}_{c}") for c in columns], F.lit(1).alias(f"_{p}"))
    j = side(generated, "g").join(side(reference, "r"), ["contract", "row_no"], "full_outer")
    both = F.col("_g").isNotNull() & F.col("_r").isNotNull()

    def differs(c: str) -> Column:
        a, b = F.col(f"g_{c}"), F.col(f"r_{c}")
        if c in floats:
            return F.coalesce(F.abs(a - b) > 1e-6, a.isNull() != b.isNull())
        if c in texts:
            return F.trim(F.coalesce(a.cast("string"), F.lit(""))) != F.trim(F.coalesce(b.cast("string"), F.lit("")))
        return F.coalesce(a != b, a.isNull() != b.isNull())

    wrong = F.filter(F.array(*[F.when(differs(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    j = j.withColumn("_wrong", F.when(both, wrong).otherwise(F.array().cast("array<string>")))
    first = F.min(F.when(F.size("_wrong") > 0, F.struct("row_no", F.col("_wrong")[0].alias("column_name"))))
    g = j.groupBy("contract").agg(F.count("_g").alias("generated_rows"), F.count("_r").alias("reference_rows"), F.sum(F.size("_wrong")).alias("mismatch_count"), first.alias("_first"))
    status = (
        F.when(F.col("reference_rows") == 0, "missing_reference").when(F.col("generated_rows") == 0, "missing_input").when(F.col("generated_rows") != F.col("reference_rows"), "row_count_mismatch")
        .when(F.col("mismatch_count") > 0, "value_mismatch").otherwise("passed")
    )
    return g.select("contract", status.alias("status"), "generated_rows", "reference_rows", "mismatch_count", F.col("_first.column_name").alias("first_mismatch_column"), F.col("_first.row_no").alias("first_mismatch_row"))


def extremes(bars: DataFrame, fields: list[str], q: float = 0.999, most: int = 500) -> DataFrame:
    """The rows above a field's quantile, at most `most` of the greatest per field (a report's top list)."""
    long = bars.select("contract", "datetime", *[F.abs(F.col(f).cast("double")).alias(f) for f in fields]).unpivot(["contract", "datetime"], fields, "field", "value")
    cut = quantiles(long, ["field"], "value", [q]).select("field", F.get("q", F.lit(0)).alias("cut"))  # a row a field
    above = long.join(F.broadcast(cut), "field").where("value > cut")
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("value"), "contract", "datetime"))
    return above.withColumn("place", place).where(F.col("place") <= most).drop("cut")


def isolation(selected: DataFrame, train_summary: DataFrame, params: DataFrame, refitted: DataFrame, used_cuts: DataFrame, refitted_cuts: DataFrame) -> DataFrame:
    """Checks that fitted values come from the training part only.

    selected features have the training summary's coefficients; parameters and thresholds equal those fitted again on the training part; every split uses the
    same thresholds. Each compares small fitted tables.
    """
    s = selected.join(train_summary.select("feature", F.col("abs_spearman_ic").alias("_ic")), "feature", "left")
    off = lambda a, b, tolerance: F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())
    chosen = findings(s, "isolation", {"selected_from_train_summary": ("BLOCKER", F.count_if(off(F.col("abs_spearman_ic"), F.col("_ic"), 1e-12)))})
    values = ["lower", "upper", "center", "scale"]
    p = params.select("contract", "feature", *values, F.lit(1).alias("_p")).join(refitted.select("contract", "feature", *[F.col(v).alias(f"_{v}") for v in values], F.lit(1).alias("_r")), ["contract", "feature"], "full_outer")
    wrong = F.col("_p").isNull() | F.col("_r").isNull()
    for v in values:
        wrong = wrong | off(F.col(v), F.col(f"_{v}"), 1e-9)
    fitted = findings(p, "isolation", {"params_from_train": ("BLOCKER", F.count_if(wrong)), "params_have_global": ("BLOCKER", F.when(F.count_if(F.col("contract") == "__GLOBAL__") > 0, 0).otherwise(1))})
    cuts = ["long_threshold", "short_threshold"]
    c = used_cuts.crossJoin(F.broadcast(refitted_cuts.select(*[F.col(x).alias(f"_{x}") for x in cuts])))  # one row
    again = off(F.col(cuts[0]), F.col(f"_{cuts[0]}"), 1e-9) | off(F.col(cuts[1]), F.col(f"_{cuts[1]}"), 1e-9)
    shared = F.count_distinct(F.struct(*cuts)) - 1
    thresholds = findings(c, "isolation", {"thresholds_from_train": ("BLOCKER", F.count_if(again)), "thresholds_shared": ("BLOCKER", shared)})
    return chosen.unionByName(fitted).unionByName(thresholds)


def feature_checks(quality: DataFrame, correlations: DataFrame, selected: DataFrame, total: int, near: float = 0.95, share: float = 0.6) -> DataFrame:
    """Features with infinite values or hardly any variance, pairs that are nearly one, and a group that holds most of the selected features."""
    q = findings(quality, "quality", {"infinite_values": ("BLOCKER", F.count_if(F.col("inf_count") > 0)), "near_constant": ("WARNING", F.count_if((F.col("unique_count") <= 1) | (F.col("std") < 1e-12)))})
    c = findings(correlations, "correlation", {"nearly_equal_pairs": ("WARNING", F.count_if(F.abs("spearman_corr") >= near))})
    g = selected.groupBy("group").agg((F.count(F.lit(1)) / total).alias("_share"))
    d = findings(g, "diversity", {"dominant_group": ("WARNING", F.count_if(F.col("_share") >= share)), "one_group_only": ("WARNING", F.when(F.count(F.lit(1)) <= 1, 1).otherwise(0))})
    return q.unionByName(c).unionByName(d)


#: Features that look one row back, so that a contract's first row has none of them; fixed values.
ONE_ROW_BACK = ["close_to_prev_close_return", "gap_return", "delta_change_1", "poc_shift_ticks", "open_interest_change", "open_interest_change_pct"]


def first_row_sentinel(features: DataFrame) -> DataFrame:
    """One finding: values of ONE_ROW_BACK at the first rows of contracts, which could come from another contract only."""
    there = [c for c in ONE_ROW_BACK if c in features.columns]
    first = features.withColumn("_row", F.row_number().over(per_contract())).where("_row = 1")
    return findings(first, "isolation", {"first_row_shift": ("BLOCKER", sum((F.count(c) for c in there), F.lit(0)))})


def forbidden_columns(df: DataFrame, tokens: tuple[str, ...] = ("future", "mfe", "mae", "trade_return", "entry_open", "exit_close")) -> list[str]:
    """Columns whose names betray a look ahead."""
    return [c for c in df.columns if any(t in c.lower() for t in tokens)]
