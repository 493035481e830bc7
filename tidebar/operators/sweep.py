"""The pullback parameter sweep as one job per side: exit configurations and signal masks meet on candidate rows only."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.kernels import flag
from tidebar.functions.ordered import with_quantiles
from tidebar.operators import metrics
from tidebar.operators.fit import Fitted
from tidebar.operators.simulate import ahead_of, barrier_exits, closed_trades

TIMES, STOPS, TAKES = (5, 12, 24, 36), (0.5, 0.75, 1.0, 1.25), (1.0, 1.5, 2.0, 2.5)
KLINE_MODES, SPACE = ("none", "strong_close_only", "full_patterns"), (False, True)


def grid(times=TIMES, stops=STOPS, takes=TAKES, klines=KLINE_MODES, spaces=SPACE) -> list[dict]:
    out = []
    for k, ((ti, t), (si, s), (pi, p), kline, space) in enumerate(product(enumerate(times), enumerate(stops), enumerate(takes), klines, spaces)):
        out.append({"case_id": f"case_{k + 1:04d}", "time_i": ti, "stop_i": si, "take_i": pi, "time_barrier_bars": t, "stop_atr_multiple": s, "take_profit_multiple": p, "kline_mode": kline, "space_filter_on": space})
    return out


def signal(side: str, kline: str, space: bool) -> Column:
    p = "" if side == "long" else "short_"
    base = F.col(f"{p}trend_filter_pass") & F.col(f"{p}pullback_structure_pass") & F.col(f"{p}flow_confirm_pass") & F.col("trade_ready")
    if kline == "strong_close_only":
        base = base & F.col("strong_bullish_close_flag" if side == "long" else "strong_bearish_close_flag") & F.col("body_quality_flag")
    elif kline == "full_patterns":
        base = base & F.col(f"{p}kline_turn_pass")
    return base & F.col(f"{p}space_filter_pass") if space else base


def sweep_trades(features: DataFrame, split: Fitted, side: str, cases: list[dict], tick: float = 1.0, cost: float = 2.0, signals: Callable[[str, bool], Column] | None = None) -> DataFrame:
    """Trades of every case in one pass: rows without any signal drop out, the rest meet each distinct (time, stop, take) once, and its exit serves all
    cases whose signal holds there. `signals` gives another signal by K-line mode and space filter."""
    chosen = signals or (lambda kline, space: signal(side, kline, space))
    masks = sorted({(c["kline_mode"], c["space_filter_on"]) for c in cases})
    held = F.filter(F.array(*[F.when(flag(chosen(k, s)), F.lit(f"{k}|{s}")) for k, s in masks]), lambda x: x.isNotNull())
    rows = ahead_of(features, max(c["time_barrier_bars"] for c in cases)).withColumn("_masks", held).where(F.size("_masks") > 0)
    configs = sorted({(c["time_barrier_bars"], c["stop_atr_multiple"], c["take_profit_multiple"]) for c in cases})
    config = F.explode(F.array(*[F.struct(F.lit(t).alias("bars"), F.lit(float(s)).alias("stop"), F.lit(float(p)).alias("take")) for t, s, p in configs]))
    needed = ["contract", "datetime", "i", "entry_time", "entry_price", "atr20_ticks", "stop_price_signal", "short_stop_price_signal", "_ahead", "_masks"]
    exits = barrier_exits(rows.select(*needed, config.alias("_c")), side, F.col("_c.bars"), F.col("_c.stop"), F.col("_c.take"), tick).withColumn("_mask", F.explode("_masks"))
    ids = [x for c in cases for x in (F.lit("|".join([str(c["time_barrier_bars"]), str(float(c["stop_atr_multiple"])), str(float(c["take_profit_multiple"])), c["kline_mode"], str(c["space_filter_on"])])), F.lit(c["case_id"]))]
    of = F.concat_ws("|", F.col("_c.bars").cast("string"), F.col("_c.stop").cast("string"), F.col("_c.take").cast("string"), F.col("_mask"))
    out = exits.withColumn("case_id", F.element_at(F.create_map(*ids), of)).where("case_id is not null").drop("_masks", "_mask", "_c")
    return closed_trades(out, ["case_id"], split, side, cost * tick)


def case_summary(trades: DataFrame, cases: DataFrame, split: str = "train") -> DataFrame:
    """Every case with its metrics in one split; a case without trades has none."""
    m = metrics.strategy_metrics(trades.where(F.col("split") == split), ["case_id"])
    return F.broadcast(cases).join(m, "case_id", "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0)))  # a row per case of the grid


def ranking(train: DataFrame, test: DataFrame, least_trades: int = 300, top: int = 20) -> DataFrame:
    """The best training cases by plateau score with their figures in the test part, and behind them the best test cases that are not among them.

    recommendation_status: train_test_consistent, not_verified, train_not_passed, or test_only for the latter, which have no train_rank. Both tables have a
    row per case of the grid.
    """
    by = lambda *names: [F.round(c, 9).desc_nulls_last() for c in names]  # noqa: E731  scores that differ only in the last bits are ties
    order = by("plateau_score", "neighbour_mean", "avg_net_return")
    place = F.row_number().over(Window.orderBy(*order, "case_id"))
    best = train.where(F.col("trade_count") >= least_trades).withColumn("train_rank", place).where(F.col("train_rank") <= top)
    best = best.select("train_rank", "case_id", F.col("avg_net_return").alias("train_avg_net_return"), F.col("sum_net_return").alias("train_sum_net_return"), "neighbour_mean", "neighbour_positive", "plateau_score")
    figures = ["trade_count", "win_rate", "avg_net_return", "sum_net_return"]
    good = flag((F.col("train_avg_net_return") > 0) & (F.col("train_sum_net_return") > 0) & (F.col("neighbour_mean") > 0) & (F.col("neighbour_positive") >= 0.5))
    holds = flag((F.col("avg_net_return") > 0) & (F.col("sum_net_return") > 0))
    status = F.when(good & holds, "train_test_consistent").when(good, "not_verified").otherwise("train_not_passed")
    verified = best.join(test.select("case_id", *figures), "case_id", "left").withColumn("recommendation_status", status)
    seen = F.row_number().over(Window.orderBy(*by("avg_net_return", "sum_net_return", "win_rate"), "case_id"))
    only = test.select("case_id", *figures, seen.alias("_seen")).where(F.col("_seen") <= top).drop("_seen").join(best, "case_id", "left_anti")
    return verified.unionByName(only.withColumn("recommendation_status", F.lit("test_only")), allowMissingColumns=True)


def best_cases(verified: DataFrame, test: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: the best case of a side, a verified one if there is any (source train_test_consistent), else the best of the test part (source test_only)."""
    a = verified.where("recommendation_status = 'train_test_consistent'").select("case_id", "avg_net_return", "sum_net_return", "win_rate", F.lit("train_test_consistent").alias("selection_source"), F.lit(0).alias("_first"))
    b = test.where("avg_net_return is not null").select("case_id", "avg_net_return", "sum_net_return", "win_rate", F.lit("test_only").alias("selection_source"), F.lit(1).alias("_first"))
    best = a.unionByName(b).orderBy("_first", *[F.round(c, 9).desc_nulls_last() for c in ("avg_net_return", "sum_net_return", "win_rate")], "case_id").limit(1).drop("_first")
    return best.join(F.broadcast(cases), "case_id")


RATES = ("take_profit_rate", "stop_loss_rate", "time_barrier_rate")


def exit_diagnostics(test: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Per setting of keys: cases, means and median of the test cases' results, and the mean shares of their exits (of cases with trades)."""
    found = test.groupBy(*keys).agg(F.count_distinct("case_id").alias("cases"), F.avg("win_rate").alias("mean_win_rate"), F.avg("avg_net_return").alias("mean_net_return"), F.avg("sum_net_return").alias("mean_sum_net_return"))
    found = with_quantiles(found, test, keys, "avg_net_return", {"median_net_return": 0.5})
    shares = test.select("case_id", *keys).join(rates, "case_id").groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in RATES])
    return found.join(shares, keys, "left")


def time_barrier_diagnostics(test: DataFrame, rates: DataFrame, base: int = 5, long: tuple[int, ...] = (24, 36)) -> DataFrame:
    """`exit_diagnostics` by time barrier, with a diagnosis where a long one is better on average than the base."""
    found = exit_diagnostics(test, rates, ["time_barrier_bars"])
    at_base = found.groupBy().agg(F.max(F.when(F.col("time_barrier_bars") == base, F.col("mean_net_return"))).alias("_base"))
    better = F.col("time_barrier_bars").isin(*long) & (F.col("mean_net_return") > F.col("_base"))
    return found.crossJoin(F.broadcast(at_base)).withColumn("diagnosis", F.when(better, f"longer_than_{base}_is_better").otherwise("")).drop("_base")  # one row


def stop_take_diagnostics(test: DataFrame, rates: DataFrame) -> DataFrame:
    """`exit_diagnostics` by stop and target, with a diagnosis of stops that are hit often and targets that are hardly met."""
    found = exit_diagnostics(test, rates, ["stop_atr_multiple", "take_profit_multiple"])
    tight, rare = (F.col("stop_atr_multiple") == 0.5) & (F.col("mean_stop_loss_rate") > 0.35), (F.col("take_profit_multiple") >= 2.0) & (F.col("mean_take_profit_rate") < 0.1)
    return found.withColumn("diagnosis", F.concat_ws(";", F.when(tight, "stop_is_tight"), F.when(rare, "target_is_rare")))


def best_plateaus(verified: DataFrame, side: str, most: int = 10) -> DataFrame:
    """The first rows of a side's ranking: by training rank, then the best test cases."""
    order = [F.col("train_rank").asc_nulls_last(), *[F.round(c, 9).desc_nulls_last() for c in ("avg_net_return", "sum_net_return", "win_rate")], F.col("case_id")]
    return verified.orderBy(*order).limit(most).withColumn("side", F.lit(side))


def exit_comparison(best: DataFrame, rates: DataFrame, side: str) -> DataFrame:
    """One row: the exits in the test part of a side's best case."""
    return best.select("case_id", "selection_source").join(rates, "case_id").withColumn("side", F.lit(side))


def comparison(test: DataFrame, trials: int) -> DataFrame:
    """Per side the best test case by mean net return, with the p-value of its win rate against one half times all trials."""
    place = F.row_number().over(Window.partitionBy("side").orderBy(*[F.round(c, 9).desc_nulls_last() for c in ("avg_net_return", "sum_net_return", "win_rate")], "case_id"))
    best = test.withColumn("_place", place).where("_place = 1").drop("_place").withColumn("split", F.lit("test"))
    return metrics.win_rate_test(best, trials).drop("split")


def asymmetry(long: DataFrame, short: DataFrame, steps: dict[str, int]) -> DataFrame:
    """One row: the likeness of two cases' settings (1 - distance on the grid for each of steps, equality of K-line mode and space filter), its mean and 1 less it."""
    columns = ["case_id", *steps, "kline_mode", "space_filter_on", "selection_source"]
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in columns])
    both = side(long, "long").join(F.broadcast(side(short, "short")), F.lit(True))  # a row each
    like = {c: 1 - F.abs(F.col(f"long_{c}") - F.col(f"short_{c}")) / max(n - 1, 1) for c, n in steps.items()}
    like |= {c: (F.col(f"long_{c}") == F.col(f"short_{c}")).cast("double") for c in ("kline_mode", "space_filter_on")}
    mean = sum(like.values(), F.lit(0.0)) / len(like)
    return both.select("*", *[x.alias(f"{c}_likeness") for c, x in like.items()], mean.alias("overlap_score"), (1 - mean).alias("asymmetry_score"))
