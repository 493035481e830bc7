"""Trade tables to figures: strategy metrics, equity, costs, months, overlap, confidence, tests, exits, plateaus, ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.kernels import two_sided_p
from tidebar.functions.ordered import attached, deepest_fall, running, with_quantiles


def with_all(df: DataFrame, column: str = "split") -> DataFrame:
    """Each row under its own value and under 'all'."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit("all"))))


def strategy_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: trades by side, win rate, mean, median and sum of net returns, Sharpe ratio, and the greatest fall from a running peak.

    The path runs by contract and signal time, in chunks of a contract's months; its peak starts at the first value.
    """
    n, std = F.count(F.lit(1)), F.stddev_samp("net_return")
    found = trades.groupBy(*keys).agg(
        n.alias("trade_count"), F.count_if(F.col("side") == "long").alias("long_count"), F.count_if(F.col("side") == "short").alias("short_count"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"),
        F.avg("gross_return").alias("avg_gross_return"), F.avg("net_return").alias("avg_net_return"), F.sum("net_return").alias("sum_net_return"), F.when(std > 0, F.try_divide(F.sqrt(n) * F.avg("net_return"), std)).alias("sharpe"),
    )
    month = F.struct("contract", F.date_trunc("month", "signal_time").alias("month"))
    falls = deepest_fall(trades, keys, month, ["contract", "signal_time"], "net_return")
    found = with_quantiles(attached(found, falls, keys), trades, keys, "net_return", {"median_net_return": 0.5})
    return found.select(*keys, "trade_count", "long_count", "short_count", "win_rate", "avg_gross_return", "avg_net_return", "median_net_return", "sum_net_return", "sharpe", "max_drawdown")


BY_EXIT = ["exit_time", "contract", "signal_time"]


def equity_curve(trades: DataFrame, keys: list[str]) -> DataFrame:
    """trades with the running sum of net returns by exit time, ties by contract and signal time; days are summed apart and carried on."""
    found = running(trades, keys, F.date_trunc("day", "exit_time"), BY_EXIT, "net_return", "equity")
    return found.select(*keys, "contract", "signal_time", "exit_time", "equity")


def cost_sensitivity(trades: DataFrame, ticks: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0), tick: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Per keys, cost and split: the metrics had each trade cost so many ticks."""
    costs = F.explode(F.array(*[F.lit(float(x)) for x in ticks])).alias("cost_ticks")
    t = with_all(trades).select("*", costs)
    return strategy_metrics(t.withColumn("net_return", F.col("gross_return") - F.col("cost_ticks") * tick / F.col("entry_price")), [*(keys or []), "cost_ticks", "split"])


def monthly(trades: DataFrame, keys: list[str], pattern: str = "yyyy-MM") -> DataFrame:
    t = trades.withColumn("month", F.date_format("exit_time", pattern))
    return t.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("trade_count"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.avg("net_return").alias("avg_net_return"), F.sum("net_return").alias("sum_net_return"))


def overlaps(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per contract: trades that begin before the one before has ended."""
    keys = [*(keys or []), "contract"]
    later = F.lead("entry_time").over(Window.partitionBy(*keys).orderBy("signal_time"))
    t = trades.withColumn("_overlap", F.coalesce(later < F.col("exit_time"), F.lit(False)))
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count"), F.count_if("_overlap").alias("overlap_count"))


def sample_confidence(metrics: DataFrame, low: int = 100, good: int = 300, every_split: bool = False) -> DataFrame:
    """metrics with the standard error of the win rate, its 95 % interval within 0..1, and a status by trade count (of the test part only, unless every_split)."""
    n, rate = F.col("trade_count"), F.col("win_rate")
    se = F.sqrt(F.try_divide(rate * (1 - rate), n))
    judged = F.lit(True) if every_split else F.col("split") == "test"
    status = F.when((n == 0) | rate.isNull(), F.when(judged, "insufficient_samples").otherwise("no_samples")).when(judged & (n < low), "insufficient_samples").when(judged & (n < good), "low_confidence").otherwise("enough_samples")
    known = lambda x: F.when(se.isNotNull(), x)  # noqa: E731  greatest and least pass over what is missing
    return metrics.withColumns({"win_rate_se": se, "win_rate_low": known(F.greatest(F.lit(0.0), rate - 1.96 * se)), "win_rate_high": known(F.least(F.lit(1.0), rate + 1.96 * se)), "sample_status": status})


def positive_months(monthly_trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: the share of months with a mean net return above 0."""
    return monthly_trades.groupBy(*keys).agg(F.avg((F.col("avg_net_return") > 0).cast("double")).alias("positive_month_share"))


def moments(x: Column) -> tuple[Column, Column]:
    """Aggregates: skew and excess kurtosis corrected for bias; missing for fewer than 3 and 4 values, 0 where all are equal."""
    n = F.count(x)
    flat = F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0
    skew = F.when(n >= 3, F.when(flat, 0.0).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)))
    kurtosis = F.when(n >= 4, F.when(flat, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)))
    return skew, kurtosis


#: Quantiles of a signal's distribution; fixed values.
SHOWN_QUANTILES = (0.01, 0.05, 0.15, 0.5, 0.85, 0.95, 0.99)


def signal_distribution(scored: DataFrame, keys: list[str], cuts: list[str], score: str = "signal_score") -> DataFrame:
    """Per keys: count, mean, deviation, bias-corrected skew and kurtosis, and quantiles of the scores that pass the risk filter, with the thresholds `cuts`
    (long, short) of the keys, their distance and their mean size."""
    x = F.col(score)
    skew, kurtosis = moments(x)
    passed = scored.where("risk_pass")
    g = passed.groupBy(*keys).agg(F.count(x).alias("signal_count"), F.avg(x).alias("score_mean"), F.stddev_pop(x).alias("score_std"), skew.alias("score_skew"), kurtosis.alias("score_kurtosis"), *[F.first(c).alias(c) for c in cuts])
    long, short = map(F.col, cuts)
    shown = {f"score_p{round(100 * p):02d}": p for p in SHOWN_QUANTILES}
    g = with_quantiles(g, passed, keys, x, shown)
    return g.select(*keys, "signal_count", "score_mean", "score_std", "score_skew", "score_kurtosis", *shown, *cuts, (long - short).alias("tail_separation"), ((F.abs(long) + F.abs(short)) / 2).alias("threshold_abs_mean"))


def distribution_diagnostics(distribution: DataFrame, summary: DataFrame, most: float = 0.40) -> DataFrame:
    """distribution with benchmark_combo, tail_shrink_ratio and distribution_status: how far a combination's thresholds moved together against its benchmark's.

    delta_poc is held against the better test result of delta_only and poc_only, delta_poc_position against delta_poc. A shrink above `most` is tail_compressed,
    and distribution_deformed where the net return did not gain.
    """
    test = summary.where("split = 'test'").select("combo_name", F.col("avg_net_return").alias("net"), F.col("win_rate").alias("rate"))
    tails = distribution.where("split = 'train'").select("combo_name", F.col("tail_separation").alias("tail"))
    facts = tails.join(test, "combo_name", "left")
    single = facts.where(F.col("combo_name").isin("delta_only", "poc_only") & F.col("net").isNotNull())
    single = single.groupBy().agg(F.max_by("combo_name", F.struct("net", "rate")).alias("benchmark_combo"), F.count(F.lit(1)).alias("n")).where("n = 2")
    chosen = single.select(F.lit("delta_poc").alias("combo_name"), "benchmark_combo").union(single.select(F.lit("delta_poc_position"), F.lit("delta_poc")))
    base = facts.select(F.col("combo_name").alias("benchmark_combo"), F.col("tail").alias("base_tail"), F.col("net").alias("base_net"))
    pair = chosen.join(facts, "combo_name").join(base, "benchmark_combo").where("tail is not null and base_tail <> 0")
    shrink = 1 - F.col("tail") / F.col("base_tail")
    status = F.when((shrink > most) & (F.col("net") <= F.col("base_net")), "distribution_deformed").when(shrink > most, "tail_compressed").otherwise("ok")
    pair = pair.select("combo_name", "benchmark_combo", shrink.alias("tail_shrink_ratio"), status.alias("distribution_status"))
    return distribution.join(F.broadcast(pair), "combo_name", "left").withColumn("distribution_status", F.coalesce("distribution_status", F.lit("ok")))


def dimension_gains(summary: DataFrame, monthly_test: DataFrame, correlation: DataFrame, distribution: DataFrame, bar: float = 0.01) -> DataFrame:
    """The test rows of summary (metrics with sample_status by combo_name) with the gains over distribution's benchmark_combo, the worst correlation
    status within the combination, the share of good months, and an effectiveness label."""
    own = correlation.groupBy("combo_name").agg(
        F.max("abs_spearman_corr").alias("max_selected_abs_corr"), F.bool_or(F.col("correlation_status") == "collinearity_blocked").alias("_blocked"), F.bool_or(F.col("correlation_status") == "collinearity_warning").alias("_warned"),
    )
    shape = distribution.where("split = 'test'").select("combo_name", "benchmark_combo", "tail_shrink_ratio", "distribution_status")
    test = summary.where("split = 'test'")
    base = test.select(F.col("combo_name").alias("benchmark_combo"), F.col("win_rate").alias("_rate"), F.col("avg_net_return").alias("_net"))
    t = test.join(shape, "combo_name", "left").join(base, "benchmark_combo", "left").join(own, "combo_name", "left").join(positive_months(monthly_test, ["combo_name"]), "combo_name", "left")
    t = t.withColumns({"win_rate_gain": F.col("win_rate") - F.col("_rate"), "avg_net_gain": F.col("avg_net_return") - F.col("_net")})
    t = t.withColumn("collinearity_status", F.when(F.col("_blocked"), "collinearity_blocked").when(F.col("_warned"), "collinearity_warning").otherwise("ok"))
    gain, net = F.col("win_rate_gain"), F.col("avg_net_gain")
    cost = (F.col("avg_gross_return") > 0) & (F.col("avg_net_return") <= 0)
    best = F.when((F.col("win_rate") > 0.5) & (F.col("avg_net_return") > 0), "absolute_effective").otherwise("ineffective")
    against = F.when((gain >= bar) & (net > 0), "incremental_effective").when((gain > 0) & (net <= 0), "win_rate_only").when(cost, "cost_failed").when((gain <= 0) & (net <= 0), "ineffective").otherwise(best)
    label = F.when(gain.isNotNull(), against).when(cost, "cost_failed").otherwise(best)
    steady = F.coalesce(F.col("positive_month_share"), F.lit(0.0)) >= 0.5
    final = (
        F.when(F.col("sample_status") == "insufficient_samples", "insufficient_samples").when(F.col("_blocked"), "collinearity_blocked").when(F.col("distribution_status") == "distribution_deformed", "distribution_deformed")
        .when(label.isin("absolute_effective", "incremental_effective") & ~steady, "unstable").otherwise(label)
    )
    return t.withColumn("effectiveness", final).drop("_rate", "_net", "_blocked", "_warned")


def case_effectiveness(test: DataFrame) -> DataFrame:
    """Test metrics with sample_status, with an effectiveness label of their own."""
    status = F.col("sample_status")
    label = F.when(status != "enough_samples", status).when((F.col("win_rate") > 0.5) & (F.col("avg_net_return") > 0) & (F.col("sum_net_return") > 0), "absolute_effective").when((F.col("avg_gross_return") > 0) & (F.col("avg_net_return") <= 0), "cost_failed")
    return test.withColumn("effectiveness", label.otherwise("ineffective"))


def selected_correlations(selected: DataFrame, corr: DataFrame, cap: float = 0.85, warn: float = 0.70) -> DataFrame:
    """Pairs of features within a combination by selection order, with their Spearman correlation and its status."""
    side = lambda s: selected.select("combo_name", F.col("selection_order").alias(f"order_{s}"), F.col("feature").alias(f"feature_{s}"), F.col("dimension").alias(f"dimension_{s}"))
    pairs = side("a").join(side("b"), "combo_name").where("order_a < order_b")
    both = corr.select("feature_a", "feature_b", "spearman_corr").union(corr.select("feature_b", "feature_a", "spearman_corr"))
    size = F.abs("spearman_corr")
    status = F.when(size.isNull(), "unknown").when(size > cap, "collinearity_blocked").when(size >= warn, "collinearity_warning").otherwise("ok")
    out = pairs.join(both, ["feature_a", "feature_b"], "left")
    return out.select("combo_name", "feature_a", "dimension_a", "feature_b", "dimension_b", "spearman_corr", size.alias("abs_spearman_corr"), (F.col("dimension_a") != F.col("dimension_b")).alias("is_cross_dimension"), status.alias("correlation_status"))


def interaction_patterns(df: DataFrame, delta: str, poc: str, position: str, target: str = "future_return_5") -> DataFrame:
    """By the agreement of three scores' signs: rows, mean and median of the target, and the share above 0."""
    d, p, x = (F.signum(F.col(c)) for c in (delta, poc, position))
    pattern = F.when((d == p) & (p == x), "all_same_direction").when(d == p, "delta_poc_same").otherwise("delta_poc_conflict")
    known = df.dropna(subset=[delta, poc, position, target])
    known = known.select(pattern.alias("pattern"), target)
    found = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("rows"), F.avg(target).alias("mean_return"), F.avg((F.col(target) > 0).cast("double")).alias("positive_rate"))
    return with_quantiles(found, known, ["pattern"], target, {"median_return": 0.5})


def exit_reasons(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and exit reason, and per keys with a null reason: count, share of the keys' trades, mean net return."""
    g = trades.groupingSets([[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col("exit_reason")]], *[F.col(k) for k in keys], F.col("exit_reason"))
    out = g.agg(F.count(F.lit(1)).alias("count"), F.avg("net_return").alias("avg_net_return"))
    total = F.max("count").over(Window.partitionBy(*keys))
    return out.select(*keys, "exit_reason", "count", F.try_divide("count", total).alias("rate"), "avg_net_return")


def exit_rates(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: trades, the share of each exit, and the mean number of bars held."""
    share = lambda reason: F.avg((F.col("exit_reason") == reason).cast("double")).alias(f"{reason}_rate")
    return trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), share("take_profit"), share("stop_loss"), share("time_barrier"), F.avg("holding_bars").alias("mean_holding_bars"))


def two_proportions(wins_a: Column, n_a: Column, wins_b: Column, n_b: Column) -> tuple[Column, Column]:
    """(z, two-sided p) of the difference of two shares with a pooled error."""
    pooled, each = F.try_divide(wins_a + wins_b, n_a + n_b), F.try_divide(F.lit(1), n_a) + F.try_divide(F.lit(1), n_b)
    z = F.try_divide(F.try_divide(wins_a, n_a) - F.try_divide(wins_b, n_b), F.sqrt(F.greatest(pooled * (1 - pooled) * each, F.when(each.isNotNull(), 0.0))))
    return z, two_sided_p(z)


def win_rate_test(metrics: DataFrame, trials: int, level: float = 0.05, half: float = 0.5) -> DataFrame:
    """metrics with z and p of the win rate against one half, p times the number of trials, and a verdict for the test part only."""
    z = F.try_divide(F.col("win_rate") - half, F.sqrt(F.try_divide(F.lit(half * (1 - half)), F.col("trade_count"))))
    m = metrics.withColumn("win_rate_z", z).withColumn("win_rate_p", two_sided_p(F.col("win_rate_z")))
    m = m.withColumn("win_rate_p_bonferroni", F.when(F.col("win_rate_p").isNotNull(), F.least(F.lit(1.0), F.col("win_rate_p") * trials)))
    verdict = F.when((F.col("split") != "test") | F.col("win_rate_p").isNull(), "not_tested").when(F.col("win_rate_p_bonferroni") >= level, "not_significant").when(F.col("win_rate_z") > 0, "passes_bonferroni").otherwise("significant_below_50")
    return m.withColumn("win_rate_verdict", verdict)


def block_size(n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(5), F.round(F.sqrt(n)))).cast("long")


def _numbered(trades: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., _i, _sum): the running sums of net returns by exit time, numbered, with a row 0."""
    t = running(trades, keys, F.date_trunc("day", "exit_time"), BY_EXIT, "net_return", "_sum", number="_i").select(*keys, "_i", "_sum")
    return t.unionByName(trades.select(*keys).distinct().select(*keys, F.lit(0).alias("_i"), F.lit(0.0).alias("_sum")))


def block_means(trades: DataFrame, groups: DataFrame, keys: list[str], part: Column, samples: int, seed: int) -> DataFrame:
    """(keys..., _sample, _mean) of moving-block samples of each of groups (keys, n trades, size of a block).

    A sample is as long as its group; its blocks of `size` trades by exit time begin at places drawn by a hash of (seed, part, sample, block), and the last is cut. A block's sum is
    the difference of two running sums, so a sample meets two rows for each block, whatever its length.
    """
    blocks = F.ceil(F.col("n") / F.col("size"))
    g = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_sample")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_block"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), part, F.col("_sample").cast("string"), F.col("_block").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("decimal(20,0)")
    start = F.call_function("div", drawn * (F.col("n") - F.col("size") + 1).cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
    length = F.least(F.col("size"), F.col("n") - F.col("_block") * F.col("size"))
    ends = g.withColumn("_start", start).select(*keys, "n", "_sample", F.explode(F.array(F.struct(F.col("_start").alias("i"), F.lit(-1.0).alias("sign")), F.struct((F.col("_start") + length).alias("i"), F.lit(1.0).alias("sign")))).alias("_end"))
    ends = ends.select(*keys, "n", "_sample", F.col("_end.i").alias("_i"), F.col("_end.sign").alias("_sign"))
    met = attached(ends, _numbered(trades, keys), [*keys, "_i"], "inner")
    return met.groupBy(*keys, "n", "_sample").agg((F.sum(F.col("_sign") * F.col("_sum")) / F.col("n")).alias("_mean")).drop("n")


INTERVAL = {"low": 0.025, "high": 0.975}


def block_bootstrap(trades: DataFrame, keys: list[str], samples: int = 500, seed: int = 20260528) -> DataFrame:
    """Per keys: trades, their mean net return, and its 95 % interval from moving blocks by exit time, some root of n trades long."""
    groups = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("net_return").alias("mean"))
    means = block_means(trades, groups.select(*keys, "n", block_size(F.col("n")).alias("size")), keys, F.lit("one"), samples, seed)
    return with_quantiles(groups.withColumnRenamed("n", "trades"), means, keys, "_mean", INTERVAL)


def bootstrap_differences(trades: DataFrame, combos: list[str], samples: int = 500, seed: int = 20260528) -> DataFrame:
    """(combo_name, benchmark_combo, low, high): a 95 % interval of the difference of mean net returns between each combination and the one before it in
    combos, from moving blocks of both by exit time, as long as the root of the smaller one's trades. Pairs without trades on both sides have no interval."""
    pairs = F.array(*[F.struct(F.lit(b).alias("combo"), F.lit(a).alias("benchmark")) for a, b in zip(combos, combos[1:], strict=False)])
    n = trades.groupBy("combo_name").agg(F.count(F.lit(1)).alias("n"))
    one = n.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("combo_name", "n"))).alias("_n"))  # a row, an entry a combination
    both = one.select(F.explode(pairs).alias("p"), "_n").select("p.*", *[F.element_at("_n", F.col(f"p.{c}")).alias(f"n_{c}") for c in ("combo", "benchmark")])
    both = both.where("n_combo is not null or n_benchmark is not null")
    size = F.greatest(F.lit(5), F.round(F.sqrt(F.least("n_combo", "n_benchmark"))))
    sides = []
    for s, sign in (("combo", 1), ("benchmark", -1)):
        groups = both.where("n_combo is not null and n_benchmark is not null").select("combo", "benchmark", F.col(s).alias("combo_name"), F.col(f"n_{s}").alias("n"), F.least(size, F.col(f"n_{s}")).cast("long").alias("size"))
        mine = block_means(attached(groups.select("combo", "benchmark", "combo_name"), trades.select("combo_name", *BY_EXIT, "net_return"), ["combo_name"], "inner"), groups, ["combo", "benchmark", "combo_name"], F.lit(s), samples, seed)
        sides.append(mine.select("combo", "benchmark", "_sample", (sign * F.col("_mean")).alias("_mean")))
    differences = sides[0].unionByName(sides[1]).groupBy("combo", "benchmark", "_sample").agg(F.sum("_mean").alias("_mean"))
    return with_quantiles(both.select("combo", "benchmark"), differences, ["combo", "benchmark"], "_mean", INTERVAL).withColumnsRenamed({"combo": "combo_name", "benchmark": "benchmark_combo"})


def gain_diagnostics(summary: DataFrame, monthly_test: DataFrame, combos: list[str]) -> DataFrame:
    """The test rows of summary (metrics with sample_status by combo_name) held against the combination before: gains, z and p of the win rates, the share
    of good months, and an effectiveness label."""
    order = F.array_position(F.array(*map(F.lit, combos)), F.col("combo_name"))
    w = Window.orderBy("_order")  # a row per combination
    figures = ["combo_name", "trade_count", "win_rate", "avg_net_return", "sum_net_return"]
    t = summary.where("split = 'test'").withColumn("_order", order).join(positive_months(monthly_test, ["combo_name"]), "combo_name", "left")
    t = t.withColumns({f"_was_{c}": F.lag(c).over(w) for c in figures})
    wins = lambda p: F.round(F.col(f"{p}win_rate") * F.col(f"{p}trade_count"))
    z, p = two_proportions(wins(""), F.col("trade_count"), wins("_was_"), F.col("_was_trade_count"))
    t = t.withColumns({"benchmark_combo": F.col("_was_combo_name"), "win_rate_gain": F.col("win_rate") - F.col("_was_win_rate"), "avg_net_gain": F.col("avg_net_return") - F.col("_was_avg_net_return"), "sum_net_gain": F.col("sum_net_return") - F.col("_was_sum_net_return"), "win_rate_diff_z": z})
    t = t.withColumn("win_rate_diff_p", p)
    gross_only = (F.col("avg_gross_return") > 0) & (F.col("avg_net_return") <= 0)
    gain, net, total = F.col("win_rate_gain"), F.col("avg_net_gain"), F.col("sum_net_gain")
    against = F.when((gain >= 0.01) & (net > 0) & (total >= 0), "incremental_effective").when((gain > 0) & (net > 0) & (total < 0), "quality_improved_not_scalable").when((gain > 0) & (net <= 0), "win_rate_only").when(gross_only, "cost_failed").otherwise("ineffective")
    alone = F.when((F.col("win_rate") > 0.5) & (F.col("avg_net_return") > 0) & (F.col("sum_net_return") > 0), "absolute_effective").when(gross_only, "cost_failed").otherwise("ineffective")
    label = F.when(F.col("benchmark_combo").isNotNull(), against).otherwise(alone)
    stable = F.when(label.isin("absolute_effective", "incremental_effective") & (F.col("positive_month_share") < 0.5), "unstable").otherwise(label)
    status = F.col("sample_status")
    t = t.withColumn("effectiveness", F.when(status.isin("insufficient_samples", "low_confidence"), status).otherwise(stable))
    return t.drop("_order", *[f"_was_{c}" for c in figures])


def plateau_scores(cases: DataFrame, axes: tuple[str, ...] = ("time_i", "stop_i", "take_i"), same: tuple[str, ...] = ("kline_mode", "space_filter_on")) -> DataFrame:
    """cases with a score of their neighbourhood: cases equal in `same` and at most one step away on each axis, themselves included.

    mean * share of positive * log(1 + the case's own trades) / (deviation + |mean| / 10), over the neighbours' mean net returns.
    """
    near = cases.select(*same, *[F.col(a).alias(f"near_{a}") for a in axes], F.col("avg_net_return").alias("near_net"))
    close = F.lit(True)
    for a in axes:
        close = close & (F.abs(F.col(a) - F.col(f"near_{a}")) <= 1)
    j = cases.join(near, [*same]).where(close)
    mean, std = F.avg("near_net"), F.coalesce(F.stddev_samp("near_net"), F.lit(0.0))
    positive = F.avg((F.col("near_net") > 0).cast("double"))
    score = mean * positive * F.log1p(F.greatest(F.col("trade_count"), F.lit(1))) / (std + 0.1 * F.abs(mean) + 1e-12)
    return j.groupBy(*cases.columns).agg(F.count(F.lit(1)).alias("neighbours"), mean.alias("neighbour_mean"), std.alias("neighbour_std"), positive.alias("neighbour_positive"), score.alias("plateau_score"))


def against_baseline(cases: DataFrame, column: str, baseline, same: list[str], value: str = "avg_net_return") -> DataFrame:
    """cases with their difference to the case that has the baseline in `column` and is equal in `same`."""
    base = F.max(F.when(F.col(column) == baseline, F.col(value))).over(Window.partitionBy(*same))
    return cases.withColumn(f"{value}_vs_baseline", F.col(value) - base)


def marginal(cases: DataFrame, keys: list[str]) -> DataFrame:
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.sum("trade_count").alias("trade_count"), F.avg("avg_net_return").alias("mean_net_return"), F.avg("win_rate").alias("mean_win_rate"), F.avg((F.col("avg_net_return") > 0).cast("double")).alias("positive_share"))


def funnel(df: DataFrame, combos: dict[str, list[str]]) -> DataFrame:
    """Per nested combination and split: rows, rows ready, rows passed, those the combination before passed, and the rates."""
    ready = F.col("trade_ready")
    names = list(combos)
    rows = with_all(df.where("split is not null"))
    sums = rows.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(ready).alias("ready_count"), *[F.count_if(ready & F.col(f"{n}_pass")).alias(n) for n in names])
    long = sums.unpivot(["split", "row_count", "ready_count"], names, "combo_name", "passed_count")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("combo_name"))
    long = long.withColumn("combo_order", place.cast("int"))
    before = F.coalesce(F.lag("passed_count").over(Window.partitionBy("split").orderBy("combo_order")), F.col("ready_count"))
    return long.select("combo_order", "combo_name", "split", "row_count", "ready_count", "passed_count", before.alias("previous_count"), F.try_divide(F.col("passed_count"), before).alias("pass_rate"), F.try_divide("passed_count", "ready_count").alias("ready_rate"))
