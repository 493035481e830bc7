"""The order-flow queries: every operator over the supplied tables. Doubles are rounded and times are text, so that results compare exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import audit, bars, evaluate, features, fit, indicators, metrics, simulate, sweep, tick_bars
from tidebar.plans import programs
from tidebar.plans.tables import shared_table
from tidebar.sources import events, ticks

EVALUATED = features.FEATURES
#: Groups of the score and their features.
SCORED = {"price_structure": ["close_location_value", "body_ratio"], "orderflow_delta": ["delta_strength", "cvd_change_10"], "auction_poc": ["poc_distance_ticks"]}
COST = 2.0
SESSIONS = ((9, 11), (13, 14), (21, 25))  # hours of a day, ends inclusive; the last runs into the next day

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded (a billionth is added first, so that halves that a last bit may miss go up), times as text, whole numbers as long."""
    out = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind == "double":
            c = F.round(c + 1e-9, places)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return shared_table(spark, sf, "bars", lambda: events.event_bars(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with features and labels, in one pass over the same windows. Features are rounded to 11 places, so that ties and distinct values do not hang on
    the last bits, in which engines differ."""
    d = lambda: features.labels(features.extended(_bars(spark, sf)), cost_ticks=COST)
    return shared_table(spark, sf, "pack", lambda: d().withColumns({f: F.round(F.col(f).cast("double"), 11) for f in features.FEATURES}))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select(*features.BASE, *features.FEATURES)


def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    ticks = events.event_ticks(spark, sf).withColumn("datetime", F.date_trunc("hour", "ts"))
    return bars.ladder_of(ticks, ("ts", "event_id"))


def _split(spark: SparkSession, sf: str) -> dict:
    return fit.constants(shared_table(spark, sf, "split", lambda: fit.time_split(_bars(spark, sf))))


def _train(df: DataFrame, split: dict) -> DataFrame:
    return df.where(F.col("datetime") <= split["train_end"])


@query
def bars_hourly(spark, sf):
    return shown(events.event_bars(spark, sf))


def _quotes(spark, sf):
    """The raw feed, as its files hold it."""
    return shared_table(spark, sf, "quotes", lambda: events.event_quotes(spark, sf))


def _session_ticks(spark, sf):
    """Raw ticks filled forward, checked, and placed in their sessions."""
    return ticks.in_session(ticks.filled_forward(_quotes(spark, sf)))


@query
def ticks_in_session(spark, sf):
    t = _session_ticks(spark, sf)
    begin = F.timestamp_millis("session_begin_ms")
    return shown(t.select("contract", (F.col("seq") % (1 << 33)).alias("event_id"), F.timestamp_millis("wall_ms").alias("wall"), begin.alias("session_begin"), F.col("trading_day").cast("string").alias("trading_day"), "last_price", "lowest", "bid_price1", "volume"))


@query
def ticks_between_sessions(spark, sf):
    """Ticks outside sessions with the session that comes next."""
    t = ticks.session_neighbours(_quotes(spark, sf)).where("not in_session")
    at = lambda c: F.timestamp_millis(F.col(f"{c}_ms")).alias(c)
    return shown(t.select("contract", (F.col("seq") % (1 << 33)).alias("event_id"), at("next_begin"), at("last_end")))


@query
def ticks_classified(spark, sf):
    t = bars.classified_ticks(_session_ticks(spark, sf))
    return shown(t.select("contract", (F.col("seq") % (1 << 33)).alias("event_id"), "qty", "oi_change", "interest", "way", "tick_type", "side"))


@query
def bars_from_ticks(spark, sf):
    """Five-minute bars out of raw level-1 ticks."""
    return shown(tick_bars.bars_of_ticks(_quotes(spark, sf)))


@query
def bars_from_ticks_60(spark, sf):
    """Hourly bars, whose windows last beyond session begins at half hours."""
    return shown(tick_bars.bars_of_ticks(_quotes(spark, sf), 60))


@query
def bars_from_ticks_7(spark, sf):
    """Bars of seven minutes, which meet no session begin."""
    return shown(tick_bars.bars_of_ticks(_quotes(spark, sf), 7))


@query
def bars_from_lineitem(spark, sf):
    return shown(events.lineitem_bars(spark, sf).drop("open_interest"))


@query
def price_ladder(spark, sf):
    return shown(_ladder(spark, sf).select("contract", "datetime", "level", "buy", "sell", "other"))


@query
def poc_by_bar(spark, sf):
    return shown(_bars(spark, sf).select("contract", "datetime", "poc"))


@query
def imbalance_runs(spark, sf):
    return shown(bars.imbalance_runs(_ladder(spark, sf), ratio=1.0, run=2))


@query
def price_grid(spark, sf):
    """Every price level of a bar, traded or not."""
    return shown(bars.price_grid(_ladder(spark, sf)))


def _quoted(spark, sf):
    """Events as quotes: last, bid and ask around it, a cumulative volume per day, and open interest."""
    t = events.event_ticks(spark, sf)
    return t.select("contract", "ts", "event_id", F.to_date("ts").alias("day"), F.col("price").alias("last_price"), (F.col("level") - 1).alias("bid"), (F.col("level") + 1).alias("ask"), "qty", "oi")


@query
def tick_direction_class(spark, sf):
    t = bars.previous_tick(_quoted(spark, sf), ("ts", "event_id"), ["bid", "ask"], F.col("day")).where("prev_bid is not null")
    interest = bars.interest_class(F.col("qty"), F.col("oi"))
    way = bars.direction(F.col("last_price"), F.col("bid"), F.col("ask"), F.col("prev_bid"), F.col("prev_ask"))
    t = t.withColumns({"interest": interest, "way": way}).withColumn("tick_type", bars.tick_type(F.col("interest"), F.col("way")))
    return shown(t.withColumn("side", bars.side_of(F.col("tick_type"))).groupBy("contract", "interest", "way", "tick_type", "side").agg(F.count(F.lit(1)).alias("ticks"), F.sum("qty").alias("qty")))


@query
def session_semi_join(spark, sf):
    hours = spark.createDataFrame([(k, b, e) for k, (b, e) in enumerate(SESSIONS)], "session int, begin_h int, end_h int")
    t = events.event_ticks(spark, sf).select("contract", "ts", "qty")
    base = F.when(F.hour("ts") < 8, F.date_sub(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))
    t = t.withColumn("trading_day", base).withColumn("h", F.hour("ts") + F.when(F.hour("ts") < 8, 24).otherwise(0))
    j = t.join(F.broadcast(hours), F.col("h").between(F.col("begin_h"), F.col("end_h")))
    return shown(j.groupBy("contract", F.date_format("trading_day", "yyyy-MM-dd").alias("trading_day"), "session").agg(F.count(F.lit(1)).alias("ticks"), F.sum("qty").alias("qty")))


def _group(name: str, places: int = 6):
    def run(spark, sf):
        return shown(features.extended(_bars(spark, sf)).select("contract", "datetime", *features.GROUPS[name]), places)

    run.__name__ = f"features_{name}"
    return query(run)


for _name in features.GROUPS:
    _group(_name, 4 if _name == "open_interest" else 6)


@query
def stage1_features(spark, sf):
    return shown(features.stage1(_bars(spark, sf)).select("contract", "datetime", *features.STAGE1))


@query
def labels_forward(spark, sf):
    return shown(features.labels(_bars(spark, sf)).select("contract", "datetime", *features.LABELS))


def _pullback(spark, sf):
    return shared_table(spark, sf, "pullback", lambda: features.pullback(_labelled(spark, sf)))


@query
def ema60(spark, sf):
    return shown(_pullback(spark, sf).select("contract", "datetime", "ema60", "ema60_slope_12_ticks"))


@query
def trendline60(spark, sf):
    return shown(_pullback(spark, sf).select("contract", "datetime", "trendline_60", "trendline_slope_60_ticks"))


PULLBACK_SHOWN = [
    "distance_to_ema60_ticks", "low_distance_to_ema60_ticks", "distance_to_trendline_ticks", "low_distance_to_trendline_ticks", "adaptive_pullback_tolerance_ticks", "trend_filter_pass", "ema60_hold_flag", "trendline_hold_flag",
    "pullback_structure_pass", "bullish_bar_flag", "strong_bullish_close_flag", "body_quality_flag", "bullish_engulfing_flag", "morning_star_proxy", "weak_to_strong_3bar_flag", "kline_turn_pass", "delta_confirm_long",
    "volume_normal_or_better_flag", "volume_expand_flag", "flow_confirm_pass", "atr20_ticks", "previous_swing_high_20", "stop_price_signal", "stop_distance_ticks_signal", "reward_ticks_signal", "reward_to_risk_proxy",
    "space_filter_pass", *[f"{c}_pass" for c in features.COMBOS], "trade_ready",
]
SHORT_SHOWN = [
    "short_distance_to_ema60_ticks", "short_high_distance_to_ema60_ticks", "short_distance_to_trendline_ticks", "short_high_distance_to_trendline_ticks", "short_trend_filter_pass", "short_ema60_reject_flag", "short_trendline_reject_flag",
    "short_pullback_structure_pass", "bearish_bar_flag", "strong_bearish_close_flag", "bearish_engulfing_flag", "evening_star_proxy", "strong_to_weak_3bar_flag", "short_kline_turn_pass", "short_delta_confirm", "short_flow_confirm_pass",
    "previous_swing_low_20", "short_stop_price_signal", "short_stop_distance_ticks_signal", "short_reward_ticks_signal", "short_reward_to_risk_proxy", "short_space_filter_pass",
]


@query
def pullback_features(spark, sf):
    return shown(features.pullback(_labelled(spark, sf)).select("contract", "datetime", *PULLBACK_SHOWN))


@query
def short_mirror_features(spark, sf):
    return shown(features.pullback(_labelled(spark, sf)).select("contract", "datetime", *SHORT_SHOWN))


@query
def feature_quality(spark, sf):
    return shown(evaluate.quality(_features(spark, sf), EVALUATED))


@query
def feature_quintiles(spark, sf):
    return shown(evaluate.quintiles(_labelled(spark, sf), EVALUATED))


@query
def periodic_ic(spark, sf):
    return shown(evaluate.periodic_ic(_labelled(spark, sf), EVALUATED, "yyyy-MM-dd"))


@query
def feature_summary(spark, sf):
    """In the training part, the test part and both."""
    d = metrics.with_all(fit.with_split(_labelled(spark, sf), _split(spark, sf)).where("split is not null"))
    return shown(evaluate.summary(d, EVALUATED, keys=["split"]))


@query
def correlation_pairs(spark, sf):
    return shown(evaluate.correlations(_features(spark, sf), EVALUATED))


@query
def time_split(spark, sf):
    return shown(fit.time_split(_bars(spark, sf)))


def _params(spark, sf):
    """Of all features, fitted on the training part."""
    train = lambda: evaluate.long_form(_train(_features(spark, sf), _split(spark, sf)), EVALUATED, ["contract"])
    return shared_table(spark, sf, "params", lambda: fit.transform_params(train()))


@query
def winsor_params(spark, sf):
    return shown(fit.transform_params(evaluate.long_form(_train(_features(spark, sf), _split(spark, sf)), EVALUATED, ["contract"])))


SCORE_NAMES = [f for fs in SCORED.values() for f in fs]


@query
def zscore_apply(spark, sf):
    long = evaluate.long_form(_features(spark, sf), SCORE_NAMES, ["contract", "datetime"])
    return shown(fit.standardised(long, _params(spark, sf)).select("contract", "datetime", "feature", "clipped", "z"))


def _with_scores(spark, sf):
    """Labelled bars with signal_score and a score per group, whose signs and weights are the training coefficients (a table of five rows)."""
    d, split = _labelled(spark, sf), _split(spark, sf)
    ic = {r["feature"]: r["spearman_ic"] or 0.0 for r in evaluate.information_coefficients(_train(d, split), SCORE_NAMES).collect()}
    groups = {}
    for g, fs in SCORED.items():
        total = sum(abs(ic[f]) for f in fs) or 1.0
        groups[g] = [(f"z_{f}", (ic[f] > 0) - (ic[f] < 0), abs(ic[f]) / total) for f in fs]
    z = fit.with_z(d, _params(spark, sf).where(F.col("feature").isin(SCORE_NAMES)), SCORE_NAMES)
    return z.select(*d.columns, fit.weighted_score(groups).alias("signal_score"), *[fit.weighted_score({g: x}).alias(f"score_{g}") for g, x in groups.items()])


def _scored(spark, sf):
    keep = ["contract", "datetime", "open", "high", "low", "close", "volume", "true_range_ticks", "poc_shift_ticks", "entry_open_next", "exit_close_after_5", "future_return_5"]
    return shared_table(spark, sf, "scored", lambda: _with_scores(spark, sf).select(*keep, "signal_score", *[f"score_{g}" for g in SCORED]))


@query
def signal_score(spark, sf):
    return shown(_with_scores(spark, sf).select("contract", "datetime", "signal_score"))


def _limits(spark, sf):
    return shared_table(spark, sf, "limits", lambda: fit.risk_limits(_train(_scored(spark, sf), _split(spark, sf))))


def _risked(spark, sf):
    return fit.risk_pass(fit.constants(_limits(spark, sf)), _scored(spark, sf))


def _cuts(spark, sf):
    return fit.thresholds(_train(_risked(spark, sf), _split(spark, sf)).where("risk_pass"))


@query
def risk_filter(spark, sf):
    return shown(fit.with_split(_risked(spark, sf), _split(spark, sf)).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.count_if("risk_pass").alias("passed")))


@query
def score_thresholds(spark, sf):
    return shown(fit.attach(_cuts(spark, sf), fit.constants(_limits(spark, sf))))


def _new_trades(spark, sf):
    return simulate.fixed_hold_trades(_risked(spark, sf), fit.constants(_cuts(spark, sf)), _split(spark, sf), cost=COST)


def _trades(spark, sf):
    return shared_table(spark, sf, "trades", lambda: _new_trades(spark, sf))


@query
def trades_fixed_hold(spark, sf):
    return shown(_new_trades(spark, sf))


@query
def trades_stage1(spark, sf):
    """Stage-1 rules: 80/20 thresholds over all training scores, entry / exit - 1 for shorts, no skipped crossings."""
    scored, split = _scored(spark, sf), _split(spark, sf)
    ready = scored.withColumn("risk_pass", F.col("signal_score").isNotNull())
    cuts = fit.constants(fit.thresholds(_train(scored, split), high=0.8, low=0.2))
    return shown(simulate.fixed_hold_trades(ready, cuts, split, cost=COST, mirror=True, cross=True))


@query
def signal_distribution(spark, sf):
    cuts = fit.constants(_cuts(spark, sf))
    d = metrics.with_all(fit.with_split(fit.attach(_risked(spark, sf), cuts), _split(spark, sf)).where("split is not null"))
    return shown(metrics.signal_distribution(d, ["split"], ["long_threshold", "short_threshold"]))


@query
def interaction_patterns(spark, sf):
    test = _scored(spark, sf).where(F.col("datetime") >= _split(spark, sf)["test_start"])
    return shown(metrics.interaction_patterns(test, "score_orderflow_delta", "score_auction_poc", "score_price_structure"))


#: A choice of features, to hold their correlations against the caps.
CHOSEN = [(c, k + 1, f, g) for c, gs in {"one": list(SCORED), "two": list(SCORED)[:2]}.items() for k, (g, f) in enumerate((g, f) for g in gs for f in SCORED[g])]


@query
def selected_correlations(spark, sf):
    selected = spark.createDataFrame(CHOSEN, "combo_name string, selection_order int, feature string, dimension string")
    corr = evaluate.correlations(_train(_features(spark, sf), _split(spark, sf)), SCORE_NAMES)
    return shown(metrics.selected_correlations(selected, corr, cap=0.5, warn=0.05))


@query
def strategy_metrics(spark, sf):
    return shown(metrics.strategy_metrics(metrics.with_all(_trades(spark, sf)), ["split"]))


@query
def equity_curve(spark, sf):
    return shown(metrics.equity_curve(_trades(spark, sf), ["split"]))


@query
def overlap_check(spark, sf):
    return shown(metrics.overlaps(_trades(spark, sf)))


@query
def cost_sensitivity(spark, sf):
    return shown(metrics.cost_sensitivity(_trades(spark, sf)).select("cost_ticks", "split", "trade_count", "win_rate", "avg_net_return", "sum_net_return", "max_drawdown"))


@query
def periodic_trades(spark, sf):
    return shown(metrics.monthly(_trades(spark, sf), ["split"], "yyyy-MM-dd"))


@query
def sample_confidence(spark, sf):
    m = metrics.strategy_metrics(metrics.with_all(_trades(spark, sf)), ["split"]).select("split", "trade_count", "win_rate")
    return shown(metrics.sample_confidence(m))


@query
def win_rate_tests(spark, sf):
    m = metrics.strategy_metrics(metrics.with_all(_trades(spark, sf)), ["split"]).select("split", "trade_count", "win_rate")
    return shown(metrics.win_rate_test(m, trials=768).select("split", "trade_count", "win_rate", "win_rate_z", "win_rate_p", "win_rate_p_bonferroni", "win_rate_verdict"))


@query
def two_proportion_test(spark, sf):
    t, sides = _trades(spark, sf), ("long", "short")
    counts = [F.count_if((F.col("side") == s) & on).alias(f"{k}_{s}") for s in sides for k, on in (("wins", F.col("net_return") > 0), ("n", F.lit(True)))]
    z, p = metrics.two_proportions(F.col("wins_long"), F.col("n_long"), F.col("wins_short"), F.col("n_short"))
    return shown(t.agg(*counts).select("*", z.alias("z"), p.alias("p"), (p < 0.05).alias("significant")))


@query
def bootstrap_interval(spark, sf):
    return shown(metrics.block_bootstrap(_trades(spark, sf), ["split"]))


@query
def filter_funnel(spark, sf):
    return shown(metrics.funnel(fit.with_split(_pullback(spark, sf), _split(spark, sf)), features.COMBOS))


BARRIER_SIGNAL = "strong_bullish_close_flag"


def _barrier(spark, sf):
    ready = F.col(BARRIER_SIGNAL) & F.col("trade_ready")
    return simulate.barrier_trades(_pullback(spark, sf), ready, _split(spark, sf), "long", cost=COST)


@query
def trades_triple_barrier(spark, sf):
    return shown(_barrier(spark, sf))


@query
def trades_triple_barrier_short(spark, sf):
    ready = F.col("strong_bearish_close_flag") & F.col("trade_ready")
    return shown(simulate.barrier_trades(_pullback(spark, sf), ready, _split(spark, sf), "short", bars=12, stop_atr=0.5, take=1.5, cost=COST))


@query
def exit_reasons(spark, sf):
    return shown(metrics.exit_reasons(_barrier(spark, sf), ["split"]))


@query
def barrier_replay_audit(spark, sf):
    p, t, split = _pullback(spark, sf), shared_table(spark, sf, "barrier_trades", lambda: _barrier(spark, sf)), _split(spark, sf)
    return shown(audit.trade_checks(t, p, split, COST).unionByName(audit.path_replay(t, p)))


@query
def sweep_replay_audit(spark, sf):
    """Every trade of all 384 cases of both sides against its path."""
    p, split = _pullback(spark, sf), _split(spark, sf)
    found = None
    for side in ("long", "short"):
        t = _sweep(spark, sf, side)
        checks = audit.trade_checks(t, p, split, COST).unionByName(audit.path_replay(t, p, ("case_id",))).withColumn("side", F.lit(side))
        found = checks if found is None else found.unionByName(checks)
    return shown(found)


def _new_combo_trades(spark, sf):
    """The five nested filter combinations."""
    signals = {name: F.col(f"{name}_pass") & F.col("trade_ready") for name in features.COMBOS}
    return simulate.named_barrier_trades(_pullback(spark, sf), signals, _split(spark, sf), "long", cost=COST)


def _combo_trades(spark, sf):
    return shared_table(spark, sf, "combo_trades", lambda: _new_combo_trades(spark, sf))


@query
def trades_by_combination(spark, sf):
    return shown(_new_combo_trades(spark, sf))


@query
def combination_gains(spark, sf):
    """Combinations in the test part against the one before. Samples here are small, so the bounds of confidence are low as well."""
    t = _combo_trades(spark, sf)
    m = metrics.strategy_metrics(t, ["combo_name", "split"]).select("combo_name", "split", "trade_count", "win_rate", "avg_gross_return", "avg_net_return", "sum_net_return")
    gains = metrics.gain_diagnostics(metrics.sample_confidence(m, 1, 2), metrics.monthly(t.where("split = 'test'"), ["combo_name"]), list(features.COMBOS))
    return shown(gains)


@query
def combination_bootstrap(spark, sf):
    return shown(metrics.bootstrap_differences(_combo_trades(spark, sf), list(features.COMBOS)))


@query
def positive_months(spark, sf):
    return shown(metrics.positive_months(metrics.monthly(_combo_trades(spark, sf), ["combo_name", "split"], "yyyy-MM-dd"), ["combo_name", "split"]))


RATIOS = (1.0, 1.5, 2.0)


@query
def reward_risk_sensitivity(spark, sf):
    """Confirmed flow with room to the last swing, re-simulated with other least ratios of reward to risk (of flow alone, as these bars leave no row of all filters)."""
    base = F.col("flow_confirm_pass") & F.col("trade_ready") & (F.col("previous_swing_high_20") > F.col("close")) & F.col("stop_distance_ticks_signal").between(2.0, 30.0)
    new = lambda: simulate.named_barrier_trades(_pullback(spark, sf), {str(r): base & (F.col("reward_to_risk_proxy") >= r) for r in RATIOS}, _split(spark, sf), "long", cost=COST)
    t = shared_table(spark, sf, "ratio_trades", new)  # metrics read it several times
    m = metrics.strategy_metrics(metrics.with_all(t), ["combo_name", "split"])
    return shown(m.select(F.col("combo_name").cast("double").alias("reward_to_risk_threshold"), "split", "trade_count", "win_rate", "avg_net_return", "sum_net_return", "max_drawdown"))


def _new_sweep(spark, sf, side):
    return sweep.sweep_trades(_pullback(spark, sf), _split(spark, sf), side, sweep.grid(), cost=COST)


def _sweep(spark, sf, side):
    return shared_table(spark, sf, f"sweep_{side}", lambda: _new_sweep(spark, sf, side))


def _grid(spark):
    return spark.createDataFrame(sweep.grid())


CASE = ["case_id", "time_i", "stop_i", "take_i", "time_barrier_bars", "stop_atr_multiple", "take_profit_multiple", "kline_mode", "space_filter_on"]


def _cases(spark, sf, side="long", split="train"):
    return sweep.case_summary(_sweep(spark, sf, side), _grid(spark), split).select(*CASE, "trade_count", "win_rate", "avg_net_return", "sum_net_return")


@query
def sweep_long(spark, sf):
    """All 384 cases."""
    return shown(_new_sweep(spark, sf, "long"))


@query
def sweep_short(spark, sf):
    return shown(_new_sweep(spark, sf, "short"))


@query
def plateau_scores(spark, sf):
    return shown(metrics.plateau_scores(_cases(spark, sf)))


@query
def kline_ablation(spark, sf):
    same = ["time_barrier_bars", "stop_atr_multiple", "take_profit_multiple", "space_filter_on"]
    return shown(metrics.against_baseline(_cases(spark, sf), "kline_mode", "none", same).select("case_id", "kline_mode", "avg_net_return", "avg_net_return_vs_baseline"))


@query
def space_ablation(spark, sf):
    same = ["time_barrier_bars", "stop_atr_multiple", "take_profit_multiple", "kline_mode"]
    return shown(metrics.against_baseline(_cases(spark, sf, "short"), "space_filter_on", False, same).select("case_id", "space_filter_on", "avg_net_return", "avg_net_return_vs_baseline"))


@query
def marginal_means(spark, sf):
    c = _cases(spark, sf)
    a = metrics.marginal(c, ["time_barrier_bars"]).withColumn("stop_atr_multiple", F.lit(None).cast("double"))
    b = metrics.marginal(c, ["stop_atr_multiple"]).withColumn("time_barrier_bars", F.lit(None).cast("long"))
    return shown(a.unionByName(b))


def _rates(spark, sf, side="long"):
    """The exits of each case in the test part."""
    return metrics.exit_rates(_sweep(spark, sf, side).where("split = 'test'"), ["case_id"])


@query
def time_barrier_diagnostics(spark, sf):
    return shown(sweep.time_barrier_diagnostics(_cases(spark, sf, split="test"), _rates(spark, sf)))


@query
def stop_take_diagnostics(spark, sf):
    return shown(sweep.stop_take_diagnostics(_cases(spark, sf, split="test"), _rates(spark, sf)))


LEAST_TRADES = 3  # of a training case here; the operator's own bound is 300


def _verified(spark, sf, side):
    train = metrics.plateau_scores(_cases(spark, sf, side))
    return sweep.ranking(train, _cases(spark, sf, side, "test"), LEAST_TRADES)


@query
def sweep_ranking(spark, sf):
    return shown(_verified(spark, sf, "long").withColumn("side", F.lit("long")).unionByName(_verified(spark, sf, "short").withColumn("side", F.lit("short"))), 5)


def _both_tests(spark, sf):
    return _cases(spark, sf, "long", "test").withColumn("side", F.lit("long")).unionByName(_cases(spark, sf, "short", "test").withColumn("side", F.lit("short")))


@query
def long_short_comparison(spark, sf):
    return shown(sweep.comparison(_both_tests(spark, sf), trials=2 * len(sweep.grid())).select("side", *CASE, "trade_count", "win_rate", "avg_net_return", "sum_net_return", "win_rate_z", "win_rate_p", "win_rate_p_bonferroni", "win_rate_verdict"))


@query
def best_plateaus(spark, sf):
    """The ten best cases of each side."""
    return shown(sweep.best_plateaus(_verified(spark, sf, "long"), "long").unionByName(sweep.best_plateaus(_verified(spark, sf, "short"), "short")), 5)


@query
def exit_comparison(spark, sf):
    """How the best case of each side leaves its trades."""
    side = lambda s: sweep.exit_comparison(sweep.best_cases(_verified(spark, sf, s), _cases(spark, sf, s, "test"), _grid(spark)), _rates(spark, sf, s), s)
    return shown(side("long").unionByName(side("short")))


@query
def long_short_asymmetry(spark, sf):
    best = [sweep.best_cases(_verified(spark, sf, s), _cases(spark, sf, s, "test"), _grid(spark)) for s in ("long", "short")]
    return shown(sweep.asymmetry(*best, {"time_i": 4, "stop_i": 4, "take_i": 4}))


@query
def audit_integrity(spark, sf):
    return shown(audit.bar_integrity(_bars(spark, sf)))


@query
def stage1_replay_audit(spark, sf):
    """The first-stage strategy, run and made again from its tables."""
    return shown(programs.stage1(_bars(spark, sf))["replay"])


@query
def audit_columns(spark, sf):
    """Nulls, infinities, distinct and extreme values of each column of bars and features."""
    return shown(audit.column_report(_features(spark, sf).drop("trading_day")))


@query
def audit_label_alignment(spark, sf):
    y = features.labels(_bars(spark, sf))
    shifted = y.withColumn("future_return_5", F.col("future_return_5") + F.when(F.hour("datetime") == 7, 0.01).otherwise(0.0)).where(F.hour("datetime") != 3)
    return shown(audit.differences(y, shifted, ["contract", "datetime"], features.LABELS))


#: Rows that each label looks ahead.
HORIZONS = {"future_return_1": 1, "future_return_3": 3, "future_return_5": 5, "future_return_10": 10, "mfe_10_long": 10, "mae_10_long": 10, "entry_open_next": 1, "exit_close_after_5": 5, "trade_return_5_gross": 5, "trade_return_5_net": 5}


@query
def audit_tail_null(spark, sf):
    return shown(audit.tail_nulls(features.labels(_bars(spark, sf)), HORIZONS))


@query
def audit_head_null(spark, sf):
    return shown(audit.head_nulls(_pullback(spark, sf), {"ema60": 59, "atr20_ticks": 19, "trendline_60": 59, "volume_zscore_20": 19}))


@query
def audit_first_rows(spark, sf):
    return shown(audit.first_row_sentinel(_features(spark, sf)))


@query
def audit_features(spark, sf):
    """Infinite and constant features, pairs that are nearly one, groups of the ten best, and names that betray a look ahead."""
    f, top = _features(spark, sf), _train_summary(spark, sf).where("abs_spearman_ic is not null").orderBy(F.desc("abs_spearman_ic"), "feature").limit(10)
    groups = F.create_map(*[F.lit(x) for pair in features.GROUP_OF.items() for x in pair])
    found = audit.feature_checks(evaluate.quality(f, EVALUATED), evaluate.correlations(f, EVALUATED), top.select("feature", groups[F.col("feature")].alias("group")), 10)
    bad = len(audit.forbidden_columns(f))
    return shown(found.unionByName(spark.createDataFrame([("BLOCKER", "isolation", "forbidden_columns", "FAIL" if bad else "PASS", bad)], found.schema)))


@query
def audit_summary(spark, sf):
    found = audit.bar_integrity(_bars(spark, sf)).unionByName(audit.head_nulls(_pullback(spark, sf), {"ema60": 59, "atr20_ticks": 19}))
    return shown(audit.finding_summary(found))


@query
def golden_diff(spark, sf):
    b = _bars(spark, sf)
    other = b.withColumn("close", F.col("close") + F.when((F.hour("datetime") == 5) & (F.col("contract") == "C1"), 0.1).otherwise(0.0)).where("contract <> 'C3' or hour(datetime) > 0")
    return shown(audit.golden_diff(b, other, ["open", "high", "low", "close", "poc"], ["volume", "delta", "open_interest"], []))


@query
def bar_extremes(spark, sf):
    return shown(audit.extremes(_bars(spark, sf), ["volume", "delta"], q=0.99))


@query
def donchian(spark, sf):
    return shown(indicators.donchian(_bars(spark, sf)))


@query
def trend_correlation(spark, sf):
    return shown(indicators.trend_correlation(_bars(spark, sf)), 3)


@query
def ema_indicator(spark, sf):
    return shown(indicators.ema(_bars(spark, sf), 20), 4)


@query
def wilder_atr(spark, sf):
    return shown(indicators.atr(_bars(spark, sf), 14), 4)


@query
def keltner(spark, sf):
    return shown(indicators.keltner(_bars(spark, sf), 20), 4)


@query
def kama(spark, sf):
    return shown(indicators.kama_interval(_bars(spark, sf)))


@query
def kama_atr(spark, sf):
    return shown(indicators.kama_atr(_bars(spark, sf)))


@query
def union_ragged(spark, sf):
    b = _bars(spark, sf)
    wide = b.where("contract in ('C0', 'C2')").select("contract", "datetime", "close", "volume")
    return shown(wide.unionByName(b.where("contract in ('C1', 'C3')").select("contract", "datetime", "close", "delta"), allowMissingColumns=True))


@query
def distinct_keys(spark, sf):
    return shown(_bars(spark, sf).select("contract", F.hour("datetime").alias("hour")).distinct())


@query
def anti_test_only(spark, sf):
    """Delta and volume that a bar had in the test part only."""
    b = fit.with_split(_bars(spark, sf), _split(spark, sf)).select("split", "contract", "delta", "volume")
    train, test = (b.where(F.col("split") == part).drop("split").distinct() for part in ("train", "test"))
    return shown(test.join(train, ["contract", "delta", "volume"], "left_anti"))


def _train_summary(spark, sf):
    return shared_table(spark, sf, "train_summary", lambda: evaluate.summary(_train(_labelled(spark, sf), _split(spark, sf)), EVALUATED))


def _selected(spark, sf):
    """The greedy choice over the training summary: the 65 candidate rows and their correlations reach the driver."""
    table = [r.asDict() for r in _train_summary(spark, sf).select("feature", "coverage", "unique_count", "inf_count", "spearman_ic").collect()]
    corr = {(r["feature_a"], r["feature_b"]): r["spearman_corr"] for r in evaluate.correlations(_train(_features(spark, sf), _split(spark, sf)), EVALUATED).collect()}
    chosen = fit.select_features(table, corr, features.GROUP_OF)
    return spark.createDataFrame(chosen, "selection_order int, feature string, group string, abs_spearman_ic double, mrmr_score double")


@query
def feature_selection(spark, sf):
    return shown(_selected(spark, sf))


@query
def audit_isolation(spark, sf):
    """The checks that nothing was fitted on the test part, over tables that keep to it."""
    d, split = _labelled(spark, sf), _split(spark, sf)
    selected = _train_summary(spark, sf).where("abs_spearman_ic is not null").orderBy(F.desc("abs_spearman_ic"), "feature").limit(10).select("feature", "abs_spearman_ic")
    used = _cuts(spark, sf).withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"))))
    return shown(audit.isolation(selected, _train_summary(spark, sf), _params(spark, sf), fit.transform_params(evaluate.long_form(_train(d, split), EVALUATED, ["contract"])), used, _cuts(spark, sf)))


#: The tables that queries share, in an order in which each finds those that it reads.
TABLES: dict[str, Callable[[SparkSession, str], object]] = {
    "quotes": _quotes, "bars": _bars, "pack": _labelled, "split": _split, "pullback": _pullback, "params": _params, "scored": _scored, "limits": _limits, "trades": _trades,
    "combo_trades": _combo_trades, "sweep_long": lambda spark, sf: _sweep(spark, sf, "long"), "train_summary": _train_summary,
}
