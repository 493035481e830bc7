"""Whole research programs over bars: each gives its tables by name, and `save` writes them as Parquet.

Tables that a program reads more than once are written to the session's shared folder, so plans stay short and nothing is held in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import audit, evaluate, features, fit, metrics, simulate, sweep, tick_bars
from tidebar.sources import ticks
from tidebar.sources.shared import written

TARGET = "future_return_5"


@dataclass(frozen=True)
class Settings:
    tick: float = 1.0
    cost_ticks: float = 2.0
    holding_bars: int = 5
    train_ratio: float = 0.8
    high: float = 0.85
    low: float = 0.15
    max_features: int = 18
    reward_to_risk: float = 1.5

    @property
    def cost(self) -> float:
        return self.cost_ticks * self.tick


#: Dimensions of the gain curve, and the combinations that are compared.
DIMENSIONS = {"delta": features.GROUPS["orderflow_delta"], "poc": features.GROUPS["auction_poc"], "position": ["close_location_value", "upper_shadow_ratio", "lower_shadow_ratio", "wick_imbalance", "body_ratio"]}
GAIN_COMBOS = {"delta_only": ["delta"], "poc_only": ["poc"], "position_only": ["position"], "delta_poc": ["delta", "poc"], "delta_poc_position": ["delta", "poc", "position"]}


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table."""
    return written(df, f"program-{name}")


def _parts(df: DataFrame, split: fit.Fitted) -> tuple[DataFrame, DataFrame]:
    s = fit.with_split(df, split)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def _outcome(trades: DataFrame, cfg: Settings) -> dict[str, DataFrame]:
    return {
        "trades": trades, "metrics": metrics.strategy_metrics(metrics.with_all(trades), ["split"]), "equity": metrics.equity_curve(trades, ["split"]), "overlap": metrics.overlaps(trades),
        "cost_sensitivity": metrics.cost_sensitivity(trades, tick=cfg.tick), "monthly_trades": metrics.monthly(trades, ["split"]),
    }


def stage1(bars: DataFrame, cfg: Settings = Settings(high=0.8, low=0.2), top: int = 5) -> dict[str, DataFrame]:
    """17 features, coefficients, and a strategy on the mean of the signed z-scores of the `top` features by training coefficient."""
    data = features.labels(features.stage1(bars, cfg.tick), cfg.tick, cfg.cost_ticks, cfg.holding_bars)
    data, split = _kept(data, "stage1"), fit.constants(fit.time_split(bars, cfg.train_ratio))
    train, _ = _parts(data, split)
    ranked = evaluate.summary(train, features.STAGE1).where("coverage >= 0.5 and spearman_ic is not null").orderBy(F.desc("abs_spearman_ic"), "feature").limit(top)
    chosen = [(r["feature"], r["ic_direction"]) for r in ranked.collect()]
    moments = train.agg(*[f(n).alias(f"{k}_{n}") for n, _ in chosen for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")) * sign for n, sign in chosen]
    known = sum((x.isNotNull().cast("int") for x in z), F.lit(0))
    score = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0)), known)
    scored = fit.attach(data, fit.constants(moments)).withColumn("signal_score", score).drop(*moments.columns).withColumn("risk_pass", F.col("signal_score").isNotNull())
    scored = _kept(scored, "stage1-scored")
    cuts = fit.thresholds(_parts(scored, split)[0], high=cfg.high, low=cfg.low)
    trades = _kept(simulate.fixed_hold_trades(scored, fit.constants(cuts), split, cfg.holding_bars, cfg.cost, mirror=True, cross=True), "stage1-trades")
    summary = _kept(evaluate.summary(train, features.STAGE1), "stage1-summary")
    signals = scored.select("contract", F.col("datetime").alias("signal_time"), "signal_score")
    replay = audit.strategy_replay(data, trades.join(signals, ["contract", "signal_time"], "left"), ranked.select("feature"), summary, split, cfg.cost, cfg.holding_bars, top, cfg.high, cfg.low)
    return {
        "replay": replay, "features": data, "summary": summary, "quintiles": evaluate.quintiles(train, features.STAGE1), "monthly_ic": evaluate.periodic_ic(data, features.STAGE1),
        "selected": ranked, "thresholds": cuts, **_outcome(trades, cfg), "correlations": evaluate.correlations(train, features.STAGE1), "quality": evaluate.quality(data, features.STAGE1), "audit": audit.bar_integrity(bars),
    }


def clipped_features(bars: DataFrame, split: fit.Fitted, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """(features with continuous ones clipped to their training bounds, the parameters)."""
    raw = _kept(features.extended(bars, cfg.tick), "features")
    names = [f for f in features.FEATURES if features.feature_type(f) == "continuous"]
    train, _ = _parts(raw, split)
    params = _kept(fit.transform_params(evaluate.long_form(train, names, ["contract"])), "params")
    return fit.with_z(raw, params, names, clipped=True).select(*features.BASE, *features.FEATURES), params


def _scored(data: DataFrame, params: DataFrame, split: fit.Fitted, groups: dict[str, list[str]], ic: dict[str, float], cfg: Settings) -> tuple[DataFrame, dict]:
    """(bars with signal_score, a score_<group> each and risk_pass; the training thresholds). Scores are means over groups of signed, |IC|-weighted z-scores."""
    names = [f for fs in groups.values() for f in fs]
    scaled = [f for f in names if features.feature_type(f) == "continuous"]
    z = fit.with_z(data, params.where(F.col("feature").isin(scaled)), scaled) if scaled else data
    z = z.withColumns({f"z_{f}": F.col(f).cast("double") for f in names if f not in scaled})
    weights = {g: [(f"z_{f}", (ic[f] > 0) - (ic[f] < 0), abs(ic[f]) / (sum(abs(ic[x]) for x in fs) or 1.0)) for f in fs] for g, fs in groups.items()}
    keep = [*features.BASE, "true_range_ticks", "poc_shift_ticks", "entry_open_next", "exit_close_after_5", TARGET]
    scored = _kept(z.select(*keep, fit.weighted_score(weights).alias("signal_score"), *[fit.weighted_score({g: x}).alias(f"score_{g}") for g, x in weights.items()]), "scored")
    risked = fit.risk_pass(fit.constants(fit.risk_limits(_parts(scored, split)[0])), scored)
    return risked, fit.constants(fit.thresholds(_parts(risked.where("risk_pass"), split)[0], high=cfg.high, low=cfg.low))


def stage2_pack(bars: DataFrame, cfg: Settings = Settings()) -> dict[str, DataFrame]:
    """The tables the later programs read: clipped features with labels, parameters, split, training summary and correlations."""
    table = _kept(fit.time_split(bars, cfg.train_ratio), "split")
    split = fit.constants(table)
    clipped, params = clipped_features(bars, split, cfg)
    data = _kept(features.labels(clipped, cfg.tick, cfg.cost_ticks, cfg.holding_bars), "pack")
    train, test = _parts(data, split)
    return {
        "data": data, "params": params, "split": table, "summary": _kept(evaluate.summary(train, features.FEATURES), "summary"), "test_summary": evaluate.summary(test, features.FEATURES),
        "correlations": _kept(evaluate.correlations(train, features.FEATURES), "correlations"), "quality": evaluate.quality(data, features.FEATURES), "quintiles": evaluate.quintiles(train, features.FEATURES),
        "monthly_ic": evaluate.periodic_ic(data, features.FEATURES),
    }


def _collected(pack: dict[str, DataFrame]) -> tuple[list[dict], dict[tuple[str, str], float], dict[str, float]]:
    """The summary and correlations of 65 features: small tables by construction."""
    table = [r.asDict() for r in pack["summary"].select("feature", "coverage", "unique_count", "inf_count", "spearman_ic").collect()]
    corr = {(r["feature_a"], r["feature_b"]): r["spearman_corr"] for r in pack["correlations"].collect()}
    return table, corr, {r["feature"]: r["spearman_ic"] or 0.0 for r in table}


def stage2(bars: DataFrame, cfg: Settings = Settings(), pack: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """65 features, the redundancy-aware choice of some, and the grouped strategy."""
    pack = pack or stage2_pack(bars, cfg)
    table, corr, ic = _collected(pack)
    chosen = fit.select_features(table, corr, features.GROUP_OF, most=cfg.max_features)
    groups: dict[str, list[str]] = {}
    for r in chosen:
        groups.setdefault(r["group"], []).append(r["feature"])
    split = fit.constants(pack["split"])
    risked, cuts = _scored(pack["data"], pack["params"], split, groups, ic, cfg)
    trades = _kept(simulate.fixed_hold_trades(risked, cuts, split, cfg.holding_bars, cfg.cost), "stage2-trades")
    selected = bars.sparkSession.createDataFrame(chosen, "selection_order int, feature string, group string, abs_spearman_ic double, mrmr_score double")
    found = audit.bar_integrity(bars).unionByName(audit.trade_checks(trades, bars, split, cfg.cost)).unionByName(audit.feature_checks(pack["quality"], pack["correlations"], selected, len(chosen)))
    return {**pack, "selected": selected, **_outcome(trades, cfg), "audit": found, "audit_summary": audit.finding_summary(found)}


def gain_curve(bars: DataFrame, cfg: Settings = Settings(), pack: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """What each dimension of features adds: the strategy on each combination, its metrics, signal distribution, correlations, confidence, months and label."""
    pack = pack or stage2_pack(bars, cfg)
    spark, split = bars.sparkSession, fit.constants(pack["split"])
    table, corr, ic = _collected(pack)
    best = {d: fit.select_dimension(table, corr, fs) for d, fs in DIMENSIONS.items()}
    chosen = [(name, k + 1, f, d) for name, dims in GAIN_COMBOS.items() for k, (d, f) in enumerate((d, f) for d in dims for f in best[d])]
    selected = spark.createDataFrame(chosen, "combo_name string, selection_order int, feature string, dimension string")
    trades = shapes = None
    for name, dims in GAIN_COMBOS.items():
        groups = {d: best[d] for d in dims if best[d]}
        if not groups:
            continue
        risked, cuts = _scored(pack["data"], pack["params"], split, groups, ic, cfg)
        t = simulate.fixed_hold_trades(risked, cuts, split, cfg.holding_bars, cfg.cost).withColumn("combo_name", F.lit(name))
        rows = metrics.with_all(fit.with_split(fit.attach(risked, cuts), split).where("split is not null"))
        shape = metrics.signal_distribution(rows, ["split"], list(cuts)).withColumn("combo_name", F.lit(name))
        trades, shapes = (t, shape) if trades is None else (trades.unionByName(t), shapes.unionByName(shape))
    trades = _kept(trades, "gain-trades")
    summary = _kept(metrics.sample_confidence(metrics.strategy_metrics(metrics.with_all(trades), ["combo_name", "split"]), every_split=True), "gain-summary")
    monthly = metrics.monthly(trades, ["combo_name", "split"])
    shapes = _kept(metrics.distribution_diagnostics(shapes, summary), "gain-shapes")
    between = metrics.selected_correlations(selected, pack["correlations"])
    out = {
        "selected": selected, "trades": trades, "summary": summary, "monthly": monthly, "overlap": metrics.overlaps(trades, ["combo_name"]), "signal_distribution": shapes, "selected_correlations": between,
        "gains": metrics.dimension_gains(summary, monthly.where("split = 'test'"), between, shapes), "cost_sensitivity": metrics.cost_sensitivity(trades, (0.0, 1.0, 2.0, 3.0, 4.0), cfg.tick, ["combo_name"]),
    }
    if all(best.values()):
        risked, _ = _scored(pack["data"], pack["params"], split, best, ic, cfg)
        out["interaction_patterns"] = metrics.interaction_patterns(_parts(risked, split)[1], "score_delta", "score_poc", "score_position", TARGET)
    return out


def pullback(bars: DataFrame, cfg: Settings = Settings(), pack: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The five nested filter combinations with triple-barrier exits: funnel, trades, metrics, confidence, gains, exit reasons, other reward ratios."""
    pack = pack or stage2_pack(bars, cfg)
    split = fit.constants(pack["split"])
    data = _kept(features.pullback(pack["data"], cfg.tick, cfg.reward_to_risk), "pullback")
    options = {"bars": cfg.holding_bars, "tick": cfg.tick, "cost": cfg.cost_ticks}
    ready = F.col("trade_ready")
    trades = _kept(simulate.named_barrier_trades(data, {n: F.col(f"{n}_pass") & ready for n in features.COMBOS}, split, "long", **options), "pullback-trades")
    room = F.col("trend_pullback_kline_flow_pass") & ready & (F.col("previous_swing_high_20") > F.col("close")) & F.col("stop_distance_ticks_signal").between(2.0, 30.0)
    ratios = _kept(simulate.named_barrier_trades(data, {str(x): room & (F.col("reward_to_risk_proxy") >= x) for x in (1.0, 1.5, 2.0)}, split, "long", **options), "pullback-ratios")
    summary = _kept(metrics.sample_confidence(metrics.strategy_metrics(metrics.with_all(trades), ["combo_name", "split"])), "pullback-summary")
    monthly = metrics.monthly(trades, ["combo_name", "split"])
    names = list(features.COMBOS)
    found = audit.trade_checks(trades, bars, split, cfg.cost).unionByName(audit.path_replay(trades, bars))
    return {
        "features": data, "funnel": metrics.funnel(fit.with_split(data, split), features.COMBOS), "trades": trades, "summary": summary, "exit_reasons": metrics.exit_reasons(trades, ["combo_name", "split"]), "monthly": monthly,
        "gains": metrics.gain_diagnostics(summary, monthly.where("split = 'test'"), names), "bootstrap": metrics.bootstrap_differences(trades.where("split = 'test'"), names), "reward_risk": metrics.strategy_metrics(metrics.with_all(ratios), ["combo_name", "split"]),
        "cost_sensitivity": metrics.cost_sensitivity(trades, (0.0, 1.0, 2.0, 3.0, 4.0), cfg.tick, ["combo_name"]), "audit": found,
    }


def parameter_sweep(bars: DataFrame, cfg: Settings = Settings(), pack: dict[str, DataFrame] | None = None, cases: list[dict] | None = None) -> dict[str, DataFrame]:
    """Both sides over the parameter grid: trades, summaries with plateau scores, ranking, ablations, marginal means, win-rate tests, comparison of the sides."""
    pack = pack or stage2_pack(bars, cfg)
    split = fit.constants(pack["split"])
    data = _kept(features.pullback(pack["data"], cfg.tick, cfg.reward_to_risk), "pullback")
    cases = cases or sweep.grid()
    table = bars.sparkSession.createDataFrame(cases)
    axes = ["time_barrier_bars", "stop_atr_multiple", "take_profit_multiple"]
    steps = {a: len({c[a] for c in cases}) for a in ("time_i", "stop_i", "take_i")}
    out: dict[str, DataFrame] = {}
    tests, best = [], []
    for side in ("long", "short"):
        trades = _kept(sweep.sweep_trades(data, split, side, cases, cfg.tick, cfg.cost_ticks), f"sweep-{side}")
        train, test = (_kept(sweep.case_summary(trades, table, s), f"cases-{side}-{s}") for s in ("train", "test"))
        scored = _kept(metrics.plateau_scores(train), f"plateaus-{side}")
        ranked = _kept(sweep.ranking(scored, test), f"ranking-{side}")
        judged = metrics.case_effectiveness(metrics.sample_confidence(test.withColumn("split", F.lit("test"))))
        tests.append(judged.withColumn("side", F.lit(side)))
        best.append(sweep.best_cases(ranked, test, table))
        rates = _kept(metrics.exit_rates(trades.where("split = 'test'"), ["case_id"]), f"exit-rates-{side}")
        out |= {f"{side}_time_diagnostics": sweep.time_barrier_diagnostics(test, rates), f"{side}_stop_take_diagnostics": sweep.stop_take_diagnostics(test, rates), f"{side}_best": sweep.best_plateaus(ranked, side), f"{side}_best_exits": sweep.exit_comparison(best[-1], rates, side)}
        out |= {
            f"{side}_trades": trades, f"{side}_summary": scored, f"{side}_ranking": ranked, f"{side}_kline_ablation": metrics.against_baseline(train, "kline_mode", "none", [*axes, "space_filter_on"]),
            f"{side}_space_ablation": metrics.against_baseline(train, "space_filter_on", False, [*axes, "kline_mode"]), f"{side}_time_means": metrics.marginal(train, ["time_barrier_bars"]),
            f"{side}_stop_take_means": metrics.marginal(train, ["stop_atr_multiple", "take_profit_multiple"]), f"{side}_tests": metrics.win_rate_test(judged.where("trade_count > 0"), trials=len(cases)), f"{side}_exit_reasons": metrics.exit_reasons(trades, ["case_id", "split"]),
        }
    return out | {"comparison": sweep.comparison(tests[0].unionByName(tests[1]), trials=2 * len(cases)), "asymmetry": sweep.asymmetry(*best, steps)}


def tick_validation(spark: SparkSession, tick_folder: str, golden_folder: str, minutes: int = 5, out: str | None = None) -> DataFrame:
    """Bars of all tick files of a folder held against its golden bar files, a row a contract of either folder: contract, input_csv, reference_csv, status, and the rest of `golden_diff`.

    Statuses are passed, value_mismatch, row_count_mismatch, missing_input (no tick file), missing_reference (no golden file) and generation_failed (a tick file without a bar). With `out`,
    the bars are written there, a folder a contract.
    """
    inputs, golden = ticks.tick_index(spark, tick_folder), ticks.golden_index(spark, golden_folder, minutes)
    index = inputs.select("contract", F.col("path").alias("input_csv")).join(golden.select("contract", F.col("path").alias("reference_csv")), "contract", "full_outer")
    chosen = index.collect()  # a row a file
    bars = written(tick_bars.bars_of_ticks(ticks.read_tick_csv(spark, [r["input_csv"] for r in chosen if r["input_csv"]]), minutes), "tick-bars")
    if out:
        ticks.write_table(bars, out)
    paths = [r["reference_csv"] for r in chosen if r["reference_csv"]]
    reference = ticks.read_bar_csv(spark, paths) if paths else bars.limit(0)
    found = audit.golden_diff(bars, reference, ["open", "high", "low", "close", "poc"], ["volume", "delta", "open_interest"], ["datetime"])
    j = index.join(found, "contract", "left")
    status = F.when(F.col("input_csv").isNull(), "missing_input").when(F.coalesce("generated_rows", F.lit(0)) == 0, "generation_failed").when(F.col("reference_csv").isNull(), "missing_reference").when(F.coalesce("reference_rows", F.lit(0)) == 0, "row_count_mismatch")
    return j.select("contract", "input_csv", "reference_csv", F.coalesce(status, "status").alias("status"), *[c for c in found.columns if c not in ("contract", "status")])


PROGRAMS = {"stage1": stage1, "stage2": stage2, "gain_curve": gain_curve, "pullback": pullback, "parameter_sweep": parameter_sweep}


def markdown(rows: list[dict], columns: list[str], most: int = 50) -> str:
    """A small collected table as Markdown."""
    cell = lambda v: "-" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows[:most])]
    return "\n".join(lines + ([f"({len(rows) - most} more rows)"] if len(rows) > most else []))


def main() -> None:
    """python -m tidebar.plans.programs PROGRAM BARS OUT: a program over a Parquet table of bars, its tables written below OUT."""
    import argparse

    ask = argparse.ArgumentParser(description=main.__doc__)
    ask.add_argument("program", choices=sorted(PROGRAMS))
    ask.add_argument("bars")
    ask.add_argument("out")
    ask.add_argument("--tick", type=float, default=1.0)
    ask.add_argument("--cost-ticks", type=float, default=2.0)
    given = ask.parse_args()
    spark = SparkSession.builder.getOrCreate()
    settings = {"high": 0.8, "low": 0.2} if given.program == "stage1" else {}
    save(PROGRAMS[given.program](spark.read.parquet(given.bars), Settings(tick=given.tick, cost_ticks=given.cost_ticks, **settings)), given.out)


if __name__ == "__main__":
    main()
