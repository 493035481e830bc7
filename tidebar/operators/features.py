"""Per-contract features of bars. Windows that build on other windows come in layers; all share one exchange and one sort by contract and time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.kernels import ahead, diff, div, ema, ema_within, flag, fracdiff, lag, lead, per_contract, rolling, running_sum, so_far, trailing, zscore

BASE = ["contract", "datetime", "open", "high", "low", "close", "volume", "poc", "delta", "open_interest"]

#: The catalogue of features by group.
GROUPS = {
    "price_structure": ["bar_return", "close_to_prev_close_return", "gap_return", "true_range_ticks", "range_expansion_20", "body_ratio", "close_location_value", "upper_shadow_ratio", "lower_shadow_ratio", "wick_imbalance"],
    "orderflow_delta": ["delta_strength", "abs_delta_strength", "delta_zscore_20", "delta_zscore_60", "delta_change_1", "delta_accel_3", "cvd_change_5", "cvd_change_10", "cvd_change_20", "cvd_slope_20", "delta_price_agreement", "delta_price_divergence"],
    "auction_poc": ["poc_distance_ticks", "abs_poc_distance_ticks", "poc_distance_zscore_20", "poc_shift_ticks", "poc_shift_zscore_20", "close_above_poc", "poc_price_agreement", "value_acceptance_ratio"],
    "volume_liquidity": ["volume_zscore_20", "volume_zscore_60", "volume_change_1", "volume_burst_flag", "range_per_volume", "return_per_volume", "amihud_like_illiquidity", "volume_adjusted_delta"],
    "open_interest": ["open_interest_change", "open_interest_change_pct", "open_interest_zscore_20", "open_interest_zscore_60", "price_oi_state", "delta_oi_agreement", "oi_volume_ratio", "open_interest_fracdiff_04", "open_interest_fracdiff_zscore_60", "fracdiff_oi_delta_confirm"],
    "regime_time": ["trend_return_12", "trend_return_48", "volatility_20", "volatility_60", "trend_strength_48", "volatility_ratio_20_60", "is_night_session", "minute_of_day_sin", "minute_of_day_cos"],
    "interaction": ["flow_at_bar_extreme", "absorption_score", "exhaustion_score", "trend_delta_confirm", "poc_rejection_score", "volume_delta_confirm", "oi_delta_confirm", "volatility_adjusted_flow"],
}
FEATURES = [f for names in GROUPS.values() for f in names]
GROUP_OF = {f: g for g, names in GROUPS.items() for f in names}
BINARY, CYCLICAL = ("volume_burst_flag", "is_night_session"), ("minute_of_day_sin", "minute_of_day_cos")
SIGNED = ("delta_price_agreement", "close_above_poc", "poc_price_agreement", "price_oi_state", "delta_oi_agreement", "fracdiff_oi_delta_confirm")


def feature_type(name: str) -> str:
    return "binary" if name in BINARY else "cyclical" if name in CYCLICAL else "signed" if name in SIGNED else "continuous"


def return_of(x: str | Column, k: int = 1) -> Column:
    return div(x, lag(x, k)) - 1


def extended(bars: DataFrame, tick: float = 1.0) -> DataFrame:
    """bars with the 65 features of FEATURES."""
    c, o, h, l, v = (F.col(x).cast("double") for x in ("close", "open", "high", "low", "volume"))
    d = F.col("delta").cast("double")
    rng, top, bottom = h - l, F.greatest(o, c), F.least(o, c)
    df = bars.withColumns(
        {
            "_pc": lag("close"), "_known": F.last("close", ignorenulls=True).over(so_far()), "_cvd": running_sum("delta"), "_d1": diff("delta").cast("double"),
            "open_interest_change": diff("open_interest").cast("double"), "poc_shift_ticks": diff("poc") / tick, "gap_return": div("open", lag("close")) - 1,
            "volume_change_1": return_of("volume"), "open_interest_change_pct": div(diff("open_interest"), lag("open_interest")),
            "trend_return_12": return_of("close", 12), "trend_return_48": return_of("close", 48), "open_interest_fracdiff_04": fracdiff("open_interest"),
            "delta_zscore_20": zscore("delta", 20), "delta_zscore_60": zscore("delta", 60), "volume_zscore_20": zscore("volume", 20), "volume_zscore_60": zscore("volume", 60),
            "poc_distance_ticks": (c - F.col("poc")) / tick, "_volume_20": rolling(F.avg, "volume", 20),
            "bar_return": div(c, o) - 1, "body_ratio": div(F.abs(c - o), rng, 0.0), "close_location_value": div((c - l) - (h - c), rng, 0.0),
            "upper_shadow_ratio": div(h - top, rng, 0.0), "lower_shadow_ratio": div(bottom - l, rng, 0.0), "wick_imbalance": div((bottom - l) - (h - top), rng, 0.0),
            "delta_strength": div(d, v, 0.0), "abs_delta_strength": F.abs(div(d, v, 0.0)), "_dd": F.signum(d), "value_acceptance_ratio": 1 - div(F.abs(c - F.col("poc")), rng, 0.0),
            "close_above_poc": F.signum(c - F.col("poc")), "delta_price_agreement": F.signum(c - o) * F.signum(d),
        }
    )
    pc, clv = F.col("_pc"), F.col("close_location_value")
    tr = F.greatest(rng, F.abs(h - pc), F.abs(l - pc)) / tick
    df = df.withColumns(
        {
            "true_range_ticks": tr, "close_to_prev_close_return": div(c, pc) - 1, "_dir": F.signum(c - pc), "_pct": div("_known", lag("_known")) - 1,
            "delta_accel_3": F.col("_d1") - lag("_d1", 3), "cvd_change_5": (F.col("_cvd") - lag("_cvd", 5)).cast("double"), "cvd_change_10": (F.col("_cvd") - lag("_cvd", 10)).cast("double"),
            "cvd_change_20": (F.col("_cvd") - lag("_cvd", 20)).cast("double"), "poc_distance_zscore_20": zscore("poc_distance_ticks", 20), "poc_shift_zscore_20": zscore("poc_shift_ticks", 20),
            "open_interest_zscore_20": zscore("open_interest_change", 20), "open_interest_zscore_60": zscore("open_interest_change", 60), "open_interest_fracdiff_zscore_60": zscore("open_interest_fracdiff_04", 60),
        }
    )
    df = df.withColumns({"range_expansion_20": div("true_range_ticks", rolling(F.avg, "true_range_ticks", 20)) - 1, "volatility_20": rolling(F.stddev_pop, "_pct", 20), "volatility_60": rolling(F.stddev_pop, "_pct", 60)})
    minute = F.hour("datetime") * 60 + F.minute("datetime")
    against = flag(F.col("_dir") * F.col("_dd") < 0)
    return df.withColumns(
        {
            "delta_change_1": F.col("_d1"), "cvd_slope_20": F.col("cvd_change_20") / 20, "delta_price_divergence": F.when(against, F.col("abs_delta_strength")).otherwise(0.0),
            "abs_poc_distance_ticks": F.abs("poc_distance_ticks"), "poc_price_agreement": F.col("_dir") * F.signum("poc_shift_ticks"),
            "volume_burst_flag": flag(F.col("volume_zscore_20") > 2).cast("double"), "range_per_volume": div("true_range_ticks", v, 0.0),
            "return_per_volume": div("close_to_prev_close_return", v, 0.0), "amihud_like_illiquidity": div(F.abs("close_to_prev_close_return"), v, 0.0), "volume_adjusted_delta": div(d, "_volume_20"),
            "price_oi_state": F.col("_dir") * F.signum("open_interest_change"), "delta_oi_agreement": F.col("_dd") * F.signum("open_interest_change"), "oi_volume_ratio": div("open_interest_change", v, 0.0),
            "fracdiff_oi_delta_confirm": F.signum("open_interest_fracdiff_04") * F.col("_dd"), "trend_strength_48": div("trend_return_48", F.col("volatility_60") * math.sqrt(48)),
            "volatility_ratio_20_60": div("volatility_20", "volatility_60"), "is_night_session": ((F.hour("datetime") >= 21) | (F.hour("datetime") < 9)).cast("double"),
            "minute_of_day_sin": F.sin(2 * math.pi * minute / 1440), "minute_of_day_cos": F.cos(2 * math.pi * minute / 1440),
            "flow_at_bar_extreme": F.col("delta_strength") * clv, "absorption_score": F.when(against, F.col("abs_delta_strength") * F.col("_dd")).otherwise(0.0),
            "exhaustion_score": F.when(F.col("volume_zscore_20").isNotNull(), F.col("abs_delta_strength") * F.abs(clv) * F.greatest("volume_zscore_20", F.lit(0.0))),
            "trend_delta_confirm": F.signum("trend_return_12") * F.col("delta_strength"), "poc_rejection_score": F.col("poc_distance_zscore_20") * clv,
            "volume_delta_confirm": F.col("volume_zscore_20") * F.col("delta_strength"), "oi_delta_confirm": F.col("open_interest_zscore_20") * F.col("delta_strength"),
            "volatility_adjusted_flow": div("delta_strength", "volatility_20"),
        }
    ).select(*BASE, *FEATURES)


#: The features of stage 1.
STAGE1 = [
    "bar_return", "range_ticks", "body_ratio", "close_position", "upper_shadow_ratio", "lower_shadow_ratio", "delta_strength", "delta_zscore_20", "volume_zscore_20", "cvd_change_10",
    "poc_distance_ticks", "poc_shift_ticks", "open_interest_change", "open_interest_zscore_20", "trend_return_12", "volatility_20", "price_delta_agreement",
]


def stage1(bars: DataFrame, tick: float = 1.0) -> DataFrame:
    """bars with the 17 features of STAGE1."""
    c, o, h, l = (F.col(x).cast("double") for x in ("close", "open", "high", "low"))
    rng = h - l
    df = bars.withColumns({"_cvd": running_sum("delta"), "_known": F.last("close", ignorenulls=True).over(so_far()), "open_interest_change": diff("open_interest").cast("double")})
    df = df.withColumns({"_pct": div("_known", lag("_known")) - 1, "open_interest_zscore_20": zscore("open_interest_change", 20), "cvd_change_10": (F.col("_cvd") - lag("_cvd", 10)).cast("double")})
    return df.withColumns(
        {
            "bar_return": div(c, o) - 1, "range_ticks": rng / tick, "body_ratio": div(F.abs(c - o), rng, 0.0), "close_position": div(c - l, rng, 0.5),
            "upper_shadow_ratio": div(h - F.greatest(o, c), rng, 0.0), "lower_shadow_ratio": div(F.least(o, c) - l, rng, 0.0), "delta_strength": div("delta", "volume", 0.0),
            "delta_zscore_20": zscore("delta", 20), "volume_zscore_20": zscore("volume", 20), "poc_distance_ticks": (c - F.col("poc")) / tick, "poc_shift_ticks": diff("poc") / tick,
            "trend_return_12": return_of("close", 12), "volatility_20": rolling(F.stddev_pop, "_pct", 20), "price_delta_agreement": F.signum(c - o) * F.signum(F.col("delta").cast("double")),
        }
    ).select(*BASE, *STAGE1)


#: The labels.
LABELS = ["future_return_1", "future_return_3", "future_return_5", "future_return_10", "mfe_10_long", "mae_10_long", "entry_open_next", "exit_close_after_5", "trade_return_5_gross", "trade_return_5_net"]


def labels(bars: DataFrame, tick: float = 1.0, cost_ticks: float = 2.0, holding_bars: int = 5) -> DataFrame:
    """bars with forward-looking LABELS; the last rows of a contract, whose future is not all there, have none."""
    df = bars.withColumns({f"future_return_{h}": div(lead("close", h), "close") - 1 for h in (1, 3, 5, 10)})
    df = df.withColumns(
        {
            "mfe_10_long": div(ahead(F.max, "high", 10), "close") - 1, "mae_10_long": div(ahead(F.min, "low", 10), "close") - 1,
            "entry_open_next": lead("open", 1), "exit_close_after_5": lead("close", holding_bars),
        }
    )
    df = df.withColumn("trade_return_5_gross", div("exit_close_after_5", "entry_open_next") - 1)
    return df.withColumn("trade_return_5_net", F.col("trade_return_5_gross") - div(F.lit(cost_ticks * tick), "entry_open_next")).select(*bars.columns, *LABELS)


#: Nested filters of the pullback combinations.
COMBOS = {
    "trend_only": ["trend_filter_pass"],
    "trend_pullback": ["trend_filter_pass", "pullback_structure_pass"],
    "trend_pullback_kline": ["trend_filter_pass", "pullback_structure_pass", "kline_turn_pass"],
    "trend_pullback_kline_flow": ["trend_filter_pass", "pullback_structure_pass", "kline_turn_pass", "flow_confirm_pass"],
    "trend_pullback_full_space": ["trend_filter_pass", "pullback_structure_pass", "kline_turn_pass", "flow_confirm_pass", "space_filter_pass"],
}


def _side_patterns(side: int) -> dict[str, Column]:
    """The candle conditions of a side: 1 looks for rising turns, -1 for falling ones."""
    c, o = F.col("close"), F.col("open")
    clv, ret = F.col("close_location_value"), F.col("bar_return")
    sign = F.lit(float(side))
    own = flag(sign * (c - o) > 0)
    strong = own & flag(sign * clv >= 0.4)
    body = flag(F.col("body_ratio").between(0.2, 0.8))
    against = lambda k: flag(sign * (F.col(f"_c{k}") - F.col(f"_o{k}")) < 0)
    engulfing = own & against(1) & flag(sign * (o - F.col("_c1")) <= 0) & flag(sign * (c - F.col("_o1")) >= 0)
    small = flag(F.col("_body1") <= 0.35) | flag(F.abs("_clv1") <= 0.2)
    star = against(2) & small & own & flag(sign * (c - (F.col("_o2") + F.col("_c2")) / 2) > 0)
    weak = flag(sign * F.col("_ret1") < 0) | flag(sign * F.col("_ret2") < 0) | flag(sign * F.col("_clv1") < -0.2) | flag(sign * F.col("_clv2") < -0.2)
    three = weak & strong & flag(sign * (ret - F.coalesce("_ret1", F.lit(0.0))) > 0)
    return {"own": own, "strong": strong, "body": body, "engulfing": engulfing, "star": star, "three": three, "turn": strong & body & (engulfing | star | three)}


def pullback(features: DataFrame, tick: float = 1.0, reward_to_risk: float = 1.5) -> DataFrame:
    """The trend-pullback features of both sides over `extended` features joined with `labels`."""
    c, h, l = F.col("close"), F.col("high"), F.col("low")
    df = features.withColumns({"_row": F.row_number().over(per_contract())})
    i = F.col("_row").cast("double")
    w60 = trailing(60)
    full = F.count("close").over(w60) == 60
    df = df.withColumns(
        {
            "_ema": ema_within("close", 60), "_slope": F.when(full, F.regr_slope(c, i).over(w60)), "_mean": F.when(full, F.avg(c).over(w60)), "atr20_ticks": rolling(F.avg, "true_range_ticks", 20),
            "pullback_low_10": rolling(F.min, "low", 10), "pullback_high_10": rolling(F.max, "high", 10), "_h1": lag("high"), "_l1": lag("low"),
            "_o1": lag("open"), "_c1": lag("close"), "_o2": lag("open", 2), "_c2": lag("close", 2), "_body1": lag("body_ratio"),
            "_clv1": lag("close_location_value"), "_clv2": lag("close_location_value", 2), "_ret1": lag("bar_return"), "_ret2": lag("bar_return", 2),
        }
    )
    df = df.withColumns({"ema60": ema("_ema", 60)})
    df = df.withColumns(
        {
            "ema60_slope_12_ticks": (F.col("ema60") - lag("ema60", 12)) / tick / 12, "trendline_60": F.col("_mean") + F.col("_slope") * 29.5, "trendline_slope_60_ticks": F.col("_slope") / tick,
            "adaptive_pullback_tolerance_ticks": F.col("atr20_ticks") * 0.5, "previous_swing_high_20": rolling(F.max, "_h1", 20), "previous_swing_low_20": rolling(F.min, "_l1", 20),
        }
    )
    tol = F.col("adaptive_pullback_tolerance_ticks") * tick
    ema60, line = F.col("ema60"), F.col("trendline_60")
    rising, falling = _side_patterns(1), _side_patterns(-1)
    trends = [F.col(x) for x in ("ema60_slope_12_ticks", "trendline_slope_60_ticks", "trend_return_48", "trend_strength_48")]
    every = lambda xs: xs[0] if len(xs) == 1 else xs[0] & every(xs[1:])
    holds = lambda x: flag((l <= x + tol) & (l >= x - tol) & (c >= x))
    rejects = lambda x: flag((h >= x - tol) & (h <= x + tol) & (c <= x))
    agree = flag(F.col("delta_price_agreement") >= 0)
    normal = flag(F.col("volume_zscore_20") >= -0.5)
    df = df.withColumns(
        {
            "trend_filter_pass": every([flag(x > 0) for x in trends]), "short_trend_filter_pass": every([flag(x < 0) for x in trends]),
            "distance_to_ema60_ticks": (c - ema60) / tick, "low_distance_to_ema60_ticks": (l - ema60) / tick, "distance_to_trendline_ticks": (c - line) / tick, "low_distance_to_trendline_ticks": (l - line) / tick,
            "ema60_hold_flag": holds(ema60), "trendline_hold_flag": holds(line), "pullback_structure_pass": holds(ema60) | holds(line),
            "bullish_bar_flag": rising["own"], "strong_bullish_close_flag": rising["strong"], "body_quality_flag": rising["body"], "bullish_engulfing_flag": rising["engulfing"],
            "morning_star_proxy": rising["star"], "weak_to_strong_3bar_flag": rising["three"], "kline_turn_pass": rising["turn"],
            "delta_confirm_long": flag(F.col("delta") > 0) & flag(F.col("delta_strength") > 0), "volume_normal_or_better_flag": normal,
            "volume_expand_flag": flag(F.col("volume_zscore_20") >= 0) | flag(F.col("volume_burst_flag") == 1),
            "short_distance_to_ema60_ticks": (ema60 - c) / tick, "short_high_distance_to_ema60_ticks": (h - ema60) / tick, "short_distance_to_trendline_ticks": (line - c) / tick, "short_high_distance_to_trendline_ticks": (h - line) / tick,
            "short_ema60_reject_flag": rejects(ema60), "short_trendline_reject_flag": rejects(line), "short_pullback_structure_pass": rejects(ema60) | rejects(line),
            "bearish_bar_flag": falling["own"], "strong_bearish_close_flag": falling["strong"], "bearish_engulfing_flag": falling["engulfing"], "evening_star_proxy": falling["star"],
            "strong_to_weak_3bar_flag": falling["three"], "short_kline_turn_pass": falling["turn"], "short_delta_confirm": flag(F.col("delta") < 0) & flag(F.col("delta_strength") < 0),
            "stop_price_signal": F.col("pullback_low_10") - tick, "short_stop_price_signal": F.col("pullback_high_10") + tick,
        }
    )
    df = df.withColumns(
        {
            "flow_confirm_pass": F.col("delta_confirm_long") & agree & normal, "short_flow_confirm_pass": F.col("short_delta_confirm") & agree & normal,
            "stop_distance_ticks_signal": (c - F.col("stop_price_signal")) / tick, "reward_ticks_signal": (F.col("previous_swing_high_20") - c) / tick,
            "short_stop_distance_ticks_signal": (F.col("short_stop_price_signal") - c) / tick, "short_reward_ticks_signal": (c - F.col("previous_swing_low_20")) / tick,
        }
    )
    df = df.withColumns({"reward_to_risk_proxy": div("reward_ticks_signal", "stop_distance_ticks_signal"), "short_reward_to_risk_proxy": div("short_reward_ticks_signal", "short_stop_distance_ticks_signal")})
    room = lambda beyond, p: flag(beyond) & flag(F.col(f"{p}stop_distance_ticks_signal").between(2.0, 30.0)) & flag(F.col(f"{p}reward_to_risk_proxy") >= reward_to_risk)
    df = df.withColumns({"space_filter_pass": room(F.col("previous_swing_high_20") > c, ""), "short_space_filter_pass": room(F.col("previous_swing_low_20") < c, "short_")})
    df = df.withColumns({f"{name}_pass": every([F.col(x) for x in need]) for name, need in COMBOS.items()})
    df = df.withColumn("trade_ready", flag(F.col("volume") > 0) & F.col("entry_open_next").isNotNull() & F.col("exit_close_after_5").isNotNull())
    return df.drop(*[x for x in df.columns if x.startswith("_") and x != "_row"]).withColumnRenamed("_row", "row_i")
