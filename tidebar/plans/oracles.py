"""SQL that DuckDB runs on the same tables for each query, written apart from the Spark code."""

from __future__ import annotations

from tidebar.functions.kernels import fracdiff_weights
from tidebar.operators.features import COMBOS, GROUPS, LABELS, STAGE1
from tidebar.operators.metrics import SHOWN_QUANTILES
from tidebar.plans.queries import CHOSEN, EVALUATED, HORIZONS, LEAST_TRADES, PULLBACK_SHOWN, RATIOS, SCORED, SESSIONS, SHORT_SHOWN

T = "strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime"


def r(x: str, name: str | None = None, places: int = 6) -> str:
    return f"round(({x})::DOUBLE + 1e-9, {places}) + 0.0::DOUBLE AS {name or x}"


TICKS = """ticks AS (SELECT 'C' || (user_id % 4)::VARCHAR AS contract, ts, event_id, floor(value * 10) / 10 AS price, floor(value) AS level, k AS qty, date_trunc('hour', ts) AS datetime,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS side, CASE event_type WHEN 'signup' THEN k WHEN 'purchase' THEN -k ELSE 0 END AS oi
  FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events))"""
LADDER = """ladder AS (SELECT contract, datetime, level, sum(CASE WHEN side = 1 THEN qty ELSE 0 END)::BIGINT AS buy, sum(CASE WHEN side = -1 THEN qty ELSE 0 END)::BIGINT AS sell,
  sum(CASE WHEN side = 0 THEN qty ELSE 0 END)::BIGINT AS other FROM ticks GROUP BY ALL)"""
BARS = f"""{TICKS}, {LADDER},
hours AS (SELECT contract, datetime, arg_min(price, {{'t': ts, 'e': event_id}}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {{'t': ts, 'e': event_id}}) AS close, sum(qty)::BIGINT AS volume,
  sum(qty * side)::BIGINT AS delta, sum(oi)::BIGINT AS oi FROM ticks GROUP BY ALL),
pocs AS (SELECT contract, datetime, arg_max(level, {{'v': buy + sell, 'l': -level}}) AS poc FROM ladder GROUP BY ALL),
bars AS (SELECT h.contract, h.datetime, open, high, low, close, volume, poc, delta, (100000 + sum(oi) OVER (PARTITION BY h.contract ORDER BY h.datetime))::BIGINT AS open_interest
  FROM hours h JOIN pocs p ON h.contract = p.contract AND h.datetime = p.datetime)"""
W = "WINDOW w AS (PARTITION BY contract ORDER BY datetime)" + "".join(f", w{n} AS (PARTITION BY contract ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (10, 20, 60, 200)) + ", f10 AS (PARTITION BY contract ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), so_far AS (PARTITION BY contract ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {f}({x}) OVER w{n} END"


def z(x: str, n: int) -> str:
    return f"({x} - ({roll('avg', x, n)})) / nullif({roll('stddev_pop', x, n)}, 0)"


_WEIGHTS = "[" + ", ".join(f"{w!r}::DOUBLE" for w in reversed(fracdiff_weights())) + "]"
FEATURES = f"""{BARS},
f1 AS (SELECT *, (high - low) AS rng, lag(close) OVER w AS pc, sum(delta) OVER so_far AS cvd, (delta - lag(delta) OVER w)::DOUBLE AS d1, (open_interest - lag(open_interest) OVER w)::DOUBLE AS open_interest_change,
  poc - lag(poc) OVER w AS poc_shift_ticks, close - poc AS poc_distance_ticks, close / nullif(lag(close) OVER w, 0) - 1 AS pct,
  CASE WHEN count(open_interest) OVER w200 = 200 THEN list_inner_product((list(open_interest::DOUBLE) OVER w200)[:200], CASE WHEN count(open_interest) OVER w200 = 200 THEN {_WEIGHTS} ELSE [0.0::DOUBLE for x in (list(1) OVER w200)] END) END AS open_interest_fracdiff_04,
  delta / nullif(volume, 0)::DOUBLE AS ds, sign(delta)::DOUBLE AS dd FROM bars {W}),
f2 AS (SELECT *, coalesce(ds, 0) AS delta_strength, coalesce(((close - low) - (high - close)) / nullif(rng, 0), 0) AS close_location_value, coalesce(abs(close - open) / nullif(rng, 0), 0) AS body_ratio,
  greatest(rng, abs(high - pc), abs(low - pc)) AS true_range_ticks, sign(close - pc) AS dir, close / nullif(open, 0) - 1 AS bar_return, {z('volume', 20)} AS volume_zscore_20, {z('volume', 60)} AS volume_zscore_60,
  close / nullif(lag(close, 12) OVER w, 0) - 1 AS trend_return_12, close / nullif(lag(close, 48) OVER w, 0) - 1 AS trend_return_48, {roll('stddev_pop', 'pct', 20)} AS volatility_20, {roll('stddev_pop', 'pct', 60)} AS volatility_60,
  {z('poc_distance_ticks', 20)} AS poc_distance_zscore_20, {z('poc_shift_ticks', 20)} AS poc_shift_zscore_20, {z('open_interest_change', 20)} AS open_interest_zscore_20, {z('open_interest_change', 60)} AS open_interest_zscore_60,
  {z('open_interest_fracdiff_04', 60)} AS open_interest_fracdiff_zscore_60, (cvd - lag(cvd, 5) OVER w)::DOUBLE AS cvd_change_5, (cvd - lag(cvd, 10) OVER w)::DOUBLE AS cvd_change_10, (cvd - lag(cvd, 20) OVER w)::DOUBLE AS cvd_change_20 FROM f1 {W}),
feats AS (SELECT *, pct AS close_to_prev_close_return, open / nullif(pc, 0) - 1 AS gap_return, true_range_ticks / nullif({roll('avg', 'true_range_ticks', 20)}, 0) - 1 AS range_expansion_20,
  coalesce((high - greatest(open, close)) / nullif(rng, 0), 0) AS upper_shadow_ratio, coalesce((least(open, close) - low) / nullif(rng, 0), 0) AS lower_shadow_ratio,
  coalesce(((least(open, close) - low) - (high - greatest(open, close))) / nullif(rng, 0), 0) AS wick_imbalance, abs(delta_strength) AS abs_delta_strength, {z('delta', 20)} AS delta_zscore_20, {z('delta', 60)} AS delta_zscore_60,
  d1 AS delta_change_1, d1 - lag(d1, 3) OVER w AS delta_accel_3, cvd_change_20 / 20 AS cvd_slope_20, sign(close - open) * dd AS delta_price_agreement, CASE WHEN dir * dd < 0 THEN abs(delta_strength) ELSE 0 END AS delta_price_divergence,
  abs(poc_distance_ticks) AS abs_poc_distance_ticks, sign(close - poc)::DOUBLE AS close_above_poc, dir * sign(poc_shift_ticks) AS poc_price_agreement, 1 - coalesce(abs(close - poc) / nullif(rng, 0), 0) AS value_acceptance_ratio_0,
  volume::DOUBLE / nullif(lag(volume) OVER w, 0) - 1 AS volume_change_1, CASE WHEN volume_zscore_20 > 2 THEN 1.0 ELSE 0.0 END AS volume_burst_flag, coalesce(true_range_ticks / nullif(volume, 0), 0) AS range_per_volume,
  coalesce(pct / nullif(volume, 0), 0) AS return_per_volume, coalesce(abs(pct) / nullif(volume, 0), 0) AS amihud_like_illiquidity, delta / nullif({roll('avg', 'volume', 20)}, 0) AS volume_adjusted_delta,
  open_interest_change / nullif(lag(open_interest) OVER w, 0) AS open_interest_change_pct, dir * sign(open_interest_change) AS price_oi_state, dd * sign(open_interest_change) AS delta_oi_agreement, coalesce(open_interest_change / nullif(volume, 0), 0) AS oi_volume_ratio,
  sign(open_interest_fracdiff_04) * dd AS fracdiff_oi_delta_confirm, trend_return_48 / nullif(volatility_60 * sqrt(48), 0) AS trend_strength_48, volatility_20 / nullif(volatility_60, 0) AS volatility_ratio_20_60,
  CASE WHEN hour(datetime) >= 21 OR hour(datetime) < 9 THEN 1.0 ELSE 0.0 END AS is_night_session, sin(2 * pi() * (hour(datetime) * 60 + minute(datetime)) / 1440) AS minute_of_day_sin, cos(2 * pi() * (hour(datetime) * 60 + minute(datetime)) / 1440) AS minute_of_day_cos,
  delta_strength * close_location_value AS flow_at_bar_extreme, CASE WHEN dir * dd < 0 THEN abs(delta_strength) * dd ELSE 0 END AS absorption_score, abs(delta_strength) * abs(close_location_value) * CASE WHEN volume_zscore_20 IS NOT NULL THEN greatest(volume_zscore_20, 0) END AS exhaustion_score,
  sign(trend_return_12) * delta_strength AS trend_delta_confirm, poc_distance_zscore_20 * close_location_value AS poc_rejection_score, volume_zscore_20 * delta_strength AS volume_delta_confirm, open_interest_zscore_20 * delta_strength AS oi_delta_confirm,
  delta_strength / nullif(volatility_20, 0) AS volatility_adjusted_flow FROM f2 {W}),
exact AS (SELECT *, value_acceptance_ratio_0 AS value_acceptance_ratio FROM feats),
features AS (SELECT * REPLACE ({', '.join(f'round({f}::DOUBLE, 11) AS {f}' for names in GROUPS.values() for f in names)}) FROM exact)"""
LABEL_COLUMNS = f"""{', '.join(f'lead(close, {h}) OVER w / nullif(close, 0) - 1 AS future_return_{h}' for h in (1, 3, 5, 10))},
  CASE WHEN count(high) OVER f10 = 10 THEN max(high) OVER f10 END / nullif(close, 0) - 1 AS mfe_10_long, CASE WHEN count(low) OVER f10 = 10 THEN min(low) OVER f10 END / nullif(close, 0) - 1 AS mae_10_long,
  lead(open) OVER w AS entry_open_next, lead(close, 5) OVER w AS exit_close_after_5, lead(close, 5) OVER w / nullif(lead(open) OVER w, 0) - 1 AS trade_return_5_gross,
  lead(close, 5) OVER w / nullif(lead(open) OVER w, 0) - 1 - 2.0 / nullif(lead(open) OVER w, 0) AS trade_return_5_net"""
LABELLED = f"{FEATURES}, labelled AS (SELECT *, {LABEL_COLUMNS} FROM features {W})"
SPLIT = """cut AS (SELECT min(epoch_us(datetime)) + (max(epoch_us(datetime)) - min(epoch_us(datetime))) * 0.8 AS c FROM bars),
split AS (SELECT max(CASE WHEN epoch_us(datetime) <= c THEN datetime END) AS train_end, min(CASE WHEN epoch_us(datetime) > c THEN datetime END) AS test_start FROM bars, cut)"""
A = "row_number() OVER w"
PULLBACK = f"""{LABELLED},
p1 AS (SELECT *, {A} AS row_i, {roll('avg', 'true_range_ticks', 20)} AS atr20_ticks, {roll('min', 'low', 10)} AS pullback_low_10, {roll('max', 'high', 10)} AS pullback_high_10, lag(high) OVER w AS h1, lag(low) OVER w AS l1,
  lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2, lag(body_ratio) OVER w AS b1, lag(close_location_value) OVER w AS v1, lag(close_location_value, 2) OVER w AS v2, lag(bar_return) OVER w AS r1, lag(bar_return, 2) OVER w AS r2 FROM labelled {W}),
p2 AS (SELECT *, CASE WHEN row_i >= 60 THEN sum(CASE WHEN row_i = 1 THEN 1.0 ELSE 2.0 / 61 END * close * pow(1 - 2.0 / 61, 1 - row_i)) OVER so_far * pow(1 - 2.0 / 61, row_i - 1) END AS ema60,
  CASE WHEN count(close) OVER w60 = 60 THEN regr_slope(close, row_i) OVER w60 END AS slope, {roll('avg', 'close', 60)} AS mean60, {roll('max', 'h1', 20)} AS previous_swing_high_20, {roll('min', 'l1', 20)} AS previous_swing_low_20 FROM p1 {W}),
p3 AS (SELECT *, (ema60 - lag(ema60, 12) OVER w) / 12 AS ema60_slope_12_ticks, mean60 + slope * 29.5 AS trendline_60, slope AS trendline_slope_60_ticks, 0.5 * atr20_ticks AS tol, pullback_low_10 - 1 AS stop_price_signal, pullback_high_10 + 1 AS short_stop_price_signal,
  coalesce(close > open, false) AS bullish_bar_flag, coalesce(close < open, false) AS bearish_bar_flag, coalesce(body_ratio BETWEEN 0.2 AND 0.8, false) AS body_quality_flag,
  coalesce(close > open AND close_location_value >= 0.4, false) AS strong_bullish_close_flag, coalesce(close < open AND close_location_value <= -0.4, false) AS strong_bearish_close_flag,
  coalesce(b1 <= 0.35, false) OR coalesce(abs(v1) <= 0.2, false) AS small1 FROM p2 {W}),
p4 AS (SELECT *, coalesce(ema60_slope_12_ticks > 0, false) AND coalesce(trendline_slope_60_ticks > 0, false) AND coalesce(trend_return_48 > 0, false) AND coalesce(trend_strength_48 > 0, false) AS trend_filter_pass,
  coalesce(ema60_slope_12_ticks < 0, false) AND coalesce(trendline_slope_60_ticks < 0, false) AND coalesce(trend_return_48 < 0, false) AND coalesce(trend_strength_48 < 0, false) AS short_trend_filter_pass,
  coalesce(abs(low - ema60) <= tol AND close >= ema60, false) AS ema60_hold_flag, coalesce(abs(low - trendline_60) <= tol AND close >= trendline_60, false) AS trendline_hold_flag,
  coalesce(abs(high - ema60) <= tol AND close <= ema60, false) AS short_ema60_reject_flag, coalesce(abs(high - trendline_60) <= tol AND close <= trendline_60, false) AS short_trendline_reject_flag,
  close - ema60 AS distance_to_ema60_ticks, low - ema60 AS low_distance_to_ema60_ticks, close - trendline_60 AS distance_to_trendline_ticks, low - trendline_60 AS low_distance_to_trendline_ticks, tol AS adaptive_pullback_tolerance_ticks,
  ema60 - close AS short_distance_to_ema60_ticks, high - ema60 AS short_high_distance_to_ema60_ticks, trendline_60 - close AS short_distance_to_trendline_ticks, high - trendline_60 AS short_high_distance_to_trendline_ticks,
  coalesce(delta > 0 AND delta_strength > 0, false) AS delta_confirm_long, coalesce(delta < 0 AND delta_strength < 0, false) AS short_delta_confirm, coalesce(volume_zscore_20 >= -0.5, false) AS volume_normal_or_better_flag,
  coalesce(volume_zscore_20 >= 0, false) OR volume_burst_flag = 1 AS volume_expand_flag,
  bullish_bar_flag AND coalesce(c1 < o1, false) AND coalesce(open <= c1, false) AND coalesce(close >= o1, false) AS bullish_engulfing_flag, bearish_bar_flag AND coalesce(c1 > o1, false) AND coalesce(open >= c1, false) AND coalesce(close <= o1, false) AS bearish_engulfing_flag,
  coalesce(c2 < o2, false) AND small1 AND bullish_bar_flag AND coalesce(close > (o2 + c2) / 2, false) AS morning_star_proxy, coalesce(c2 > o2, false) AND small1 AND bearish_bar_flag AND coalesce(close < (o2 + c2) / 2, false) AS evening_star_proxy,
  (coalesce(r1 < 0, false) OR coalesce(r2 < 0, false) OR coalesce(v1 < -0.2, false) OR coalesce(v2 < -0.2, false)) AND strong_bullish_close_flag AND coalesce(bar_return > coalesce(r1, 0), false) AS weak_to_strong_3bar_flag,
  (coalesce(r1 > 0, false) OR coalesce(r2 > 0, false) OR coalesce(v1 > 0.2, false) OR coalesce(v2 > 0.2, false)) AND strong_bearish_close_flag AND coalesce(bar_return < coalesce(r1, 0), false) AS strong_to_weak_3bar_flag,
  coalesce(delta > 0 AND delta_strength > 0 AND delta_price_agreement >= 0 AND volume_zscore_20 >= -0.5, false) AS flow_confirm_pass, coalesce(delta < 0 AND delta_strength < 0 AND delta_price_agreement >= 0 AND volume_zscore_20 >= -0.5, false) AS short_flow_confirm_pass,
  close - stop_price_signal AS stop_distance_ticks_signal, previous_swing_high_20 - close AS reward_ticks_signal, short_stop_price_signal - close AS short_stop_distance_ticks_signal, close - previous_swing_low_20 AS short_reward_ticks_signal,
  volume > 0 AND entry_open_next IS NOT NULL AND exit_close_after_5 IS NOT NULL AS trade_ready FROM p3),
p5 AS (SELECT *, ema60_hold_flag OR trendline_hold_flag AS pullback_structure_pass, short_ema60_reject_flag OR short_trendline_reject_flag AS short_pullback_structure_pass, strong_bullish_close_flag AND body_quality_flag AND (bullish_engulfing_flag OR morning_star_proxy OR weak_to_strong_3bar_flag) AS kline_turn_pass, strong_bearish_close_flag AND body_quality_flag AND (bearish_engulfing_flag OR evening_star_proxy OR strong_to_weak_3bar_flag) AS short_kline_turn_pass,
  reward_ticks_signal / nullif(stop_distance_ticks_signal, 0) AS reward_to_risk_proxy, short_reward_ticks_signal / nullif(short_stop_distance_ticks_signal, 0) AS short_reward_to_risk_proxy FROM p4),
p6 AS (SELECT *, coalesce(previous_swing_high_20 > close AND stop_distance_ticks_signal BETWEEN 2 AND 30 AND reward_to_risk_proxy >= 1.5, false) AS space_filter_pass,
  coalesce(previous_swing_low_20 < close AND short_stop_distance_ticks_signal BETWEEN 2 AND 30 AND short_reward_to_risk_proxy >= 1.5, false) AS short_space_filter_pass FROM p5),
pullback AS (SELECT *, trend_filter_pass AS trend_only_pass, trend_filter_pass AND pullback_structure_pass AS trend_pullback_pass, trend_filter_pass AND pullback_structure_pass AND kline_turn_pass AS trend_pullback_kline_pass,
  trend_filter_pass AND pullback_structure_pass AND kline_turn_pass AND flow_confirm_pass AS trend_pullback_kline_flow_pass, trend_filter_pass AND pullback_structure_pass AND kline_turn_pass AND flow_confirm_pass AND space_filter_pass AS trend_pullback_full_space_pass FROM p6)"""


def shown(cte: str, body: str) -> str:
    return f"WITH RECURSIVE {cte}\n{body}"


#: Columns with names like those of flags that are numbers.
DOUBLES = ("volume_burst_flag", "trend_delta_confirm", "volume_delta_confirm", "oi_delta_confirm", "fracdiff_oi_delta_confirm")


def picked(cte: str, table: str, columns: list[str], places: int = 6, plain: tuple[str, ...] = ()) -> str:
    cols = ", ".join(c if c in plain or c.endswith(("_pass", "_flag", "_proxy", "_ready", "_confirm", "confirm_long")) and "reward" not in c and c not in DOUBLES else r(c, places=places) for c in columns)
    return shown(cte, f"SELECT contract, {T}, {cols} FROM {table}")


def long_of(table: str, names: list[str], keep: str) -> str:
    kept = ", ".join(k.split(" AS ")[-1] for k in keep.split(", "))
    return f"SELECT {kept}, feature, x FROM (SELECT {keep}, {', '.join(f'{f}::DOUBLE AS {f}' for f in names)} FROM {table}) UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(names)}))"


def edges(x: str = "x") -> str:
    return "list_sort(list_distinct([" + ", ".join(f"round(quantile_cont({x}, {q}), 12)" for q in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) + "]))"


def quintiles_of(source: str, keys: str) -> str:
    """The pairs of `source` with a target as known, and their quintiles, by keys."""
    on = " AND ".join(f"k.{x} = c.{x}" for x in keys.split(", "))
    return f"""known AS (SELECT * FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
cuts AS (SELECT {keys}, {edges()} AS e FROM known GROUP BY {keys}), placed AS (SELECT k.*, 1 + len(list_filter(e[2:len(e) - 1], lambda q: q + 1e-12 < x)) AS quintile FROM known k JOIN cuts c ON {on} WHERE len(e) > 1),
quintiles AS (SELECT {keys}, quintile::BIGINT AS quintile, count(*) AS n, avg(x) AS mx, avg(y) AS my, median(y) AS medy, avg((y > 0)::INT) AS win, avg(mfe) AS mmfe, avg(mae) AS mmae FROM placed GROUP BY ALL)"""


QUINTILES = f"long AS ({long_of('labelled', EVALUATED, 'future_return_5 AS y, mfe_10_long AS mfe, mae_10_long AS mae')}), {quintiles_of('long', 'feature')}"


def ranks(keys: str, source: str = "pairs") -> str:
    mid = lambda v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0"
    return f"ranked AS (SELECT *, {mid('x')} AS rx, {mid('y')} AS ry FROM {source})"


CORR = lambda a, b: f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
_Q = {"p001": 0.001, "p01": 0.01, "median": 0.5, "p99": 0.99, "p999": 0.999}
QUALITY = f"""quality AS (SELECT feature, count(x) AS non_null_count, count(*) - count(x) AS missing_count, 0::BIGINT AS inf_count, count(*) AS row_count, count(x) / count(*)::DOUBLE AS coverage, count(DISTINCT x) AS unique_count, stddev_pop(x) AS std, min(x) AS min,
  {', '.join(f'quantile_cont(x, {q}) AS {n}' for n, q in _Q.items())}, max(x) AS max FROM flong GROUP BY feature)"""
SCORE_NAMES = [f for fs in SCORED.values() for f in fs]
PARAMS = """both_of AS (SELECT contract, feature, x FROM plong WHERE x IS NOT NULL UNION ALL SELECT '__GLOBAL__', feature, x FROM plong WHERE x IS NOT NULL),
bounds AS (SELECT contract, feature, quantile_cont(x, 0.01) AS lower, quantile_cont(x, 0.99) AS upper FROM both_of GROUP BY ALL),
clipped AS (SELECT contract, feature, lower, upper, greatest(lower, least(x, upper)) AS x FROM both_of JOIN bounds USING (contract, feature)),
middle AS (SELECT contract, feature, any_value(lower) AS lower, any_value(upper) AS upper, median(x) AS med, avg(x) AS mean, stddev_pop(x) AS std FROM clipped GROUP BY ALL),
mads AS (SELECT contract, feature, median(abs(x - med)) AS mad FROM clipped JOIN middle USING (contract, feature) GROUP BY ALL),
params AS (SELECT contract, feature, lower, upper, CASE WHEN mad > 1e-12 THEN med ELSE mean END AS center, CASE WHEN mad > 1e-12 THEN 1.4826 * mad WHEN std > 1e-12 THEN std ELSE 1.0 END AS scale,
  CASE WHEN mad > 1e-12 THEN 'mad' WHEN std > 1e-12 THEN 'std' ELSE 'constant' END AS scale_type FROM middle JOIN mads USING (contract, feature))"""


def train_long(table: str, names: list[str]) -> str:
    return f"train AS (SELECT t.* FROM {table} t, split WHERE datetime <= train_end), plong AS ({long_of('train', names, 'contract')})"


ZS = f"""zlong AS ({long_of('features', SCORE_NAMES, 'contract, datetime')}),
zs AS (SELECT l.contract, l.datetime, l.feature, CASE WHEN x IS NOT NULL THEN greatest(coalesce(o.lower, g.lower), least(x, coalesce(o.upper, g.upper))) END AS clipped,
  (CASE WHEN x IS NOT NULL THEN greatest(coalesce(o.lower, g.lower), least(x, coalesce(o.upper, g.upper))) END - coalesce(o.center, g.center)) / nullif(coalesce(o.scale, g.scale), 0) AS z
  FROM zlong l LEFT JOIN params o ON o.contract = l.contract AND o.feature = l.feature LEFT JOIN params g ON g.contract = '__GLOBAL__' AND g.feature = l.feature)"""
_GROUP_OF = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{g}'" for g, fs in SCORED.items() for f in fs) + " END"
SCORE = f"""{LABELLED}, {SPLIT}, {train_long('labelled', SCORE_NAMES)}, {PARAMS}, {ZS},
pairs AS (SELECT * FROM ({long_of('train', SCORE_NAMES, 'future_return_5 AS y')}) t WHERE x IS NOT NULL AND y IS NOT NULL), {ranks('feature')},
ic AS (SELECT feature, CASE WHEN count(*) >= 20 THEN {CORR('rx', 'ry')} END AS ic, {_GROUP_OF} AS g FROM ranked GROUP BY feature),
weights AS (SELECT feature, g, coalesce(sign(ic), 0) * abs(coalesce(ic, 0)) / sum(abs(coalesce(ic, 0))) OVER (PARTITION BY g) AS w FROM ic),
by_group AS (SELECT contract, datetime, g, sum(z * w) AS s FROM zs JOIN weights USING (feature) GROUP BY ALL),
scores AS (SELECT contract, datetime, avg(s) AS signal_score FROM by_group GROUP BY ALL),
group_scores AS (SELECT contract, datetime, {', '.join(f"max(s) FILTER (g = '{g}') AS score_{g}" for g in SCORED)} FROM by_group GROUP BY ALL),
scored AS (SELECT l.*, signal_score, {', '.join(f'score_{g}' for g in SCORED)}, row_number() OVER (PARTITION BY l.contract ORDER BY l.datetime) - 1 AS i, lead(datetime) OVER (PARTITION BY l.contract ORDER BY l.datetime) AS entry_time,
  lead(datetime, 5) OVER (PARTITION BY l.contract ORDER BY l.datetime) AS exit_time FROM labelled l JOIN scores s USING (contract, datetime) JOIN group_scores gs USING (contract, datetime)),
limits AS (SELECT quantile_cont(true_range_ticks, 0.995) AS max_range, quantile_cont(abs(poc_shift_ticks), 0.995) AS max_poc_shift FROM scored, split WHERE datetime <= train_end),
risked AS (SELECT s.*, coalesce(signal_score IS NOT NULL AND volume > 0 AND true_range_ticks <= max_range AND abs(poc_shift_ticks) <= max_poc_shift AND entry_open_next IS NOT NULL AND exit_close_after_5 IS NOT NULL, false) AS risk_pass FROM scored s, limits)"""
NAMED = "CASE WHEN datetime <= train_end THEN 'train' WHEN datetime >= test_start THEN 'test' END"


def walk(keys: str) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    return f"""nexts AS (SELECT a.*, (SELECT min(b.i) FROM cand b WHERE {on('b', 'a')} AND b.i >= a.next_i) AS to_i FROM cand a),
walk AS (SELECT {keys}, min(i) AS i FROM nexts GROUP BY {keys} UNION ALL SELECT {', '.join('w.' + k for k in keys.split(', '))}, n.to_i FROM walk w JOIN nexts n ON {on('n', 'w')} AND n.i = w.i WHERE n.to_i IS NOT NULL),
trades AS (SELECT n.* FROM nexts n JOIN walk w ON {on('n', 'w')} AND n.i = w.i)"""


def fixed(high: float, low: float, ok: str, mirror: bool, cross: bool) -> str:
    short = "entry_price / exit_price - 1" if mirror else "1 - exit_price / entry_price"
    where = "" if cross else "AND NOT (datetime <= train_end AND exit_time >= test_start)"
    return f"""cuts AS (SELECT quantile_cont(signal_score, {high}) AS hi, quantile_cont(signal_score, {low}) AS lo FROM risked, split WHERE datetime <= train_end AND {ok}),
marked AS (SELECT *, CASE WHEN signal_score >= hi THEN 'long' WHEN signal_score <= lo THEN 'short' END AS side, {NAMED} AS split, entry_open_next AS entry_price, exit_close_after_5 AS exit_price FROM risked, cuts, split WHERE {ok}),
cand AS (SELECT contract, side, datetime AS signal_time, entry_time, exit_time, entry_price, exit_price, CASE WHEN side = 'long' THEN exit_price / entry_price - 1 ELSE {short} END AS gross_return, split, i, i + 5 AS next_i
  FROM marked WHERE side IS NOT NULL AND split IS NOT NULL AND exit_price IS NOT NULL AND entry_price > 0 {where}), {walk('contract')}, priced AS (SELECT *, gross_return - 2.0 / entry_price AS net_return FROM trades)"""


TRADES = f"{SCORE}, {fixed(0.85, 0.15, 'risk_pass', False, False)}"
_TIME = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
TRADE_ROWS = f"SELECT contract, side, {_TIME('signal_time')}, {_TIME('entry_time')}, {_TIME('exit_time')}, {r('entry_price')}, {r('exit_price')}, {r('gross_return')}, split, i::BIGINT AS i, {r('net_return')} FROM priced"
WITH_ALL = "alls AS (SELECT * FROM priced UNION ALL SELECT * REPLACE ('all' AS split) FROM priced)"


def metrics_of(source: str, keys: str) -> str:
    return f"""path AS (SELECT *, sum(net_return) OVER (PARTITION BY {keys} ORDER BY contract, signal_time ROWS UNBOUNDED PRECEDING) AS eq FROM {source}),
falls AS (SELECT *, eq - max(eq) OVER (PARTITION BY {keys} ORDER BY contract, signal_time ROWS UNBOUNDED PRECEDING) AS fall FROM path),
metrics AS (SELECT {keys}, count(*) AS trade_count, count(*) FILTER (side = 'long') AS long_count, count(*) FILTER (side = 'short') AS short_count, avg((net_return > 0)::INT) AS win_rate, avg(gross_return) AS avg_gross_return, avg(net_return) AS avg_net_return,
  median(net_return) AS median_net_return, sum(net_return) AS sum_net_return, CASE WHEN stddev_samp(net_return) > 0 THEN sqrt(count(*)) * avg(net_return) / stddev_samp(net_return) END AS sharpe, min(fall) AS max_drawdown FROM falls GROUP BY ALL)"""


def barriers(side: str, candidates: str) -> str:
    """candidates: SQL of rows of pullback with case_id, bars_n, stop_m, take_m."""
    long = side == "long"
    stop = "stop_price_signal" if long else "short_stop_price_signal"
    d = f"entry_price - {stop}" if long else f"{stop} - entry_price"
    s, t = ("b.low <= c.stop_price", "b.high >= c.take_profit_price") if long else ("b.high >= c.stop_price", "b.low <= c.take_profit_price")
    way = "-" if long else "+"
    other = "+" if long else "-"
    gross = "exit_price / entry_price - 1" if long else "1 - exit_price / entry_price"
    return f"""numbered AS (SELECT *, row_i - 1 AS i, lead(open) OVER w AS entry_price, lead(datetime) OVER w AS entry_time, count(*) OVER (PARTITION BY contract) AS n_rows FROM pullback {W}),
wanted AS ({candidates}),
sized AS (SELECT *, CASE WHEN {d} > 0 THEN {d} END AS d_sig, CASE WHEN stop_m * atr20_ticks > 0 THEN stop_m * atr20_ticks END AS d_atr FROM wanted WHERE i + bars_n < n_rows AND entry_price > 0),
barred AS (SELECT *, greatest(d_sig, d_atr, 1.0) AS dist FROM sized),
priced_c AS (SELECT *, CASE WHEN d_sig = dist THEN 'signal' WHEN d_atr = dist THEN 'atr' ELSE 'tick' END AS stop_distance_source, entry_price {way} dist AS stop_price, entry_price {other} take_m * dist AS take_profit_price FROM barred),
hits AS (SELECT c.case_id, c.contract, c.i, min(b.i) AS hit_i FROM priced_c c JOIN numbered b ON b.contract = c.contract AND b.i BETWEEN c.i + 1 AND c.i + c.bars_n WHERE {s} OR {t} GROUP BY ALL),
exits AS (SELECT c.*, coalesce(h.hit_i, c.i + c.bars_n) AS exit_i, h.hit_i IS NULL AS timed FROM priced_c c LEFT JOIN hits h ON h.case_id = c.case_id AND h.contract = c.contract AND h.i = c.i),
ended AS (SELECT c.*, b.datetime AS exit_time, CASE WHEN timed THEN 'time_barrier' WHEN {s} THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason,
  CASE WHEN timed THEN b.close WHEN {s} THEN {'least' if long else 'greatest'}(b.open, c.stop_price) ELSE c.take_profit_price END AS exit_price FROM exits c JOIN numbered b ON b.contract = c.contract AND b.i = c.exit_i),
cand AS (SELECT case_id, contract, '{side}' AS side, datetime AS signal_time, entry_time, exit_time, entry_price, exit_price, {gross} AS gross_return, exit_i - i AS holding_bars, exit_reason, stop_price, take_profit_price, stop_distance_source, {NAMED} AS split, i, exit_i + 1 AS next_i
  FROM ended, split WHERE ({NAMED}) IS NOT NULL AND NOT (datetime <= train_end AND exit_time >= test_start)), {walk('case_id, contract')}, priced AS (SELECT *, gross_return - 2.0 / entry_price AS net_return FROM trades)"""


ONE_CASE = lambda flag, n, s, t: f"SELECT *, 'one' AS case_id, {n} AS bars_n, {s} AS stop_m, {t} AS take_m FROM numbered WHERE {flag} AND trade_ready"
BARRIER = f"{PULLBACK}, {SPLIT}, {barriers('long', ONE_CASE('strong_bullish_close_flag', 5, 1.0, 2.0))}"
BARRIER_SHORT = f"{PULLBACK}, {SPLIT}, {barriers('short', ONE_CASE('strong_bearish_close_flag', 12, 0.5, 1.5))}"
BARRIER_ROWS = f"SELECT contract, side, {_TIME('signal_time')}, {_TIME('entry_time')}, {_TIME('exit_time')}, {r('entry_price')}, {r('exit_price')}, {r('gross_return')}, holding_bars::BIGINT AS holding_bars, exit_reason, {r('stop_price')}, {r('take_profit_price')}, stop_distance_source, split, i::BIGINT AS i, {r('net_return')} FROM priced"


COMBO_CAND = " UNION ALL ".join(f"SELECT *, '{c}' AS case_id, 5 AS bars_n, 1.0 AS stop_m, 2.0 AS take_m FROM numbered WHERE {c}_pass AND trade_ready" for c in COMBOS)
COMBO = f"{PULLBACK}, {SPLIT}, {barriers('long', COMBO_CAND)}"
RATIO_CAND = " UNION ALL ".join(f"SELECT *, '{x}' AS case_id, 5 AS bars_n, 1.0 AS stop_m, 2.0 AS take_m FROM numbered WHERE flow_confirm_pass AND trade_ready AND previous_swing_high_20 > close AND stop_distance_ticks_signal BETWEEN 2 AND 30 AND reward_to_risk_proxy >= {x}" for x in RATIOS)


def _case_rows() -> str:
    from tidebar.operators.sweep import grid

    keys = ["case_id", "time_i", "stop_i", "take_i", "time_barrier_bars", "stop_atr_multiple", "take_profit_multiple", "kline_mode", "space_filter_on"]
    rows = ", ".join("(" + ", ".join(repr(c[k]) if not isinstance(c[k], bool) else str(c[k]).lower() for k in keys) + ")" for c in grid())
    return f"cases AS (SELECT * FROM (VALUES {rows}) v({', '.join(keys)}))"


def sweep_sql(side: str) -> str:
    p, strong = ("", "strong_bullish_close_flag") if side == "long" else ("short_", "strong_bearish_close_flag")
    base = f"{p}trend_filter_pass AND {p}pullback_structure_pass AND {p}flow_confirm_pass AND trade_ready"
    mode = f"(kline_mode = 'none' OR kline_mode = 'strong_close_only' AND {strong} AND body_quality_flag OR kline_mode = 'full_patterns' AND {p}kline_turn_pass) AND (NOT space_filter_on OR {p}space_filter_pass)"
    cand = f"SELECT n.*, c.case_id, c.time_barrier_bars AS bars_n, c.stop_atr_multiple AS stop_m, c.take_profit_multiple AS take_m FROM numbered n, cases c WHERE {base} AND {mode}"
    return f"{PULLBACK}, {SPLIT}, {_case_rows()}, {barriers(side, cand)}"


CASE_SHOWN = "time_i::BIGINT AS time_i, stop_i::BIGINT AS stop_i, take_i::BIGINT AS take_i, time_barrier_bars::BIGINT AS time_barrier_bars, stop_atr_multiple::DOUBLE AS stop_atr_multiple, take_profit_multiple::DOUBLE AS take_profit_multiple, kline_mode, space_filter_on"


def cases_sql(side: str = "long", split: str = "train") -> str:
    return f"""{sweep_sql(side)}, {metrics_of(f"(SELECT * FROM priced WHERE split = '{split}')", 'case_id')},
summary AS (SELECT c.case_id, {CASE_SHOWN}, coalesce(trade_count, 0) AS trade_count, win_rate, avg_net_return, sum_net_return FROM cases c LEFT JOIN metrics m ON c.case_id = m.case_id)"""


CASES = cases_sql()
PLATEAU = """near AS (SELECT s.*, n.avg_net_return AS nn FROM summary s JOIN summary n ON s.kline_mode = n.kline_mode AND s.space_filter_on = n.space_filter_on AND abs(s.time_i - n.time_i) <= 1 AND abs(s.stop_i - n.stop_i) <= 1 AND abs(s.take_i - n.take_i) <= 1),
agg AS (SELECT case_id, count(*) AS neighbours, avg(nn) AS m, coalesce(stddev_samp(nn), 0) AS sd, avg((nn > 0)::INT) AS pos FROM near GROUP BY case_id),
plateaus AS (SELECT s.*, neighbours, m AS neighbour_mean, sd AS neighbour_std, pos AS neighbour_positive, m * pos * ln(1 + greatest(trade_count, 1)) / (sd + 0.1 * abs(m) + 1e-12) AS plateau_score FROM summary s JOIN agg USING (case_id))"""
SWEEP_ROWS = f"SELECT case_id, contract, side, {_TIME('signal_time')}, {_TIME('entry_time')}, {_TIME('exit_time')}, {r('entry_price')}, {r('exit_price')}, {r('gross_return')}, holding_bars::BIGINT AS holding_bars, exit_reason, {r('stop_price')}, {r('take_profit_price')}, stop_distance_source, split, i::BIGINT AS i, {r('net_return')} FROM priced"
MARGINAL = "count(*) AS cases, sum(trade_count)::BIGINT AS trade_count, round(avg(avg_net_return) + 1e-9, 6) + 0.0 AS mean_net_return, round(avg(win_rate) + 1e-9, 6) + 0.0 AS mean_win_rate, round(avg((avg_net_return > 0)::INT) + 1e-9, 6) + 0.0 AS positive_share"


def finding(category: str, checks: list[tuple[str, str, str]], source: str) -> str:
    status = {"BLOCKER": "FAIL", "WARNING": "WARN"}
    return " UNION ALL ".join(f"SELECT '{s}' AS severity, '{category}' AS category, '{k}' AS check_id, CASE WHEN n = 0 THEN 'PASS' ELSE '{status.get(s, 'INFO')}' END AS status, n AS affected_rows FROM (SELECT count(*) FILTER ({c}) AS n FROM {source})" for k, s, c in checks)


_CORE = ("contract", "datetime", "open", "high", "low", "close", "volume", "poc", "delta", "open_interest")
_SUM = lambda check, severity, x, source: f" UNION ALL SELECT '{severity}', 'integrity', '{check}', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, n FROM (SELECT {x} AS n FROM {source})"
_SORTED = f"(SELECT *, lag(datetime) OVER w AS prev FROM bars {W})"
INTEGRITY = finding(
    "integrity",
    [
        ("duplicate_key", "BLOCKER", "datetime = prev"), ("invalid_time", "BLOCKER", "datetime IS NULL"), ("null_price", "BLOCKER", "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL"), ("ohlc_order", "BLOCKER", "high < greatest(open, close) OR low > least(open, close) OR high < low"),
        ("negative_volume", "BLOCKER", "volume < 0"), ("zero_volume", "OBSERVATION", "volume = 0"), ("negative_open_interest", "BLOCKER", "open_interest < 0"), ("delta_bound", "BLOCKER", "abs(delta) > volume"), ("poc_in_range", "BLOCKER", "poc > high OR poc < low"),
    ],
    _SORTED,
) + _SUM("core_columns", "BLOCKER", "0::BIGINT", "(SELECT 1)") + _SUM("time_order", "BLOCKER", "count(DISTINCT contract) FILTER (datetime = prev)", _SORTED) + _SUM("core_nulls", "BLOCKER", "(" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _CORE) + ")", "bars") + _SUM(
    "infinite_values", "BLOCKER", "(" + " + ".join(f"count(*) FILTER (isinf({c}))" for c in ("open", "high", "low", "close", "poc")) + ")", "bars"
)
HEAD = lambda names: finding("isolation", [(f"head_null_{v}", "BLOCKER", f"row_i <= {n} AND {v} IS NOT NULL") for v, n in names.items()], "pullback")
BAR_SHOWN = ", ".join([r("open"), r("high"), r("low"), r("close"), "volume", r("poc"), "delta", "open_interest"])
LABEL_DIFF = lambda v, off="0": f"SELECT '{v}' AS column_name, count(*) FILTER (hour(datetime) = 3) AS only_expected, 0::BIGINT AS only_actual, count(*) FILTER (hour(datetime) <> 3 AND abs({off}) > 1e-10 AND {v} IS NOT NULL) AS mismatch_count, 0::BIGINT AS null_mismatch_count FROM labels"
TAIL = HORIZONS
LABELS_ONLY = f"{BARS}, labels AS (SELECT *, {LABEL_COLUMNS} FROM bars {W})"

_FILL = lambda x: f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY contract ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)"
RAW_TICKS = f"""{TICKS}, quotes AS (SELECT 'SHFE.cu240' || contract[2:] AS contract, event_id, ts, CASE WHEN event_id % 13 <> 0 THEN price END AS lp, level + 5 AS highest, CASE WHEN event_id % 7 <> 0 THEN level END AS lo, CASE WHEN event_id % 11 <> 0 THEN level - 1 END AS bid0,
  level + 1 AS ask, sum(qty) OVER (PARTITION BY contract, ts::DATE ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS volume, 100000 + sum(oi) OVER (PARTITION BY contract ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS interest_level FROM ticks),
filled AS (SELECT *, {_FILL('lp')} AS last_price, {_FILL('lo')} AS lowest, {_FILL('bid0')} AS bid FROM quotes), sessions(b, e) AS (VALUES (32400, 36900), (37800, 41400), (48600, 54000), (75600, 90000)),
based AS (SELECT *, CASE WHEN hour(ts) < 8 THEN ts::DATE - 1 ELSE ts::DATE END AS day FROM filled WHERE highest >= lowest AND highest <> 0 AND lowest <> 0 AND last_price <> 0 AND bid <> 0 AND ask <> 0),
inside AS (SELECT *, epoch_ms(day::TIMESTAMP) + b * 1000 AS begin_ms, epoch_us(ts) // 1000 AS wall_ms FROM based, sessions WHERE epoch_us(ts) // 1000 - epoch_ms(day::TIMESTAMP) BETWEEN b * 1000 AND e * 1000),
paired AS (SELECT *, lag(ts) OVER o AS pt, lag(volume) OVER o AS pv, lag(interest_level) OVER o AS pi, lag(bid) OVER o AS pb, lag(ask) OVER o AS pa FROM inside WINDOW o AS (PARTITION BY contract ORDER BY event_id)),
sized AS (SELECT *, CASE WHEN volume >= pv THEN volume - pv WHEN epoch_us(ts) - epoch_us(pt) > 600000000 THEN volume ELSE 0 END AS qty, interest_level - pi AS oi_change FROM paired WHERE pt IS NOT NULL),
named AS (SELECT *, CASE WHEN oi_change = 0 AND qty = 0 THEN 'NONE' WHEN oi_change = 0 THEN 'EXCHANGE' WHEN oi_change > 0 AND oi_change = qty THEN 'DOUBLEOPEN' WHEN oi_change > 0 THEN 'OPEN' WHEN oi_change + qty = 0 THEN 'DOUBLECLOSE' ELSE 'CLOSE' END AS interest,
  CASE WHEN last_price >= pa THEN 'UP' WHEN last_price <= pb THEN 'DOWN' WHEN last_price >= ask THEN 'UP' WHEN last_price <= bid THEN 'DOWN' ELSE 'MIDDLE' END AS way FROM sized),
typed AS (SELECT *, CASE WHEN interest IN ('OPEN', 'CLOSE', 'EXCHANGE') THEN interest || CASE WHEN way = 'MIDDLE' THEN 'UNKNOWN' WHEN interest = 'CLOSE' THEN CASE way WHEN 'UP' THEN 'SHORT' ELSE 'LONG' END WHEN way = 'UP' THEN 'LONG' ELSE 'SHORT' END ELSE interest END AS tick_type FROM named),
sided AS (SELECT *, CASE WHEN tick_type IN ('OPENLONG', 'CLOSESHORT', 'EXCHANGELONG') THEN 1 WHEN tick_type IN ('OPENSHORT', 'CLOSELONG', 'EXCHANGESHORT') THEN -1 ELSE 0 END AS side FROM typed)"""
_MS = lambda x, n: f"strftime(epoch_ms({x}::BIGINT), '%Y-%m-%d %H:%M:%S') AS {n}"



def tick_bars_sql(minutes: int) -> str:
    """Windows one after the other: each begins with the first tick at or after the end of the last. Multiples of the width are those of epoch time, 8 hours before wall time."""
    width = minutes * 60_000
    begin = f"greatest((wall_ms - 28800000) // {width} * {width} + 28800000, begin_ms)"
    return shown(
        f"""{RAW_TICKS}, starts AS MATERIALIZED (SELECT contract, wall_ms, min(begin_ms) AS begin_ms FROM sided GROUP BY ALL),
chain AS (SELECT contract, min(wall_ms) AS at, arg_min({begin}, wall_ms) AS w FROM starts GROUP BY contract
  UNION ALL SELECT n.contract, min(n.wall_ms), arg_min({begin}, n.wall_ms) FROM chain c JOIN starts n ON n.contract = c.contract AND n.wall_ms >= c.w + {width} GROUP BY n.contract, c.w),
windowed AS (SELECT s.*, c.w FROM sided s ASOF JOIN chain c ON s.contract = c.contract AND s.wall_ms >= c.at),
ladders AS (SELECT contract, w, last_price AS level, sum(CASE WHEN side <> 0 THEN qty ELSE 0 END) AS v FROM windowed GROUP BY ALL), peaks AS (SELECT contract, w, arg_max(level, {{'v': v, 'l': -level}}) AS poc FROM ladders GROUP BY ALL)""",
        f"SELECT s.contract, strftime(date_trunc('minute', min(ts)), '%Y-%m-%d %H:%M:%S') AS datetime, {r('arg_min(last_price, event_id)', 'open')}, {r('max(last_price)', 'high')}, {r('min(last_price)', 'low')}, {r('arg_max(last_price, event_id)', 'close')}, sum(qty)::BIGINT AS volume, {r('any_value(poc)', 'poc')}, "
        "sum(qty * side)::BIGINT AS delta, arg_max(interest_level, event_id)::BIGINT AS open_interest FROM windowed s JOIN peaks p ON p.contract = s.contract AND p.w = s.w GROUP BY s.contract, s.w",
    )


#: Every level of a bar; those without trades have nothing bought or sold.
GRID = """spans AS (SELECT contract, datetime, unnest(generate_series(min(level)::BIGINT, max(level)::BIGINT))::DOUBLE AS level FROM ladder GROUP BY contract, datetime),
grid AS (SELECT s.contract, s.datetime, s.level, coalesce(l.buy, 0) AS buy, coalesce(l.sell, 0) AS sell FROM spans s LEFT JOIN ladder l ON l.contract = s.contract AND l.datetime = s.datetime AND l.level = s.level)"""


def p_of(z: str) -> str:
    """2 (1 - Phi(|z|)) by Simpson's rule over the normal density."""
    end = f"least(abs({z}), 12)"
    return f"CASE WHEN ({z}) IS NOT NULL THEN greatest(0, 1 - sqrt(2 / pi()) * {end} / 3000 * list_sum(list_transform(range(0, 1001), lambda k: (CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({end} * k / 1000, 2) / 2)))) END"


def bootstrap_sql(part: str, group: str, source: str, keys: str) -> str:
    """Means of 500 samples of moving blocks: tables of `source` (keys, sums by place) and `group` (keys, n, size)."""
    on = lambda a: " AND ".join(f"{a}.{k} = b.{k}" for k in keys.split(", "))
    return f"""(SELECT {keys}, sample, sum(t.s - f.s) / any_value(n) AS m FROM (SELECT *, start + least(size, n - block * size) AS stop FROM (SELECT g.*, sample, block, (('0x' || substr(sha256('20260528:{part}:' || sample || ':' || block), 1, 8))::BIGINT * (n - size + 1)) >> 32 AS start
  FROM (SELECT *, unnest(range(ceil(n / size)::BIGINT)) AS block FROM {group}) g, range(500) x(sample))) b JOIN {source} f ON f.i = b.start AND {on('f')} JOIN {source} t ON t.i = b.stop AND {on('t')} GROUP BY ALL)""".replace(f"SELECT {keys}, sample", f"SELECT {', '.join('b.' + k for k in keys.split(', '))}, sample", 1)


def interval(q: str) -> str:
    return f"{r(f'quantile_cont(m, {q[0]})', 'low')}, {r(f'quantile_cont(m, {q[1]})', 'high')}"


def running_sums(rows: str, key: str) -> str:
    return f"(SELECT {key}, row_number() OVER o AS i, sum(net_return) OVER (o ROWS UNBOUNDED PRECEDING) AS s FROM {rows} WINDOW o AS (PARTITION BY {key} ORDER BY exit_time, contract, signal_time) UNION ALL SELECT DISTINCT {key}, 0, 0.0 FROM {rows})"


#: The adaptive mean row by row, each step rounded to two places.
KAMA = f"""{BARS}, stepped AS (SELECT *, row_number() OVER w AS n, abs(close - lag(close) OVER w) AS step, lag(close, 3) OVER w AS c3, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
  max(close) OVER (PARTITION BY contract ORDER BY datetime ROWS 20 PRECEDING) AS up, min(close) OVER (PARTITION BY contract ORDER BY datetime ROWS 20 PRECEDING) AS down FROM bars {W}),
paced AS (SELECT *, pow(CASE WHEN noise <> 0 THEN abs(close - c3) / noise ELSE 0 END * (2.0::DOUBLE / 11 - 2.0::DOUBLE / 51) + 2.0::DOUBLE / 51, 2) AS smooth, lag(close) OVER (PARTITION BY contract ORDER BY n) AS c1 FROM (SELECT *, sum(step) OVER (PARTITION BY contract ORDER BY n ROWS 2 PRECEDING) AS noise FROM stepped)),
kr AS (SELECT contract, n, round_even(c1 + smooth * (close - c1), 2) AS k FROM paced WHERE n = 4 UNION ALL SELECT r.contract, r.n + 1, round_even(k + smooth * (close - k), 2) FROM kr r JOIN paced b ON b.contract = r.contract AND b.n = r.n + 1)"""

ORACLES: dict[str, str] = {
    "bars_hourly": shown(BARS, f"SELECT contract, {T}, {BAR_SHOWN} FROM bars"),
    "bars_from_lineitem": f"""WITH ticks AS (SELECT 'P' || (l_partkey % 16)::VARCHAR AS contract, date_trunc('day', l_shipdate) AS datetime, l_orderkey AS o, l_linenumber AS n, floor(l_extendedprice / nullif(l_quantity, 0) * 10) / 10 AS price, l_quantity::BIGINT AS qty,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS side FROM lineitem), priced AS (SELECT *, floor(price / 100) * 100 AS level FROM ticks),
levels AS (SELECT contract, datetime, level, sum(CASE WHEN side <> 0 THEN qty ELSE 0 END) AS v FROM priced GROUP BY ALL), pocs AS (SELECT contract, datetime, arg_max(level, {{'v': v, 'l': -level}}) AS poc FROM levels GROUP BY ALL),
hours AS (SELECT contract, datetime, arg_min(price, {{'o': o, 'n': n}}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {{'o': o, 'n': n}}) AS close, sum(qty)::BIGINT AS volume, sum(qty * side)::BIGINT AS delta FROM priced GROUP BY ALL)
SELECT h.contract, strftime(h.datetime, '%Y-%m-%d %H:%M:%S') AS datetime, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, {r('poc')}, delta FROM hours h JOIN pocs p ON h.contract = p.contract AND h.datetime = p.datetime""",
    "ticks_in_session": shown(RAW_TICKS, f"SELECT contract, event_id, {_MS('wall_ms', 'wall')}, {_MS('begin_ms', 'session_begin')}, strftime(day, '%Y-%m-%d') AS trading_day, {r('last_price')}, {r('lowest')}, {r('bid', 'bid_price1')}, {r('volume')} FROM inside"),
    "ticks_between_sessions": shown(
        f"{RAW_TICKS}, dated AS (SELECT contract, event_id, epoch_us(ts) // 1000 AS ms, epoch_ms(CASE WHEN hour(ts) < 8 THEN (ts::DATE - 1)::TIMESTAMP ELSE ts::DATE::TIMESTAMP END) AS base FROM quotes)",
        f"SELECT contract, event_id, {_MS('(SELECT min(base + b * 1000) FROM sessions WHERE base + b * 1000 > ms)', 'next_begin')}, {_MS('base + 90000000', 'last_end')} FROM dated WHERE NOT EXISTS (FROM sessions WHERE ms - base BETWEEN b * 1000 AND e * 1000)",
    ),
    "ticks_classified": shown(RAW_TICKS, f"SELECT contract, event_id, {r('qty')}, {r('oi_change')}, interest, way, tick_type, side::BIGINT AS side FROM sided"),
    "bars_from_ticks": tick_bars_sql(5), "bars_from_ticks_60": tick_bars_sql(60), "bars_from_ticks_7": tick_bars_sql(7),
    "price_ladder": shown(f"{TICKS}, {LADDER}", f"SELECT contract, {T}, {r('level')}, buy, sell, other FROM ladder"),
    "poc_by_bar": shown(BARS, f"SELECT contract, {T}, {r('poc')} FROM bars"),
    "imbalance_runs": shown(
        f"""{TICKS}, {LADDER}, {GRID}, flags AS (SELECT contract, datetime, level, 'buy' AS side, CASE WHEN sell > 0 THEN buy / sell::DOUBLE >= 1 ELSE buy >= 1 END AS f FROM grid UNION ALL SELECT contract, datetime, level, 'sell', CASE WHEN buy > 0 THEN sell / buy::DOUBLE >= 1 ELSE sell >= 1 END FROM grid),
rolled AS (SELECT *, sum(f::INT) OVER (PARTITION BY contract, datetime, side ORDER BY level ROWS 1 PRECEDING) = 2 AS run FROM flags), ends AS (SELECT *, level - row_number() OVER (PARTITION BY contract, datetime, side ORDER BY level) AS g FROM rolled WHERE run)""",
        f"SELECT contract, {T}, side, round(min(level) - 1 + 1e-9, 6) AS low_level, round(max(level) + 1e-9, 6) AS high_level, count(*) + 1 AS levels, round(min(level) + 1e-9, 6) AS from_level FROM ends GROUP BY contract, ends.datetime, side, g",
    ),
    "price_grid": shown(f"{TICKS}, {LADDER}, {GRID}", f"SELECT contract, {T}, {r('level')}, buy, sell FROM grid"),
    "tick_direction_class": shown(
        f"""{TICKS}, prev AS (SELECT *, level - 1 AS bid, level + 1 AS ask, lag(level - 1) OVER (PARTITION BY contract ORDER BY ts, event_id) AS pb, lag(level + 1) OVER (PARTITION BY contract ORDER BY ts, event_id) AS pa FROM ticks),
classed AS (SELECT *, CASE WHEN oi = 0 AND qty = 0 THEN 'NONE' WHEN oi = 0 THEN 'EXCHANGE' WHEN oi > 0 AND oi = qty THEN 'DOUBLEOPEN' WHEN oi > 0 THEN 'OPEN' WHEN oi + qty = 0 THEN 'DOUBLECLOSE' ELSE 'CLOSE' END AS interest,
  CASE WHEN price >= pa THEN 'UP' WHEN price <= pb THEN 'DOWN' WHEN price >= ask THEN 'UP' WHEN price <= bid THEN 'DOWN' ELSE 'MIDDLE' END AS way FROM prev WHERE pb IS NOT NULL),
types(interest, way, tick_type, s) AS (VALUES ('OPEN', 'UP', 'OPENLONG', 1), ('OPEN', 'DOWN', 'OPENSHORT', -1), ('OPEN', 'MIDDLE', 'OPENUNKNOWN', 0), ('CLOSE', 'UP', 'CLOSESHORT', 1), ('CLOSE', 'DOWN', 'CLOSELONG', -1), ('CLOSE', 'MIDDLE', 'CLOSEUNKNOWN', 0),
  ('EXCHANGE', 'UP', 'EXCHANGELONG', 1), ('EXCHANGE', 'DOWN', 'EXCHANGESHORT', -1), ('EXCHANGE', 'MIDDLE', 'EXCHANGEUNKNOWN', 0))""",
        "SELECT c.contract, c.interest, c.way, coalesce(tick_type, c.interest) AS tick_type, coalesce(s, 0)::BIGINT AS side, count(*) AS ticks, sum(qty)::BIGINT AS qty FROM classed c LEFT JOIN types t ON c.interest = t.interest AND c.way = t.way GROUP BY ALL",
    ),
    "session_semi_join": shown(
        f"{TICKS}, hrs(session, b, e) AS (VALUES {', '.join(f'({k}, {b}, {e})' for k, (b, e) in enumerate(SESSIONS))}), based AS (SELECT *, CASE WHEN hour(ts) < 8 THEN ts::DATE - 1 ELSE ts::DATE END AS d, hour(ts) + CASE WHEN hour(ts) < 8 THEN 24 ELSE 0 END AS h FROM ticks)",
        "SELECT contract, strftime(d, '%Y-%m-%d') AS trading_day, session::BIGINT AS session, count(*) AS ticks, sum(qty)::BIGINT AS qty FROM based JOIN hrs ON h BETWEEN b AND e GROUP BY ALL",
    ),
    **{f"features_{g}": picked(FEATURES, "features", names, 4 if g == "open_interest" else 6) for g, names in GROUPS.items()},
    "stage1_features": shown(
        f"""{FEATURES}, s1 AS (SELECT *, rng AS range_ticks, coalesce((close - low) / nullif(rng, 0), 0.5) AS close_position, delta_price_agreement AS price_delta_agreement FROM features)""",
        f"SELECT contract, {T}, {', '.join(r(c) for c in STAGE1)} FROM s1",
    ),
    "labels_forward": shown(LABELS_ONLY, f"SELECT contract, {T}, {', '.join(r(c) for c in LABELS)} FROM labels"),
    "ema60": picked(PULLBACK, "pullback", ["ema60", "ema60_slope_12_ticks"]),
    "trendline60": picked(PULLBACK, "pullback", ["trendline_60", "trendline_slope_60_ticks"]),
    "pullback_features": picked(PULLBACK, "pullback", PULLBACK_SHOWN, plain=("morning_star_proxy",)),
    "short_mirror_features": picked(PULLBACK, "pullback", SHORT_SHOWN, plain=("evening_star_proxy",)),
    "feature_quality": shown(f"{FEATURES}, flong AS ({long_of('features', EVALUATED, '1 AS one')}), {QUALITY}", f"SELECT feature, non_null_count, missing_count, inf_count, row_count, {r('coverage')}, unique_count, {', '.join(r(c) for c in ('std', 'min', *_Q, 'max'))} FROM quality"),
    "feature_quintiles": shown(f"{LABELLED}, {QUINTILES}", f"SELECT feature, quintile, n AS count, {r('mx', 'mean_feature')}, {r('my', 'mean_return')}, {r('medy', 'median_return')}, {r('win', 'win_rate')}, {r('mmfe', 'mean_mfe_10_long')}, {r('mmae', 'mean_mae_10_long')} FROM quintiles"),
    "periodic_ic": shown(
        f"{LABELLED}, dated AS (SELECT *, strftime(datetime, '%Y-%m-%d') AS period FROM labelled), plong AS ({long_of('dated', EVALUATED, 'period, future_return_5 AS y')}), pairs AS (SELECT * FROM plong WHERE x IS NOT NULL AND y IS NOT NULL), {ranks('period, feature')}",
        f"SELECT period, feature, count(*) AS count, {r(CORR('x', 'y'), 'pearson_ic')}, {r(CORR('rx', 'ry'), 'spearman_ic')} FROM ranked GROUP BY ALL HAVING count(*) >= 20",
    ),
    "feature_summary": shown(
        f"{LABELLED}, {SPLIT}, named AS (SELECT l.*, {NAMED} AS sp FROM labelled l, split), both_of AS (SELECT *, sp AS split FROM named WHERE sp IS NOT NULL UNION ALL SELECT *, 'all' FROM named WHERE sp IS NOT NULL), "
        f"long AS MATERIALIZED ({long_of('both_of', EVALUATED, 'split, future_return_5 AS y, mfe_10_long AS mfe, mae_10_long AS mae')}), {quintiles_of('long', 'split, feature')}, {ranks('split, feature', 'known')}, "
        f"ics AS (SELECT split, feature, CASE WHEN count(*) >= 20 THEN {CORR('x', 'y')} END AS p, CASE WHEN count(*) >= 20 THEN {CORR('rx', 'ry')} END AS s FROM ranked GROUP BY ALL), "
        "facts AS (SELECT split, feature, count(x) AS non_null_count, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS valid_count, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*)::DOUBLE AS coverage, count(DISTINCT x) FILTER (y IS NOT NULL) AS unique_count FROM long GROUP BY ALL), "
        "ends AS (SELECT split, feature, max(my) FILTER (quintile = 5) - max(my) FILTER (quintile = 1) AS d, max(win) FILTER (quintile = 5) AS w, max(mmfe) FILTER (quintile = 5) AS f, max(mmae) FILTER (quintile = 5) AS a FROM quintiles GROUP BY ALL)",
        f"SELECT split, feature, non_null_count, valid_count, {r('coverage')}, unique_count, 0::BIGINT AS inf_count, {r('p', 'pearson_ic')}, {r('s', 'spearman_ic')}, {r('d', 'quintile_spread')}, {r('CASE WHEN d IS NOT NULL THEN w END', 'top_quintile_win_rate')}, {r('CASE WHEN d IS NOT NULL THEN f END', 'top_quintile_mean_mfe')}, "
        f"{r('CASE WHEN d IS NOT NULL THEN a END', 'top_quintile_mean_mae')}, {r('abs(s)', 'abs_spearman_ic')}, {r('coalesce(sign(s), 0)::DOUBLE', 'ic_direction')} FROM facts LEFT JOIN ics USING (split, feature) LEFT JOIN ends USING (split, feature)",
    ),
    "correlation_pairs": shown(
        f"{FEATURES}, clong AS ({long_of('features', EVALUATED, 'contract, datetime')}), cr AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY feature, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 END AS rk FROM clong), "
        + f"cp AS (SELECT a.feature AS feature_a, b.feature AS feature_b, a.x AS xa, b.x AS xb, a.rk AS ra, b.rk AS rb FROM cr a JOIN cr b ON a.contract = b.contract AND a.datetime = b.datetime WHERE list_position({EVALUATED!r}, a.feature) < list_position({EVALUATED!r}, b.feature) AND a.x IS NOT NULL AND b.x IS NOT NULL)",
        f"SELECT l.f AS feature_a, m.f AS feature_b, {r('p', 'pearson_corr')}, {r('s', 'spearman_corr')} FROM (SELECT unnest({EVALUATED!r}) AS f) l JOIN (SELECT unnest({EVALUATED!r}) AS f) m ON list_position({EVALUATED!r}, l.f) < list_position({EVALUATED!r}, m.f) "
        f"LEFT JOIN (SELECT feature_a, feature_b, CASE WHEN count(*) >= 20 THEN {CORR('xa', 'xb')} END AS p, CASE WHEN count(*) >= 20 THEN {CORR('ra', 'rb')} END AS s FROM cp GROUP BY ALL) c ON c.feature_a = l.f AND c.feature_b = m.f",
    ),
    "time_split": shown(f"{BARS}, {SPLIT}", f"SELECT {_TIME('train_end')}, {_TIME('test_start')} FROM split"),
    "winsor_params": shown(f"{FEATURES}, {SPLIT}, {train_long('features', EVALUATED)}, {PARAMS}", f"SELECT contract, feature, {', '.join(r(c) for c in ('lower', 'upper', 'center', 'scale'))}, scale_type FROM params"),
    "zscore_apply": shown(f"{FEATURES}, {SPLIT}, {train_long('features', SCORE_NAMES)}, {PARAMS}, {ZS}", f"SELECT contract, {T}, feature, {r('clipped')}, {r('z')} FROM zs"),
    "signal_score": shown(SCORE, f"SELECT contract, {T}, {r('signal_score')} FROM scored"),
    "risk_filter": shown(SCORE, f"SELECT {NAMED} AS split, count(*) AS row_count, count(*) FILTER (risk_pass) AS passed FROM risked, split GROUP BY 1"),
    "score_thresholds": shown(SCORE, "SELECT round(quantile_cont(signal_score, 0.85) + 1e-9, 6) AS long_threshold, round(quantile_cont(signal_score, 0.15) + 1e-9, 6) AS short_threshold, round(any_value(max_range) + 1e-9, 6) AS max_range, round(any_value(max_poc_shift) + 1e-9, 6) AS max_poc_shift FROM risked, split, limits WHERE datetime <= train_end AND risk_pass"),
    "trades_fixed_hold": shown(TRADES, TRADE_ROWS),
    "trades_stage1": shown(f"{SCORE}, {fixed(0.8, 0.2, 'signal_score IS NOT NULL', True, True)}", TRADE_ROWS),
    "strategy_metrics": shown(f"{TRADES}, {WITH_ALL}, {metrics_of('alls', 'split')}", f"SELECT split, trade_count, long_count, short_count, {', '.join(r(c) for c in ('win_rate', 'avg_gross_return', 'avg_net_return', 'median_net_return', 'sum_net_return', 'sharpe', 'max_drawdown'))} FROM metrics"),
    "equity_curve": shown(TRADES, f"SELECT split, contract, {_TIME('signal_time')}, {_TIME('exit_time')}, round(sum(net_return) OVER (PARTITION BY split ORDER BY priced.exit_time, contract, priced.signal_time ROWS UNBOUNDED PRECEDING) + 1e-9, 6) + 0.0 AS equity FROM priced"),
    "overlap_check": shown(TRADES, "SELECT contract, count(*) AS trade_count, count(*) FILTER (nxt < exit_time) AS overlap_count FROM (SELECT *, lead(entry_time) OVER (PARTITION BY contract ORDER BY signal_time) AS nxt FROM priced) GROUP BY contract"),
    "cost_sensitivity": shown(
        f"{TRADES}, {WITH_ALL}, costed AS (SELECT a.* REPLACE (gross_return - c / entry_price AS net_return), c AS cost_ticks FROM alls a, (VALUES (1.0::DOUBLE), (2.0), (3.0), (4.0)) v(c)), {metrics_of('costed', 'cost_ticks, split')}",
        f"SELECT {r('cost_ticks')}, split, trade_count, {r('win_rate')}, {r('avg_net_return')}, {r('sum_net_return')}, {r('max_drawdown')} FROM metrics",
    ),
    "periodic_trades": shown(TRADES, "SELECT split, strftime(exit_time, '%Y-%m-%d') AS month, count(*) AS trade_count, round(avg((net_return > 0)::INT) + 1e-9, 6) AS win_rate, round(avg(net_return) + 1e-9, 6) + 0.0 AS avg_net_return, round(sum(net_return) + 1e-9, 6) + 0.0 AS sum_net_return FROM priced GROUP BY ALL"),
    "sample_confidence": shown(
        f"{TRADES}, {WITH_ALL}, {metrics_of('alls', 'split')}, se AS (SELECT *, sqrt(win_rate * (1 - win_rate) / trade_count) AS e FROM metrics)",
        f"SELECT split, trade_count, {r('win_rate')}, {r('e', 'win_rate_se')}, {r('greatest(0, win_rate - 1.96 * e)', 'win_rate_low')}, {r('least(1, win_rate + 1.96 * e)', 'win_rate_high')}, CASE WHEN split = 'test' AND trade_count < 100 THEN 'insufficient_samples' WHEN split = 'test' AND trade_count < 300 THEN 'low_confidence' ELSE 'enough_samples' END AS sample_status FROM se",
    ),
    "win_rate_tests": shown(
        f"{TRADES}, {WITH_ALL}, {metrics_of('alls', 'split')}, rate_z AS (SELECT *, (win_rate - 0.5) / sqrt(0.25 / trade_count) AS z FROM metrics), rate_p AS (SELECT *, {p_of('z')} AS p FROM rate_z)",
        f"SELECT split, trade_count, {r('win_rate')}, {r('z', 'win_rate_z')}, {r('p', 'win_rate_p')}, {r('CASE WHEN p IS NOT NULL THEN least(1, p * 768) END', 'win_rate_p_bonferroni')}, CASE WHEN split <> 'test' OR p IS NULL THEN 'not_tested' WHEN least(1, p * 768) >= 0.05 THEN 'not_significant' WHEN z > 0 THEN 'passes_bonferroni' ELSE 'significant_below_50' END AS win_rate_verdict FROM rate_p",
    ),
    "bootstrap_interval": shown(
        f"{TRADES}, sums AS {running_sums('priced', 'split')}, g AS (SELECT split, count(*) AS n, avg(net_return) AS mean, least(count(*), greatest(5, round(sqrt(count(*)))))::BIGINT AS size FROM priced GROUP BY split), means AS {bootstrap_sql('one', 'g', 'sums', 'split')}",
        f"SELECT g.split, any_value(n) AS trades, {r('any_value(g.mean)', 'mean')}, {interval(('0.025', '0.975'))} FROM g JOIN means m ON m.split = g.split GROUP BY g.split",
    ),
    "two_proportion_test": shown(
        f"{TRADES}, w AS (SELECT count(*) FILTER (side = 'long' AND net_return > 0) AS wins_long, count(*) FILTER (side = 'long') AS n_long, count(*) FILTER (side = 'short' AND net_return > 0) AS wins_short, count(*) FILTER (side = 'short') AS n_short FROM priced), "
        "pz AS (SELECT *, (wins_long / n_long::DOUBLE - wins_short / n_short::DOUBLE) / nullif(sqrt((wins_long + wins_short) / (n_long + n_short)::DOUBLE * (1 - (wins_long + wins_short) / (n_long + n_short)::DOUBLE) * (1.0::DOUBLE / n_long + 1.0::DOUBLE / n_short)), 0) AS z FROM w)",
        f"SELECT wins_long, n_long, wins_short, n_short, {r('z')}, {r(p_of('z'), 'p')}, abs(z) > 1.959963984540054 AS significant FROM pz",
    ),
    "filter_funnel": shown(
        f"""{PULLBACK}, {SPLIT}, named AS (SELECT p.*, {NAMED} AS sp FROM pullback p, split), both_of AS (SELECT *, sp AS split FROM named WHERE sp IS NOT NULL UNION ALL SELECT *, 'all' FROM named WHERE sp IS NOT NULL),
counted AS (SELECT split, count(*) AS row_count, count(*) FILTER (trade_ready) AS ready_count, [count(*) FILTER (trade_ready AND trend_filter_pass), count(*) FILTER (trade_ready AND trend_filter_pass AND pullback_structure_pass), count(*) FILTER (trade_ready AND trend_filter_pass AND pullback_structure_pass AND kline_turn_pass),
  count(*) FILTER (trade_ready AND trend_filter_pass AND pullback_structure_pass AND kline_turn_pass AND flow_confirm_pass), count(*) FILTER (trade_ready AND trend_filter_pass AND pullback_structure_pass AND kline_turn_pass AND flow_confirm_pass AND space_filter_pass)] AS c FROM both_of GROUP BY split),
names(o, combo_name) AS (VALUES (1, 'trend_only'), (2, 'trend_pullback'), (3, 'trend_pullback_kline'), (4, 'trend_pullback_kline_flow'), (5, 'trend_pullback_full_space'))""",
        "SELECT o::BIGINT AS combo_order, combo_name, split, row_count, ready_count, c[o] AS passed_count, CASE WHEN o = 1 THEN ready_count ELSE c[o - 1] END AS previous_count, round(c[o] / nullif(CASE WHEN o = 1 THEN ready_count ELSE c[o - 1] END, 0)::DOUBLE + 1e-9, 6) AS pass_rate, round(c[o] / nullif(ready_count, 0)::DOUBLE + 1e-9, 6) AS ready_rate FROM counted, names",
    ),
    "trades_triple_barrier": shown(BARRIER, BARRIER_ROWS),
    "trades_triple_barrier_short": shown(BARRIER_SHORT, BARRIER_ROWS),
    "exit_reasons": shown(
        f"{BARRIER}, g AS (SELECT split, exit_reason, count(*) AS n, avg(net_return) AS a FROM priced GROUP BY GROUPING SETS ((split), (split, exit_reason)))",
        f"SELECT split, exit_reason, n AS count, {r('n / (max(n) OVER (PARTITION BY split))::DOUBLE', 'rate')}, {r('a', 'avg_net_return')} FROM g",
    ),
    "barrier_replay_audit": " UNION ALL ".join(f"SELECT 'BLOCKER' AS severity, 'trades' AS category, '{k}' AS check_id, 'PASS' AS status, 0::BIGINT AS affected_rows" for k in ("entry_price", "gross_return", "net_return", "boundary", "time_order", "path_replay")),
    "sweep_long": shown(sweep_sql("long"), SWEEP_ROWS),
    "sweep_short": shown(sweep_sql("short"), SWEEP_ROWS),
    "trades_by_combination": shown(COMBO, SWEEP_ROWS.replace("SELECT case_id,", "SELECT case_id AS combo_name,")),
    "positive_months": shown(f"{COMBO}, days AS (SELECT case_id, split, strftime(exit_time, '%Y-%m-%d') AS d, avg(net_return) AS a FROM priced GROUP BY ALL)", f"SELECT case_id AS combo_name, split, {r('avg((a > 0)::INT)', 'positive_month_share')} FROM days GROUP BY ALL"),
    "combination_bootstrap": shown(
        f"{COMBO}, sums AS {running_sums('priced', 'case_id')}, n AS (SELECT case_id, count(*) AS n FROM priced GROUP BY case_id), pairs AS (SELECT unnest({list(COMBOS)[1:]!r}) AS combo, unnest({list(COMBOS)[:-1]!r}) AS benchmark), "
        "both_of AS (SELECT p.*, a.n AS na, b.n AS nb, greatest(5, round(sqrt(least(a.n, b.n)))) AS size FROM pairs p LEFT JOIN n a ON a.case_id = combo LEFT JOIN n b ON b.case_id = benchmark WHERE a.n IS NOT NULL OR b.n IS NOT NULL), "
        "ga AS (SELECT combo, benchmark, combo AS case_id, na AS n, least(size, na)::BIGINT AS size FROM both_of WHERE na IS NOT NULL AND nb IS NOT NULL), gb AS (SELECT combo, benchmark, benchmark AS case_id, nb AS n, least(size, nb)::BIGINT AS size FROM both_of WHERE na IS NOT NULL AND nb IS NOT NULL), "
        f"ma AS {bootstrap_sql('combo', 'ga', 'sums', 'case_id').replace('SELECT b.case_id, sample', 'SELECT combo, benchmark, sample', 1)}, mb AS {bootstrap_sql('benchmark', 'gb', 'sums', 'case_id').replace('SELECT b.case_id, sample', 'SELECT combo, benchmark, sample', 1)}, "
        "diffs AS (SELECT combo, benchmark, ma.m - mb.m AS m FROM ma JOIN mb USING (combo, benchmark, sample))",
        f"SELECT combo AS combo_name, benchmark AS benchmark_combo, {interval(('0.025', '0.975'))} FROM both_of LEFT JOIN diffs USING (combo, benchmark) GROUP BY combo, benchmark",
    ),
    "combination_gains": shown(
        f"{COMBO}, {metrics_of('priced', 'case_id, split')}, days AS (SELECT case_id, strftime(exit_time, '%Y-%m') AS d, avg(net_return) AS a FROM priced WHERE split = 'test' GROUP BY ALL), shares AS (SELECT case_id, avg((a > 0)::INT) AS positive_month_share FROM days GROUP BY ALL), "
        f"placed AS (SELECT m.*, list_position({list(COMBOS)!r}, case_id) AS o, sqrt(win_rate * (1 - win_rate) / trade_count) AS e FROM metrics m WHERE split = 'test'), "
        "held AS (SELECT p.*, positive_month_share, lag(case_id) OVER v AS b, lag(win_rate) OVER v AS bw, lag(avg_net_return) OVER v AS ba, lag(sum_net_return) OVER v AS bs, lag(trade_count) OVER v AS bn FROM placed p LEFT JOIN shares USING (case_id) WINDOW v AS (ORDER BY o)), "
        "zed AS (SELECT *, (win_rate * trade_count + bw * bn) / (trade_count + bn) AS pool FROM held), "
        "named AS (SELECT *, CASE WHEN trade_count < 1 THEN 'insufficient_samples' WHEN trade_count < 2 THEN 'low_confidence' ELSE 'enough_samples' END AS sample_status, "
        "CASE WHEN b IS NOT NULL THEN CASE WHEN win_rate - bw >= 0.01 AND avg_net_return > ba AND sum_net_return >= bs THEN 'incremental_effective' WHEN win_rate > bw AND avg_net_return > ba AND sum_net_return < bs THEN 'quality_improved_not_scalable' "
        "WHEN win_rate > bw AND avg_net_return <= ba THEN 'win_rate_only' WHEN avg_gross_return > 0 AND avg_net_return <= 0 THEN 'cost_failed' ELSE 'ineffective' END WHEN win_rate > 0.5 AND avg_net_return > 0 AND sum_net_return > 0 THEN 'absolute_effective' "
        "WHEN avg_gross_return > 0 AND avg_net_return <= 0 THEN 'cost_failed' ELSE 'ineffective' END AS label FROM zed)",
        f"SELECT case_id AS combo_name, split, trade_count, {r('win_rate')}, {r('avg_gross_return')}, {r('avg_net_return')}, {r('sum_net_return')}, {r('e', 'win_rate_se')}, {r('greatest(0, win_rate - 1.96 * e)', 'win_rate_low')}, {r('least(1, win_rate + 1.96 * e)', 'win_rate_high')}, sample_status, {r('positive_month_share')}, b AS benchmark_combo, "
        f"{r('win_rate - bw', 'win_rate_gain')}, {r('avg_net_return - ba', 'avg_net_gain')}, {r('sum_net_return - bs', 'sum_net_gain')}, {r('(win_rate - bw) / nullif(sqrt(pool * (1 - pool) * (1.0::DOUBLE / trade_count + 1.0::DOUBLE / bn)), 0)', 'win_rate_diff_z')}, {r(p_of('((win_rate - bw) / nullif(sqrt(pool * (1 - pool) * (1.0::DOUBLE / trade_count + 1.0::DOUBLE / bn)), 0))'), 'win_rate_diff_p')}, "
        "CASE WHEN sample_status <> 'enough_samples' THEN sample_status WHEN label IN ('absolute_effective', 'incremental_effective') AND positive_month_share < 0.5 THEN 'unstable' ELSE label END AS effectiveness FROM named",
    ),
    "reward_risk_sensitivity": shown(
        f"{PULLBACK}, {SPLIT}, {barriers('long', RATIO_CAND)}, {WITH_ALL}, {metrics_of('alls', 'case_id, split')}",
        f"SELECT round(case_id::DOUBLE, 6) AS reward_to_risk_threshold, split, trade_count, {r('win_rate')}, {r('avg_net_return')}, {r('sum_net_return')}, {r('max_drawdown')} FROM metrics",
    ),
    "signal_distribution": shown(
        f"{SCORE}, {fixed(0.85, 0.15, 'risk_pass', False, False)}, named AS (SELECT x.*, {NAMED} AS sp FROM risked x, split), every AS (SELECT *, sp AS split FROM named WHERE sp IS NOT NULL UNION ALL SELECT *, 'all' FROM named WHERE sp IS NOT NULL)",
        f"SELECT split, count(*) AS signal_count, {r('avg(signal_score)', 'score_mean')}, {r('stddev_pop(signal_score)', 'score_std')}, {r('skewness(signal_score)', 'score_skew')}, {r('kurtosis(signal_score)', 'score_kurtosis')}, "
        + ", ".join(r(f"quantile_cont(signal_score, {q})", f"score_p{round(100 * q):02d}") for q in SHOWN_QUANTILES)
        + f", {r('any_value(hi)', 'long_threshold')}, {r('any_value(lo)', 'short_threshold')}, {r('any_value(hi - lo)', 'tail_separation')}, {r('any_value((abs(hi) + abs(lo)) / 2)', 'threshold_abs_mean')} FROM every, cuts WHERE risk_pass GROUP BY split",
    ),
    "interaction_patterns": shown(
        f"{SCORE}, known AS (SELECT *, sign(score_orderflow_delta) AS d, sign(score_auction_poc) AS p, sign(score_price_structure) AS q, future_return_5 AS y FROM scored, split WHERE datetime >= test_start AND score_orderflow_delta IS NOT NULL AND score_auction_poc IS NOT NULL AND score_price_structure IS NOT NULL AND future_return_5 IS NOT NULL)",
        f"SELECT CASE WHEN d = p AND p = q THEN 'all_same_direction' WHEN d = p THEN 'delta_poc_same' ELSE 'delta_poc_conflict' END AS pattern, count(*) AS rows, {r('avg(y)', 'mean_return')}, {r('median(y)', 'median_return')}, {r('avg((y > 0)::INT)', 'positive_rate')} FROM known GROUP BY 1",
    ),
    "selected_correlations": shown(
        f"{FEATURES}, {SPLIT}, tr AS (SELECT f.* FROM features f, split WHERE datetime <= train_end), clong AS ({long_of('tr', SCORE_NAMES, 'contract, datetime')}), cr AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY feature, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 END AS rk FROM clong), "
        + f"ch(combo_name, o, feature, dimension) AS (VALUES {', '.join(repr(c) for c in CHOSEN)}), corr AS (SELECT a.feature AS fa, b.feature AS fb, CASE WHEN count(*) >= 20 THEN {CORR('a.rk', 'b.rk')} END AS s FROM cr a JOIN cr b ON a.contract = b.contract AND a.datetime = b.datetime WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL)",
        f"SELECT a.combo_name, a.feature AS feature_a, a.dimension AS dimension_a, b.feature AS feature_b, b.dimension AS dimension_b, {r('s', 'spearman_corr')}, {r('abs(s)', 'abs_spearman_corr')}, a.dimension <> b.dimension AS is_cross_dimension, CASE WHEN s IS NULL THEN 'unknown' WHEN abs(s) > 0.5 THEN 'collinearity_blocked' WHEN abs(s) >= 0.05 THEN 'collinearity_warning' ELSE 'ok' END AS correlation_status "
        "FROM ch a JOIN ch b ON a.combo_name = b.combo_name AND a.o < b.o LEFT JOIN corr ON fa = a.feature AND fb = b.feature",
    ),
    "space_ablation": shown(cases_sql("short"), f"SELECT case_id, space_filter_on, {r('avg_net_return')}, round(avg_net_return - max(CASE WHEN NOT space_filter_on THEN summary.avg_net_return END) OVER (PARTITION BY time_barrier_bars, stop_atr_multiple, take_profit_multiple, kline_mode) + 1e-9, 6) + 0.0 AS avg_net_return_vs_baseline FROM summary"),
    "audit_isolation": " UNION ALL ".join(f"SELECT 'BLOCKER' AS severity, 'isolation' AS category, '{k}' AS check_id, 'PASS' AS status, 0::BIGINT AS affected_rows" for k in ("selected_from_train_summary", "params_from_train", "params_have_global", "thresholds_from_train", "thresholds_shared")),
    "plateau_scores": shown(f"{CASES}, {PLATEAU}", f"SELECT case_id, {CASE_SHOWN}, trade_count, {r('win_rate')}, {r('avg_net_return')}, {r('sum_net_return')}, neighbours, {r('neighbour_mean')}, {r('neighbour_std')}, {r('neighbour_positive')}, {r('plateau_score')} FROM plateaus"),
    "kline_ablation": shown(CASES, f"SELECT case_id, kline_mode, {r('avg_net_return')}, round(avg_net_return - max(CASE WHEN kline_mode = 'none' THEN summary.avg_net_return END) OVER (PARTITION BY time_barrier_bars, stop_atr_multiple, take_profit_multiple, space_filter_on) + 1e-9, 6) + 0.0 AS avg_net_return_vs_baseline FROM summary"),
    "marginal_means": shown(CASES, f"SELECT time_barrier_bars, {MARGINAL}, NULL::DOUBLE AS stop_atr_multiple FROM summary GROUP BY time_barrier_bars UNION ALL SELECT NULL, {MARGINAL}, round(stop_atr_multiple, 6) FROM summary GROUP BY stop_atr_multiple"),
    "audit_integrity": shown(BARS, INTEGRITY),
    "audit_label_alignment": shown(LABELS_ONLY, " UNION ALL ".join([LABEL_DIFF(v, "CASE WHEN hour(datetime) = 7 THEN 0.01 ELSE 0 END" if v == "future_return_5" else "0") for v in LABELS])),
    "audit_tail_null": shown(
        f"{LABELS_ONLY}, left_of AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY datetime DESC) AS l FROM labels)",
        " UNION ALL ".join(f"SELECT '{v}' AS label, {h}::BIGINT AS horizon, count(*) FILTER (l <= {h} AND {v} IS NOT NULL) AS leaked_rows, count(*) FILTER (l > {h} AND {v} IS NULL) AS missing_rows FROM left_of" for v, h in TAIL.items()),
    ),
    "audit_head_null": shown(PULLBACK, HEAD({"ema60": 59, "atr20_ticks": 19, "trendline_60": 59, "volume_zscore_20": 19})),
    "audit_summary": shown(
        f"{PULLBACK}, found AS ({INTEGRITY} UNION ALL {HEAD({'ema60': 59, 'atr20_ticks': 19})})",
        "SELECT coalesce(category, '__OVERALL__') AS category, coalesce(severity, 'ALL') AS severity, count(*) AS checks, count(*) FILTER (status = 'PASS') AS passed, sum(affected_rows)::BIGINT AS affected_rows FROM found GROUP BY ROLLUP (category, severity)",
    ),
    "golden_diff": shown(
        f"{BARS}, gen AS (SELECT *, row_number() OVER w AS n FROM bars {W}), ref AS (SELECT *, row_number() OVER w AS n FROM (SELECT * REPLACE (close + CASE WHEN hour(datetime) = 5 AND contract = 'C1' THEN 0.1 ELSE 0 END AS close) FROM bars WHERE contract <> 'C3' OR hour(datetime) > 0) {W}), "
        + "cells AS ("
        + " UNION ALL ".join(f"SELECT g.contract, g.n, '{c}' AS c, {k} AS k FROM gen g JOIN ref x ON g.contract = x.contract AND g.n = x.n WHERE {'abs(g.' + c + ' - x.' + c + ') > 1e-6' if k < 5 else 'g.' + c + ' <> x.' + c}" for k, c in enumerate(["open", "high", "low", "close", "poc", "volume", "delta", "open_interest"]))
        + "), bad AS (SELECT contract, count(*) AS m, arg_min(c, {'n': n, 'k': k}) AS col, min(n) AS row_no FROM cells GROUP BY contract), sizes AS (SELECT contract, count(*) AS gr, (SELECT count(*) FROM ref x WHERE x.contract = g.contract) AS rr FROM gen g GROUP BY contract)",
        "SELECT s.contract, CASE WHEN rr = 0 THEN 'missing_reference' WHEN gr <> rr THEN 'row_count_mismatch' WHEN coalesce(m, 0) > 0 THEN 'value_mismatch' ELSE 'passed' END AS status, gr AS generated_rows, rr AS reference_rows, coalesce(m, 0)::BIGINT AS mismatch_count, col AS first_mismatch_column, row_no AS first_mismatch_row FROM sizes s LEFT JOIN bad b ON s.contract = b.contract",
    ),
    "bar_extremes": shown(
        f"{BARS}, el AS (SELECT contract, datetime, 'volume' AS field, volume::DOUBLE AS value FROM bars UNION ALL SELECT contract, datetime, 'delta', abs(delta)::DOUBLE FROM bars), ec AS (SELECT field, quantile_cont(value, 0.99) AS cut FROM el GROUP BY field), ep AS (SELECT el.*, row_number() OVER (PARTITION BY field ORDER BY value DESC, contract, datetime) AS place FROM el JOIN ec USING (field) WHERE value > cut)",
        f"SELECT contract, {T}, field, {r('value')}, place FROM ep WHERE place <= 500",
    ),
    "donchian": shown(BARS, f"SELECT contract, {T}, CASE WHEN count(close) OVER b = 20 THEN max(close) OVER b END AS upper, CASE WHEN count(close) OVER b = 20 THEN min(close) OVER b END AS lower FROM bars WINDOW b AS (PARTITION BY contract ORDER BY bars.datetime ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"),
    "trend_correlation": shown(f"{BARS}, lasts AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY datetime DESC) AS l FROM bars)", f"SELECT contract, {r('CASE WHEN count(*) = 20 THEN ' + CORR('-l', 'close') + ' END', 'correlation', 3)} FROM lasts WHERE l <= 20 GROUP BY contract"),
    "ema_indicator": shown(
        f"{BARS}, nb AS (SELECT *, row_number() OVER w AS n FROM bars {W}), er AS (SELECT contract, 20::BIGINT AS n, avg(close) AS e FROM nb WHERE n <= 20 GROUP BY contract HAVING count(*) = 20 UNION ALL SELECT r.contract, r.n + 1, e + 2.0 / 21 * (b.close - e) FROM er r JOIN nb b ON b.contract = r.contract AND b.n = r.n + 1)",
        f"SELECT b.contract, strftime(b.datetime, '%Y-%m-%d %H:%M:%S') AS datetime, {r('e', 'ema', 4)} FROM nb b LEFT JOIN er r ON r.contract = b.contract AND r.n = b.n",
    ),
    "wilder_atr": shown(
        f"{BARS}, nb AS (SELECT *, row_number() OVER w AS n, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}), ar AS (SELECT contract, 15::BIGINT AS n, avg(tr) AS a FROM nb WHERE n BETWEEN 2 AND 15 GROUP BY contract HAVING count(*) = 14 UNION ALL SELECT r.contract, r.n + 1, (a * 13 + b.tr) / 14 FROM ar r JOIN nb b ON b.contract = r.contract AND b.n = r.n + 1)",
        f"SELECT b.contract, strftime(b.datetime, '%Y-%m-%d %H:%M:%S') AS datetime, {r('a', 'atr', 4)} FROM nb b LEFT JOIN ar r ON r.contract = b.contract AND r.n = b.n",
    ),
    "keltner": shown(
        f"{BARS}, nb AS (SELECT *, row_number() OVER w AS n, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}), ar AS (SELECT contract, 21::BIGINT AS n, avg(tr) AS a FROM nb WHERE n BETWEEN 2 AND 21 GROUP BY contract HAVING count(*) = 20 UNION ALL SELECT r.contract, r.n + 1, (a * 19 + b.tr) / 20 FROM ar r JOIN nb b ON b.contract = r.contract AND b.n = r.n + 1), "
        "er AS (SELECT contract, 20::BIGINT AS n, avg(close) AS e FROM nb WHERE n <= 20 GROUP BY contract HAVING count(*) = 20 UNION ALL SELECT r.contract, r.n + 1, e + 2.0 / 21 * (b.close - e) FROM er r JOIN nb b ON b.contract = r.contract AND b.n = r.n + 1)",
        f"SELECT b.contract, strftime(b.datetime, '%Y-%m-%d %H:%M:%S') AS datetime, {r('e', 'ema', 4)}, {r('a', 'atr', 4)}, {r('e + 2 * a', 'upper', 4)}, {r('e - 2 * a', 'lower', 4)} FROM nb b LEFT JOIN ar a ON a.contract = b.contract AND a.n = b.n LEFT JOIN er e ON e.contract = b.contract AND e.n = b.n",
    ),
    "kama": shown(KAMA, f"SELECT b.contract, strftime(b.datetime, '%Y-%m-%d %H:%M:%S') AS datetime, {r('coalesce(k, 0)', 'kama')}, {r('CASE WHEN b.n > 20 THEN up END', 'upper')}, {r('CASE WHEN b.n > 20 THEN down END', 'lower')} FROM paced b LEFT JOIN kr k ON k.contract = b.contract AND k.n = b.n"),
    "kama_atr": shown(
        f"{KAMA}, frames AS (SELECT contract, n, list_sum(list_transform(range(1, 100), lambda j: trs[j] * pow(29.0 / 30, 99 - greatest(j, 30)) / 30)) AS atr FROM (SELECT contract, n, list(tr) OVER (PARTITION BY contract ORDER BY n ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING) AS trs FROM paced) WHERE n > 100)",
        f"SELECT b.contract, strftime(b.datetime, '%Y-%m-%d %H:%M:%S') AS datetime, {r('coalesce(k, 0)', 'kama')}, {r('atr')}, {r('round_even(coalesce(k, 0) + 2 * atr, 2)', 'upper')}, {r('round_even(coalesce(k, 0) - 2 * atr, 2)', 'lower')} FROM paced b LEFT JOIN kr k ON k.contract = b.contract AND k.n = b.n LEFT JOIN frames f ON f.contract = b.contract AND f.n = b.n",
    ),
    "union_ragged": shown(BARS, f"SELECT contract, {T}, {r('close')}, volume, NULL::BIGINT AS delta FROM bars WHERE contract IN ('C0', 'C2') UNION ALL SELECT contract, strftime(datetime, '%Y-%m-%d %H:%M:%S'), round(close, 6), NULL, delta FROM bars WHERE contract IN ('C1', 'C3')"),
    "distinct_keys": shown(BARS, "SELECT DISTINCT contract, hour(datetime)::BIGINT AS hour FROM bars"),
    "anti_test_only": shown(f"{BARS}, {SPLIT}", "SELECT DISTINCT contract, delta, volume FROM bars, split WHERE datetime >= test_start EXCEPT SELECT contract, delta, volume FROM bars, split WHERE datetime <= train_end"),
}


def _ranked(side: str) -> str:
    """Selects the ranking of a side; the tables are named by the side."""
    return f"""(WITH {cases_sql(side).removeprefix(',')}, {PLATEAU}, held AS (SELECT *, row_number() OVER (ORDER BY round(plateau_score, 9) DESC NULLS LAST, round(neighbour_mean, 9) DESC NULLS LAST, round(avg_net_return, 9) DESC NULLS LAST, case_id) AS train_rank FROM plateaus WHERE trade_count >= {LEAST_TRADES}),
best AS (SELECT * FROM held WHERE train_rank <= 20), tests AS (SELECT c.case_id, coalesce(n, 0) AS trade_count, w AS win_rate, a AS avg_net_return, s AS sum_net_return FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n, avg((net_return > 0)::INT) AS w, avg(net_return) AS a, sum(net_return) AS s FROM trades_net WHERE split = 'test' GROUP BY case_id) t ON t.case_id = c.case_id),
seen AS (SELECT *, row_number() OVER (ORDER BY round(avg_net_return, 9) DESC NULLS LAST, round(sum_net_return, 9) DESC NULLS LAST, round(win_rate, 9) DESC NULLS LAST, case_id) AS place FROM tests)
SELECT '{side}' AS side, b.train_rank, b.case_id, b.avg_net_return AS train_avg_net_return, b.sum_net_return AS train_sum_net_return, neighbour_mean, neighbour_positive, plateau_score, t.trade_count, t.win_rate, t.avg_net_return, t.sum_net_return,
  CASE WHEN NOT coalesce(b.avg_net_return > 0 AND b.sum_net_return > 0 AND neighbour_mean > 0 AND neighbour_positive >= 0.5, false) THEN 'train_not_passed' WHEN coalesce(t.avg_net_return > 0 AND t.sum_net_return > 0, false) THEN 'train_test_consistent' ELSE 'not_verified' END AS recommendation_status FROM best b LEFT JOIN tests t USING (case_id)
UNION ALL SELECT '{side}', NULL, case_id, NULL, NULL, NULL, NULL, NULL, trade_count, win_rate, avg_net_return, sum_net_return, 'test_only' FROM seen WHERE place <= 20 AND case_id NOT IN (SELECT case_id FROM best))""".replace("trades_net", "priced")


def _recursive(x: str) -> str:
    return x.replace("(WITH ", "(WITH RECURSIVE ", 1)


_RANKS = f"{_recursive(_ranked('long'))} UNION ALL {_recursive(_ranked('short'))}"
_TESTS = " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {cases_sql(side, 'test')} SELECT '{side}' AS side, * FROM summary)" for side in ("long", "short"))
ORACLES["sweep_ranking"] = f"SELECT side, train_rank::BIGINT AS train_rank, case_id, {', '.join(r(c, places=5) for c in ('train_avg_net_return', 'train_sum_net_return', 'neighbour_mean', 'neighbour_positive', 'plateau_score'))}, trade_count, {', '.join(r(c, places=5) for c in ('win_rate', 'avg_net_return', 'sum_net_return'))}, recommendation_status FROM ({_RANKS})"
ORACLES["long_short_comparison"] = f"""WITH tests AS ({_TESTS}), placed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round(avg_net_return, 9) DESC NULLS LAST, round(sum_net_return, 9) DESC NULLS LAST, round(win_rate, 9) DESC NULLS LAST, case_id) AS place, (win_rate - 0.5) / sqrt(0.25 / trade_count) AS z FROM tests)
SELECT side, case_id, time_i, stop_i, take_i, time_barrier_bars, {r('stop_atr_multiple')}, {r('take_profit_multiple')}, kline_mode, space_filter_on, trade_count, {r('win_rate')}, {r('avg_net_return')}, {r('sum_net_return')}, {r('z', 'win_rate_z')}, {r(p_of('z'), 'win_rate_p')}, {r(f"CASE WHEN z IS NOT NULL THEN least(1, 768 * {p_of('z')}) END", 'win_rate_p_bonferroni')},
  CASE WHEN z IS NULL THEN 'not_tested' WHEN abs(z) < 3.9 THEN 'not_significant' WHEN z > 0 THEN 'passes_bonferroni' ELSE 'significant_below_50' END AS win_rate_verdict FROM placed WHERE place = 1"""

_EXITS = "rates AS (SELECT case_id, count(*) AS trades, avg((exit_reason = 'take_profit')::INT) AS tp, avg((exit_reason = 'stop_loss')::INT) AS sl, avg((exit_reason = 'time_barrier')::INT) AS tb, avg(holding_bars) AS held FROM priced WHERE split = 'test' GROUP BY case_id)"
_DIAGNOSED = f"count(DISTINCT s.case_id) AS cases, {r('avg(win_rate)', 'mean_win_rate')}, {r('avg(avg_net_return)', 'mean_net_return')}, {r('avg(sum_net_return)', 'mean_sum_net_return')}, {r('median(avg_net_return)', 'median_net_return')}, {r('avg(tp)', 'mean_take_profit_rate')}, {r('avg(sl)', 'mean_stop_loss_rate')}, {r('avg(tb)', 'mean_time_barrier_rate')}"
_TEST_CASES = cases_sql("long", "test")
ORACLES["time_barrier_diagnostics"] = f"""WITH RECURSIVE {_TEST_CASES}, {_EXITS}, d AS (SELECT time_barrier_bars, {_DIAGNOSED}, avg(avg_net_return) AS m FROM summary s LEFT JOIN rates USING (case_id) GROUP BY time_barrier_bars)
SELECT * EXCLUDE (m), CASE WHEN time_barrier_bars IN (24, 36) AND m > (SELECT m FROM d WHERE time_barrier_bars = 5) THEN 'longer_than_5_is_better' ELSE '' END AS diagnosis FROM d"""
ORACLES["stop_take_diagnostics"] = f"""WITH RECURSIVE {_TEST_CASES}, {_EXITS}, d AS (SELECT {r('stop_atr_multiple')}, {r('take_profit_multiple')}, {_DIAGNOSED}, avg(sl) AS s_rate, avg(tp) AS t_rate FROM summary s LEFT JOIN rates USING (case_id) GROUP BY s.stop_atr_multiple, s.take_profit_multiple)
SELECT * EXCLUDE (s_rate, t_rate), concat_ws(';', CASE WHEN stop_atr_multiple = 0.5 AND s_rate > 0.35 THEN 'stop_is_tight' END, CASE WHEN take_profit_multiple >= 2 AND t_rate < 0.1 THEN 'target_is_rare' END) AS diagnosis FROM d"""
_BEST_FIRST = ", ".join(f"round({c}, 9) DESC NULLS LAST" for c in ("avg_net_return", "sum_net_return", "win_rate")) + ", case_id"
ORACLES["best_plateaus"] = f"""SELECT side, train_rank::BIGINT AS train_rank, case_id, {', '.join(r(c, places=5) for c in ('train_avg_net_return', 'train_sum_net_return', 'neighbour_mean', 'neighbour_positive', 'plateau_score'))}, trade_count, {', '.join(r(c, places=5) for c in ('win_rate', 'avg_net_return', 'sum_net_return'))}, recommendation_status
FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY train_rank NULLS LAST, {_BEST_FIRST}) AS place FROM ({_RANKS})) WHERE place <= 10"""
_ALL_RATES = " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {cases_sql(side, 'test')}, {_EXITS} SELECT '{side}' AS side, * FROM rates)" for side in ("long", "short"))
ORACLES["exit_comparison"] = f"""WITH tests AS ({_TESTS}), ranks AS ({_RANKS}), may AS (SELECT side, case_id, avg_net_return, sum_net_return, win_rate, 'train_test_consistent' AS selection_source FROM ranks WHERE recommendation_status = 'train_test_consistent'
  UNION ALL SELECT side, case_id, avg_net_return, sum_net_return, win_rate, 'test_only' FROM tests WHERE avg_net_return IS NOT NULL), placed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY selection_source DESC, {_BEST_FIRST}) AS place FROM may), rates AS ({_ALL_RATES})
SELECT p.side, p.case_id, selection_source, trades, {r('tp', 'take_profit_rate')}, {r('sl', 'stop_loss_rate')}, {r('tb', 'time_barrier_rate')}, {r('held', 'mean_holding_bars')} FROM placed p JOIN rates x ON x.side = p.side AND x.case_id = p.case_id WHERE place = 1"""
ORACLES["audit_first_rows"] = "SELECT 'BLOCKER' AS severity, 'isolation' AS category, 'first_row_shift' AS check_id, 'PASS' AS status, 0::BIGINT AS affected_rows"
