"""Kernels, bars, simulation, fits and audits: hand-computed edges, pandas restatements, properties, seeded defects."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import kernels as k
from tidebar.operators import audit, bars, evaluate, features, fit, indicators, metrics, simulate, sweep, tick_bars
from tidebar.sources import calendar, ticks
from tidebar.streaming.bars import stream_bars, write_bars

T0 = dt.datetime(2024, 1, 1)
BAR = "contract string, datetime timestamp, open double, high double, low double, close double, volume long, poc double, delta long, open_interest long"


def bar_rows(n=260, contract="A", seed=0):
    r = np.random.default_rng(seed)
    close = (1000 + np.cumsum(r.normal(0, 3, n)).round(1)).tolist()
    out = []
    for i in range(n):
        o = float(close[i - 1]) if i else float(close[0])
        h, low = max(o, close[i]) + float(r.integers(0, 4)), min(o, close[i]) - float(r.integers(0, 4))
        v = int(r.integers(1, 100))
        out.append((contract, T0 + dt.timedelta(minutes=5 * i), o, h, low, float(close[i]), v, float(round((h + low) / 2)), int(r.integers(-v, v + 1)), 100000 + int(r.integers(-500, 500))))
    return out


@pytest.fixture(scope="module")
def some_bars(spark):
    return spark.createDataFrame(bar_rows() + bar_rows(300, "B", 1), BAR).repartition(4).persist()


def series(spark, values, name="x"):
    return spark.createDataFrame([("A", T0 + dt.timedelta(minutes=i), None if v is None else float(v)) for i, v in enumerate(values)], f"contract string, datetime timestamp, {name} double")


def column(df, c):
    return [r[0] for r in df.orderBy("contract", "datetime").select(c).collect()]


def close_to(found, want, tolerance=1e-9):
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        if b is None or isinstance(b, float) and math.isnan(b):
            assert a is None
        else:
            assert a == pytest.approx(b, abs=tolerance, rel=tolerance)


# ---- kernels


def test_forward_extremes_need_a_full_window(spark):
    got = column(series(spark, range(30)).withColumn("m", k.ahead(F.max, "x", 10)), "m")
    assert got[:20] == [float(i + 10) for i in range(20)] and got[20:] == [None] * 10


def test_rolling_and_zscore_match_pandas(some_bars):
    d = some_bars.withColumns({"z": k.zscore("volume", 20), "m": k.rolling(F.min, "low", 10)})
    p = d.toPandas().sort_values(["contract", "datetime"])
    g = p.groupby("contract")["volume"]
    want = (p["volume"] - g.transform(lambda s: s.rolling(20).mean())) / g.transform(lambda s: s.rolling(20).std(ddof=0))
    close_to(column(d, "z"), want.tolist())
    close_to(column(d, "m"), p.groupby("contract")["low"].transform(lambda s: s.rolling(10).min()).tolist())


def test_constant_window_has_no_zscore(spark):
    assert column(series(spark, [5] * 25).withColumn("z", k.zscore("x", 20)), "z") == [None] * 25


def test_division_fills_missing_numerators_too(spark):
    d = spark.createDataFrame([(None, 2.0), (1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in d.select(k.div("a", "b"), k.div("a", "b", 0.0)).collect()] == [(None, 0.0), (None, 0.0), (0.5, 0.5)]


def test_fracdiff(spark):
    w = k.fracdiff_weights()
    assert len(w) == 200 and w[-1] == pytest.approx(-0.000162677, abs=1e-9)
    x = np.random.default_rng(0).normal(size=230)
    want = [None] * 199 + [float(np.dot(x[i - 199 : i + 1][::-1], w)) for i in range(199, 230)]
    close_to(column(series(spark, x).withColumn("f", k.fracdiff("x")), "f"), want)


def test_ema_and_trendline_match_pandas(spark, some_bars):
    d = features.pullback(features.labels(features.extended(some_bars)))
    p = some_bars.toPandas().sort_values(["contract", "datetime"])
    close_to(column(d, "ema60"), p.groupby("contract")["close"].transform(lambda s: s.ewm(span=60, adjust=False, min_periods=60).mean()).tolist())
    i = np.arange(60)
    want = p.groupby("contract")["close"].transform(lambda s: s.rolling(60).apply(lambda y: np.polyval(np.polyfit(i, y, 1), 59)))
    close_to(column(d, "trendline_60"), want.tolist(), 1e-7)


def test_ema_of_a_long_contract(spark):
    n = 3 * k.ema_piece(60) + 500  # far beyond where 1 / q^n leaves a double
    x = 100 + np.cumsum(np.random.default_rng(3).normal(size=n))
    d = spark.createDataFrame(pd.DataFrame({"contract": "A", "datetime": np.arange(n), "x": x, "_row": np.arange(1, n + 1)}))
    found = d.withColumn("_e", k.ema_within("x", 60)).select("datetime", k.ema("_e", 60).alias("e")).toPandas().sort_values("datetime")["e"]
    want = pd.Series(x).ewm(span=60, adjust=False, min_periods=60).mean()
    assert found.isna().sum() == 59 and np.abs(found.to_numpy()[59:] - want.to_numpy()[59:]).max() < 1e-9


def test_ranks_by_pieces_are_ranks(spark):
    r = np.random.default_rng(4)
    p = pd.DataFrame({"g": r.integers(0, 3, 3000), "x": r.integers(0, 200, 3000) / 7, "y": r.normal(size=3000)})
    found = evaluate.ranks(spark.createDataFrame(p), ["x", "y"], ["g"], pieces=8).toPandas()
    want = p.assign(rx=p.groupby("g")["x"].rank(), ry=p.groupby("g")["y"].rank())
    key = ["g", "x", "y"]
    pd.testing.assert_frame_equal(found.sort_values(key)[[*key, "rx", "ry"]].reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_correlations_match_pandas(spark, some_bars):
    names = ["bar_return", "delta_strength", "volume_burst_flag", "trend_return_48", "open_interest_zscore_60"]
    d = features.extended(some_bars).withColumn("volume_burst_flag", F.lit(1.0))  # a constant correlates with nothing
    p = d.toPandas()[names].astype(float)
    x, r = p.corr(min_periods=20), p.rank().corr(min_periods=20)
    for row in evaluate.correlations(d, names).collect():
        for found, want in ((row["pearson_corr"], x), (row["spearman_corr"], r)):
            w = want.loc[row["feature_a"], row["feature_b"]]
            assert found is None if math.isnan(w) else found == pytest.approx(w, abs=1e-9)


def test_summary_counts_rows_with_feature_and_target(spark):
    rows = [(float(i), None if i >= 25 else i / 10, 0.0, 0.0) for i in range(30)] + [(None, 1.0, 0.0, 0.0)] * 10
    s = evaluate.summary(spark.createDataFrame(rows, "f double, future_return_5 double, mfe_10_long double, mae_10_long double"), ["f"]).first()
    assert (s["non_null_count"], s["valid_count"], s["coverage"], s["unique_count"], s["inf_count"]) == (30, 25, 25 / 40, 25, 0)
    assert s["spearman_ic"] == pytest.approx(1.0) and s["top_quintile_win_rate"] == 1.0


def test_moments_match_pandas(spark):
    x = pd.Series(np.random.default_rng(5).exponential(size=50))
    for n in (50, 4, 3, 2):
        row = series(spark, x[:n].tolist()).agg(*[m.alias(c) for m, c in zip(metrics.moments(F.col("x")), "sk", strict=True)]).first()
        for found, want in ((row["s"], x[:n].skew()), (row["k"], x[:n].kurtosis())):
            assert found is None if math.isnan(want) else found == pytest.approx(want)


def gains(spark, *rows):
    """rows: combo, trades, win rate, gross, net, sum."""
    return spark.createDataFrame([(c, "test", n, w, g, x, s, "enough_samples" if n >= 300 else "low_confidence") for c, n, w, g, x, s in rows], "combo_name string, split string, trade_count long, win_rate double, avg_gross_return double, avg_net_return double, sum_net_return double, sample_status string")


def test_gain_labels(spark):
    m = gains(spark, ("a", 1000, 0.52, 0.2, 0.1, 9.0), ("b", 900, 0.54, 0.3, 0.2, 12.0), ("c", 400, 0.56, 0.4, 0.3, 8.0), ("d", 350, 0.57, 0.2, 0.2, 7.0), ("e", 320, 0.50, 0.1, -0.1, -3.0), ("f", 299, 0.9, 1.0, 1.0, 9.0))
    months = spark.createDataFrame([(c, x) for c in "abcdef" for x in ((1.0, 1.0) if c != "b" else (1.0, -1.0, -1.0))], "combo_name string, avg_net_return double")
    found = {r["combo_name"]: r for r in metrics.gain_diagnostics(m, months, list("abcdef")).collect()}
    assert [found[c]["effectiveness"] for c in "abcdef"] == ["absolute_effective", "unstable", "quality_improved_not_scalable", "win_rate_only", "cost_failed", "low_confidence"]
    assert found["b"]["benchmark_combo"] == "a" and found["a"]["benchmark_combo"] is None
    z = (0.54 - 0.52) / math.sqrt(1006 / 1900 * (1 - 1006 / 1900) * (1 / 1000 + 1 / 900))
    assert found["b"]["win_rate_diff_z"] == pytest.approx(z) and found["b"]["win_rate_diff_p"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_dimension_gains(spark):
    m = gains(spark, ("delta_only", 1000, 0.48, 0.2, -0.1, -9.0), ("poc_only", 1000, 0.49, 0.2, 0.05, 9.0), ("delta_poc", 900, 0.55, 0.3, 0.2, 12.0), ("delta_poc_position", 900, 0.52, 0.3, 0.1, 8.0))
    tails = spark.createDataFrame([(c, s, x) for c, x in (("delta_only", 1.0), ("poc_only", 1.0), ("delta_poc", 0.9), ("delta_poc_position", 0.3)) for s in ("train", "test", "all")], "combo_name string, split string, tail_separation double")
    shapes = metrics.distribution_diagnostics(tails, m)
    by = {r["combo_name"]: r for r in shapes.where("split = 'test'").collect()}
    assert (by["delta_poc"]["benchmark_combo"], by["delta_poc"]["distribution_status"]) == ("poc_only", "ok") and by["delta_only"]["benchmark_combo"] is None
    assert by["delta_poc_position"]["distribution_status"] == "distribution_deformed" and by["delta_poc_position"]["tail_shrink_ratio"] == pytest.approx(2 / 3)
    chosen = spark.createDataFrame([("poc_only", 1, "x", "poc"), ("poc_only", 2, "y", "poc"), ("delta_poc", 1, "x", "poc"), ("delta_poc", 2, "w", "delta")], "combo_name string, selection_order int, feature string, dimension string")
    corr = metrics.selected_correlations(chosen, spark.createDataFrame([("y", "x", -0.9)], "feature_a string, feature_b string, spearman_corr double"))
    assert {(r["combo_name"], r["correlation_status"], r["is_cross_dimension"]) for r in corr.collect()} == {("poc_only", "collinearity_blocked", False), ("delta_poc", "unknown", True)}
    months = spark.createDataFrame([(c, 1.0) for c in ("delta_only", "poc_only", "delta_poc")], "combo_name string, avg_net_return double")
    found = {r["combo_name"]: r["effectiveness"] for r in metrics.dimension_gains(m, months, corr, shapes).collect()}
    assert found == {"delta_only": "cost_failed", "poc_only": "collinearity_blocked", "delta_poc": "incremental_effective", "delta_poc_position": "distribution_deformed"}


def test_bootstrap_difference_is_that_of_the_means(spark):
    rows = [(c, "A", T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i), base + (i % 5) / 10) for c, base in (("a", 0.0), ("b", 1.0), ("z", 5.0)) for i in range(60)]
    d = spark.createDataFrame(rows, "combo_name string, contract string, signal_time timestamp, exit_time timestamp, net_return double")
    (row,) = metrics.bootstrap_differences(d, ["a", "b"]).collect()
    assert (row["combo_name"], row["benchmark_combo"]) == ("b", "a") and 0.9 < row["low"] <= 1.0 <= row["high"] < 1.1


def test_average_rank(spark):
    assert column(series(spark, [1, 2, 2, 4]).withColumn("r", k.average_rank("x")), "r") == [1.0, 2.5, 2.5, 4.0]


def test_quintiles_renumber_tied_edges(spark):
    d = series(spark, [0] * 50 + list(range(50))).withColumns({"future_return_5": F.col("x"), "mfe_10_long": F.col("x"), "mae_10_long": F.col("x")})
    assert {r["quintile"]: r["count"] for r in evaluate.quintiles(d, ["x"]).collect()} == {1: 60, 2: 20, 3: 20}


def test_spearman_variants(spark):
    a, b = [1, 2, None, 4, 5, 0], [1, None, 3, 7, 2, 9]
    rows = [("A", T0 + dt.timedelta(minutes=i), *(None if v is None else float(v) for v in (a[i % 6], b[i % 6]))) for i in range(6)]
    d = spark.createDataFrame(rows, "contract string, datetime timestamp, a double, b double")
    pairwise = evaluate.ranked(d, ["a"], "b", []).agg(evaluate.correlation("rx", "ry")).first()[0]
    assert pairwise == pytest.approx(-0.4)
    ranks = d.withColumns({"ra": k.average_rank("a"), "rb": k.average_rank("b")}).where("a is not null and b is not null")
    assert ranks.agg(evaluate.correlation("ra", "rb")).first()[0] == pytest.approx(-0.3, abs=0.05)


def test_two_sided_p(spark):
    z = [0.0, 0.5, -1.0, 1.96, 3.0, -5.0]
    got = [r[0] for r in series(spark, z, "z").orderBy("datetime").select(k.two_sided_p(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], abs=1e-15)


# ---- properties


def test_contracts_are_apart_and_features_do_not_look_ahead(spark, some_bars):
    key = ["contract", "datetime"]
    full = features.extended(some_bars).drop("open", "high", "low", "close", "volume", "poc", "delta", "open_interest")
    alone = features.extended(some_bars.where("contract = 'A'")).select(full.columns)
    early = features.extended(some_bars.where(F.col("datetime") < T0 + dt.timedelta(minutes=5 * 150))).select(full.columns)
    rows = {(r["contract"], r["datetime"]): r for r in full.collect()}
    for part in (alone, early):
        for r in part.collect():
            other = rows[r["contract"], r["datetime"]]
            close_to([r[c] for c in full.columns if c not in key], [other[c] for c in full.columns if c not in key])


def test_first_rows(spark, some_bars):
    first = features.extended(some_bars).orderBy("datetime", "contract").first()
    assert first["return_per_volume"] == 0.0 and first["oi_volume_ratio"] == 0.0 and first["close_to_prev_close_return"] is None
    assert len(features.FEATURES) == 65 and len(features.STAGE1) == 17


# ---- ticks to bars

CU = "SHFE.cu2401"


def tick_table(spark):
    at = [("09:00:00", 100, 90, 110, 10, 1000), ("09:00:01", 110, 100, 120, 15, 1002), ("09:00:02", 100, 90, 110, 18, 1002), ("09:04:59", 105, 100, 110, 20, 999), ("09:05:00", 120, 110, 120, 24, 1003), ("21:00:00", 120, 110, 120, 7, 1003), ("21:00:10", 120, 110, 120, 6, 1003), ("12:00:00", 120, 110, 120, 9, 1003)]
    rows = []
    for i, (t, last, bid, ask, v, oi) in enumerate(at):
        wall = dt.datetime.fromisoformat(f"2024-01-10T{t}+08:00")
        rows.append((CU, i, int(wall.timestamp()) * 10**9 * 1.0, *map(float, (last, 200, 50, v, oi, bid, ask))))
    return full_ticks(spark, rows)


def full_ticks(spark, rows):
    t = spark.createDataFrame(rows, "contract string, seq long, datetime_nano double, last_price double, highest double, lowest double, volume double, open_interest double, bid_price1 double, ask_price1 double")
    return t.withColumns({c: F.lit(1.0) for c in ticks.NUMERIC if c not in t.columns})


def test_tick_fold(spark):
    inside = ticks.in_session(tick_table(spark))
    assert inside.count() == 7  # noon is in no session
    found = tick_bars.bars_of_ticks(tick_table(spark)).orderBy("datetime").collect()
    got = [(r["datetime"].strftime("%H:%M"), r["open"], r["high"], r["low"], r["close"], r["volume"], r["poc"], r["delta"], r["open_interest"]) for r in found]
    utc = {"01:00": "09:00", "01:05": "09:05", "13:00": "21:00"}
    got = [(utc.get(t, t), *rest) for t, *rest in got]
    assert got == [("09:00", 110, 110, 100, 105, 10, 110, 2, 999), ("09:05", 120, 120, 120, 120, 4, 120, 0, 1003), ("21:00", 120, 120, 120, 120, 7, 120, 7, 1003)]


def test_session_ends_are_inside(spark):
    at = ["10:14:59", "10:15:00", "10:15:01"]
    rows = [(CU, i, int(dt.datetime.fromisoformat(f"2024-01-10T{t}+08:00").timestamp()) * 1e9, 100.0, 101.0, 99.0, 5.0 + i, 10.0, 99.0, 101.0) for i, t in enumerate(["10:14:50", *at])]
    t = full_ticks(spark, rows)
    assert ticks.in_session(t).count() == 3
    assert tick_bars.bars_of_ticks(t).count() == 2


def test_previous_tick_crosses_chunks(spark):
    d = spark.createDataFrame([("A", i, i // 3, i * 10) for i in range(10)] + [("B", 0, 0, 7)], "contract string, t int, day int, v int")
    got = {(r["contract"], r["t"]): r["prev_v"] for r in bars.previous_tick(d, ("t",), ["v"], F.col("day")).collect()}
    assert got == {("A", i): (i - 1) * 10 if i else None for i in range(10)} | {("B", 0): None}


def test_point_of_control_ties_to_the_lowest(spark):
    rows = [("A", T0, i, float(level), float(level), q, s, 0) for i, (level, q, s) in enumerate([(1, 10, 1), (2, 4, -1), (3, 10, -1), (5, 99, 0)])]
    t = spark.createDataFrame(rows, "contract string, datetime timestamp, n int, price double, level double, qty long, side int, oi long")
    b = bars.bars_of(bars.ladder_of(t, ("n",))).first()
    assert (b["poc"], b["volume"], b["delta"], b["open"], b["close"]) == (1.0, 123, -4, 1.0, 5.0)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "SHFE.cu2401_tick.csv").write_text(f"{CU}.datetime," + ",".join(f"{CU}.{c}" for c in ticks.NUMERIC) + "\nx," + ",".join(["1"] * 12) + "\ny," + ",".join(["2", "bad", *["3"] * 10]) + "\n")
    t = ticks.filled_forward(ticks.read_tick_csv(spark, f"{tmp_path}/SHFE.cu2401_tick.csv")).orderBy("seq").collect()
    assert [r["contract"] for r in t] == [CU, CU] and t[1]["last_price"] == 1.0
    (tmp_path / "period_of_5_a_b_SHFE.cu2401_2.csv").write_text("﻿datetime,open,high,low,close,volume,poc,delta,buy_imbalance,sell_imbalance,open_interest\n2024.01.02 09:00,1,2,0,1,5,1,2,,,10\nbad,1,2,0,1,5,1,2,,,10\n2024.01.01 09:00,x,2,0,1,5,1,2,,,10\n")
    b = ticks.read_bar_csv(spark, f"{tmp_path}/period*.csv")
    assert b.count() == 2 and b.where("open is null").count() == 1
    assert ticks.read_bar_csv(spark, f"{tmp_path}/period*.csv", [CU], "2024-01-02").count() == 1
    ticks.write_table(b, f"{tmp_path}/bars")
    assert spark.read.parquet(f"{tmp_path}/bars").count() == 2


def test_numbers_are_carried_between_chunks(spark):
    rows = [(c, (chunk << 33) + i, None if (chunk, i) in ((0, 0), (1, 0), (2, 1), (3, 0), (3, 1)) else float(10 * chunk + i)) for c in "AB" for chunk in range(4) for i in range(2)]
    t = spark.createDataFrame([(c, s, *[x] * len(ticks.NUMERIC)) for c, s, x in rows], "contract string, seq long, " + ", ".join(f"{n} double" for n in ticks.NUMERIC)).repartition(3)
    found = ticks.filled_forward(t).where("contract = 'A'").orderBy("seq").collect()
    assert [r["last_price"] for r in found] == [0.0, 1.0, 1.0, 11.0, 20.0, 20.0, 20.0, 20.0] and found[0]["volume"] == 0.0


def test_calendar():
    assert len(calendar.INSTRUMENTS) == 44 and calendar.tick_size("CU") == 10.0
    assert calendar.session_rows("au", ("21:00:00-02:30:00",)) == [("au", 75600, 95400)]


# ---- simulation


def test_greedy(spark):
    d = spark.createDataFrame([("A", i, i + 5) for i in range(0, 30, 3)], "contract string, i int, next_i int")
    assert sorted(r["i"] for r in simulate.greedy(d, ["contract"]).collect()) == [0, 6, 12, 18, 24]


def flat(spark, n, **changes):
    rows = [("A", T0 + dt.timedelta(minutes=i), 1000.0, 1000.0, 1000.0, 1000.0, 10, 1000.0, 0, 1) for i in range(n)]
    return spark.createDataFrame(rows, BAR)


def halves(spark, at=10**6):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=at), T0 + dt.timedelta(minutes=at + 1))], "train_end timestamp, test_start timestamp")


def test_fixed_hold_may_begin_on_the_exit_bar(spark):
    d = flat(spark, 21).withColumns({"signal_score": F.lit(1.0), "risk_pass": F.lit(True)})
    cuts = spark.createDataFrame([(0.5, -0.5)], "long_threshold double, short_threshold double")
    t = simulate.fixed_hold_trades(d, cuts, halves(spark))
    assert sorted(r["i"] for r in t.collect()) == [0, 5, 10, 15]
    crossing = simulate.fixed_hold_trades(d, cuts, halves(spark, 12))
    assert sorted(r["i"] for r in crossing.collect()) == [0, 5, 13]


def test_stop_comes_first_and_gaps_fill_at_the_open(spark):
    rows = [("A", T0, 1000.0, 1000.0, 1000.0, 1000.0), ("A", T0 + dt.timedelta(minutes=1), 1000.0, 1050.0, 980.0, 1000.0), ("A", T0 + dt.timedelta(minutes=2), 950.0, 1090.0, 940.0, 1000.0)]
    d = spark.createDataFrame(rows, "contract string, datetime timestamp, open double, high double, low double, close double").withColumns({"stop_price_signal": F.lit(960.0), "atr20_ticks": F.lit(3.0), "ready": F.col("datetime") == F.lit(T0)})
    t = simulate.barrier_trades(d, F.col("ready"), halves(spark), "long", bars=2, stop_atr=1.0, take=2.0, tick=10.0, cost=2.0).first()
    assert (t["stop_price"], t["take_profit_price"], t["exit_price"], t["exit_reason"], t["holding_bars"]) == (960.0, 1080.0, 950.0, "stop_loss", 2)
    assert t["gross_return"] == pytest.approx(-0.05) and t["net_return"] == pytest.approx(-0.07)


def test_short_mirrors_long(spark, some_bars):
    p = features.pullback(features.labels(features.extended(some_bars)))
    split = fit.time_split(some_bars)
    for side, flag in (("long", "strong_bullish_close_flag"), ("short", "strong_bearish_close_flag")):
        t = simulate.barrier_trades(p, F.col(flag) & F.col("trade_ready"), split, side).persist()
        assert t.count() > 0
        assert {r["status"] for r in audit.trade_checks(t, some_bars, split).unionByName(audit.path_replay(t, some_bars)).collect()} == {"PASS"}
        wrong = t.withColumns({"exit_price": F.col("exit_price") * 1.01, "exit_time": F.col("exit_time") + F.expr("interval 10 minutes")})
        bad = {r["check_id"] for r in audit.trade_checks(wrong, some_bars, split).unionByName(audit.path_replay(wrong, some_bars)).collect() if r["status"] == "FAIL"}
        assert {"gross_return", "path_replay"} <= bad


def test_time_split(spark):
    s = fit.time_split(spark.createDataFrame([(T0 + dt.timedelta(minutes=i),) for i in range(11)], "datetime timestamp")).first()
    assert (s["train_end"], s["test_start"]) == (T0 + dt.timedelta(minutes=8), T0 + dt.timedelta(minutes=9))


def test_sweep_grid_and_cases(spark, some_bars):
    cases = sweep.grid()
    assert len(cases) == 384 and cases[0]["case_id"] == "case_0001"
    p = features.pullback(features.labels(features.extended(some_bars))).persist()
    few = [c for c in cases if c["time_i"] == 0 and c["stop_i"] == 0 and c["kline_mode"] != "full_patterns" and not c["space_filter_on"]]
    base = F.col("strong_bullish_close_flag") & F.col("trade_ready")
    t = sweep.sweep_trades(p, fit.time_split(some_bars), "long", few, signals=lambda kline, space: base)
    one = simulate.barrier_trades(p, base, fit.time_split(some_bars), "long", bars=5, stop_atr=0.5, take=1.0)
    mine = t.where(F.col("case_id") == few[0]["case_id"])
    assert sorted(r["i"] for r in mine.collect()) == sorted(r["i"] for r in one.collect())
    table = spark.createDataFrame(few)
    train, test = (sweep.case_summary(t, table, s).select(*table.columns, "trade_count", "win_rate", "avg_net_return", "sum_net_return") for s in ("train", "test"))
    scored = metrics.plateau_scores(train)
    ranked = sweep.ranking(scored, test, least_trades=1, top=3)
    by = {r["case_id"]: r for r in ranked.collect()}
    best = sorted(scored.collect(), key=lambda r: (-r["plateau_score"], -r["neighbour_mean"], -r["avg_net_return"], r["case_id"]))[:3]
    assert [by[r["case_id"]]["train_rank"] for r in best] == [1, 2, 3]
    assert all((r["train_rank"] is None) == (r["recommendation_status"] == "test_only") for r in by.values()) and 3 <= len(by) <= 6
    mean = {c["case_id"]: c for c in train.collect()}
    first = best[0]
    near = [c for c in mean.values() if c["kline_mode"] == first["kline_mode"] and abs(c["take_i"] - first["take_i"]) <= 1]
    net = [c["avg_net_return"] for c in near]
    want = np.mean(net) * np.mean([x > 0 for x in net]) * math.log1p(first["trade_count"]) / (np.std(net, ddof=1) + 0.1 * abs(np.mean(net)) + 1e-12)
    assert first["plateau_score"] == pytest.approx(want)
    chosen = sweep.best_cases(ranked, test, table)
    same = sweep.asymmetry(chosen, chosen, {"time_i": 4, "stop_i": 4, "take_i": 4}).first()
    assert same["asymmetry_score"] == 0.0 and same["long_selection_source"] in ("train_test_consistent", "test_only")


def test_sweep_ends_where_bars_end(spark):
    """The longest horizon of a sweep does not shorten the others'."""
    d = flat(spark, 12).withColumns({"ready": F.lit(True), "stop_price_signal": F.lit(900.0), "short_stop_price_signal": F.lit(1100.0), "atr20_ticks": F.lit(3.0)})
    cases = sweep.grid(times=(2, 9), stops=(1.0,), takes=(2.0,), klines=("none",), spaces=(False,))
    t = sweep.sweep_trades(d, halves(spark), "long", cases, signals=lambda kline, space: F.col("ready"))
    assert {(r["case_id"], r["i"]) for r in t.collect()} == {("case_0001", i) for i in (0, 3, 6, 9)} | {("case_0002", 0)}


# ---- fits and metrics


def test_transform_falls_back_to_global(spark):
    train = spark.createDataFrame([("A", "f", float(i)) for i in range(100)] + [("B", "g", 3.0)] * 5, "contract string, feature string, x double")
    params = fit.transform_params(train)
    by = {(r["contract"], r["feature"]): r for r in params.collect()}
    assert by["A", "f"]["scale_type"] == "mad" and by["A", "f"]["center"] == pytest.approx(49.5) and by["B", "g"]["scale_type"] == "constant"
    new = fit.standardised(spark.createDataFrame([("N", "f", 1000.0), ("N", "f", None)], "contract string, feature string, x double"), params)
    wide = fit.with_z(spark.createDataFrame([("N", 1000.0), ("N", None), ("A", 50.0)], "contract string, f double"), params, ["f"], clipped=True)
    found = {(r["contract"], r["f"]): r["z_f"] for r in wide.collect()}
    z = {r["x"]: r["z"] for r in new.collect()}
    assert found["N", by[fit.GLOBAL, "f"]["upper"]] == z[1000.0] and found["N", None] is None
    assert found["A", 50.0] == pytest.approx((50.0 - 49.5) / by["A", "f"]["scale"])
    assert z[1000.0] == pytest.approx((by[fit.GLOBAL, "f"]["upper"] - 49.5) / by[fit.GLOBAL, "f"]["scale"]) and z[None] is None


def test_selection_caps_correlation_and_groups():
    rows = [{"feature": f, "coverage": 1.0, "unique_count": 50, "spearman_ic": ic} for f, ic in (("a1", 0.10), ("a2", -0.09), ("a3", 0.08), ("b1", 0.02), ("c1", 0.05))]
    groups = {r["feature"]: r["feature"][0] for r in rows}
    corr = {("a1", "a2"): 0.9, ("a1", "a3"): 0.2}
    chosen = [r["feature"] for r in fit.select_features(rows, corr, groups, most=4)]
    assert chosen[:3] == ["a1", "b1", "c1"] and "a2" not in chosen
    assert fit.select_dimension(rows, corr, ["a1", "a2", "a3"], most=2) == ["a1", "a3"]
    assert fit.select_features([], {}, {}) == []


def test_drawdown_starts_at_the_first_value(spark):
    rows = [("A", T0 + dt.timedelta(minutes=i), "long", x, x, "train") for i, x in enumerate([-0.5, 0.2, -0.3])]
    m = metrics.strategy_metrics(spark.createDataFrame(rows, "contract string, signal_time timestamp, side string, gross_return double, net_return double, split string"), ["split"]).first()
    assert m["max_drawdown"] == pytest.approx(-0.3) and m["win_rate"] == pytest.approx(1 / 3)


def test_indicators(spark, some_bars):
    p = some_bars.where("contract = 'A'").toPandas().sort_values("datetime")
    a = indicators.atr(some_bars, 14).where("contract = 'A'")
    tr = pd.concat([p["high"] - p["low"], (p["high"] - p["close"].shift()).abs(), (p["low"] - p["close"].shift()).abs()], axis=1).max(axis=1).iloc[1:]
    want = [None] * 14 + [tr.iloc[:14].mean()]
    for x in tr.iloc[14:]:
        want.append((want[-1] * 13 + x) / 14)
    close_to(column(a, "atr"), want)
    assert column(indicators.kama(some_bars).where("contract = 'A'"), "kama")[:3] == [0.0, 0.0, 0.0]
    assert indicators.keltner(some_bars).where("upper < lower").count() == 0


def wilder(rows, period):
    """Average true range of the last of rows (high, low, close), step by step."""
    tr = [max(h - low, abs(h - c), abs(low - c)) for (h, low, _), (_, _, c) in zip(rows[1:], rows, strict=False)]
    if len(tr) < period:
        return None
    out = sum(tr[:period]) / period
    for x in tr[period:]:
        out = (out * (period - 1) + x) / period
    return out


def test_recursive_indicators_row_by_row(spark, some_bars):
    p = some_bars.where("contract = 'B'").toPandas().sort_values("datetime")
    rows = list(zip(p["high"], p["low"], p["close"], strict=True))
    of = lambda df, c: column(df.where("contract = 'B'"), c)
    close_to(of(indicators.atr(some_bars, 7), "atr"), [wilder(rows[: i + 1], 7) for i in range(len(rows))])
    bands = indicators.kama_atr(some_bars, slow=20, period=11)
    close_to(of(bands, "atr"), [wilder(rows[i - 40 : i], 11) if i >= 40 else None for i in range(len(rows))])
    assert bands.where("upper < kama or lower > kama").count() == 0
    close = p["close"].tolist()
    want = [None] * 4 + [sum(close[:5]) / 5]
    for x in close[5:]:
        want.append(want[-1] + 2 / 6 * (x - want[-1]))
    close_to(of(indicators.ema(some_bars, 5), "ema"), want)
    assert indicators.kama_atr(some_bars, slow=5, period=30).where("atr is not null").count() == 0 and indicators.ema(some_bars, 10_000).where("ema is not null").count() == 0


def test_wilder_of_a_long_contract(spark):
    n = 7000  # several pieces
    r = np.random.default_rng(5)
    close = 100 + np.cumsum(r.normal(size=n))
    d = spark.createDataFrame(pd.DataFrame({"contract": "A", "datetime": np.arange(n), "high": close + 1, "low": close - r.uniform(0, 2, n), "close": close}))
    found = indicators.atr(d, 14).toPandas().sort_values("datetime")["atr"]
    rows = list(d.select("high", "low", "close").toPandas().itertuples(index=False, name=None))
    assert found.isna().sum() == 14 and found.iloc[-1] == pytest.approx(wilder(rows, 14), abs=1e-9) and found.iloc[5000] == pytest.approx(wilder(rows[:5001], 14), abs=1e-9)


# ---- audits


def test_audits_find_seeded_defects(spark, some_bars):
    status = lambda df: {r["check_id"]: r["status"] for r in audit.bar_integrity(df).collect()}
    assert status(some_bars)["ohlc_order"] == "PASS" and status(some_bars)["duplicate_key"] == "PASS"
    assert status(some_bars.union(some_bars.limit(1)))["duplicate_key"] == "FAIL"
    assert status(some_bars.withColumn("high", F.col("low") - 1))["ohlc_order"] == "FAIL"
    assert status(some_bars.withColumn("delta", F.col("volume") + 1))["delta_bound"] == "FAIL"
    y = features.labels(some_bars)
    leak = audit.tail_nulls(y.withColumn("future_return_5", F.coalesce("future_return_5", F.lit(0.0))), {"future_return_5": 5, "future_return_1": 1})
    assert {r["label"]: r["leaked_rows"] for r in leak.collect()} == {"future_return_5": 10, "future_return_1": 0}
    same = audit.differences(y, y, ["contract", "datetime"], ["future_return_5"]).first()
    assert (same["only_expected"], same["mismatch_count"]) == (0, 0)
    assert audit.forbidden_columns(y) == [c for c in features.LABELS]
    assert {r["status"] for r in audit.golden_diff(some_bars, some_bars, ["open", "close"], ["volume"], []).collect()} == {"passed"}


# ---- streams


def test_stream_equals_batch(spark, tmp_path):
    rows = [("A", T0 + dt.timedelta(seconds=20 * i), i, 100.0 + i % 7, float(100 + i % 7), i % 5, (i % 3) - 1) for i in range(200)]
    schema = "contract string, ts timestamp, event_id long, price double, level double, qty long, side int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    query = write_bars(stream_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert not query.isActive
    batch = stream_bars(spark.createDataFrame(rows, schema))
    done = spark.read.parquet(f"{tmp_path}/out")
    assert done.count() > 5 and done.exceptAll(batch).count() == 0
