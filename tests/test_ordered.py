"""Order statistics and running figures of large groups, the normal p-value, and what is built on them, against plain Python."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import kernels, ordered
from tidebar.operators import audit, bars, metrics

T0 = dt.datetime(2024, 1, 1)


def cont(x, p):
    x, place = sorted(x), p * (len(x) - 1)
    lo, hi, d = x[math.floor(place)], x[math.ceil(place)], place - math.floor(place)
    return lo if d == 0 else lo * (1 - d) + hi * d


PROBABILITIES = [0.0, 0.001, 0.01, 0.3, 0.5, 0.99, 0.999, 1.0]


def test_quantiles_of_a_million_values_and_ties(spark, tmp_path):
    r = np.random.default_rng(0)
    n = 1_300_000
    p = pd.DataFrame({"g": np.where(r.random(n) < 0.9, "hot", "small"), "x": np.where(r.random(n) < 0.3, 7.5, r.standard_cauchy(n))})
    p.to_parquet(f"{tmp_path}/p.parquet")
    found = {row["g"]: row["q"] for row in ordered.quantiles(spark.read.parquet(f"{tmp_path}/p.parquet"), ["g"], "x", PROBABILITIES).collect()}
    assert p["x"].nunique() > 800_000
    for g, own in p.groupby("g"):
        assert found[g] == [cont(own["x"].tolist(), q) for q in PROBABILITIES]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_of_small_groups(spark, seed):
    r = random.Random(seed)
    groups = {(k if k % 7 else None, "a" if k % 2 else None): [r.choice([1.0, 2.5, -3.0, r.gauss(0, 9), math.inf]) for _ in range(k % 13 + 1)] for k in range(40)}
    rows = [(a, b, x) for (a, b), xs in groups.items() for x in [*xs, None]] + [(99, "none", None)]
    d = spark.createDataFrame(rows, "a int, b string, x double").repartition(5)
    found = {(row["a"], row["b"]): row["q"] for row in ordered.quantiles(d, ["a", "b"], "x", PROBABILITIES).collect()}
    merged = {}
    for a, b, x in rows:
        if x is not None:
            merged.setdefault((a, b), []).append(x)
    assert set(found) == set(merged)
    for k, xs in merged.items():
        assert found[k] == pytest.approx([cont(xs, q) for q in PROBABILITIES], nan_ok=True)


def test_quantiles_without_rows_or_keys(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert ordered.quantiles(none, [], "x", [0.5]).collect() == ordered.quantiles(none, ["g"], "x", [0.5]).collect() == []
    d = spark.createDataFrame([(None, 3.0), ("a", 1.0)], "g string, x double")
    assert ordered.quantiles(d, [], "x", [0.5]).first()["q"] == [2.0]
    grouped = spark.createDataFrame([("a",), (None,), ("z",)], "g string")
    assert sorted(map(tuple, ordered.with_quantiles(grouped, d, ["g"], "x", {"m": 0.5}).collect()), key=str) == [("a", 1.0), ("z", None), (None, 3.0)]


def test_no_percentile_is_left():
    from pathlib import Path

    for f in Path(ordered.__file__).parent.parent.glob("[!l]*/*.py"):
        assert not any(w in f.read_text() for w in ("F.percentile(", "F.median(")), f


TRADE = "contract string, signal_time timestamp, exit_time timestamp, net_return double, split string"


def trade_rows(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(hours=r.randint(0, 3000))
        out.append((r.choice("ABC"), at, at + dt.timedelta(hours=r.randint(1, 400)), r.choice([-1.0, 0.5, r.gauss(0, 1)]), r.choice(["train", "test", None])))
    return list({(t[0], t[1]): t for t in out}.values())


def test_running_sums_and_falls_over_chunks(spark):
    rows = trade_rows(400)
    d = spark.createDataFrame(rows, TRADE).repartition(7)
    got = {(r["split"], r["contract"], r["signal_time"]): (r["s"], r["i"]) for r in ordered.running(d, ["split"], F.date_trunc("day", "exit_time"), ["exit_time", "contract", "signal_time"], "net_return", "s", "i").collect()}
    falls = {r["split"]: r["f"] for r in ordered.deepest_fall(d, ["split"], F.struct("contract", F.date_trunc("month", "signal_time")), ["contract", "signal_time"], "net_return", "f").collect()}
    for s in {t[4] for t in rows}:
        total = 0.0
        for i, t in enumerate(sorted((t for t in rows if t[4] == s), key=lambda t: (t[2], t[0], t[1]))):
            total += t[3]
            assert got[s, t[0], t[1]] == (pytest.approx(total), i + 1)
        path = np.cumsum([t[3] for t in sorted((t for t in rows if t[4] == s), key=lambda t: (t[0], t[1]))])
        assert falls[s] == pytest.approx((path - np.maximum.accumulate(path)).min())


def drawn(n, size, part, samples, seed=20260528):
    """Places of every sample's blocks, as stated."""
    for s in range(samples):
        yield [(int(hashlib.sha256(f"{seed}:{part}:{s}:{b}".encode()).hexdigest()[:8], 16) * (n - size + 1) >> 32, min(size, n - b * size)) for b in range(-(-n // size))]


def sampled(x, size, part, samples):
    return np.array([np.concatenate([x[at : at + k] for at, k in places]).mean() for places in drawn(len(x), size, part, samples)])


def test_bootstrap_equals_its_draws(spark):
    rows = trade_rows(250, 3)
    found = {r["split"]: r for r in metrics.block_bootstrap(spark.createDataFrame(rows, TRADE), ["split"], samples=80).collect()}
    for s in {t[4] for t in rows}:
        x = np.array([t[3] for t in sorted((t for t in rows if t[4] == s), key=lambda t: (t[2], t[0], t[1]))])
        means = sampled(x, min(len(x), max(5, round(len(x) ** 0.5))), "one", 80)
        assert (found[s]["trades"], found[s]["mean"]) == (len(x), pytest.approx(x.mean()))
        assert (found[s]["low"], found[s]["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_bootstrap_of_one_trade_and_of_missing_sides(spark):
    d = spark.createDataFrame([("A", T0, T0, 2.0, "test")], TRADE)
    (row,) = metrics.block_bootstrap(d, ["split"], samples=9).collect()
    assert (row["low"], row["high"]) == (2.0, 2.0)
    (pair,) = metrics.bootstrap_differences(d.withColumn("combo_name", F.lit("a")), ["a", "b"]).collect()
    assert (pair["combo_name"], pair["benchmark_combo"], pair["low"], pair["high"]) == ("b", "a", None, None)
    assert metrics.block_bootstrap(d.limit(0), ["split"]).collect() == []


def test_erfc_is_that_of_the_library(spark):
    x = [0.0, 1e-300, 1e-9, 0.46875, 0.469, 0.5, 1.0, 2.0, 3.999, 4.0, 4.001, 6.0, 10.0, 25.9, 26.5, 40.0, *np.random.default_rng(0).uniform(0, 12, 500)]
    rows = spark.createDataFrame([(float(s * v),) for v in x for s in (1, -1)] + [(None,)], "x double").select("x", kernels.erfc(F.col("x")).alias("e")).collect()
    for r in rows:
        if r["x"] is None:
            assert r["e"] is None
        else:
            assert abs(r["e"] - math.erfc(r["x"])) < 1e-15 and (r["x"] > 26 or r["e"] == pytest.approx(math.erfc(r["x"]), rel=2e-14))


def runs_brute(levels, ratio, run, step):
    """(side, from, to) by a grid of all levels and a rolling count."""
    low, high = min(levels), max(levels)
    grid = [round(low + i * step, 10) for i in range(round((high - low) / step) + 1)]
    out = []
    for k, side in ((0, "buy"), (1, "sell")):
        own = [levels.get(g, (0, 0)) for g in grid]
        flag = [(a >= ratio * b) if b > 0 else a >= 1 for a, b in ((v[k], v[1 - k]) for v in own)]
        full = [i for i in range(len(grid)) if i >= run - 1 and all(flag[i - run + 1 : i + 1])]
        for i in full:
            if i - 1 not in full:
                start = i
            if i + 1 not in full:
                out.append((side, grid[start], grid[i]))
    return sorted(out)


@pytest.mark.parametrize("step", [1.0, 0.02, 0.005, 0.2])
def test_imbalance_by_a_levels_own_sides(spark, step):
    r = random.Random(7)
    books = {i: {round(100 + k * step, 10): (r.choice([0, 0, 1, 3, 9]), r.choice([0, 0, 1, 3, 9])) for k in range(40) if r.random() < 0.9} for i in range(12)}
    rows = [("A", T0 + dt.timedelta(hours=i), p, *v) for i, book in books.items() for p, v in book.items()]
    ladder = spark.createDataFrame(rows, "contract string, datetime timestamp, level double, buy long, sell long")
    found = {}
    for x in bars.imbalance_runs(ladder, 3.0, 3, step).collect():
        found.setdefault((x["datetime"] - T0).seconds // 3600, []).append((x["side"], x["from_level"], x["high_level"]))
    for i, book in books.items():
        assert [(s, pytest.approx(a), pytest.approx(b)) for s, a, b in sorted(found.get(i, []))] == runs_brute(book, 3.0, 3, step)
    assert bars.price_grid(ladder, step).groupBy("datetime").count().count() == 12 and bars.price_grid(ladder, step).count() == sum(round((max(b) - min(b)) / step) + 1 for b in books.values())


def test_replay_of_trades_of_several_cases(spark):
    bar = lambda i, low, high: ("A", T0 + dt.timedelta(minutes=i), float(high), float(low))
    b = spark.createDataFrame([bar(i, 99, 101) for i in range(40)] + [bar(40, 90, 101)] + [bar(i, 99, 101) for i in range(41, 90)], "contract string, datetime timestamp, high double, low double")
    at = lambda i: T0 + dt.timedelta(minutes=i)
    t = [("x", "A", "long", at(1), at(2), at(40), 95.0, 110.0, "stop_loss"), ("y", "A", "long", at(1), at(2), at(41), 95.0, 110.0, "stop_loss"), ("x", "A", "long", at(45), at(46), at(80), 95.0, 110.0, "time_barrier")]
    t += [("z", "A", "long", at(1), at(2), at(60), 95.0, 110.0, "time_barrier"), ("z", "A", "short", at(1), at(2), at(39), 110.0, 95.0, "time_barrier"), ("w", "A", "long", at(1), at(2), at(500), 95.0, 110.0, "stop_loss")]
    trades = spark.createDataFrame(t, "case_id string, contract string, side string, signal_time timestamp, entry_time timestamp, exit_time timestamp, stop_price double, take_profit_price double, exit_reason string")
    assert audit.path_replay(trades, b, ("case_id",)).first()["affected_rows"] == 3  # y too late, z's stop passed over, w ends at no bar
    assert audit.path_replay(trades.where("case_id = 'x'"), b, ("case_id",), bucket=7).first()["status"] == "PASS"


def test_integrity_finds_every_defect(spark):
    good = ("A", T0, 1.0, 2.0, 0.5, 1.5, 10, 1.0, 5, 100)
    put = lambda **c: tuple(c.get(k, v) for k, v in zip(audit.CORE, good, strict=True))
    rows = [put(), put(datetime=T0 + dt.timedelta(hours=1), poc=0.4), put(datetime=T0 + dt.timedelta(hours=2), open_interest=-1), put(datetime=T0 + dt.timedelta(hours=3), volume=None, high=math.inf), put(datetime=T0 + dt.timedelta(hours=4), delta=11), put(), put(datetime=None), put(datetime=T0 + dt.timedelta(hours=5), close=3.0, volume=-1)]
    d = spark.createDataFrame(rows, "contract string, datetime timestamp, open double, high double, low double, close double, volume long, poc double, delta long, open_interest long")
    n = {r["check_id"]: r["affected_rows"] for r in audit.bar_integrity(d).collect()}
    assert n == {"core_columns": 0, "invalid_time": 1, "duplicate_key": 1, "time_order": 1, "null_price": 0, "core_nulls": 2, "infinite_values": 1, "ohlc_order": 1, "negative_volume": 1, "zero_volume": 0, "negative_open_interest": 1, "delta_bound": 2, "poc_in_range": 1}
    short = {r["check_id"]: r["affected_rows"] for r in audit.bar_integrity(d.drop("poc", "volume")).collect()}
    assert (short["core_columns"], short["poc_in_range"], short["negative_volume"]) == (2, 8, 8)
    report = {r["field"]: r for r in audit.column_report(d).collect()}
    assert (report["volume"]["null_count"], report["high"]["inf_count"], report["high"]["max"], report["low"]["zero_variance"]) == (1, 1, 2.0, True)
