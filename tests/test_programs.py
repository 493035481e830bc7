"""Each program end to end on small bars."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_ticks import fold, lines_of, write
from tests_support import small_bars

from tidebar.operators import audit, fit, sweep
from tidebar.plans import programs


@pytest.fixture(scope="module")
def bars(spark):
    return small_bars(spark)


@pytest.fixture(scope="module")
def pack(bars):
    return programs.stage2_pack(bars)


def test_stage1(spark, bars, tmp_path):
    out = programs.stage1(bars)
    programs.save({k: out[k] for k in ("selected", "metrics", "trades")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/selected").count() == 5 and spark.read.parquet(f"{tmp_path}/trades").count() > 0


def test_stage1_made_again_finds_seeded_defects(spark, bars):
    out = programs.stage1(bars)
    crossing = out["trades"].where("split = 'train'").join(out["features"].select("contract", F.col("datetime").alias("exit_time")), ["contract", "exit_time"]).crossJoin(fit.time_split(bars)).where("exit_time >= test_start").count()
    assert {r["check_id"]: r["affected_rows"] for r in out["replay"].collect()} == dict.fromkeys(("selected_top", "signal_score", "threshold_side", "bars_by_number", "returns", "overlap"), 0) | {"boundary": crossing}
    split = fit.constants(fit.time_split(bars))
    scored = audit.score_again(out["features"], [(r["feature"], r["ic_direction"]) for r in out["selected"].collect()], split)
    t = out["trades"].join(scored.select("contract", F.col("datetime").alias("signal_time"), F.col("_score").alias("signal_score")), ["contract", "signal_time"])
    t = t.where(~((F.col("split") == "train") & (F.col("exit_time") >= split["test_start"])))  # this strategy lets trades run on into the test part
    one = F.col("signal_time") == t.agg(F.min("signal_time")).first()[0]
    check = lambda trades, selected=out["selected"]: {r["check_id"] for r in audit.strategy_replay(out["features"], trades, selected.select("feature"), out["summary"], split).where("status = 'FAIL'").collect()}
    assert check(t) == set()
    assert check(t.withColumn("signal_score", F.when(one, F.col("signal_score") + 1e-6).otherwise(F.col("signal_score")))) == {"signal_score"}
    assert check(t.withColumn("side", F.when(one, F.when(F.col("side") == "long", "short").otherwise("long")).otherwise(F.col("side")))) == {"threshold_side", "returns"}
    assert check(t.withColumn("exit_price", F.col("exit_price") + 1)) == {"bars_by_number"} and check(t.withColumn("net_return", F.lit(0.0))) == {"returns"}
    assert "overlap" in check(t.unionByName(t.where(one)))
    ends = {"exit_time": F.lit("2030-01-01").cast("timestamp")}
    assert {"boundary", "bars_by_number"} <= check(t.withColumns(ends))
    swapped = spark.createDataFrame([(r["feature"],) for r in out["selected"].collect()][::-1], "feature string").coalesce(1)
    assert "selected_top" in check(t, swapped)


def test_tick_validation_of_two_folders(spark, tmp_path):
    folders = [tmp_path / n for n in ("ticks", "golden")]
    for f in folders:
        f.mkdir()
    feeds = {f"SHFE.cu240{i}": lines_of(f"SHFE.cu240{i}", i, 1) for i in range(1, 6)}
    for c in ("SHFE.cu2401", "SHFE.cu2402", "SHFE.cu2403", "SHFE.cu2405"):
        write(folders[0] / f"{c}_tick.csv", c, feeds[c] if c != "SHFE.cu2405" else feeds[c][:1])
    for c in ("SHFE.cu2401", "SHFE.cu2402", "SHFE.cu2404"):
        rows = [f"{b[1]:%Y.%m.%d %H:%M},{b[2]},{b[3]},{b[4]},{b[5] + (c.endswith('2') and i == 3)},{b[6]},{b[7]},{b[8]},,,{b[9]}" for i, b in enumerate(fold(c, feeds[c], 5))]
        (folders[1] / f"period_of_5_a_b_{c}_{len(rows)}.csv").write_text("\ufeffdatetime,open,high,low,close,volume,poc,delta,buy_imbalance,sell_imbalance,open_interest\n" + "\n".join(rows) + "\n")
    found = {r["contract"]: r for r in programs.tick_validation(spark, str(folders[0]), str(folders[1]), out=str(tmp_path / "bars")).collect()}
    assert {c: r["status"] for c, r in found.items()} == {"SHFE.cu2401": "passed", "SHFE.cu2402": "value_mismatch", "SHFE.cu2403": "missing_reference", "SHFE.cu2404": "missing_input", "SHFE.cu2405": "generation_failed"}
    bad = found["SHFE.cu2402"]
    assert (bad["mismatch_count"], bad["first_mismatch_column"], bad["first_mismatch_row"]) == (1, "close", 4) and found["SHFE.cu2403"]["generated_rows"] > 5
    assert spark.read.parquet(str(tmp_path / "bars")).select("contract").distinct().count() == 3


def test_stage2(spark, bars, pack, tmp_path):
    out = programs.stage2(bars, pack=pack)
    programs.save({k: v for k, v in out.items() if k not in ("data", "params", "split", "summary", "correlations")}, str(tmp_path))
    assert 1 < spark.read.parquet(f"{tmp_path}/selected").count() <= 18 and spark.read.parquet(f"{tmp_path}/trades").count() > 0
    assert spark.read.parquet(f"{tmp_path}/audit").where("severity = 'BLOCKER' and status <> 'PASS' and category <> 'integrity'").count() == 0


def test_gain_curve(spark, bars, pack, tmp_path):
    out = programs.gain_curve(bars, pack=pack)
    programs.save(out, str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert {r["combo_name"] for r in read("trades").select("combo_name").distinct().collect()} == set(programs.GAIN_COMBOS)
    gains = {r["combo_name"]: r for r in read("gains").collect()}
    assert gains["delta_poc_position"]["benchmark_combo"] == "delta_poc" and gains["delta_poc"]["benchmark_combo"] in ("delta_only", "poc_only")
    assert all(r["effectiveness"] == "insufficient_samples" for r in gains.values())
    assert read("signal_distribution").count() == 3 * len(programs.GAIN_COMBOS) and read("interaction_patterns").count() >= 1


def test_pullback(spark, bars, pack, tmp_path):
    out = programs.pullback(bars, pack=pack)
    programs.save(out, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/funnel").count() == 15
    assert spark.read.parquet(f"{tmp_path}/audit").where("status <> 'PASS'").count() == 0
    assert spark.read.parquet(f"{tmp_path}/trades").where("combo_name = 'trend_only'").count() > 0


def test_parameter_sweep(spark, bars, pack, tmp_path):
    cases = sweep.grid(times=(5, 12), stops=(0.5, 1.0), takes=(1.0, 2.0), klines=("none", "full_patterns"), spaces=(False, True))
    out = programs.parameter_sweep(bars, pack=pack, cases=cases)
    programs.save(out, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/long_summary").count() == len(cases) and spark.read.parquet(f"{tmp_path}/comparison").count() == 2
    assert {r["recommendation_status"] for r in spark.read.parquet(f"{tmp_path}/long_ranking").collect()} <= {"test_only"}
    both = spark.read.parquet(f"{tmp_path}/asymmetry").collect()  # no row where a side has no trade in the test part
    assert len(both) <= 1 and all(r["overlap_score"] + r["asymmetry_score"] == pytest.approx(1.0) for r in both)


def test_markdown_shows_what_it_leaves_out():
    shown = programs.markdown([{"a": 1.5, "b": None}] * 3, ["a", "b"], most=2).split("\n")
    assert shown == ["| a | b |", "|---|---|", "| 1.5 | - |", "| 1.5 | - |", "(1 more rows)"]
