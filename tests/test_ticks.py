"""Raw tick files: discovery, headers, bad numbers, and bars of any width against a fold over lines of text."""

import datetime as dt
import math
import random
from types import SimpleNamespace

import pytest

from tidebar.operators import tick_bars
from tidebar.plans import tables
from tidebar.sources import calendar, shared, ticks

ZONE = dt.timezone(dt.timedelta(hours=8))
TIMES = [("09:00:00", 75), ("10:30:00", 60), ("13:30:00", 90), ("21:00:00", 120), ("11:31:00", 20)]  # the last is in no session


def lines_of(contract, seed, days=3, first="2024-01-09"):
    """Lines of a tick file in time order, with gaps, missing and bad numbers, volume falls, and ticks at session begins and ends."""
    r = random.Random(seed)
    out, oi, tick = [], 5000, calendar.tick_size(contract.split(".")[1].rstrip("0123456789"))
    price = 300 * tick
    for d in range(days):
        day, volume = dt.datetime.fromisoformat(first) + dt.timedelta(days=d), 0
        for begin, minutes in sorted(TIMES):
            t = dt.datetime.combine(day.date(), dt.time.fromisoformat(begin), ZONE)
            end = t + dt.timedelta(minutes=minutes)
            while t <= end:
                price += tick * r.choice([-1, 0, 0, 1])
                volume += r.choice([0, 0, 1, 2, 5])
                oi += r.choice([-2, -1, 0, 0, 1, 2])
                v = {"datetime_nano": str(int(t.timestamp() * 1e9)), "last_price": f"{price:.4f}", "highest": f"{price + 5 * tick:.4f}", "lowest": f"{price - 5 * tick:.4f}", "average": "1", "volume": str(volume), "amount": "1", "open_interest": str(oi)}
                v |= {"bid_price1": f"{price - tick * r.choice([0, 1]):.4f}", "bid_volume1": "1", "ask_price1": f"{price + tick * r.choice([0, 1]):.4f}", "ask_volume1": "1"}
                for c in ("last_price", "lowest", "bid_price1", "volume", "open_interest"):
                    if r.random() < 0.06:
                        v[c] = r.choice(["nan", "NaN", "", "bad", "null"])
                if r.random() < 0.02:
                    v["ask_price1"] = r.choice(["0", "nan"])
                if r.random() < 0.02:
                    volume = max(volume - 3, 0)
                out.append((t.strftime("%Y-%m-%d %H:%M:%S.%f"), v))
                t += dt.timedelta(seconds=r.choice([0, 1, 30, 60, 299, 300, 1500]) + r.choice([0, 0.5]))
            if r.random() < 0.5:
                out.append((end.strftime("%Y-%m-%d %H:%M:%S.%f"), out[-1][1] | {"datetime_nano": str(int(end.timestamp() * 1e9))}))
    return out


def write(path, contract, lines, columns=None):
    columns = columns or ["datetime", *ticks.NUMERIC]
    rows = [",".join([contract + "." + c for c in columns])] + [",".join(t if c == "datetime" else v.get(c, "") for c in columns) for t, v in lines]
    path.write_text("﻿" + "\n".join(rows) + "\n")


def fold(contract, lines, minutes):
    """The rules one tick at a time."""
    symbol = contract.split(".")[1].rstrip("0123456789").lower()
    known = {s.lower(): (t, (*d, *n)) for s, _, _, t, d, n in calendar.INSTRUMENTS}
    tick, sessions = known[symbol]
    places = max(len(f"{tick:.6f}".rstrip("0").partition(".")[2]), 1)
    last, good, bars, bar, end = dict.fromkeys(ticks.NUMERIC, 0.0), [], [], None, None

    def num(x):
        try:
            return None if math.isnan(float(x)) else float(x)
        except ValueError:
            return None

    for _, v in lines:
        last = {c: last[c] if (x := num(v.get(c, ""))) is None else x for c in ticks.NUMERIC}
        ms = last["datetime_nano"] / 1e6
        wall = dt.datetime.fromtimestamp(ms / 1000, ZONE)
        base = wall.date() - dt.timedelta(days=wall.hour < 8)
        midnight = dt.datetime.combine(base, dt.time(), ZONE).timestamp() * 1000
        inside = [midnight + b * 1000 for _, b, e in calendar.session_rows(symbol, sessions) if b * 1000 <= ms - midnight <= e * 1000]
        if inside and last["highest"] >= last["lowest"] and all(last[c] for c in ("last_price", "highest", "lowest", "bid_price1", "ask_price1")) and last["volume"] >= 0:
            good.append(last | {"ms": ms, "session": inside[0], "wall": wall})
    buys, sells = {("OPEN", "UP"), ("CLOSE", "UP"), ("EXCHANGE", "UP")}, {("OPEN", "DOWN"), ("CLOSE", "DOWN"), ("EXCHANGE", "DOWN")}
    for p, t in zip(good, good[1:]):
        d, oi, x = t["volume"] - p["volume"], t["open_interest"] - p["open_interest"], t["last_price"]
        if d < 0:
            d = t["volume"] if t["ms"] - p["ms"] > 600_000 else 0
        kind = "NONE" if oi == d == 0 else "EXCHANGE" if oi == 0 else ("DOUBLE" if oi == d else "OPEN") if oi > 0 else ("DOUBLE" if oi + d == 0 else "CLOSE")
        way = "UP" if x >= p["ask_price1"] else "DOWN" if x <= p["bid_price1"] else "UP" if x >= t["ask_price1"] else "DOWN" if x <= t["bid_price1"] else "MIDDLE"
        if end is None or t["ms"] >= end:
            width = minutes * 60_000
            end = max(t["ms"] // width * width, t["session"]) + width
            bars.append({"at": t["wall"].replace(second=0, microsecond=0, tzinfo=None), "prices": [], "levels": {}, "volume": 0, "delta": 0})
        bar = bars[-1]
        side = ((kind, way) in buys) - ((kind, way) in sells)
        bar["prices"].append(x)
        bar["levels"][x] = bar["levels"].get(x, 0) + d * abs(side)
        bar["volume"] += d
        bar["delta"] += d * side
        bar["oi"] = int(t["open_interest"])
    r = lambda x: round(x, places)
    return [(contract, b["at"], r(b["prices"][0]), r(max(b["prices"])), r(min(b["prices"])), r(b["prices"][-1]), int(b["volume"]), r(min(b["levels"], key=lambda k: (-b["levels"][k], k))), int(b["delta"]), b["oi"]) for b in bars]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("ticks")
    feeds = {"SHFE.cu2401": lines_of("SHFE.cu2401", 1), "SHFE.au2402": lines_of("SHFE.au2402", 2, 2), "INE.sc2403": lines_of("INE.sc2403", 3, 1), "SHFE.ag2404": lines_of("SHFE.ag2404", 4, 1)[:1]}
    for i, (c, lines) in enumerate(feeds.items()):
        write(at / f"{c}_tick.csv", c, lines, ["datetime", *(ticks.NUMERIC if i % 2 else ticks.NUMERIC[::-1])])
    (at / "SHFE.cu2499_tick.csv").write_text("")
    (at / "notes_tick.csv").write_text("a,b\n1,2\n")
    return at, feeds


@pytest.mark.parametrize("minutes", [5, 7, 60, 1440])
def test_bars_equal_a_fold(spark, folder, minutes):
    at, feeds = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several chunks a file
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        t = ticks.read_tick_csv(spark, f"{at}/*.csv").where("contract <> ''")
        assert t.where("contract like '%cu24%'").select("chunk").distinct().count() > 3
        found = tick_bars.bars_of_ticks(t, minutes)
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted(b for c, lines in feeds.items() for b in fold(c, lines, minutes))
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 3
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and list(g[2:]) == pytest.approx(list(w[2:])), (g, w)


def test_two_reads_of_the_ticks(spark, folder, monkeypatch):
    read = []
    whole = tick_bars.written
    monkeypatch.setattr(tick_bars, "written", lambda df, name: read.append(df) or whole(df, name))
    at, _ = folder
    bars = tick_bars.bars_of_ticks(ticks.read_tick_csv(spark, f"{at}/SHFE.cu2401_tick.csv"))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(read[0]) == 2 and "csv" not in bars._jdf.queryExecution().optimizedPlan().toString()


def test_no_ticks_no_bars(spark):
    assert tick_bars.bars_of_ticks(spark.createDataFrame([], ticks.TICKS), 5).collect() == []


def test_nan_is_missing(spark, tmp_path):
    lines = [(f"2024-01-10 09:00:0{i}", {"datetime_nano": str(1704848400_000000000 + i * 10**9), "last_price": x, "highest": "9", "lowest": "1", "volume": "1", "bid_price1": "4", "ask_price1": a}) for i, (x, a) in enumerate([("nan", "6"), ("5", "NaN"), ("NaN", "6"), ("inf", "6"), ("5", "6")])]
    write(tmp_path / "SHFE.cu2401_tick.csv", "SHFE.cu2401", lines)
    t = ticks.filled_forward(ticks.read_tick_csv(spark, f"{tmp_path}/SHFE.cu2401_tick.csv"))
    assert [(r["last_price"], r["ask_price1"]) for r in t.orderBy("seq").collect()] == [(0.0, 6.0), (5.0, 6.0), (5.0, 6.0), (math.inf, 6.0), (5.0, 6.0)]
    assert t.where(ticks.valid_price()).count() == 4 and spark.createDataFrame([(math.nan, 9.0, 1.0)], "last_price double, highest double, lowest double").where(ticks.valid_price(strict=False)).count() == 0


def test_folders_of_many_files_are_few_scans(spark, tmp_path):
    for i in range(30):
        c = f"SHFE.cu{2401 + i}"
        write(tmp_path / f"{c}_tick.csv", c, lines_of(c, i, 1)[:3], ["datetime", *(ticks.NUMERIC if i % 2 else ticks.NUMERIC[:8])])
    t = ticks.read_tick_csv(spark, str(tmp_path))
    assert t.count() == 90 and t._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert t.where("ask_volume1 is null").select("contract").distinct().count() == 15
    index = ticks.tick_index(spark, str(tmp_path))
    assert index.count() == 30 and index.where("contract = 'SHFE.cu2402'").first()["path"].endswith("SHFE.cu2402_tick.csv")
    assert ticks.read_tick_csv(spark, [f"{tmp_path}/none*"]).columns == t.columns


def test_first_golden_file_of_a_contract(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"period_of_5_{n}_z_SHFE.cu2401_9.csv").write_text("datetime\n")
    (tmp_path / "period_of_15_a_z_SHFE.cu2401_9.csv").write_text("datetime\n")
    rows = ticks.golden_index(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["path"].endswith("period_of_5_a_z_SHFE.cu2401_9.csv")


def test_next_begin_and_last_end(spark):
    at = ["2024-01-10T08:30", "2024-01-10T10:20", "2024-01-10T15:30", "2024-01-10T20:59", "2024-01-11T01:30", "2024-01-11T00:30", "2024-01-11T07:59"]
    rows = [("SHFE.cu2401", i, dt.datetime.fromisoformat(t).replace(tzinfo=ZONE).timestamp() * 1e9) for i, t in enumerate(at)]
    found = ticks.session_neighbours(spark.createDataFrame(rows, "contract string, seq long, datetime_nano double")).orderBy("seq").collect()
    wall = lambda ms: ms and (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).strftime("%dT%H:%M")
    assert [(wall(r["next_begin_ms"]), wall(r["last_end_ms"]), r["in_session"]) for r in found] == [
        ("10T09:00", "11T01:00", False), ("10T10:30", "11T01:00", False), ("10T21:00", "11T01:00", False), ("10T21:00", "11T01:00", False), (None, "11T01:00", False), (None, "11T01:00", True), (None, "11T01:00", False),
    ]


def test_folders_of_tables(spark, tmp_path):
    (tmp_path / "features.csv").write_text("\ufeffcontract,datetime,x\nA,2024-01-02 09:00:00,1.5\nA,bad,\n")
    (tmp_path / "labels.csv").write_text("")
    (tmp_path / "stage1_mvp_report.md").write_text("# report\n")
    tables, missing = ticks.read_folder(spark, str(tmp_path), ticks.STAGE1_FILES)
    assert len(ticks.STAGE1_FILES) == 12 and set(tables) == {"features"} and missing == [n for n in ticks.STAGE1_FILES if n not in ("features.csv", "stage1_mvp_report.md")]
    assert [tuple(r) for r in tables["features"].collect()] == [("A", dt.datetime(2024, 1, 2, 9), 1.5), ("A", None, None)]
    assert ticks.read_table_csv(spark, f"{tmp_path}/labels.csv") is None


def test_shared_tables_follow_their_source(spark, tmp_path):
    at = str(tmp_path / "source")
    put = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{at}/t.parquet")
    build = lambda: spark.read.parquet(f"{at}/t.parquet")
    put(3)
    assert tables.shared_table(spark, at, "t", build).count() == 3 and len(tables._KEPT) >= 1
    put(5)
    assert tables.shared_table(spark, at, "t", build).count() == 5
    kept = tables.shared_table(spark, at, "t", build).inputFiles()
    assert tables.drop_tables(spark) >= 2 and not tables._KEPT and shared.listed(spark, kept[0]) == []


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.rsplit(".", 2)[-2], d)), sparkContext=SimpleNamespace(master=master))
    assert shared.shared_folder(session("local[2]", warehouse="w/")) == "w" and shared.shared_folder(session("spark://far:7077", checkpoint="s3://c/", warehouse="w")) == "s3://c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(session("spark://far:7077", warehouse="w"))
