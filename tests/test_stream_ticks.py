"""Raw ticks as a stream: the same bars as the batch, over shuffled files, and over a restart from a checkpoint."""

import random

import pytest
from pyspark.sql import functions as F
from test_ticks import fold, lines_of

from tidebar.sources.ticks import NUMERIC, number
from tidebar.streaming.bars import write_bars
from tidebar.streaming.ticks import Fold, stream_tick_bars

FEEDS = {"SHFE.cu2401": lines_of("SHFE.cu2401", 11), "SHFE.au2402": lines_of("SHFE.au2402", 12, 2)}
SCHEMA = "contract string, ts timestamp, seq long, " + ", ".join(f"{c} double" for c in NUMERIC)


def raw(spark):
    rows = [(c, i, int(v["datetime_nano"]) // 1000, *[v.get(x) for x in NUMERIC]) for c, lines in FEEDS.items() for i, (_, v) in enumerate(lines)]
    t = spark.createDataFrame(rows, "contract string, seq long, us long, " + ", ".join(f"{c} string" for c in NUMERIC))
    return t.select("contract", F.timestamp_micros("us").alias("ts"), "seq", *[number(c).alias(c) for c in NUMERIC])


@pytest.mark.parametrize("minutes", [5, 60])
def test_stream_equals_batch_over_a_restart(spark, tmp_path, minutes):
    rows = sorted(raw(spark).collect(), key=lambda r: r["ts"])
    r = random.Random(1)
    pieces = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    half = len(pieces) // 2
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))

    def feed(parts, at):
        for i, part in enumerate(parts):
            r.shuffle(part)
            spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{source}/{at + i:04d}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(f"{source}/*")
        query = write_bars(stream_tick_bars(stream, minutes, delay="5 hours"), out, state)
        query.awaitTermination(240)
        assert not query.isActive and query.exception() is None

    feed(pieces[:half], 0)
    run()
    before = spark.read.parquet(out).count()
    feed(pieces[half:], half)
    far = [("SHFE.zz9999", r_["ts"].replace(year=r_["ts"].year + 1), 0, *[None] * len(NUMERIC)) for r_ in rows[-1:]]
    feed([far], 9000)  # a tick far ahead moves the watermark past all others
    run()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(b for c, lines in FEEDS.items() for b in fold(c, lines, minutes))
    assert 0 < before < len(got) and [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert list(g[2:]) == pytest.approx(list(w[2:])), (g, w)


def test_state_is_all_that_a_fold_needs():
    lines = FEEDS["SHFE.cu2401"]
    numbers = [[None if (x := v.get(c, "")) in ("", "nan", "NaN", "bad", "null") else float(x) for c in NUMERIC] for _, v in lines]
    whole, parted, state = [], [], None
    f = Fold("SHFE.cu2401", 300_000, "Asia/Shanghai")
    for n in numbers:
        whole += f.take(n)
        g = Fold("SHFE.cu2401", 300_000, "Asia/Shanghai", state)
        parted += g.take(n)
        state = g.state()
    assert whole == parted and len([*whole, *f.close()]) == len(fold("SHFE.cu2401", lines, 5)) and not list(f.close())
