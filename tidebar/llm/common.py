"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session uses its warehouse; a cluster has to set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidebar"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 8) -> None:
    """Let Arrow batches hold a few megabytes: whole long texts go both ways, and each core of an executor has batches on both sides."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def give_back_memory() -> None:
    """Hand a worker's freed memory back to the system: workers live on after a task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def text_udf(make: Callable[[], Callable[[list], dict]], schema: str) -> Callable[[Column], Column]:
    """An Arrow-batched struct column computed from a text column.

    make() runs once per task and gives a function from a list of texts (None: null) to a dict of columns.
    """
    small_batches(SparkSession.active())

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        _USED.clear()
        run = make()
        forget_unused()
        for batch in batches:
            yield pd.DataFrame(run(batch.tolist()))
        give_back_memory()

    return apply


_WORKER: dict = {}
_USED: set = set()


def per_worker(key: tuple, build: Callable):
    """What build() gives, made once per Python worker: tasks that share a worker share automata and word memos."""
    _USED.add(key)
    if key not in _WORKER:
        _WORKER[key] = build()
    return _WORKER[key]


def forget_unused() -> None:
    """Drop what the task at hand has not asked for: a worker goes on to other stages, which have no use for it."""
    for key in [k for k in _WORKER if k not in _USED]:
        del _WORKER[key]


class Memo(dict):
    """A dict that computes missing values. Of over `limit` values it keeps those asked for since, so memory stays bounded."""

    def __init__(self, fill: Callable, limit: int = 200_000):
        self.fill, self.limit, self.older = fill, limit, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes not to clash with a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _id_bits(ids: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = _mix(ids.astype(np.int64).view(_U))
    return mixed & _U((1 << log2_bits) - 1), _mix(mixed) & _U((1 << log2_bits) - 1)


def id_filter(ids: DataFrame, most_log2_bits: int = 28) -> np.ndarray:
    """A Bloom filter (two hashes, about 12 bits an id, at most 32 MB) of a long column `id`, as bytes of bits."""
    log2_bits = min(max(int(ids.count() * 12).bit_length(), 16), most_log2_bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log2_bits - 3), np.uint8)
        for b in batches:
            for at in _id_bits(b.column(0).to_numpy(), log2_bits):
                np.bitwise_or.at(bits, at >> _U(3), np.uint8(1) << (at & _U(7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(1 << (log2_bits - 3), np.uint8)
    for row in ids.select("id").where("id is not null").mapInArrow(build, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter: all that are, and a few others."""
    a, b = ((bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool) for at in _id_bits(ids, len(bits).bit_length() + 2))
    return a & b


def may_be_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of a long column that is true for all values of the long column `id` of ids, and for a few others; missing counts as 0."""
    shared = ids.sparkSession.sparkContext.broadcast(id_filter(ids))  # of bounded size

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, values.to_numpy(np.int64)))

    return lambda value: test(F.coalesce(value.cast("long"), F.lit(0)))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in the long column `id` of ids; rows without an id stay. Only rows that may go are shuffled."""
    (name,) = free_names(docs, "gone")
    maybe = may_be_among(ids)(F.col(id_col))
    gone = ids.select(F.col("id").alias(name))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti"))


def crc_remainder(id_col: Column, divisor: int) -> Column:
    """crc32(id as text) mod divisor: the deterministic folds of the learned operators."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def ragged_sum(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values with the given sizes (empty runs give 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
