"""Line deduplication with two Bloom filters, for once-seen and twice-seen hashes.

A line's key is the line with white space `[\\x20\\x09-\\x0D]` stripped at both ends and A-Z lower-cased; keys of at least `min_chars` code points
take part. Keys found in at least `min_docs` documents lose all their lines except in the largest id that holds them; other lines stay.

1. Each task sets the bits (two a key) of its documents' distinct keys in a once-seen filter, and in a twice-seen filter those set before. Filters
   are cut into segments of 2^16 bits, sent as the offsets of set bits, and merged per segment, first among 256 tasks and then over all: what two tasks
   saw once is seen twice.
2. The twice-seen filter goes back to all tasks. Only keys with both bits in it are suspected; their 128-bit digests are shuffled, counted exactly
   (partly before the shuffle, so a key in a third of all documents costs one row per task), and get the id that keeps them.
3. The repeated keys and their keepers are counted. Up to `most_broadcast` of them (24 bytes each) are broadcast, and each text drops its lines where it is
   read. Beyond that, each document gets the numbers of the lines it loses by a join on its id and text hash, in which only rows take part
   whose id a Bloom filter of the losing ids lets through. Results are the same.

The filter has about 256 bits a document, at most 2^`most_log2_bits` (128 MB): its size is bounded, and a full filter only makes more keys suspected.

Results: null and empty texts are one empty line, which stays. A text's own repeats of a key count once and are all kept or all dropped. Each row is a
document; rows that share the largest id all keep the line, and rows without an id count as holders but lose nothing. Order does not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, may_be_among, small_batches, table

STRIP = " \t\n\x0b\x0c\r"
SEGMENT = 16  # log2 of the bits of a filter's segment


def line_key(line: str, min_chars: int) -> bytes | None:
    """The digest of a line's key, or None if the key is too short."""
    key = line.strip(STRIP)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def keys_of(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """The numbers of the lines of each key in a text."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None:
            out.setdefault(k, []).append(i)
    return out


def _positions(digests: list[bytes], log2_bits: int) -> np.ndarray:
    """Two bits of the filter for each digest, one after the other."""
    return np.frombuffer(b"".join(digests), "<u8") & np.uint64((1 << log2_bits) - 1)


def _segments(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (segment, part, once, twice) with the sorted offsets of set bits; what is seen twice is in both. `part` is common to 256 tasks."""
    names = np.unique(once >> np.uint64(SEGMENT))
    a, b = (np.searchsorted(p >> np.uint64(SEGMENT), names) for p in (once, twice))
    ends_a, ends_b = np.append(a[1:], len(once)), np.append(b[1:], len(twice))
    low = lambda p: (p & np.uint64((1 << SEGMENT) - 1)).astype("<u2")
    lo, lt = low(once), low(twice)
    rows = [[x[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)] for x, s, e in ((lo, a, ends_a), (lt, b, ends_b))]
    part = pa.array(np.full(len(names), TaskContext.get().partitionId() >> 8, np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), part, pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], ["segment", "part", "once", "twice"])


def twice_seen_filter(docs: DataFrame, text_col: str, min_chars: int, log2_bits: int) -> np.ndarray:
    """Bits (as bytes) of all positions that two documents or more set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return _segments(found, found[times > 1])

        for b in batches:
            digests = [k for t in b.column(0).to_pylist() for k in keys_of(t, min_chars)]
            if digests:
                held.append(_positions(digests, log2_bits))
                size += len(digests)
            if size > 1 << 21:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def seen(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        once, twice = np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
        for a, b in zip(rows["once"], rows["twice"], strict=True):
            new = np.frombuffer(a, "<u2")
            twice[new[once[new]]] = True
            twice[np.frombuffer(b, "<u2")] = True
            once[new] = True
        return once, twice

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = (np.flatnonzero(x).astype("<u2").tobytes() for x in seen(rows))
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "once": [once], "twice": [twice]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        _, twice = seen(rows)
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bits": [np.packbits(twice, bitorder="little").tobytes() if twice.any() else None]})

    segments = docs.select(text_col).mapInArrow(build, "segment int, part int, once binary, twice binary")
    merged = segments.groupBy("segment", "part").applyInPandas(some, "segment int, once binary, twice binary")
    merged = merged.groupBy("segment").applyInPandas(whole, "segment int, bits binary").where("bits is not null")
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    for row in merged.toLocalIterator():  # at most the filter's own size
        at = row["segment"] << (SEGMENT - 3)
        bits[at : at + (1 << (SEGMENT - 3))] = np.frombuffer(row["bits"], np.uint8)
    return bits


def suspects(docs: DataFrame, id_col: str, text_col: str, min_chars: int, log2_bits: int) -> DataFrame:
    """(id, text_hash, key, lines) of the distinct keys of each document that the twice-seen filter holds."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen_filter(docs, text_col, min_chars, log2_bits))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            found = [keys_of(t, min_chars) for t in b.column(2).to_pylist()]
            digests = [k for keys in found for k in keys]
            if not digests:
                continue
            at = _positions(digests, log2_bits)
            both = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).reshape(-1, 2)
            kept = np.flatnonzero(both[:, 0] & both[:, 1])
            owner = pa.array(np.repeat(np.arange(len(found)), [len(k) for k in found])[kept])
            lines = [x for keys in found for x in keys.values()]
            mine = kept.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), pa.array([digests[i] for i in mine], pa.binary()), pa.array([lines[i] for i in mine], pa.list_(pa.int32()))], ["id", "text_hash", "key", "lines"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(test, "id long, text_hash long, key binary, lines array<int>")


def repeated_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, most_log2_bits: int = 30) -> tuple[DataFrame, DataFrame]:
    """((id, text_hash, key, lines) of suspected keys, (key, keeper) of the keys that min_docs documents hold); both are written."""
    small_batches(docs.sparkSession)
    log2_bits = int(np.clip(int(docs.count() * 256).bit_length(), 20, most_log2_bits))
    found = materialize(suspects(docs, id_col, text_col, min_chars, log2_bits), "line-suspects")
    repeated = found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
    return found, materialize(repeated.select("key", "keeper"), "line-repeats")


def lost_lines(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, text_hash, lines): the numbers of the lines that documents with this id and text lose."""
    lost = found.join(repeated, "key").where(F.col("id") < F.col("keeper"))
    return lost.groupBy("id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


class Keepers:
    """The id that keeps each repeated key, looked up by digest."""

    def __init__(self, parts: Iterable[tuple[bytes, bytes]]):
        parts = list(parts)
        keys = np.frombuffer(b"".join(k for k, _ in parts), "<u8").reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.first, self.second = keys[order, 0], keys[order, 1]
        self.keeper = np.frombuffer(b"".join(v for _, v in parts), "<i8")[order]
        self.same = int(np.unique(self.first, return_counts=True)[1].max(initial=0))  # keys with equal first halves, nearly always 1

    def of(self, digests: list[bytes]) -> np.ndarray:
        """The keeper of each digest, or the least long where it is not repeated."""
        out = np.full(len(digests), np.iinfo(np.int64).min)
        if not len(self.first) or not digests:
            return out
        asked = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        at = np.searchsorted(self.first, asked[:, 0])
        for k in range(self.same):
            here = np.minimum(at + k, len(self.first) - 1)
            hit = (self.first[here] == asked[:, 0]) & (self.second[here] == asked[:, 1])
            out[hit] = self.keeper[here[hit]]
        return out


RESULT = "n_lines long, n_dropped long, kept string"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, into: str = "lines", most_broadcast: int = 1 << 22) -> DataFrame:
    """docs with a struct column `into`: n_lines of each text before dropping, n_dropped, and the text that is left as `kept`."""
    found, repeated = repeated_keys(docs, id_col, text_col, min_chars, min_docs)
    return drop_here(docs, repeated, id_col, text_col, min_chars, into) if repeated.count() <= most_broadcast else drop_by_join(docs, lost_lines(found, repeated), id_col, text_col, into)


def drop_here(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, min_chars: int, into: str) -> DataFrame:
    """Texts drop their lines where they are read; repeated keys are few enough to be broadcast."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(b.column(0).to_pylist())], pa.binary()), pa.array([b.column(1).to_numpy().astype("<i8").tobytes()], pa.binary())], ["keys", "keepers"])

    packed = repeated.select("key", "keeper").mapInArrow(pack, "keys binary, keepers binary")
    shared = docs.sparkSession.sparkContext.broadcast(Keepers((bytes(r[0]), bytes(r[1])) for r in packed.toLocalIterator()))  # at most most_broadcast keys

    @F.pandas_udf(RESULT)
    def drop(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        keepers = shared.value
        for ids, texts in batches:
            own, texts = ids.tolist(), [t or "" for t in texts]
            keys = [keys_of(t, min_chars) for t in texts]
            keeper = keepers.of([k for of in keys for k in of]).tolist()
            kept, dropped, at = [], [], 0
            for doc, text, of in zip(own, texts, keys, strict=True):
                gone = {i for lines, k in zip(of.values(), keeper[at : at + len(of)], strict=True) if doc < k for i in lines} if of else ()
                at += len(of)
                kept.append("\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone]) if gone else text)
                dropped.append(len(gone))
            yield pd.DataFrame({"n_lines": [t.count("\n") + 1 for t in texts], "n_dropped": dropped, "kept": kept})

    own = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))  # no keeper is greater: rows without an id lose nothing
    return docs.withColumn(into, drop(own, F.col(text_col)))


def drop_by_join(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, into: str) -> DataFrame:
    """The same through a join on id and text hash; rows whose id loses no line stay where they are."""
    lost = materialize(lost, "lost-lines")
    own, hashed = F.col(id_col).cast("long"), F.xxhash64(text_col)
    maybe = may_be_among(lost.select("id"))(own)
    inner = free_names(docs, "lost_id", "lost_hash", "lost")
    lost = lost.select(*[F.col(c).alias(n) for c, n in zip(("id", "text_hash", "lines"), inner, strict=True)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col(inner[2]), i)), "\n")
    result = F.struct(n_lines.alias("n_lines"), F.coalesce(F.size(inner[2]), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col(inner[2]).isNull(), text).otherwise(kept).alias("kept"))
    moved = docs.where(maybe).join(lost, (own == F.col(inner[0])) & (hashed == F.col(inner[1])), "left").withColumn(into, result).drop(*inner)
    whole = F.struct(n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("kept"))
    return moved.unionByName(docs.where(~maybe).withColumn(into, whole))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept"), 256).alias("kept_sha256"))


#: The same in SQL.
ORACLE = r"""
WITH lines AS (SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
repeated AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
