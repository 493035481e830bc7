"""Importance resampling of documents toward a target distribution of hashed n-gram counts.

Features are all runs of 1 to `ngrams` consecutive words, joined by one space, repeats counted; words are runs of 0-9, a-z and code points from U+0080 on, after
A-Z are lower-cased. A feature's bucket is the unsigned crc32 of its UTF-8 bytes modulo `buckets`. With S features in all documents, s of them in the bucket, and T and t
in the target, a bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).

1. Each task counts its features; counts are added by feature into a dictionary of distinct features, which hashes each string once. Buckets add up the dictionary.
2. Features that are at least a share 1 / 2^16 of all occurrences (so at most 65,536) and at most 64 bytes long are broadcast with their gains: at most 4 MB, at any size
   of the corpus. Each document adds those up where it is read and writes down its other features with their counts; these are joined with the dictionary on the feature.
   None of them is in more than 2^-16 of all occurrences (if not longer than 64 bytes), so no key of that join is hot.
3. A document's score is its weight plus Gumbel noise out of the sha256 of its id, so the highest scores are a draw without replacement. Of documents with at least
   `min_words` words, `percent` in 100 get ranks: rows are dealt in ranges of (score, id), ranked within a range and moved by the rows of the ranges before.

Results: null and empty texts have no features and weight 0. A missing id counts as an empty text in the noise, and after all others in ties; rows with equal scores
and ids are ordered by what else is shown. Repeated rows each count and each take a rank. No documents: no rows. No target: T = 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, give_back_memory, materialize, small_batches, table
from .terms import Counts, runs_of

#: Features of at least one occurrence in so many are broadcast, if not longer than so many bytes.
COMMON, COMMON_BYTES = 1 << 16, 64


def feature_counts(texts: DataFrame, ngrams: int) -> DataFrame:
    """(feature, n) of the one column of texts; a feature may have several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()

        def taken() -> Iterator[pa.RecordBatch]:
            for _, features, n, _ in counts.take():
                yield pa.RecordBatch.from_arrays([pa.array(features, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["feature", "n"])

        for b in batches:
            for raw in b.column(0).to_pylist():
                counts.add((), (runs for runs, _ in runs_of(raw, ngrams)), len(raw or b""))
                if counts.full():
                    yield from taken()
        yield from taken()
        give_back_memory()

    return texts.select(F.col(texts.columns[0]).cast("binary").alias("text")).mapInArrow(count, "feature string, n long")


def dictionary(docs: DataFrame, target: DataFrame, buckets: int, ngrams: int) -> DataFrame:
    """(feature, s, t, bucket): each distinct feature with its occurrences in the documents' and the target's texts."""
    s = feature_counts(docs, ngrams).select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    t = feature_counts(target, ngrams).select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    distinct = s.unionByName(t).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return distinct.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))


def gains(words: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that features are in: at most `buckets` rows."""
    by = words.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    both = by.crossJoin(F.broadcast(by.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    return both.select("bucket", F.floor(1000 * F.ln((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).cast("long").alias("gain"))


UNKNOWN = np.iinfo(np.int64).min


def weighed(docs: DataFrame, known: dict[bytes, int], ngrams: int) -> DataFrame:
    """(row, id, n_words, n_features, weight, rest) of (id, text): the gains of known features added up, and the others with their counts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most COMMON features of at most COMMON_BYTES bytes
    schema = "row long, id long, n_words long, n_features long, weight long, rest array<struct<feature: string, n: long>>"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, row = shared.value.get, TaskContext.get().partitionId() << 40  # rows of a table that is written once: numbers need not be the same in another run
        entry = pa.struct([("feature", pa.string()), ("n", pa.int64())])
        for b in batches:
            ids, out, offsets, features, n = b.column(0), [], [0], [], []
            for raw in b.column(1).to_pylist():
                n_words = n_features = weight = 0
                rest: Counter = Counter()
                for runs, words in runs_of(raw, ngrams):
                    found = np.fromiter(map(gain, runs, repeat(UNKNOWN)), np.int64, len(runs))
                    other = np.flatnonzero(found == UNKNOWN)
                    rest.update([runs[i] for i in other.tolist()])
                    found[other] = 0
                    n_words, n_features, weight = n_words + words, n_features + len(runs), weight + int(found.sum())
                out.append((n_words, n_features, weight))
                features.extend(rest)
                n.extend(rest.values())
                offsets.append(len(features))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            entries = pa.StructArray.from_arrays([pa.array(features, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], fields=list(entry))
            rests = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(out)), pa.int64()), ids, *columns, rests], ["row", "id", "n_words", "n_features", "weight", "rest"])
            row += len(out)
        give_back_memory()

    return docs.select(F.col(docs.columns[0]).cast("long").alias("id"), F.col(docs.columns[1]).cast("binary").alias("text")).mapInArrow(weigh, schema)


def weights(docs: DataFrame, target: DataFrame, buckets: int, ngrams: int, common: int = COMMON) -> DataFrame:
    """(id, n_words, n_features, weight) of each row of docs (id, text); target has one column of texts."""
    words = materialize(dictionary(docs.select(docs.columns[1]), target, buckets, ngrams), "features")
    gained = words.join(F.broadcast(gains(words, buckets)), "bucket")  # a row a bucket
    total = words.agg(F.sum("s")).first()[0] or 0
    is_common = (F.col("s") * common >= total) & (F.octet_length("feature") <= COMMON_BYTES)
    known = {r["feature"].encode(): r["gain"] for r in gained.where(is_common & (F.col("s") > 0)).select("feature", "gain").toLocalIterator()}
    rows = materialize(weighed(docs, known, ngrams), "weighed")
    rest = rows.select("row", F.explode("rest").alias("f")).select("row", "f.feature", "f.n").join(gained.where(~is_common).select("feature", "gain"), "feature")
    none = F.lit(None).cast("long")
    parts = rows.select("row", "id", "n_words", "n_features", "weight").unionByName(rest.select("row", none.alias("id"), none.alias("n_words"), none.alias("n_features"), (F.col("n") * F.col("gain")).alias("weight")))
    # one row of each document has its id and numbers, the others only add to its weight
    return parts.groupBy("row").agg(*[F.max(c).alias(c) for c in ("id", "n_words", "n_features")], F.sum("weight").alias("weight")).drop("row")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of sha256('seed:id')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def with_ranks(df: DataFrame, order: list[Column], most: Column, into: str) -> DataFrame:
    """df with the rank of each row in an order that takes in all its columns; null beyond `most` (of the number of rows, as column `n_rows`). No task sorts more than a range."""
    spark = df.sparkSession
    part, before = free_names(df, "part", "before")
    dealt = materialize(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))  # a row for each range
    starts = sizes.select(part, F.coalesce(F.sum("rows").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum("rows").over(Window.partitionBy()).alias("n_rows"))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col(before)
    return dealt.join(F.broadcast(starts), part).withColumn(into, F.when(rank <= most, rank)).drop(part, before, "n_rows")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, ngrams: int = 1, min_words: int = 20, percent: int = 10, seed: int = 2024, common: int = COMMON) -> DataFrame:
    """Of each row of docs: its id, n_words, n_features, weight, score, and rank among those drawn (null for others)."""
    found = weights(docs.select(id_col, text_col), target.select(target_col), buckets, ngrams, common)
    scored = materialize(found.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scores")
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("n_words"), F.asc("weight")]
    enough = F.col("n_words") >= min_words
    ranked = with_ranks(scored.where(enough), order, F.floor(F.col("n_rows") * percent / 100), "rank")
    all_rows = ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return all_rows.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: The same in SQL. crc32 is built up byte by byte from a table of 256 entries, which eight steps of its rule give.
ORACLE = r"""
WITH RECURSIVE steps(b, k, c) AS (SELECT b, 0, b::BIGINT FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8),
w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT r, unnest(words) AS f FROM w),
t AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
counts AS (SELECT f, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT f, count(*) AS s, 0 AS t FROM d GROUP BY f UNION ALL SELECT f, 0, count(*) FROM t GROUP BY f) GROUP BY f),
hashed AS (SELECT f, s, t, xor(list_reduce(list_transform(range(1, length(hex(encode(f))), 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM counts, crc),
buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM buckets),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM d JOIN hashed h ON d.f = h.f JOIN gain g ON g.bucket = h.bucket GROUP BY r),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN place END::BIGINT AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
