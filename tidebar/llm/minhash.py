"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

Shingles are five consecutive words (as in decontamination: A-Z lower-cased, runs of letters and digits); a text of one to four words is one shingle of all its
words. Each distinct shingle is a Poisson process whose rate is its weight, 1 + ln(bytes of its words): long words tell more than short ones. Its arrivals, made from
its hash alone, fall on signature slots, and a slot keeps the shingle that arrives first. A text's processes stop once they are behind the latest first arrival (early
termination). Two texts agree on a slot with the probability Jaccard similarity of their weighted shingles. A shingle weighs the same in every text, however often it is there, so this stays near
the Jaccard similarity of the sets, which links are verified by; weights of counts would lower it where copies repeat a passage a different number of times.

Texts with the same words are one class from the start (an aggregate, whatever its size). Class representatives that share a band of slots are
candidates, and a pair is linked if the exact Jaccard similarity of the two shingle sets is 0.8 or more. Candidates are tried in rounds, so that a
large group is not expanded into all its pairs: first each text against one band partner with the least id in a band. Then, in bands
that still span several components, each text outside the band's largest component meets two texts of that component, the one with the
most links so far and one drawn by lot. After `rounds` of these, texts that are still outside meet, block by block, every text in the bands whose
largest component is the same, so no link between texts that share a band is lost. Groups are the connected components of all links.

Results: texts without words (null, empty, marks only) link with nothing. Rows that share an id belong to one group. Rows without an id are kept
and have no group. The kept row of a group is that with the least id. Ties between partners go to the least id.

Whole texts never move: signatures (200 bytes) do, and the shingle hashes of candidates only. Candidates are found again in the table through
a Bloom filter of bounded size, which lets a few others through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _mix, id_filter, in_filter, materialize, small_batches, table, without_ids
from .components import components
from .decontaminate import _NORMAL

WIDTH, BANDS, ROWS = 5, 25, 5
SLOTS = BANDS * ROWS
_U = np.uint64
_rng = np.random.default_rng(20240229)
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, _U)) | _U(1)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=_U)
_PLACES = _rng.integers(1, 1 << 63, max(WIDTH, ROWS), dtype=_U) | _U(1)


#: Bytes that are hashed at once: a very long text goes in slices, cut between words.
SLICE = 1 << 22


def _hashed(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word begins, its hash, its bytes) of bytes with 32 between words and at the end."""
    inside = line != 32
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, _U), starts
    sizes = np.flatnonzero(edge == -1) - starts
    letters = line[inside]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    hashes = np.add.reduceat(_BYTES[letters] * _POWERS[place & 255] + (place >> 8).astype(_U), first)
    return starts, _mix(hashes + sizes.astype(_U)), sizes


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word of all texts, number of words of each text, bytes of each word), from the texts' bytes at once."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    whole = (b"\n".join(raw) + b"\n").translate(_NORMAL)
    line, starts, hashes, sizes, at = np.frombuffer(whole, np.uint8), [], [], [], 0
    while at < len(whole):
        end = whole.find(b" ", at + SLICE) + 1 if len(whole) - at > SLICE else len(whole)
        end = end or len(whole)
        first, found, size = _hashed(line[at:end])
        starts.append(first + at)
        hashes.append(found)
        sizes.append(size)
        at = end
    bounds = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(np.concatenate(starts), bounds), prepend=0)
    return np.concatenate(hashes), counts, np.concatenate(sizes)


def shingles(hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, distinct shingle, bytes of its words), sorted by text and shingle."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    bytes_to = np.concatenate([[0], np.cumsum(sizes)])
    if len(hashes) >= WIDTH:
        n = len(hashes) - WIDTH + 1
        values = sum((hashes[k : k + n] * _PLACES[k] for k in range(1, WIDTH)), hashes[:n] * _PLACES[0])
        whole = doc[:n] == doc[WIDTH - 1 :]
        owner, values, size = doc[:n][whole], _mix(values[whole]), (bytes_to[WIDTH:] - bytes_to[:-WIDTH])[whole]
    else:
        owner, values, size = np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        own = [_mix(np.array([(hashes[ends[i] - counts[i] : ends[i]] * _PLACES[: counts[i]]).sum() + _U(counts[i])], _U))[0] for i in short]
        owner, values, size = np.concatenate([owner, short]), np.concatenate([values, np.array(own, _U)]), np.concatenate([size, bytes_to[ends[short]] - bytes_to[ends[short] - counts[short]]])
    order = np.lexsort((values, owner))
    owner, values, size = owner[order], values[order], size[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new], size[new]


def prob_minhash(owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """texts x slots: the shingle that arrives first at each slot (0 where a text has no shingle), at rates 1 + ln(size)."""
    first = np.full(texts * slots, np.inf)
    winner = np.zeros(texts * slots, _U)
    rate = 1 + np.log(sizes)
    time = np.zeros(len(values))
    step = 0
    while len(values):
        step += 1
        draw = _mix(values + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate
        slot = owner * slots + (_mix(draw) % _U(slots)).astype(np.int64)
        early = np.flatnonzero(time < first[slot])
        early = early[np.argsort(-time[early], kind="stable")]  # the earliest is written last
        first[slot[early]] = time[early]
        winner[slot[early]] = values[early]
        limit = first.reshape(texts, slots).max(1)
        alive = time < limit[owner]
        owner, values, rate, time = owner[alive], values[alive], rate[alive], time[alive]
    return winner.reshape(texts, slots)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    cut = signature[:, :SLOTS].reshape(len(signature), BANDS, ROWS)
    return _mix((cut * _PLACES[:ROWS]).sum(2, dtype=_U) + np.arange(BANDS, dtype=_U))


def _groups(texts: list, most_chars: int = 400_000) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, n, bands): a digest of the words, the number of distinct shingles, and the band hashes of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in _groups(texts):
                hashes, counts, sizes = word_hashes(texts[i:j])
                owner, values, weight = shingles(hashes, counts, sizes)
                bands = band_hashes(prob_minhash(owner, values, weight, j - i)).astype(np.int64)
                ends = np.cumsum(counts)
                has = np.flatnonzero(counts)
                copies = [xxhash.xxh3_128_digest(hashes[ends[k] - counts[k] : ends[k]].tobytes()) for k in has.tolist()]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(bands[has].ravel()))
                n = np.bincount(owner, minlength=j - i)[has]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(has)), pa.array(copies, pa.binary()), pa.array(n, pa.int64()), flat], ["id", "copy", "n", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, copy binary, n long, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes of the texts whose id is in ids, and of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(in_filter(shared.value, b.column(0).to_numpy()))))
            own, texts = b.column(0), b.column(1).to_pylist()
            for i, j in _groups(texts):
                owner, values, _ = shingles(*word_hashes(texts[i:j]))
                cuts = np.searchsorted(owner, np.arange(j - i + 1)) * 8
                data = values.tobytes()
                yield pa.RecordBatch.from_arrays([own.slice(i, j - i), pa.array([data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["id", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least threshold, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            similar = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                shared = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) else 0
                similar.append(shared / max(len(x) + len(y) - shared, 1))
            similar = np.array(similar)
            near = pa.array(np.flatnonzero(similar >= threshold))
            yield pa.RecordBatch.from_arrays([b.column(0).take(near), b.column(1).take(near), pa.array(similar).take(near)], ["a", "b", "similarity"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long, similarity double")


def blocks(rows: DataFrame, sets: DataFrame, most_shingles: int = 60_000) -> DataFrame:
    """(component, part, ids, ends, values): the shingle sets of rows (component, node, n), packed in blocks of about most_shingles."""
    count = rows.groupBy("component").agg(F.ceil(F.sum("n") / most_shingles).alias("parts"))
    dealt = rows.join(count, "component").join(sets.withColumnRenamed("id", "node"), "node").select("component", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("int").alias("part"), "node", "set")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        ends = np.cumsum([len(x) // 8 for x in group["set"]])
        return pd.DataFrame({"component": [group["component"].iloc[0]], "part": [group["part"].iloc[0]], "ids": [group["node"].to_numpy("<i8").tobytes()], "ends": [ends.astype("<i8").tobytes()], "values": [b"".join(group["set"])]})

    return materialize(dealt.groupBy("component", "part").applyInPandas(pack, "component long, part int, ids binary, ends binary, values binary"), "set-blocks")


def linked(queries: pd.DataFrame, texts: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Edges (least, other) that join what the queries and the texts of two strips of blocks link."""
    sides = []
    for side in (queries, texts):
        sizes = [np.diff(np.frombuffer(e, "<i8"), prepend=0) for e in side["ends"]]
        sides.append((np.frombuffer(b"".join(side["ids"]), "<i8"), np.concatenate(sizes), np.frombuffer(b"".join(side["values"]), _U)))
    (ids_q, sizes_q, values_q), (ids_t, sizes, values_t) = sides
    order = np.argsort(values_t, kind="stable")
    ordered, owner = values_t[order], np.repeat(np.arange(len(ids_t)), sizes)[order]
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        parent.setdefault(i, i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ends = np.cumsum(sizes_q)
    for node, i, j in zip(ids_q.tolist(), (ends - sizes_q).tolist(), ends.tolist(), strict=True):
        low, high = np.searchsorted(ordered, values_q[i:j], "left"), np.searchsorted(ordered, values_q[i:j], "right")
        times = high - low
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        shared = np.bincount(owner[at], minlength=len(ids_t))
        for other in ids_t[(shared >= threshold * (j - i + sizes - shared)) & (shared > 0)].tolist():
            x, y = root(node), root(other)
            parent[max(x, y)] = min(x, y)
    return [(root(i), i) for i in parent if root(i) != i]


def block_links(queries: DataFrame, texts: DataFrame, threshold: float, strip: int = 12) -> DataFrame:
    """Edges (a, b) that join what any query and any text of a component link, found strip against strip.

    `strip` blocks (about half a megabyte each) are a strip. Each pair of strips of a component is a group of its own, so a large component is compared by many tasks, a block moves
    once for each strip of the other side, and a group holds two strips. It gives one edge per linked text, to the least one it is joined with there, and never a list
    of pairs.
    """
    strips = lambda df, n: df.groupBy("component").agg(F.floor(F.max("part") / strip).cast("int").alias(n))

    def dealt(df: DataFrame, own: str, others: DataFrame, other: str) -> DataFrame:
        placed = df.join(strips(others, "last"), "component").withColumn(own, F.floor(F.col("part") / strip).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("last")))).select("component", "strip_q", "strip_t", "ids", "ends", "values")

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        edges = linked(q, t, threshold) if len(q) and len(t) else []
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    keys = ["component", "strip_q", "strip_t"]
    left, right = dealt(queries, "strip_q", texts, "strip_t"), dealt(texts, "strip_t", queries, "strip_q")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, rounds: int = 2) -> DataFrame:
    """One row per row of docs that has an id: (id, class_id, kept). class_id is the least id of its group."""
    small_batches(docs.sparkSession)
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    classes = materialize(signed.groupBy("copy").agg(F.min("id").alias("node"), F.min("n").alias("n"), F.min("bands").alias("bands")), "classes")
    buckets = classes.select("node", "n", F.explode("bands").alias("band"))
    centers = materialize(buckets.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1").select("band", "center"), "bands")
    members = materialize(buckets.join(centers, "band"), "band-members")
    sizes = classes.select(F.col("node").alias("center"), F.col("n").alias("n_center"))
    similar_size = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)

    star = members.where("node <> center").groupBy("node", "n", "center").agg(F.count("*").alias("shared")).join(sizes, "center")
    star = star.where(similar_size(F.col("n"), F.col("n_center")))
    first = star.groupBy("node").agg(F.max_by("center", F.struct("shared", -F.col("center"))).alias("center"))
    first = materialize(first.select(F.col("center").alias("a"), F.col("node").alias("b")), "first-pairs")
    sets = materialize(shingle_sets(docs, members.select(F.col("node").alias("id")).distinct(), id_col, text_col), "shingle-sets")
    links = materialize(verified(first, sets, threshold), "links").select("a", "b")
    for turn in range(rounds + 1):
        found = components(links)
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
        placed = members.join(found, "node", "left").join(ends, "node", "left")
        placed = materialize(placed.select("band", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")), "placed")
        parts = placed.groupBy("band", "component").agg(
            F.count("*").alias("size"), F.max(F.struct("degree", -F.col("node"), "node", "n")).alias("busy"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node"), F.col("n"))).alias("drawn")
        )
        split = parts.groupBy("band").agg(F.max(F.struct("size", -F.col("component"), "component", "busy", "drawn")).alias("main"), F.count("*").alias("several")).where("several > 1")
        split = materialize(split.select("band", "main"), "split-bands")
        minor = placed.join(split, (placed["band"] == split["band"]) & (placed["component"] != split["main.component"])).select(placed["band"], "node", "n", F.col("main.component").alias("main"), "main.busy", "main.drawn")
        minor = materialize(minor, "minor")
        if not minor.limit(1).count():
            break
        if turn < rounds:  # one partner of many links and one drawn by lot, those that share the most bands
            partner = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}.node").alias("partner"), F.col(f"{k}.n").alias("n_partner")) for k in ("busy", "drawn")]
            tries = minor.select("node", "n", F.explode(F.array(*partner)).alias("p")).select("node", "n", "p.*").where(similar_size(F.col("n"), F.col("n_partner")))
            tries = tries.groupBy("node", "kind", "partner").agg(F.count("*").alias("shared"))
            pairs = tries.groupBy("node", "kind").agg(F.max_by("partner", F.struct("shared", -F.col("partner"))).alias("partner"))
            pairs = materialize(pairs.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct(), "pairs")
            more = verified(pairs, sets, threshold).select("a", "b")
        else:  # what is left outside meets every text of the bands with the same largest component
            queries = materialize(minor.select(F.col("main").alias("component"), "node", "n").distinct(), "left-over")
            texts = placed.join(split, "band").select(F.col("main.component").alias("component"), "node", "n").distinct()
            more = block_links(blocks(queries, sets), blocks(texts, sets), threshold)
        links = links.union(materialize(more, "links"))
    rows = materialize(signed.select("id", "copy").join(classes.select("copy", "node"), "copy").select("id", "node"), "class-of-row")
    shared_ids = rows.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    same_id = rows.join(shared_ids, "id").select("a", F.col("node").alias("b"))  # texts of one id stay together
    found = components(materialize(links.union(same_id), "all-links"))
    per_id = rows.join(found, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("class_id"))
    per_id = materialize(per_id, "class-of-id")  # texts without words have no row here
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    out = ids.join(per_id, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    return out.select("id", "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs without the near duplicates of a kept row; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, threshold).where("not kept").select("id").distinct()
    return without_ids(docs, materialize(gone, "near-copies"), id_col)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "kept")


