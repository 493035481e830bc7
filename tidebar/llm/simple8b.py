"""Simple-8b word-aligned coding of non-negative integers, and a file format for token ids built on it.

Each 64-bit word has a 4-bit selector and 60 payload bits. Selectors 0 to 13 pack (count, bits) = 60x1 ... 1x60; selector 14 is a run
of up to 2^28-1 copies of a 32-bit value; selector 15 is the escape: the whole next word is one value of over 60 bits.
`pack` chooses for each position the densest selector whose values all fit; `unpack` decodes a block with one vectorised step per selector.

A written block is one row: shard, block number, the doc ids in it, the end offset of each document within the block's ids, and the words.
Blocks hold whole documents and close at `block_ids` ids or more, so a reader can decode each block without any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, new_path, per_worker, small_batches, table

#: Fixed values of the code: values per word and bits per value, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
RUN, ESCAPE = 14, 15
LEAST_RUN = 61


def pack(values: np.ndarray) -> np.ndarray:
    """uint64 values -> uint64 words."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    # densest fitting selector at each position: a narrower code needs the next `count` values all below 2**bits
    least = np.zeros(n, np.uint8)  # the narrowest selector that holds the value alone
    small = v.astype(np.uint32) if not (v >> np.uint64(32)).any() else v
    for bits in BITS:
        wide = small >> small.dtype.type(bits) != 0 if bits < 8 * small.dtype.itemsize else None
        if wide is None or not wide.any():
            break
        least += wide
    best = np.full(n, len(COUNTS) - 1, np.uint8)
    seen = np.zeros(n + 1, np.int32)
    for s in range(len(COUNTS) - 2, -1, -1):
        count = COUNTS[s]
        if n < count:
            break
        np.cumsum(least > s, dtype=np.int32, out=seen[1:])
        fits = seen[count:] == seen[:-count]
        if not fits.any():
            break  # narrower codes hold more values, so they fit nowhere either
        best[: n - count + 1][fits] = s
    best[least >= len(COUNTS)] = ESCAPE
    # long runs of one value of at most 32 bits; one holds two neighbours among every 30th value
    runs: dict[int, int] = {}
    if (v[30::30] == v[:-30:30]).any():
        edges = np.flatnonzero(np.diff(v)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
        long = (ends - starts >= LEAST_RUN) & (v[starts] >> np.uint64(32) == 0)
        runs = {int(a): int(b) for a, b in zip(starts[long], ends[long], strict=True)}
    step = np.array([*COUNTS, 0, 1], np.uint8)[best].tobytes()
    at, selectors, lengths, i = [], [], [], 0
    add_at, sel = at.append, best.tobytes()
    if not runs:
        while i < n:
            add_at(i)
            i += step[i]
        where = np.array(at)
        chosen = best[where]
        length = None
    else:
        while i < n:
            add_at(i)
            if i in runs:
                take = min(runs[i] - i, (1 << 28) - 1)
                selectors.append(RUN)
            else:
                take = step[i]
                selectors.append(sel[i])
            lengths.append(take)
            i += take
        where, chosen, length = np.array(at), np.array(selectors, np.uint8), np.array(lengths, np.uint64)
    slots = 1 + (chosen == ESCAPE)
    out_at = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        first, to = where[mine], out_at[mine]
        if s == ESCAPE:
            words[to], words[to + 1] = np.uint64(ESCAPE) << np.uint64(60), v[first]
        elif s == RUN:
            words[to] = np.uint64(RUN) << np.uint64(60) | length[mine] << np.uint64(32) | v[first]
        else:
            word = np.full(len(first), s << 60, np.uint64)
            for k in range(COUNTS[s]):
                word |= v[first + k] << np.uint64(k * BITS[s])
            words[to] = word
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """uint64 words -> uint64 values."""
    w = np.ascontiguousarray(words, dtype=np.uint64)
    if not len(w):
        return np.zeros(0, np.uint64)
    selector = (w >> np.uint64(60)).astype(np.uint8)
    if (selector == ESCAPE).any():  # the word after an escape is data, whatever its top bits are
        head, i, marks = np.ones(len(w), bool), 0, np.flatnonzero(selector == ESCAPE).tolist()
        last = -2
        for i in marks:
            if i != last + 1:
                head[i + 1], last = False, i
        raw = w[np.minimum(np.arange(len(w)) + 1, len(w) - 1)][head]
        w, selector = w[head], selector[head]
    else:
        raw = w
    sizes = np.array([*COUNTS, 0, 1])[selector]
    is_run = selector == RUN
    sizes[is_run] = (w[is_run] >> np.uint64(32) & np.uint64((1 << 28) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    begins, out = ends - sizes, np.zeros(int(ends[-1]), np.uint64)
    for s in np.unique(selector).tolist():
        mine = selector == s
        to = begins[mine]
        if s == ESCAPE:
            out[to] = raw[mine]
        elif s == RUN:
            for a, size, value in zip(to.tolist(), sizes[mine].tolist(), (w[mine] & np.uint64(0xFFFFFFFF)).tolist(), strict=True):
                out[a : a + size] = value
        else:
            mask, word = np.uint64((1 << BITS[s]) - 1), w[mine]
            for k in range(COUNTS[s]):
                out[to + k] = word >> np.uint64(k * BITS[s]) & mask
    return out


class WordEncoder:
    """Ids of whole texts by a tokenizers file, through memos of words and of their letters.

    Valid for tokenizers whose normaliser lower-cases and never looks across a space or line feed, whose splitter parts letters from marks, and whose
    last token of each piece ends in "</w>", such as the word-end BPE file used here. The library encodes the new letter runs of a batch
    together, joined by spaces, and the word ends part them again; all other new words it encodes one by one. Marks behind a letter are
    encoded apart only where the library itself parts them: some letters' normal form ends in a combining mark.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # without the apostrophe, which may begin a piece of letters

    def __init__(self, file: str, limit: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(file), limit
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.tails = Memo(lambda marks: self._ids(marks).tobytes(), 10_000)
        self.parted = Memo(self._parts, 10_000)
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _parts(self, letter: str) -> bool:
        """Does a mark behind this letter begin a new piece?"""
        return self._ids(letter + ".").tobytes() == self._ids(letter).tobytes() + self._ids(".").tobytes()

    def _learn_letters(self, runs: list[str]) -> None:
        for i in range(0, len(runs), 10_000):
            part = runs[i : i + 10_000]
            ids = self._ids(" ".join(part))
            ends = (np.flatnonzero(self.ends_word[ids]) * 4 + 4).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                self.letters.update(zip(part, [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            else:  # the library parts some run that Python takes for letters only
                self.letters.update((w, self._ids(w).tobytes()) for w in part)

    def _learn(self, new: set[str]) -> None:
        words, runs, tailed, tails = [], [], [], []
        for w in new:
            low = w.lower() if w.isascii() else w
            if low.isalpha():
                words.append(w)
                runs.append(low)
            elif (run := low.rstrip(self.MARKS)).isalpha() and (run[-1].isascii() or self.parted[run[-1]]):
                tailed.append((w, run, self.tails[low[len(run) :]]))
            else:
                self.words[w] = self._ids(w).tobytes()
        if len(self.letters) > self.limit:
            self.letters = {}
        letters = self.letters
        self._learn_letters(list({*runs, *(run for _, run, _ in tailed)}.difference(letters)))
        self.words.update(zip(words, map(letters.__getitem__, runs), strict=True))
        self.words.update([(w, letters[run] + tail) for w, run, tail in tailed])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (null: none). Arrow cuts the words and numbers them, so that each is looked up once in an array of texts."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        coded = words.values.dictionary_encode()
        n = len(coded.dictionary)
        names = pc.binary_join(pa.ListArray.from_arrays([0, n], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if n else []  # words hold no space
        if len(self.words) > self.limit:
            self.words, self.older = {}, self.words
        new = set(names).difference(self.words)
        if self.older:
            known = new.intersection(self.older)
            self.words.update((w, self.older[w]) for w in known)
            new -= known
        if new:
            self._learn(new)
        found = pa.array(map(self.words.__getitem__, names), pa.large_binary()).take(coded.indices)  # one after the other in one buffer
        _, ends, data = found.buffers()
        ids = np.frombuffer(data, "<u4") if data else np.zeros(0, "<u4")
        cuts = (np.frombuffer(ends, "<i8") // 4)[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist() if len(found) else [0] * (len(texts) + 1)
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


BLOCK_SCHEMA = "shard int, block int, doc_ids binary, missing binary, ends binary, n_ids long, words binary"


def write_token_ids(docs: DataFrame, path: str, file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = 1 << 18) -> None:
    """Encode every whole text (null: empty), append end_id to each document, and write Simple-8b blocks in ascending id order.

    Texts are encoded where they are read; only compressed ids move, to range partitions by id. Shard k holds smaller ids than shard k + 1, and
    within a shard blocks and documents ascend. Rows that share an id are all kept, side by side. A null id sorts first.
    """
    # range bounds come from the ids alone: repartitionByRange would sample the encoded rows and so encode twice
    cuts = range_cuts(docs, id_col, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.array(cuts, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = per_worker(("words", file), lambda: WordEncoder(file))
        end = np.array([end_id], "<u4")
        for b in batches:
            own = b.column(0).cast(pa.int64())
            part = np.searchsorted(bounds, own.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
            ids = [np.append(x, end) for x in enc.encode(b.column(1))]
            plain = [x.tobytes() if x.max() >> 16 else x.astype("<u2").tobytes() for x in ids]
            packed = pa.array([pa.compress(x, "lz4", asbytes=True) for x in plain], pa.binary())
            yield pa.RecordBatch.from_arrays([own, pa.array(part), packed, pa.array([len(x) for x in ids], pa.int64()), pa.array([len(x) for x in plain], pa.int64())], ["id", "part", "packed", "n", "size"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, k, ids, parts, sizes, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            missing = np.array([x is None for x in ids], bool)
            row = [[shard], [k], [np.array([x or 0 for x in ids], "<i8").tobytes()], [missing.tobytes()], [np.cumsum(sizes).astype("<i8").tobytes()], [n], [pack(np.concatenate(parts)).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for b in batches:
            for doc, _, packed, size, plain in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(doc)
                parts.append(np.frombuffer(pa.decompress(packed, plain, "lz4"), f"<u{plain // size}"))
                sizes.append(size)
                n += size
                if n >= block_ids:
                    yield close()
                    k, ids, parts, sizes, n = k + 1, [], [], [], 0
        if ids:
            yield close()

    small_batches(docs.sparkSession)
    encoded = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, "id long, part int, packed binary, n long, size long")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("part"))
    dealt.sortWithinPartitions("id", "packed").mapInArrow(block, BLOCK_SCHEMA).write.parquet(path)


def range_cuts(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """At most n - 1 ascending ids that cut the table into ranges of about equal rows (approximate; any cuts give right results)."""
    if n < 2:
        return []
    found = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 10000).alias("q")).first()["q"]
    return sorted(set(found or []))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of written files: shard, in_shard (ids of the shard's documents before it), doc_id, ids (little-endian uint32)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, k, docs, missing, ends, _, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = unpack(np.frombuffer(words, "<u8")).astype("<u4")
                gone, ends = np.frombuffer(missing, bool), np.frombuffer(ends, "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                doc = pa.array(np.frombuffer(docs, "<i8"), mask=gone)
                data = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ends), pa.int32()), pa.array([k] * len(ends), pa.int32()), pa.array(starts, pa.int64()), doc, data.cast(pa.binary())], ["shard", "block", "in_block", "doc_id", "ids"])

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(decode, "shard int, block int, in_block long, doc_id long, ids binary")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, before): ids in all blocks before it. One small row per block; a shard's blocks are summed apart, then the shards."""
    from pyspark.sql import Window

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("shard", "block", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per shard
    return blocks.select("shard", "block", before.alias("b")).join(base, "shard").select("shard", "block", (F.col("b") + F.col("base")).alias("before"))


def token_id_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from written files."""
    docs = read_token_ids(spark, path).select("shard", "block", "in_block", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    starts = block_starts(spark, path)
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("in_block")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_id_digests(spark, path)
