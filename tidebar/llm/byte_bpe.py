"""Byte-level BPE by prefix dynamic programming, with decoding and local re-encoding.

For each byte prefix of a piece the encoder stores the one token that the greedy merge result of that prefix ends with. A longer prefix is
solved from shorter ones: among the tokens that are suffixes of the prefix, exactly one fits behind the stored last token of the rest, that is,
the two are what merging their joined bytes gives. So appending bytes only adds entries, and an edit re-encodes from the first changed byte until
the pieces agree again (`append`, `edit`). Splitting a text by the tokenizer's pattern is separate, and each match is encoded on its own.

Results: null and empty texts have no tokens. Repeated rows each have their ids. Whole texts are encoded; memory per task is bounded by one Arrow
batch and the word memo, and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, per_worker, table, text_udf


def load_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBpe:
    """Encodes pieces of bytes; `last[i]` is the token that ends the encoding of the first i bytes."""

    def __init__(self, ranks: dict[bytes, int], split: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The two tokens that merge to a token; (itself, itself) for a single byte. Tokens that merging never reaches are left out.
        self.split = split or self._splits()
        self.fits = Memo(self._fits, 200_000)
        import ahocorasick

        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self.split:
                self.suffixes.add_word(token.decode("latin-1"), (rank, len(token)))
        self.suffixes.make_automaton()

    def _splits(self) -> dict[int, tuple[int, int]]:
        out = {}
        for token, rank in self.ranks.items():
            parts = self._merge(token, rank)
            if len(parts) <= 2:
                out[rank] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return out

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Do the two tokens stay apart when their joined bytes are merged? Undo merges at the border, latest first."""
        left, right = pair
        below = 1 << 62  # merges across the border that come later than this have been undone
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < below:
                return False
            inner_left, inner_right = self.split[left][1], self.split[right][0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or inner_left != left and left > right:
                below, left = left, inner_left
            else:
                below, right = right + 1, inner_right

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill `last` (tokens of prefixes, last[0] unused) up to the whole piece."""
        done, fits = len(last), self.fits
        skip = max(0, done - self.longest)
        last += [-1] * (len(piece) + 1 - done)
        # tokens that end at each byte, the longest first
        for end, (token, length) in self.suffixes.iter(piece[skip:].decode("latin-1")):
            i = end + skip + 1
            if i >= done and last[i] < 0:
                j = i - length
                if j == 0 or fits[last[j], token]:
                    last[i] = token
        if -1 in last[1:]:
            raise ValueError("a byte has no token")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.tokens(self.extend(piece, [-1]))

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The state of piece + more from that of piece."""
        return piece + more, self.extend(piece + more, list(last))

    def edit(self, piece: bytes, last: list[int], at: int, new: bytes, drop: int) -> tuple[bytes, list[int]]:
        """The state after replacing `drop` bytes at `at`. Prefixes before the edit keep their entries.

        An entry hangs on the entries and bytes of the longest token before it, so where that many entries in a row behind the edit are the old ones, moved, all that follow are.
        """
        drop = min(drop, len(piece) - at)
        changed, shift = piece[:at] + new + piece[at + drop :], len(new) - drop
        state, agree, end = last[: at + 1], 0, at + len(new)
        while len(state) <= len(changed):
            first = max(len(state), at + len(new) + 1)
            end = min(max(end, len(state)) + 2 * self.longest, len(changed))
            self.extend(changed[:end], state)
            for i in range(first, len(state)):
                agree = agree + 1 if state[i] == last[i - shift] else 0
                if agree == self.longest:
                    return changed, state[: i + 1] + last[i - shift + 1 :]
        return changed, state


class TextBpe:
    """Splits texts by the pattern and encodes each match."""

    #: A cut before a single space between two non-spaces never crosses a match of the pattern; other white space is left to the pattern.
    _ODD = re.compile(r" \s|\s ")

    def __init__(self, file: str, pattern: str, split: dict[int, tuple[int, int]] | None = None, memo: int = 400_000):
        import regex

        self.bpe = PrefixBpe(load_ranks(file), split)
        self.bpe.fits.limit = memo // 2
        self.find = regex.compile(pattern).findall
        self.pieces = Memo(lambda p: np.array(self.bpe.encode(p.encode("utf-8", "surrogatepass")), "<u4").tobytes(), memo * 3 // 8)
        self.spaced = Memo(lambda c: self.chunks_of(" " + c), memo)
        self.size = max(self.bpe.bytes_of) + 1
        self.table = [self.bpe.bytes_of.get(i, b"") for i in range(self.size)]

    def chunks_of(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.find(chunk)])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self._ODD.search(text) or text[0] == " " or text[-1] == " ":
            return self.chunks_of(text)
        first, *rest = text.split(" ")
        return self.chunks_of(first) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _text_bpe(spark: SparkSession, file: str, pattern: str, memo: int = 400_000):
    """Gives the worker's TextBpe; the table of merges is made once on the driver (bounded by the vocabulary) and broadcast."""
    split = spark.sparkContext.broadcast(per_worker(("merges", file), lambda: PrefixBpe(load_ranks(file)).split))
    return lambda: per_worker(("bpe", file, pattern, memo), lambda: TextBpe(file, pattern, split.value, memo))


def encode_texts(docs: DataFrame, file: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with a binary column `into`: the ids of each whole text, little-endian unsigned 32-bit."""
    worker_bpe = _text_bpe(docs.sparkSession, file, pattern)

    def make():
        bpe = worker_bpe()
        return lambda texts: {"ids": [bpe.encode(t) for t in texts]}

    return docs.withColumn(into, text_udf(make, "ids binary")(F.col(text_col))["ids"])


def decode_ids(df: DataFrame, file: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """df with a binary column `into`: the bytes of each row's ids (null: empty)."""
    worker_bpe = _text_bpe(df.sparkSession, file, pattern)

    def make():
        bpe = worker_bpe()
        return lambda rows: {"bytes": [bpe.decode(r or b"") for r in rows]}

    return df.withColumn(into, text_udf(make, "bytes binary")(F.col(ids_col))["bytes"])


def bpe_digests(docs: DataFrame, file: str, pattern: str, text_col: str = "text", keep_ids: bool = False, memo: int = 400_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    Encoding and decoding run one after the other on a batch, so ids leave the worker only if kept. A worker remembers up to `memo` words.
    """
    worker_bpe = _text_bpe(docs.sparkSession, file, pattern, memo)

    def make():
        bpe = worker_bpe()

        def run(texts: list) -> dict:
            ids = [bpe.encode(t) for t in texts]
            out = {"n": [len(x) >> 2 for x in ids], "ids": [hashlib.sha256(x).hexdigest() for x in ids], "decoded": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]}
            return out | ({"raw": ids} if keep_ids else {})

        return run

    r = text_udf(make, "n long, ids string, decoded string" + ", raw binary" * keep_ids)(F.col(text_col))
    columns = [F.col("r.n").alias("n_tokens"), F.col("r.ids").alias("ids_sha256"), F.col("r.decoded").alias("decoded_sha256")]
    return docs.select("doc_id", r.alias("r")).select("doc_id", *columns, *([F.col("r.raw").alias("ids")] if keep_ids else []))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


