"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark passages scans each text once.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z: runs of digits, a-z and any code point above 0x7F. A window is 13
consecutive words of an item; an item with fewer words, but not none, is one window. Items are cut into blocks of 7 words from their start on,
of which every window holds a whole one. The automaton's patterns are the first 5 words of each block, and whole items of under 13 words, written as
word numbers: some states per benchmark word, where whole windows would take thirteen words' bytes. Where a pattern occurs in a text, the windows that may hold it there
are looked up by search among the hashes of all distinct windows of the items, and compared word by word with one place of each: an occurrence costs seven look-ups, however many items
share its pattern. Word numbers map to offsets in the original text (`hit_spans`).

Results: null, empty and word-free texts have no words, no hits and are clean. Repeated rows and repeated items give repeated rows and one id.
Items without an id hit words like any other but are in no list or number of items. Items without words match nothing; with an empty benchmark all is clean.
The automaton is built once, on the driver, and broadcast: test sets are small beside a corpus, and a benchmark of over `most_mb` of text is refused with an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _mix, table, text_udf

WINDOW = 13
#: Bytes of UTF-8 by what they are to a word: themselves, lower-cased, or a break.
_NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


ANCHOR = 5  # words of a block that the automaton matches; the others are compared with its neighbours


def _symbols(number: int) -> str:
    """A word's number as two characters of disjoint alphabets, so that no state has many thousand ways out and matches begin at words."""
    return chr(number & 255) + chr(256 + (number >> 8))


def _numbers(line: str) -> np.ndarray:
    pairs = np.frombuffer(line.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int32)
    return pairs[::2] + (pairs[1::2] - 256 << 8)


def _places(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive runs of the given lengths."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


_U = np.uint64
_ODD = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, _U)) | _U(1)


class WindowAutomaton:
    """All windows of some items; finds which occur in a text and which of its words they cover."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int = WINDOW):
        import ahocorasick

        self.size, block = size, (size + 1) // 2
        self.anchor = min(ANCHOR, block)
        self.before = size - block  # words that a window may have before an anchor
        self.coded: dict[bytes, str] = {}  # the symbols of each word; those of 0 are any other word's
        of_name: dict[str, int] = {}
        coded, lines, lengths, owners = self.coded, [], [], []
        for item, text in items:
            words = words_of(text)
            if words:
                lengths.append(len(words))
                owners.append(-1 if item is None else of_name.setdefault(item, len(of_name)))
                for w in words:
                    if w not in coded:
                        coded[w] = _symbols(len(coded) + 1)
                lines.append("".join(map(coded.__getitem__, words)))
        if len(coded) > 50_000 << 8:  # over 64 MB of words
            raise ValueError("too many distinct words for one automaton")
        self.other, self.names = _symbols(0), list(of_name)
        lengths, owners = np.array(lengths, np.int64), np.array(owners, np.int64)
        starts = np.cumsum(lengths + 1) - lengths + size  # one -1 between items
        flat = np.full(int(lengths.sum()) + len(lengths) + 2 * size + 1, -1, np.int32)
        for a, n, line in zip(starts.tolist(), lengths.tolist(), lines, strict=True):
            flat[a : a + n] = _numbers(line)

        self.flat = flat
        self._windows(flat, np.repeat(starts, np.maximum(lengths - size + 1, 0)), np.maximum(lengths - size + 1, 0), owners)
        count = np.where(lengths >= size, (lengths - block) // block + 1, 0)
        places = np.repeat(starts, count) + block * _places(count)
        anchors = np.unique(flat[places[:, None] + np.arange(self.anchor)], axis=0) if len(places) else np.zeros((0, self.anchor), np.int32)

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        symbols = [self.other, *coded.values()]
        for k, pattern in enumerate(anchors.tolist()):
            self.automaton.add_word("".join([symbols[i] for i in pattern]), k)
        self.anchors = len(anchors)
        self.whole: dict[int, tuple[int, set[int]]] = {}  # (words, items) of patterns that are items of under `size` words
        for line, n, owner in zip(lines, lengths.tolist(), owners.tolist(), strict=True):
            if n < size:
                k = self.automaton.get(line, -1)
                if k < 0:
                    k = len(self.automaton)
                    self.automaton.add_word(line, k)
                self.whole.setdefault(k, (n, set()))[1].update([owner] if owner >= 0 else [])
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def _hashes(self, numbers: np.ndarray) -> np.ndarray:
        """The hash of each `size` consecutive numbers."""
        n = max(len(numbers) - self.size + 1, 0)
        return _mix(sum((numbers[k : k + n].astype(_U) * _ODD[k] for k in range(self.size)), np.zeros(n, _U)))

    def _windows(self, flat: np.ndarray, firsts: np.ndarray, count: np.ndarray, owners: np.ndarray) -> None:
        """The distinct windows by hash: one place of each in flat, and the items that have it."""
        at = firsts + _places(count)
        owner = np.repeat(owners, count)
        keys = self._hashes(flat)[at]
        order = np.lexsort((owner, keys))
        at, owner, keys = at[order], owner[order].astype(np.int32), keys[order]
        # windows of one hash are of one text but for one chance in 2^64 a pair; those are told apart here
        other = np.zeros(len(at), bool)
        other[1:] = keys[1:] != keys[:-1]
        same = np.flatnonzero(~other)[1:] if len(at) else np.zeros(0, np.int64)
        for part in np.array_split(same, len(same) // 100_000 + 1):
            if (flat[at[part, None] + np.arange(self.size)] != flat[at[part - 1, None] + np.arange(self.size)]).any():
                raise ValueError("two windows of the benchmark share a hash")
        first = np.flatnonzero(other | (np.arange(len(at)) == 0))
        self.keys, self.place = keys[first], at[first]
        group = np.cumsum(other)
        new = np.ones(len(at), bool)
        new[1:] = other[1:] | (owner[1:] != owner[:-1])
        new &= owner >= 0
        self.items, self.items_from = owner[new], np.searchsorted(group[new], np.arange(len(first) + 1))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """(mask of hit words or None, ids of items with a window in the text)."""
        if self.empty or not words:
            return None, set()
        known, other = self.coded.get, self.other
        line = "".join([known(w, other) for w in words])
        found = list(self.automaton.iter(line))
        if not found:
            return None, set()
        change, items = np.zeros(len(words) + 1, np.int64), set()
        for end, k in found:
            if k in self.whole:
                n, of = self.whole[k]
                change[(end + 1) // 2 - n] += 1
                change[(end + 1) // 2] -= 1
                items |= of
        begins = np.array([(end + 1) // 2 - self.anchor for end, k in found if k < self.anchors], np.int64)
        if len(begins) and len(words) >= self.size:
            may = np.unique(begins[:, None] - np.arange(self.before + 1))
            may = may[(may >= 0) & (may <= len(words) - self.size)]
            numbers = _numbers(line)
            keys = self._hashes(numbers)[may]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            equal = self.keys[at] == keys
            may, at = may[equal], at[equal]
            equal = (self.flat[self.place[at][:, None] + np.arange(self.size)] == numbers[may[:, None] + np.arange(self.size)]).all(1)
            may, at = may[equal], np.unique(at[equal])
            change[may] += 1
            change[may + self.size] -= 1
            for r in at.tolist():
                items.update(self.items[self.items_from[r] : self.items_from[r + 1]].tolist())
        mask = np.cumsum(change[:-1]) > 0
        return (mask if mask.any() else None), {self.names[i] for i in items}


def hit_spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (begin, end) byte offsets in the original text's UTF-8."""
    at = [m.span() for m in _WORD_BYTES.finditer(text.encode("utf-8", "surrogatepass"))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<begin:int,end:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_mb: int = 64, spans: bool = False) -> Column:
    """A struct column of SCHEMA for text_col of docs. contaminated: n_hit > 0 and 20 * n_hit >= n_words."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_mb << 20:
        raise ValueError(f"a benchmark of {size >> 20} MB of text is more than the {most_mb} MB that one automaton may be made of")
    # the items come to the driver in id order; their size is checked above
    rows = benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator()
    shared = docs.sparkSession.sparkContext.broadcast(WindowAutomaton((r[0], r[1]) for r in rows))

    def make():
        automaton = shared.value

        def run(texts: list) -> dict:
            all_words = [words_of(t) for t in texts]
            found = list(map(automaton.scan, all_words))
            masks, items = [m for m, _ in found], [i for _, i in found]
            n_words, n_hit = [len(w) for w in all_words], [0 if m is None else int(m.sum()) for m in masks]
            ids = [sorted(i) for i in items]
            return {
                "n_words": n_words, "n_hit": n_hit, "n_items": [len(i) for i in ids], "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids],
                "contaminated": [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], "items": ids,
                "spans": [[{"begin": a, "end": b} for a, b in hit_spans(t, m)] if spans and m is not None else None for t, m in zip(texts, masks, strict=True)],
            }

        return run

    return text_udf(make, SCHEMA)(F.col(text_col))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not contaminated, with their columns as they are."""
    return docs.where(~contamination(docs, benchmark, text_col)["contaminated"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", found.alias("c")).select("doc_id", "c.n_words", "c.n_hit", "c.n_items", "c.items_sha256", "c.contaminated")


