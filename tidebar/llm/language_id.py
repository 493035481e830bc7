"""Language identification by error-correcting output codes.

Each language has a codeword of bits (`codewords`: all two-way splits of up to 7 languages, a dense deterministic code beyond). For each bit a binary
n-gram classifier tells the languages with 1 from those with 0: its weight for a character 1- to 3-gram (word ends marked) is the log-odds of
the gram between the two sides, each language counting alike, and its output is the mean weight of a text's grams. Decoding is loss-weighted: the
language whose codeword has the least exponential loss over all bits wins; a text whose two best languages are close is flagged ambiguous.

Training counts grams in Spark over about `per_language` documents of each language, drawn by a hash of their id (a documented bound on
a labelled sample); counts are summed before they meet, and at most `max_grams` grams reach the driver. Prediction covers all rows and whole texts.

Results: null texts and texts without a letter are `und` with score 0 and not ambiguous. A text with letters but no known gram gets the first language
with score 1 / languages. Ties go to the first language in order. Without training rows every text is `und`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, per_worker, small_batches, table, text_udf

ORDERS = (1, 2, 3)


def grams_of(word: str) -> list[str]:
    w = f"\x02{word}\x03"
    return [*word, *(w[i : i + n] for n in ORDERS[1:] for i in range(len(w) - n + 1))]


def codewords(languages: int) -> np.ndarray:
    """languages x bits of -1 / 1."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1.0 if s >> i & 1 else -1.0 for s in splits] for i in range(languages)])
    draw = np.random.default_rng(languages)
    best, apart = None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (languages, int(np.ceil(10 * np.log2(languages)))))
        distance = ((code[:, None] != code[None]).sum(2) + (1 << 20) * np.eye(languages)).min()
        if distance > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, distance
    return best


_U = np.uint64


def _gram_hashes(line: str, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    r"""For each order, (hash of each gram, position where it starts) over words written as \x02word\x03; no gram spans two words."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    out = []
    for n in ORDERS:
        size = len(c) - n + 1
        if size < 1:
            continue
        h, whole = np.full(size, n + (seed << 8), _U), np.ones(size, bool)
        for k in range(n):
            part = c[k : k + size]
            h = (h * _U(0x9E3779B97F4A7C15)) ^ (part * _U(0xBF58476D1CE4E5B9))
            h ^= h >> _U(29)
            if k < n - 1:
                whole &= part != 3
        if n == 1:
            whole = c > 3  # a lone mark is no gram
        at = np.flatnonzero(whole)
        out.append((h[at], at))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    grams: list[str]
    weights: np.ndarray  # grams x bits


class Predictor:
    """Applies a model to whole texts. Words are looked up in a bounded memo of (sum of weights, number of known grams)."""

    SHARPNESS, CLOSE = 12.0, 0.2

    def __init__(self, model: LanguageModel, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, model.code.shape[1] + 1))
        # grams by ascending hash; two of one hash would be mistaken for each other, so hashes are made again with another seed until all differ
        for self.seed in range(64):
            keys = np.array([next(h[0] for h, at in _gram_hashes(g, self.seed)[len(g) - 1 :]) for g in model.grams], _U)
            self.row = np.argsort(keys, kind="stable")
            self.key = keys[self.row]
            if (self.key[1:] != self.key[:-1]).all():
                break
        else:
            raise ValueError("no seed tells the hashes of all grams apart")

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are known grams, rows of these grams)."""
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == hashes)
        return hit, self.row[at[hit]]

    def _learn(self, words: list[str]) -> None:
        line = "".join([f"\x02{w}\x03" for w in words])
        starts = np.cumsum([0] + [len(w) + 2 for w in words[:-1]])
        base, bits = len(self.index), self.model.code.shape[1]
        while len(self.rows) < base + len(words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        total = np.zeros((len(words), bits + 1))
        for hashes, at in _gram_hashes(line, self.seed):
            owner = np.searchsorted(starts, at, side="right") - 1
            hit, rows = self._places(hashes)
            if len(hit):
                w, mine = self.model.weights[rows], owner[hit]
                for k in range(bits):
                    total[:, k] += np.bincount(mine, w[:, k], len(words))
                total[:, bits] += np.bincount(mine, minlength=len(words))
        self.rows[base : base + len(words)] = total
        self.index.update(zip(words, range(base, base + len(words)), strict=True))

    def predict(self, texts: list[str | None], group: int = 200) -> Iterator[tuple[str, float, bool]]:
        for i in range(0, len(texts), group):
            some = texts[i : i + group]
            counts = [Counter(t.lower().split()) if t and self.model.languages and any(map(str.isalpha, t)) else None for t in some]
            if len(self.index) > self.limit:
                self.index.clear()
            new = set().union(*[c for c in counts if c is not None]).difference(self.index)
            if new:
                self._learn(list(new))
            yield from map(self._decode, counts)

    def _decode(self, words: Counter | None) -> tuple[str, float, bool]:
        if words is None:
            return "und", 0.0, False
        total = np.array(list(words.values()), float) @ self.rows[list(map(self.index.__getitem__, words))]
        bits = total[:-1] / max(total[-1], 1.0)
        loss = np.exp(-self.model.code * np.clip(bits, -20, 20)).sum(1)
        p = np.exp(self.SHARPNESS * (loss.min() - loss))
        p /= p.sum()
        best = int(loss.argmin())
        second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return self.model.languages[best], float(p[best]), bool(p[best] - second < self.CLOSE)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, max_grams: int = 60_000) -> LanguageModel:
    """Fit on rows with a language; about per_language of each are counted."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return LanguageModel([], np.zeros((0, 1)), [], np.zeros((0, 1)))
    languages = sorted(sizes)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(per_language / sizes[name]))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = words.setdefault(lang, Counter())
                mine.update(text.lower().split())
                if len(mine) > 500_000:
                    yield from flush({lang: words.pop(lang)})
        yield from flush(words)

    def flush(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, of in words.items():
            grams: Counter = Counter()
            for word, n in of.items():
                for g in grams_of(word):
                    grams[g] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counts = drawn.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("gram").pivot("lang", languages).agg(F.sum("n"))
    total = sum((F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in languages), F.lit(0))
    top = counts.select("gram", F.array(*[F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in languages]).alias("by"), total.alias("total")).orderBy(F.desc("total"), "gram").limit(max_grams).collect()
    by = np.array([r["by"] for r in top], float).reshape(len(top), len(languages))
    share_of = (by + 0.5) / (by + 0.5).sum(0)
    code = codewords(len(languages))
    weights = np.zeros((len(top), code.shape[1]))
    for b in range(code.shape[1]):
        one = code[:, b] > 0
        if one.any() and not one.all():
            weights[:, b] = np.log(share_of[:, one].mean(1)) - np.log(share_of[:, ~one].mean(1))
    return LanguageModel(languages, code, [r["gram"] for r in top], weights)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A struct column (lang, score, ambiguous) for text_col of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_grams x bits
    key = hashlib.md5(model.weights.tobytes() + repr((model.languages, model.grams)).encode("utf-8", "surrogatepass")).hexdigest()

    def make():
        predictor = per_worker(("languages", key), lambda: Predictor(shared.value))

        def run(texts: list) -> dict:
            found = list(predictor.predict(texts))
            return {"lang": [x[0] for x in found], "score": [x[1] for x in found], "ambiguous": [x[2] for x in found]}

        return run

    return text_udf(make, "lang string, score double, ambiguous boolean")(F.col(text_col))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), identify(docs, model).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.ambiguous")
