"""Text quality by a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins; cyclic boosting visits the features in turn and adds, each time, a shrunken tree of three cuts on that
feature's bins to its lookup table. Then the pairs of features whose joint cells explain most of what is left get tables of their own,
boosted the same way. A score is the sum of looked-up bins through a logistic curve; scoring adds bins for a whole Arrow batch at once.

Training takes at most `max_rows` labelled rows, those with the smallest hash of their id (a documented bound on a labelled sample). Scoring covers all rows.

Of rows that share a labelled id one takes part. Results: null and empty texts get the features of an empty text, hence one common score. Repeated rows have equal scores. With no labelled row the
score is 0.5 everywhere; with labels of one class it is near that class. Rows whose label or id is null are not used for training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, table, text_udf

NAMES = (
    "log_words", "word_length", "upper", "digit", "symbol", "bars", "bangs", "distinct_words", "repeats", "top_word", "line_length", "repeated_lines",
    "stops", "not_ascii", "worst_upper", "worst_symbol", "capitals", "worst_repeats",
)
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 symbol, 6 not ASCII, 7 common marks
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 6
for _c in b" \n\r\t":
    _CLASS[_c] = 4
for _c in b"#$%&*@^~|\\<>{}[]=+_!":
    _CLASS[_c] = 5
for _c in b".,;:'\"()-?":
    _CLASS[_c] = 7
SEGMENTS = 8


#: Characters of a text that are cut into words or lines at once.
SLICE = 1 << 21


def _words(text: str) -> Iterator[list[str]]:
    """text.split() in slices, cut where there is white space."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _distinct_lines(text: str) -> int:
    seen, at = set(), 0
    while (end := text.find("\n", at + SLICE)) >= 0:
        seen.update(text[at:end].split("\n"))
        at = end + 1
    seen.update(text[at:].split("\n"))
    return len(seen)


def _kinds(raw: np.ndarray, cuts: list[int]) -> np.ndarray:
    """How many bytes of each class are in each of the parts that begin at cuts."""
    if len(raw) <= SLICE:
        part = np.repeat(np.arange(len(cuts)) * 8, np.diff(cuts, append=len(raw)))
        return np.bincount(part + _CLASS[raw], minlength=8 * len(cuts)).reshape(-1, 8)
    out = np.zeros((len(cuts), 8))
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(raw)], strict=True)):
        for i in range(a, b, SLICE):
            out[k] += np.bincount(_CLASS, np.bincount(raw[i : min(i + SLICE, b)], minlength=256), 8)
    return out


def features(text: str | None) -> list[float]:
    """The features NAMES. A very long text is cut in slices, so what it takes is its distinct words and lines and a few times its bytes."""
    text = text or ""
    short = list(_words(text)) if len(text) <= SLICE else None
    n = sum(map(len, short or _words(text)))
    if not n:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    cuts = np.unique(np.linspace(0, len(raw), SEGMENTS + 1).astype(np.int64)[:-1]).tolist()
    by = _kinds(raw, cuts).astype(float)
    size = by.sum(1)
    kind = by.sum(0)
    letters = max(kind[1] + kind[2] + kind[6], 1.0)
    step = max(1, -(-n // SEGMENTS))
    counts: Counter = Counter()
    same, titles, done, before = np.zeros(SEGMENTS + 1), 0, 0, None
    for words in short or _words(text):
        if not words:
            continue
        counts.update(words)
        titles += sum(map(str.istitle, words))
        if before == words[0]:
            same[(done - 1) // step] += 1
        repeats = np.flatnonzero(np.fromiter(map(eq, words, words[1:]), bool, len(words) - 1))
        if len(repeats):
            same += np.bincount((repeats + done) // step, minlength=SEGMENTS + 1)
        done, before = done + len(words), words[-1]
    lines = text.count("\n") + 1
    return [
        np.log1p(n), len(text) / n, kind[1] / letters, kind[3] / len(raw), kind[5] / len(raw), counts["|"] / n, text.count("!") / n, len(counts) / n ** 0.8,
        same.sum() / n, max(counts.values()) / n, np.log1p(len(text) / lines), 1 - _distinct_lines(text) / lines, text.count(".") / n, kind[6] / len(raw),
        float((by[:, 1] / np.maximum(by[:, 1] + by[:, 2] + by[:, 6], 1)).max()), float((by[:, 5] / size).max()), titles / n, float(same.max()) / step,
    ]


@dataclass
class AdditiveModel:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores in 0..1 of rows of features."""
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int, least: float = 3.0) -> np.ndarray:
    """Leaf values per bin of a tree grown greedily on ordered bins with given sums of gradients and curvatures."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best, cut = 1e-9, None
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                at = np.arange(a + 1, b)
                more = gain(a, at) + gain(at, b) - gain(a, b)
                more[(h[at] - h[a] < least) | (h[b] - h[at] < least)] = 0
                if more.max() > best:
                    best, cut = more.max(), (p, int(at[more.argmax()]))
        if cut is None:
            break
        a, b = parts[cut[0]]
        parts[cut[0] : cut[0] + 1] = [(a, cut[1]), (cut[1], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 48, coarse_bins: int = 8, rate: float = 0.15) -> AdditiveModel:
    """Cyclic boosting of one-feature tables, then of tables for the strongest pairs."""
    if not len(y):
        return AdditiveModel()
    share = (y.sum() + 1) / (len(y) + 2)
    m = AdditiveModel(base=float(np.log(share / (1 - share))))
    m.edges = [_edges(x[:, k], bins) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    total = np.full(len(y), m.base)
    for _ in range(rounds):
        for k in range(x.shape[1]):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(at[k], y - p, len(m.tables[k])), np.bincount(at[k], p * (1 - p), len(m.tables[k])), 4)
            m.tables[k] += step
            total += step[at[k]]
    m.coarse = [_edges(x[:, k], coarse_bins) for k in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.coarse)]
    size = [len(e) + 1 for e in m.coarse]
    p = 1 / (1 + np.exp(-total))

    def cells(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[a] * size[b] + rough[b], v, size[a] * size[b])

    gains = {(a, b): (cells(a, b, y - p) ** 2 / (cells(a, b, p * (1 - p)) + 1.0)).sum() for a, b in combinations(range(x.shape[1]), 2)}
    m.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    m.pair_tables = [np.zeros((size[a], size[b])) for a, b in m.pairs]
    for _ in range(pair_rounds):
        for t, (a, b) in zip(m.pair_tables, m.pairs, strict=True):
            p = 1 / (1 + np.exp(-total))
            g, h = cells(a, b, y - p).reshape(size[a], size[b]), cells(a, b, p * (1 - p)).reshape(size[a], size[b])
            # a shallow tree on the pair: the best cut of the first feature, then cuts of the second on either side
            left = np.cumsum(g.sum(1)) ** 2 / (np.cumsum(h.sum(1)) + 1.0)
            cut = int(left[:-1].argmax()) + 1 if size[a] > 1 else size[a]
            step = np.zeros_like(t)
            for rows in (slice(0, cut), slice(cut, size[a])):
                step[rows] = rate * _tree(g[rows].sum(0), h[rows].sum(0), 3)
            t += step
            total += step[rough[a], rough[b]]
    return m


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000) -> AdditiveModel:
    """Fit on at most max_rows labelled rows; texts are measured where they are read, and only features reach the driver."""
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")  # bounded by max_rows
    found = rows.select("_id", "_y", text_features(F.col("_text"))["f"].alias("f")).groupBy("_id", "_y").agg(F.min("f").alias("f")).collect()  # one row an id
    found.sort(key=lambda r: (r["_id"], r["f"]))
    return fit(np.array([r["f"] for r in found]).reshape(len(found), len(NAMES)), np.array([r["_y"] for r in found]))


def text_features(text: Column) -> Column:
    return text_udf(lambda: lambda texts: {"f": [features(t) for t in texts]}, "f array<double>")(text)


def quality_score(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> Column:
    """A double column: the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few lookup tables

    def make():
        return lambda texts: {"score": shared.value.score(np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES)))}

    return text_udf(make, "score double")(F.col(text_col))["score"]


THRESHOLD = 0.3


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> AdditiveModel:
    """The production model: labels of documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), 5) != 0)
    return train(docs, labels)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_score(docs, learn(spark, docs, sf_dir)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
