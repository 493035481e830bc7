"""Line dedup, decontamination, near duplicates, quality, language, HTML, embeddings, pipeline: held against brute force on small awkward tables."""

import hashlib
import math
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import AWKWARD, LONG, SCHEMA, awkward, clashing, empty, got, prose
from pyspark.sql import functions as F

from tidebar.llm import cover_tree, decontaminate, html_extract, language_id, line_dedup, minhash, quality
from tidebar.llm.components import components

# ---- lines


def lines_brute(rows, min_chars=20, min_docs=3):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(upper)
    held = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(d)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or keeper.get(key(x)) is None or d >= keeper[key(x)]]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: [(x is not None, str(type(x)), x if x is not None else 0) for x in r])


SHARED = "  This line is in many documents. \t"
LINES = AWKWARD + [(100 + i, f"{prose(i, 12)}\n{SHARED.upper() if i % 2 else SHARED}\nshort\n{SHARED}\r\nlast {i}") for i in range(40)] + [(None, SHARED), (55, SHARED), (55, SHARED)]


def test_lines(spark):
    docs = spark.createDataFrame(LINES, SCHEMA).repartition(5)
    assert got(line_dedup.dedup_lines(docs), "doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept") == lines_brute(LINES)
    assert got(line_dedup.dedup_lines(clashing(spark), into="out"), "doc_id", "out.n_lines", "out.n_dropped", "out.kept") == lines_brute(AWKWARD)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_full_filter_changes_nothing(spark):
    docs = spark.createDataFrame(LINES, SCHEMA)
    lost = [line_dedup.lost_lines(*line_dedup.repeated_keys(docs, most_log2_bits=bits)) for bits in (16, 30)]
    assert got(lost[0], "id", "lines") == got(lost[1], "id", "lines") != []


def test_lines_that_are_too_many_to_broadcast(spark):
    columns = ["doc_id", "out.n_lines", "out.n_dropped", "out.kept"]
    docs = spark.createDataFrame(LINES, SCHEMA).repartition(5)
    assert got(line_dedup.dedup_lines(docs, into="out", most_broadcast=-1), *columns) == lines_brute(LINES)
    named = docs.selectExpr("*", "1 as lost", "2 as _lost", "3 as lost_id", "4 as LOST_HASH", "5 as gone", "6 as key")
    for most in (-1, 1 << 20):
        found = line_dedup.dedup_lines(named, into="out", most_broadcast=most)
        assert got(found, *columns) == lines_brute(LINES) and found.columns == [*named.columns, "out"]


def test_keepers_with_equal_first_halves():
    keys = [bytes([1] * 8 + [i] * 8) for i in range(5)] + [bytes([i] * 16) for i in range(2, 6)]
    keepers = line_dedup.Keepers([(b"".join(keys), np.arange(9, dtype="<i8").tobytes())])
    assert keepers.of(keys[::-1]).tolist() == list(range(9))[::-1] and keepers.of([bytes([1] * 8 + [9] * 8), bytes([7] * 16)]).max() < 0
    assert line_dedup.Keepers([]).of(keys[:1]).max() < 0


def test_segments_of_many_tasks_are_merged(spark):
    rows = [(i, f"a line that only two documents have, {i % 300:05d}") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(300)
    assert spark.range(1).count() == 1 and line_dedup.suspects(docs, "doc_id", "text", 20, 24).count() == 600


# ---- benchmark passages

ITEMS = [("a", prose(201, 30)), ("b", prose(202, 5)), ("b", prose(202, 5)), ("c", "..."), ("d", None), (None, prose(203, 20)), ("e", prose(201, 30)), ("10", prose(204, 13)), ("9", prose(204, 13).upper())]
LEAKED = AWKWARD + [(300, prose(1, 300) + " " + prose(201, 30)[20:] + "!!" + prose(2, 5)), (301, prose(202, 5)), (302, prose(3, 900) + "\n" + prose(204, 13)), (303, "x" + prose(204, 13)), (304, prose(204, 12))]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark):
    want = []
    windows = [(i, {tuple(w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1)} if (w := words(t)) else set()) for i, t in ITEMS if i is not None]
    for d, t in LEAKED:
        w, hit, ids = words(t), set(), set()
        for i, of in windows:
            for g in of:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit |= set(range(k, k + len(g)))
                        ids.add(i)
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    docs, bench = spark.createDataFrame(LEAKED, SCHEMA), spark.createDataFrame(ITEMS, "item_id string, text string")
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda r: [(x is not None, str(type(x)), x if x is not None else 0) for x in r]
    found = docs.select("doc_id", decontaminate.contamination(docs, bench, spans=True).alias("x"))
    assert got(found, "doc_id", *[f"x.{c}" for c in columns]) == sorted(want, key=key)
    spans = {r["doc_id"]: r["x"]["spans"] for r in found.collect()}
    (span,) = spans[302]
    assert dict(LEAKED)[302].encode()[span["begin"] : span["end"]].decode() == prose(204, 13).rstrip(".")
    left = decontaminate.decontaminate(clashing(spark), bench)
    assert left.columns == clashing(spark).columns and left.count() == len(AWKWARD)
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id string, text string")).count() == len(LEAKED)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


def test_items_without_an_id_hit_words_but_are_not_listed(spark):
    docs = spark.createDataFrame([(1, prose(901, 13)), (2, prose(902, 13)), (3, prose(903, 40))], SCHEMA)
    bench = spark.createDataFrame([(None, prose(901, 13)), (None, prose(902, 13)), ("b", prose(902, 13))], "item_id string, text string")
    found = docs.select("doc_id", decontaminate.contamination(docs, bench).alias("x"))
    assert got(found, "doc_id", "x.n_hit", "x.n_items", "x.items", "x.contaminated") == [(1, 13, 0, [], True), (2, 13, 1, ["b"], True), (3, 0, 0, [], False)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [3]


def test_a_benchmark_above_the_bound_is_refused(spark):
    bench = spark.createDataFrame([("a", prose(1, 400_000 // 4))], "item_id string, text string")
    with pytest.raises(ValueError, match="more than the 0 MB"):
        decontaminate.contamination(awkward(spark), bench, most_mb=0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c".split()), max_size=34), max_size=5), st.lists(st.sampled_from("a b c d".split()), max_size=60), st.randoms(use_true_random=False))
def test_windows_by_blocks_are_those_by_brute_force(items, text, r):
    if items and items[0]:
        cut = r.randrange(len(items[0]))
        text = text[:20] + items[0][cut : cut + r.randrange(20)] + text[20:]
    scan = decontaminate.WindowAutomaton((f"i{k}" if k else None, " ".join(x)) for k, x in enumerate(items))
    mask, found = scan.scan([w.encode() for w in text])
    hit, want = set(), set()
    for k, x in enumerate(items):
        n = min(13, len(x))
        for p in range(len(x) - n + 1) if n else ():
            for q in range(len(text) - n + 1):
                if text[q : q + n] == x[p : p + n]:
                    hit |= set(range(q, q + n))
                    want |= {f"i{k}"} if k else set()
    assert (set() if mask is None else set(np.flatnonzero(mask).tolist())) == hit and found == want


# ---- near duplicates


def edited(text, seed, n):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
    return " ".join(w)


def groups_brute(rows, threshold=0.8):
    sets = []
    for d, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else None))
    least = {d: d for d, _ in rows if d is not None}
    while True:
        before = dict(least)
        for a, x in sets:
            for b, y in sets:
                if x and y and a is not None and b is not None and len(x & y) / len(x | y) >= threshold:
                    least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


NEAR = AWKWARD + [(400 + i, edited(prose(77, 200), i, i % 5)) for i in range(60)] + [(500 + i, prose(500 + i, 80)) for i in range(30)] + [(600, prose(500, 80) + " one more"), (601, prose(501, 80)[: len(prose(501, 80)) // 2]), (502, prose(77, 200))]


def test_near_duplicates(spark):
    docs = spark.createDataFrame(NEAR, SCHEMA).repartition(4)
    found = minhash.near_duplicates(docs)
    least = groups_brute(NEAR)
    assert {r["id"]: r["class_id"] for r in found.collect()} == least
    assert found.count() == sum(d is not None for d, _ in NEAR)
    kept = minhash.keep_one_of_each_group(docs)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in NEAR if d is None or least[d] == d}
    assert kept.where("doc_id is null").count() == 2
    same = minhash.keep_one_of_each_group(clashing(spark))
    assert same.columns == clashing(spark).columns
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_copies_that_repeat_a_passage_are_found(spark):
    rows = []
    for i in range(40):
        base, passage = prose(2000 + i, 200), prose(3000 + i, 20)
        rows += [(2 * i, f"{base} {passage}"), (2 * i + 1, f"{edited(base, i, 3)} {' '.join([passage] * 300)}")]
    least = groups_brute(rows)
    assert sum(least[2 * i + 1] == 2 * i for i in range(40)) > 30
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {r["id"]: r["class_id"] for r in found.collect()} == least


def test_signatures_estimate_probability_jaccard():
    a, b = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
    wa, wb = np.where(a % 3 == 0, 5, 1), np.where(b % 3 == 0, 1, 4)
    sig = minhash.prob_minhash(np.repeat([0, 1], 400), minhash._mix(np.concatenate([a, b])), np.concatenate([wa, wb]), 2, 4096)
    x = dict(zip(a.tolist(), 1 + np.log(wa), strict=True))
    y = dict(zip(b.tolist(), 1 + np.log(wb), strict=True))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    assert abs((sig[0] == sig[1]).mean() - exact) < 4 * math.sqrt(exact / 4096)


def test_weights_of_shingles_are_those_of_their_words():
    texts = ["aa bb cc dd eeee aa bb cc dd eeee aa", None, "ü x", ". ", "one two three four five six"]
    owner, values, weight = minhash.shingles(*minhash.word_hashes(texts))
    assert np.bincount(owner, minlength=5).tolist() == [5, 0, 1, 0, 2] and sorted(weight.tolist()) == [3, 12, 12, 12, 12, 12, 19, 19]
    alone = [minhash.shingles(*minhash.word_hashes([t])) for t in texts]
    assert np.concatenate([v for _, v, _ in alone]).tolist() == values.tolist() and np.concatenate([w for *_, w in alone]).tolist() == weight.tolist()


def test_recall_of_bands_over_all_links():
    """Of all linked pairs among edited texts, those that share a band: at least 99 %."""
    r, texts = random.Random(8), []
    for i in range(150):
        base = prose(7000 + i, r.randint(8, 150))
        texts += [base, edited(base, i, 1), edited(base, i + 500, 2), base + " " + " ".join([prose(9000 + i, 6)] * r.randint(0, 40))]
    owner, values, weight = minhash.shingles(*minhash.word_hashes(texts))
    bands = minhash.band_hashes(minhash.prob_minhash(owner, values, weight, len(texts)))
    sets = [set(values[owner == i].tolist()) for i in range(len(texts))]
    links = [(i, j) for k in range(0, len(texts), 4) for i in range(k, k + 4) for j in range(i + 1, k + 4) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = sum(bool((bands[i] == bands[j]).any()) for i, j in links)
    assert len(links) > 200 and found >= 0.99 * len(links), (found, len(links))


@pytest.mark.parametrize("strip", [1, 2, 50])
def test_strips_of_blocks_give_all_links(spark, strip):
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 1 << 60, 60)) for _ in range(12)]
    sets = {i: np.sort(np.unique(np.concatenate([base[i % 12][: 60 - i % 9], r.integers(0, 1 << 60, i % 5)]))).astype("<u8") for i in range(90)}
    rows = spark.createDataFrame([(i % 2, i, len(s)) for i, s in sets.items()], "component long, node long, n long")
    frame = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, set binary")
    queries, texts = minhash.blocks(rows.where("node % 3 = 0"), frame, 300), minhash.blocks(rows, frame, 300)
    assert texts.count() > 6
    edges = [(x["a"], x["b"]) for x in minhash.block_links(queries, texts, 0.8, strip).collect()]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = [(i, j) for i in sets for j in sets if i % 3 == 0 and i % 2 == j % 2 and i != j and jaccard(sets[i], sets[j]) >= 0.8]

    def classes(pairs):
        least = {i: i for i in sets}
        for _ in sets:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert classes(edges) == classes(want) and len(want) > 50


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- embeddings


def test_embeddings(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base + r.normal(size=base.shape) * 0.08, np.repeat(base[:1], 30, 0), base[:1] + r.normal(size=(60, 6)) * 0.1]))]
    rows += [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (1004, [float("inf")] * 6), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, [1.0] * 6), (3, rows[50][1])]
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [[k for k in range(len(ok)) if k != j and len(ok[k][1]) == len(ok[j][1]) and ok[j][1] @ ok[k][1] >= 0.95] for j in range(len(ok))]
    least = {i: i for i, _ in rows if i is not None}
    for _ in range(len(ok)):
        for j, of in enumerate(links):
            for k in of:
                least[ok[j][0]] = least[ok[k][0]] = min(least[ok[j][0]], least[ok[k][0]])
    want = [(ok[j][0], len(of), least[ok[j][0]]) for j, of in enumerate(links)] + [(i, 0, i) for i in (1000, 1001, 1002, 1003, 1004, 1005)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({"block_rows": 40}, {}, {"block_rows": 8, "most_cells": 3}):
        found = cover_tree.linked_vectors(df.selectExpr("*", "1 as id", "2 as raw", "3 as h", "4 as node"), **options)
        assert got(found, "id", "n_links", "component_id") == sorted(want)
        assert all(x["kept"] == (x["id"] == x["component_id"]) for x in found.collect())
    assert cover_tree.linked_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_size_and_of_single_precision(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-300, 1e-300]), (3, [3.0, 2.9]), (4, [1.0, -1.0]), (5, [-0.0, 1.0]), (6, [0.0, 5e-324])]
    found = cover_tree.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got(found, "id", "n_links", "component_id") == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 1, 5), (6, 1, 5)]
    r = np.random.default_rng(8)
    base = np.concatenate([r.normal(size=(150, 16)), np.repeat(r.normal(size=(1, 16)), 100, 0)]).astype(np.float32)
    base[50:100] = base[:50] + r.normal(size=(50, 16)).astype(np.float32) * 0.05
    x = base.astype(np.float64) / np.linalg.norm(base.astype(np.float64), axis=1, keepdims=True)
    n = (x @ x.T >= 0.95).sum(1) - 1
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    found = cover_tree.linked_vectors(d, block_rows=16)
    assert [(r["id"], r["n_links"]) for r in found.orderBy("id").collect()] == list(enumerate(n.tolist()))


# ---- learned operators


def test_additive_model_learns_shapes_and_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 3))
    y = ((np.abs(x[:, 0]) < 1) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    m = quality.fit(x[:3000], y[:3000], n_pairs=3, pair_rounds=150)
    assert (1, 2) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.6
    z = (np.abs(x[:, 0]) < 1).astype(float)
    assert ((quality.fit(x[:3000], z[:3000]).score(x[3000:]) > 0.5) == z[3000:]).mean() > 0.97


def junk(i):
    return " ".join([prose(i, 5).upper() + "!!"] * 6 + ["$$$ ### |"] * 5)


def test_quality(spark):
    docs = spark.createDataFrame([(i, prose(i, 60) if i % 4 else junk(i)) for i in range(200)] + AWKWARD[:6], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)] + [(0, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.quality_score(docs, model).alias("s")).collect()}
    assert all((scores[i] > 0.5) == (i % 4 > 0) for i in range(120, 200))
    assert all(0 <= s <= 1 for s in scores.values())
    assert clashing(spark).select(quality.quality_score(clashing(spark), model)).count() == len(AWKWARD)
    assert empty(spark).select(quality.quality_score(empty(spark), model).alias("s")).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert [r[0] for r in docs.limit(3).select(quality.quality_score(docs, none)).collect()] == [0.5] * 3


TONGUES = {"xx": "aka oki imi ulu", "yy": "strng blmp krtz wrd", "zz": "èa ùo ìe àé"}


def test_language(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(TONGUES[k].split(), k=12)), k) for i in range(90) for k in [list(TONGUES)[i % 3]]]
    docs = spark.createDataFrame([*rows, (1000, None, "xx"), (1001, "oki", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id % 4 <> 2"))
    assert model.languages == ["xx", "yy", "zz"] and model.code.shape == (3, 3)
    found = docs.where("lang is not null and text is not null").select("lang", language_id.identify(docs, model).alias("r")).collect()
    assert all(r["lang"] == r["r"]["lang"] and r["r"]["score"] > 0.5 and not r["r"]["ambiguous"] for r in found)
    mixed = spark.createDataFrame([(1, "oki blmp"), (2, "12 34 !!"), (3, ""), (4, None), (5, "漢字")], SCHEMA)
    out = {r["doc_id"]: r["r"] for r in mixed.select("doc_id", language_id.identify(mixed, model).alias("r")).collect()}
    assert [out[i]["lang"] for i in (2, 3, 4)] == ["und"] * 3 and out[5]["score"] == pytest.approx(1 / 3)
    assert clashing(spark).select(language_id.identify(clashing(spark), model)).count() == len(AWKWARD)
    nothing = language_id.train(docs.limit(0))
    assert {r[0] for r in docs.select(language_id.identify(docs, nothing)["lang"]).collect()} == {"und"}


def test_every_known_gram_is_found():
    r = random.Random(9)
    letters = [chr(c) for c in (*range(97, 123), *range(0x3B1, 0x3C9), *range(0x4E00, 0x4E60))]
    grams = sorted({"".join(r.choices(letters, k=r.randint(1, 3))) for _ in range(90_000)})
    p = language_id.Predictor(language_id.LanguageModel(["a", "b"], language_id.codewords(2), grams, np.zeros((len(grams), 1))))
    for n in (1, 2, 3):
        some = [g for g in grams if len(g) == n]
        hashes = np.array([next(h[0] for h, _ in language_id._gram_hashes(g, p.seed)[n - 1 :]) for g in some], np.uint64)
        hit, rows = p._places(hashes)
        assert len(hit) == len(some) and [grams[i] for i in rows] == some


def test_language_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices((TONGUES["xx"] + " " + TONGUES["yy"]).split() if i % 5 == 0 else TONGUES[k].split(), k=1 + i % 7)), k) for i in range(90) for k in [list(TONGUES)[i % 3]]]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    m = language_id.train(docs)
    weight = dict(zip(m.grams, m.weights, strict=True))
    for row in docs.select("text", language_id.identify(docs, m).alias("r")).collect():
        found = [weight[g] for w in row["text"].lower().split() for g in language_id.grams_of(w) if g in weight]
        bits = np.clip(np.mean(found, axis=0), -20, 20)
        loss = [sum(math.exp(-c * b) for c, b in zip(code, bits, strict=True)) for code in m.code]
        p = np.exp(12.0 * (min(loss) - np.array(loss)))
        p /= p.sum()
        assert row["r"]["lang"] == m.languages[int(np.argmin(loss))] and row["r"]["score"] == pytest.approx(max(p))
        assert row["r"]["ambiguous"] == (sorted(p)[-1] - sorted(p)[-2] < 0.2)


def test_a_text_between_two_languages_is_ambiguous(spark):
    docs = spark.createDataFrame([(i, "ab cd", k) for i, k in enumerate("xyxyxy")], "doc_id long, text string, lang string")
    m = language_id.train(docs)
    assert {tuple(r["r"]) for r in docs.select(language_id.identify(docs, m).alias("r")).collect()} == {("x", 0.5, True)}  # a tie goes to the first


def test_codewords_of_many_languages_are_apart():
    code = language_id.codewords(20)
    assert min((code[i] != code[j]).sum() for i in range(20) for j in range(i)) >= 10


# ---- pages


def page(k, body, host="h.example"):
    return (k, f"https://{host}/{k}", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav>{body}<footer>foot</footer></body></html>")


STORY = "<p>First &amp; <b>bold</b>\n text.<p>Second<br>line <a href=y>linked words</a> and much more of it."


def test_html(spark):
    rows = [page(i, f'<div class="ad">buy</div><div class="story-{i}"><h1>Head {i}</h1>{STORY}<div class="comments"><p>nice</p></div></div><div class="promo">x</div>') for i in range(8)]
    rows += [page(20, '<div class="story-1"><p>Tiny.</p></div><section><p>' + "other long words " * 10 + "</p></section>")]
    rows += [page(21, "no containers at all", "other.example"), (22, None, "<p>no url &lt;here"), (23, "u", None), (24, "u", ""), (25, "u", "<script>var a='</p>';</script><!-- <p>x --> 1 < 2 <"), rows[0]]
    found = html_extract.extract(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string"))
    text = {r["page_id"]: r["text"] for r in found.collect()}
    assert found.count() == len(rows) and found.columns == ["page_id", "url", "html", "host", "text"]
    for i in range(8):
        assert text[i] == f"Head {i} First & bold text. Second line linked words and much more of it."
    assert text[20] == "Tiny."  # the host's path wins over the page's own longest part
    assert text[21] == "no containers at all" and text[22] == "no url <here" and text[23] == "" and text[24] == "" and text[25] == "1 < 2 <"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG_STORY = "<p>A long story with many words in it.</p>" * 9


@pytest.mark.parametrize("name", ["class='content has-sidebar'", "class='page no-ads'", "id='search-result'", "class='content-with-sidebar'", "class='post comments-open'", "class='search'", "id='widget-1'"])
def test_containers_of_articles_are_kept_whatever_their_modifiers(name):
    _, _, source = page(1, f"<div {name}>{LONG_STORY}</div><div class='menu'>Menu</div>")
    assert html_extract.Page(source).text(None) == " ".join(["A long story with many words in it."] * 9)


@pytest.mark.parametrize("name", ["class='ad-slot'", "class='left sidebar'", "id='postComments'", "class='share-buttons'", "class='related-posts'", "role=navigation", "class='comments-list'"])
def test_containers_named_as_furniture_are_left_out(name):
    _, _, source = page(1, f"<div class='post'>{LONG_STORY}<div {name}><p>dull</p></div></div>")
    assert "dull" not in html_extract.Page(source).text(None)


def test_long_comments_stay_out():
    _, _, source = page(1, f"<div class='post'><p>Short story.</p><div class='comments'>{LONG_STORY}</div></div>")
    assert html_extract.Page(source).text(None) == "Short story."


SAYING = "many words of one kind and another, " * 20


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<div class='story'>{}</div>", "<main>{}</main>", "{}"])
@pytest.mark.parametrize("inner", ["<blockquote><p>{0}</blockquote>", "<section><p>{0}</section>", "<ul><li>{0}</li><li>{0}</li></ul>", "<table><tbody><tr><td>{0}</td><td>{0}</td></tr><tr><td>{0}</td></tr></tbody></table>"])
def test_long_parts_do_not_stand_for_their_article(spark, outer, inner):
    if outer == "{}" and "section" in inner:
        return  # sections of a body may be menus or teasers; they stay apart
    _, _, source = page(1, outer.format(f"<h1>Head</h1><p>First words.</p>{inner.format(SAYING)}<p>Last words.</p>"))
    path, _ = html_extract._vote(source)
    for text in (html_extract.Page(source).text(None), html_extract.Page(source).text(path)):
        assert text.startswith("Head First words. many words") and text.endswith("Last words.") and text.count(SAYING.strip()) == inner.count("{0}")


def test_host_of_long_lists_keeps_its_paragraphs(spark):
    rows = [page(i, f"<article><p>Cook {i}.</p><ul><li>{SAYING}</li><li>{SAYING}</li></ul></article>") for i in range(4)] + [page(9, "<article><p>No list here.</p><ul><li>x</li></ul></article>")]
    text = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[9] == "No list here. x" and all(text[i].startswith(f"Cook {i}. many words") for i in range(4))


def test_climbing_stops_where_links_or_other_stories_begin():
    menu = "<ul>" + "<li><a href=x>menu item of some length</a></li>" * 9 + "</ul>"
    source = f"<body><div id=all>{menu}<div class=teasers>{'<div><p>other story</p></div>' * 9}</div><div class=story><p>{SAYING}</div><p>tail</p></div></body>"
    assert html_extract.Page(source).text(None) == SAYING.strip()


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    good = [(i, prose(i, 80) + "\n" + SHARED + "\n" + prose(1000 + i, 20), "en", f"s{i % 3}", 0) for i in range(60)]
    bad = [(100 + i, junk(i), "en", "s0", 0) for i in range(30)]
    odd = [(200, good[0][1].replace(SHARED, "other"), None, None, None), (201, prose(300, 80) + "\n" + prose(900, 30), "fr", "s1", 1), (None, prose(301, 80) + "\n" + prose(302, 30), "de", "s2", 2)]
    spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", prose(900, 30))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = p.table(spark, str(tmp_path), "documents")
    columns = docs.columns
    steps = {}
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        steps[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not steps["quality"].keys() & {100 + i for i in range(30)} and steps["quality"].keys() >= set(range(60))
    lines = steps["line_dedup"]
    assert [SHARED.strip() in lines[i]["text"] for i in (0, 58, 59)] == [False, False, True] and lines[5]["n_chars"] == len(lines[5]["text"])
    assert [None in s for s in steps.values()] == [True] * 4
    assert 0 in steps["near_dedup"]
    assert 200 not in steps["near_dedup"]
    assert steps["decontamination"].keys() == steps["near_dedup"].keys() - {201}
    out = p.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == steps["decontamination"].keys()
    assert out.where(F.length("ids") != F.col("n_tokens") * 4).count() == 0


def test_long_text_is_not_cut(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG + "\n" + LONG)], SCHEMA)
    found = docs.select("doc_id", decontaminate.contamination(docs, spark.createDataFrame([("a", LONG[-200:])], "item_id string, text string")).alias("c"))
    assert {r["doc_id"]: r["c"]["n_words"] for r in found.collect()} == {1: len(words(LONG)), 2: 2 * len(words(LONG))}


def test_templated_items_cost_their_windows_only():
    import time

    template = prose(5, 13).split()
    items = [(f"i{k}", " ".join([*template[:6], f"name{k}", *template[6:], f"end{k}"])) for k in range(20_000)]
    scan = decontaminate.WindowAutomaton([*items, ("whole", " ".join([*template, "closing"]))])
    text = [w.encode() for w in words(" ".join([" ".join(template) + f" other{k}" for k in range(200)] + [items[77][1]] * 3))]
    began = time.process_time()
    mask, found = scan.scan(text)
    assert time.process_time() - began < 0.3 and found == {"whole", "i77"} and mask.sum() == 200 * 13 + 3 * 15


def test_long_texts_in_slices_have_the_same_features_and_hashes(monkeypatch):
    texts = [t for _, t in AWKWARD] + [LONG, "a a a\n\na", " lead", "x\x85y \x1c z", "ß" * 3000 + " é", "w " * 999, None]
    whole, hashes = [quality.features(t) for t in texts], minhash.word_hashes(texts)
    monkeypatch.setattr(quality, "SLICE", 41)
    monkeypatch.setattr(minhash, "SLICE", 29)
    assert [quality.features(t) for t in texts] == whole
    again = minhash.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(hashes, again, strict=True))
