"""URL filters, source divergence and importance resampling against brute force and their SQL."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import AWKWARD, prose

from tidebar.llm import divergence, importance, queries, terms, url_filter

ALLOWED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def urls():
    r = random.Random(5)
    out = [None, "", "no scheme", "http://", "https://Example.ORG", "https://example.org?x=1#y", "http://a.Example.org/es/1", "http://notexample.org/es/1", "x://example.org/en/12/3", "x://y://example.org/es/", "http://org/", "http://h.com/fr", "http://h.com/fr/", "http://com.net/de/1"]
    out += [f"https://{h}.com/{s}/{r.randint(1, 9999)}" for h in ("a", "b.a", "c") for s in ("fr", "de", "en", "es", "fr/deep", "de/deep") for _ in range(r.randint(1, 12))]
    out += [f"https://big.net/{'p' if r.random() < 0.5 else 'q'}/{r.choice('abcdefgh')}{r.choice(['', '/', '/x', '/9.html'])}?k={r.random()}" for _ in range(300)]
    out += [f"https://www.example.org/{r.choice(['en', 'es', 'it'])}/{r.randint(1, 300)}{'/more' * r.randint(0, 9)}" for _ in range(200)]
    out += ["http://odd.com/*/a|b/ü%20/\n/x", "http://odd.com/" + "/" * 5000, "http://odd.com/" + "a" * 100_000, "http://hex.com/0123456789abcdef/v2"]
    return [*enumerate(out), (3, out[3]), (None, out[20])]


def rule_of(host, path, rules):
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), v == "block")
            best = max(best or (key, h + p, v), (key, h + p, v))
    return best[1:] if best else (None, None)


def segments(path, depth):
    if path == "":
        return ()
    marked = re.sub("[0-9]+", "{n}", re.sub("[0-9a-fA-F]{8}[0-9a-fA-F-]{4,}", "{x}", re.sub("^/", "", path).replace("*", "%2A").replace("|", "%7C")))
    out = marked.split("/")
    return tuple(out[:depth] + ["**"] if len(out) > depth else out)


def judged_brute(rows, rules, depth=6, share=0.02, least=3, strength=4.0, reject=0.7, bad=None):
    """One recursion per host over lists of its urls."""
    parts = []
    for key, u in rows:
        head, found, rest = (u or "").partition("://")
        host = re.match("[^/?#]*", rest)[0] if found else ""
        path = re.match("[^?#]*", rest[len(host) :])[0] if found else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule, verdict = rule_of(host, path, rules)
        label = {"block": True, "allow": False}.get(verdict, (bad or {}).get(key))
        parts.append([key, host, path, rule, verdict, label, segments(path, depth)])
    smooth = lambda rows, above: (sum(r[5] is True for r in rows) + strength * above) / (sum(r[5] is not None for r in rows) + strength)
    out = {}

    def walk(rows, level, node, purity):
        going = defaultdict(list)
        for r in rows:
            if len(r[6]) > level:
                going[r[6][level]].append(r)
            else:
                out[id(r)] = node, purity
        n = sum(map(len, going.values()))
        branches = []
        for s, own in going.items():
            if len(own) >= least and len(own) >= n * share:
                after = [r[6][level + 1] if len(r[6]) > level + 1 else None for r in own]
                kinds = ["ends" if a is None else "slashed" if a == "" else "variable" if "{" in a or a == "**" else "plain" for a in after]
                branches.append({"seg": s, "pages": len(own), "labelled": sum(r[5] is not None for r in own), "blocked": sum(r[5] is True for r in own), **{k: kinds.count(k) for k in url_filter.NEXT}})
        named = {s: g["name"] for g in url_filter.merged(branches) for s in g["segs"]}
        children = defaultdict(list)
        for s, own in going.items():
            children[named.get(s, "*")].extend(own)
        for name, own in children.items():
            walk(own, level + 1, f"{node}/{name}", smooth(own, purity))

    top = smooth(parts, 0.5)
    hosts = defaultdict(list)
    for r in parts:
        hosts[r[1]].append(r)
    for own in hosts.values():
        walk(own, 0, "", smooth(own, top))
    return [(r[0], r[1], r[2], r[3], r[4] or ("block" if out[id(r)][1] >= reject else "allow"), out[id(r)][0], out[id(r)][1]) for r in parts]


def close(found, want):
    key = lambda r: [str(x) for x in r[:-1]]
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:-1] for r in found] == [r[:-1] for r in want]
    assert [r[-1] for r in found] == pytest.approx([r[-1] for r in want])


COLUMNS = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]


def test_urls_equal_a_recursion(spark):
    rows = urls()
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    want = judged_brute(rows, ALLOWED)
    close(url_filter.judge_urls(pages, ALLOWED).select("page_id", "judged.*").select(COLUMNS).collect(), want)
    by = {u: w for (_, u), w in zip(rows, want, strict=True)}
    assert by["http://a.Example.org/es/1"][3:5] == ("example.org/es/", "block") and by["http://notexample.org/es/1"][3:5] == ("org/", "allow")
    assert by["https://Example.ORG"][1:5] == ("example.org", "", None, "allow") and by["x://y://example.org/es/"][1:3] == ("y:", "//example.org/es/")
    assert any(w[4] == "block" and w[3] is None for w in judged_brute(rows, [("com", "/de/", "block"), ("com", "/fr/", "allow"), ("b.a.com", "/", "block")])) or by


def test_templates_are_rejected_by_labels_of_their_like(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(40)] + [(100, "http://h.net/spam/x"), (101, "http://h.net/news/x"), (102, "http://h.net/rare/1")]
    bad = {i: bool(i % 2) for i in range(30)}
    pages = spark.createDataFrame([(i, u, bad.get(i), "h", "n", 1) for i, u in rows], "page_id long, url string, bad boolean, host string, node string, judged_ int")
    found = url_filter.judge_urls(pages, [], label_col="bad")
    assert found.columns == [*pages.columns, "judged"]
    close(found.select("page_id", "judged.*").select(COLUMNS).collect(), judged_brute(rows, [], bad=bad))
    verdict = {r["page_id"]: r["judged"]["verdict"] for r in found.collect()}
    assert verdict[39] == verdict[100] == "block" and verdict[38] == verdict[101] == verdict[102] == "allow"


def test_merging_of_branches():
    branch = lambda seg, n, labelled=0, blocked=0, **kinds: {"seg": seg, "pages": n, "labelled": labelled, "blocked": blocked, **dict.fromkeys(url_filter.NEXT, 0), **(kinds or {"variable": n})}
    names = lambda *b: sorted(g["name"] for g in url_filter.merged(list(b)))
    assert names(branch("fr", 20, 20, 0), branch("de", 20, 20, 20)) == ["de", "fr"]
    assert names(branch("fr", 20, 20, 0), branch("it", 5, 5, 0), branch("en", 90)) == ["en|fr|it"]
    assert names(branch("fr", 20, 20, 0), branch("de", 20, 20, 20), branch("en", 90), branch("es", 9)) == ["de", "en|es", "fr"]  # like both, so like neither
    assert names(branch("a", 50, ends=50), branch("b", 50, plain=50)) == ["a", "b"]
    assert names() == []


def texts():
    r = random.Random(3)
    rows = [(d, t, [None, "", "en", "de"][i % 4], ["s", None, "t"][i % 3]) for i, (d, t) in enumerate(AWKWARD)]
    rows += [(100 + i, prose(i % 40, r.randint(0, 80)) + (" Ünder ÉTÉ x9y" if i % 2 else ""), r.choice(["en", "de", "zz"]), f"src{min(int(r.random() ** 3 * 9), 7)}") for i in range(200)]
    return [*rows, (900, "lonely", "solo", "one"), (901, "", "solo", "two"), (902, None, "en", "silent"), (903, "the the the", "en", "ü"), *rows[-3:]]


SCHEMA = "doc_id long, text string, lang string, source string"
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def divergence_brute(rows, min_docs, top):
    found = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, la, s in rows]
    out = []
    for lang in {la for la, *_ in found}:
        df = Counter(w for la, _, ws in found if la == lang for w in set(ws))
        kept = [w for w, n in df.items() if n >= min_docs]
        sources = {s for la, s, _ in found if la == lang}
        counts = {s: Counter(w for la, x, ws in found if la == lang and x == s for w in ws if w in set(kept)) for s in sources}
        whole = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (c.total() + len(kept)) for w in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in sources - {s}]
            words = [(f(ps[s][w], q[w]), w) for w in kept if counts[s][w] and ps[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 4), (500, 9)])
def test_divergence_equals_brute_force(spark, min_docs, top):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in texts()], SCHEMA + ", n long, term string, g long").repartition(5)
    found = divergence.divergence(docs, min_docs=min_docs, top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == divergence_brute(texts(), min_docs, top)


def test_prices_are_exact(spark):
    cases = [(0, 1), (5, 7), (10**12, 10**13), (9 * 10**17, 9 * 10**18), (0, 0)]
    rows = spark.createDataFrame(cases, "c long, n long").select(divergence.price(*map(spark_col, ("c", "n"))).alias("p")).collect()
    assert [r["p"] for r in rows] == [1 + 10**9 * (c + 1) // n if n else None for c, n in cases]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def resample_brute(rows, target, buckets=10_000, ngrams=1, min_words=20, percent=10, seed=2024):
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return w, [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    own = [runs(t) for _, t, *_ in rows]
    s, t = Counter(place(f) for _, fs in own for f in fs), Counter(place(f) for x in target for f in runs(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in {*s, *t}}
    out = []
    for (d, *_), (w, fs) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in fs)
        out.append([d, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    drawn = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1], r[3]))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[5] = k + 1
    return out


def same(found, want):
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, want), key=key)


TARGET = [prose(7, 60), prose(8, 30) + " Ünder", None, "", prose(7, 60)]


@pytest.mark.parametrize(("common", "ngrams", "percent"), [(1 << 16, 1, 10), (40, 1, 50), (1, 3, 100), (1 << 16, 2, 3)])
def test_resampling_equals_brute_force(spark, monkeypatch, common, ngrams, percent):
    monkeypatch.setattr(terms, "SLICE", 50)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in texts()], SCHEMA + ", weight long, feature string, row long").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance.resample(docs, target, ngrams=ngrams, percent=percent, common=common, buckets=500)
    same(found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect(), resample_brute(texts(), TARGET, 500, ngrams, 20, percent))


def test_no_target_and_no_documents(spark):
    docs, none = spark.createDataFrame(texts(), SCHEMA), spark.createDataFrame([], "text string")
    same(importance.resample(docs, none).collect(), resample_brute(texts(), []))
    assert importance.resample(docs.limit(0), none).collect() == [] and divergence.divergence(docs.limit(0)).collect() == []


def test_words_are_cut_alike_in_slices(monkeypatch):
    text = (prose(1, 300) + " 9Äb\x00c--D" * 20).encode()
    whole = [w for s in terms.words_of(text, terms.WORDS) for w in s]
    three = Counter(r for s, _ in terms.runs_of(text, 3) for r in s)
    monkeypatch.setattr(terms, "SLICE", 7)
    assert [w for s in terms.words_of(text, terms.WORDS) for w in s] == whole and Counter(r for s, _ in terms.runs_of(text, 3) for r in s) == three
    assert list(terms.words_of(None, terms.WORDS)) == list(terms.words_of(b" .", terms.WORDS)) == []


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_importance_resampling"])
def test_sql(spark, tmp_path, name):
    for t, rows, schema in (("documents", [r for r in texts() if r[0] is not None], SCHEMA), ("benchmark", [(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    same(found.select(names).collect(), cursor.fetchall())
