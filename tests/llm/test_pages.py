"""The page reader against a second one over html.parser's events, and hostile pages in bounded time and memory."""

import html
import random
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from tidebar.llm import html_extract as h


class Naive(HTMLParser):
    """The stated rules over lists of whole ancestries: no sums, no numbers."""

    def __init__(self, source, plain=frozenset()):
        super().__init__(convert_charrefs=False)
        self.open, self.blocks, self.plain, self.named, self.part, self.count, self.raw = [], [], plain, {}, [], 0, ""
        self.feed(source)
        self.close()
        self.chunk()
        self.flush()

    def flush(self):
        text = " ".join("".join(t for t, _ in self.part).split())
        if text:
            self.blocks.append((text, [e for e in self.open if e["holds"]], sum(n for _, n in self.part)))
        self.part = []

    def handle_starttag(self, tag, attrs):
        self.chunk()
        self.count += 1
        if tag in h.BLOCKS:
            self.flush()
        if tag in h._CLOSES_P or tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] == "p" or self.open[i]["tag"] == tag and tag in ("li", "option", "dd", "dt"):
                    del self.open[i:]
                    break
                if self.open[i]["tag"] in h.CONTAINERS:
                    break
        if tag in h.VOID:
            return
        found = [w for k, v in attrs if k in ("class", "id", "role") for w in map(h._head, (v or "").split())]
        names = h.FURNITURE if tag not in ("article", "main") else {"comment", "comments"}
        word = next((w for w in found if w in names), "") if tag not in ("html", "body") else ""
        tagged = tag in h.FURNITURE_TAGS
        if word and not tagged and not any(e["tagged"] for e in self.open) and self.count not in self.plain:
            self.named[self.count] = [word, 0, not any(e["by_name"] for e in self.open)]
            by_name = self.count
        else:
            by_name = 0
        dull = tagged or bool(word) and self.count not in self.plain
        classes = [c for k, v in attrs if k == "class" for c in (v or "").split()]
        step = ".".join([tag, *sorted("".join("N" if d and not p else "" if d else c for c, d, p in zip(cl, map(str.isdigit, cl), [False, *map(str.isdigit, cl)], strict=False)) for cl in classes)])
        off = any(e["dull"] for e in self.open)
        self.open.append({"tag": tag, "step": step, "dull": dull, "tagged": tagged, "by_name": by_name, "bound": tag in h.CONTAINERS, "holds": tag in h.CONTAINERS and not dull and not off, "no": self.count, "path": [e["step"] for e in self.open if e["bound"]] + [step]})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.chunk()
        if tag in h.BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.raw += data

    def handle_entityref(self, name):
        self.raw += f"&{name};"

    def handle_charref(self, name):
        self.raw += f"&#{name};"

    def handle_comment(self, data):
        self.chunk()

    def chunk(self):
        """What is between two pieces of markup."""
        raw, self.raw = self.raw, ""
        if raw and not any(e["dull"] for e in self.open):
            self.part.append((html.unescape(raw), len(raw) if any(e["tag"] == "a" for e in self.open) else 0))
        elif raw and not any(e["tagged"] for e in self.open):
            for e in self.open:
                if e["by_name"]:
                    self.named[e["by_name"]][1] += len(" ".join(raw.split()))


def naive(source):
    page = Naive(source)
    if page.named:
        whole = sum(len(t) for t, *_ in page.blocks) + sum(n for _, n, outer in page.named.values() if outer)
        plain = frozenset(k for k, (w, n, _) in page.named.items() if n and (n >= whole if w in h.REMARKS else 2 * n > whole))
        page = Naive(source, plain) if plain else page
    score, by = {}, {}
    for text, inside, links in page.blocks:
        for e in inside:
            by[e["no"]] = e
        for e, share in zip(inside[::-1], (6, 3, 2), strict=False):
            score[e["no"]] = score.get(e["no"], 0) + (len(text) - 2 * links) * share
    if not score or max(score.values()) <= 0:
        return None, " ".join(t for t, *_ in page.blocks)
    top = by[min(k for k, v in score.items() if v == max(score.values()))]
    chain = next(inside for _, inside, _ in page.blocks if top in inside)
    outward = chain[: chain.index(top)][::-1]
    found = next((e for e in outward if e["tag"] == "article"), None)
    if found is None:
        found = top
        for e in outward:
            if e["tag"] == "html" or e["tag"] == "body" and found["tag"] not in h.PARTS:
                break
            others = [(t, inside, n) for t, inside, n in page.blocks if e in inside and found not in inside]
            rest, linked = sum(len(t) for t, *_ in others), sum(n for *_, n in others)
            own = sum(len(t) for t, inside, _ in others if all(x["tag"] in h.FLOW for x in inside[inside.index(e) + 1 :]))
            if rest and 2 * linked < rest and (e["tag"] in h.PARTS or e["tag"] == "main" or 2 * own >= rest):
                found = e
    return ">".join(found["path"]), " ".join(t for t, inside, _ in page.blocks if found in inside)


TAGS = "div div section article main p p ul ol li table tr td blockquote h2 span a em nav aside header footer form dl dt dd".split()
MARKS = ["", "", " class='post'", ' class="row col-12 x7"', " id=sidebar", " class='comments'", " class='has-sidebar'", " role=navigation", " class='related-links'", " class=ad-slot"]


def grown(r, depth=0):
    """A well-formed piece of a page with some end tags left out."""
    out = []
    for _ in range(r.randint(1, 4)):
        if depth > 6 or r.random() < 0.45:
            out.append(r.choice(["Some words here. ", "x &amp; y &lt;z&gt; ", "caf&eacute; &#233; ", "<br>", "<!-- no <p> -->", "<img src='a>b'>", "long " * r.randint(1, 20)]))
        else:
            t = r.choice(TAGS)
            out.append(f"<{t}{r.choice(MARKS)}>{grown(r, depth + 1)}" + ("" if t in ("p", "li", "dt", "dd", "td", "tr") and r.random() < 0.4 else f"</{t}>"))
    return "".join(out)


def test_equals_a_second_reader():
    r = random.Random(2)
    for _ in range(3000):
        source = f"<html><body>{grown(r)}</body></html>"
        page = h.Page(source)
        top, _ = page.best()
        assert (page.path_of(page.climb(top)) if top >= 0 else None, page.text(None)) == naive(source), source


HOSTILE = {
    "unclosed tags": "<a " * 350_000, "unclosed quotes": '<a href="' * 100_000, "mixed quotes": "<a x='\" y=\"' " * 60_000, "declarations": "<!" * 500_000, "nested": "<div class='row'>" * 100_000 + "end", "nested text": "<div>x " * 100_000,
    "list items": "<ul>" * 200 + "<li>item " * 50_000, "open inline": "<b>" * 50_000 + "<p>x" * 50_000, "stray ends": "<div>" * 50_000 + "</span>" * 50_000 + "t", "script": "<script " * 100_000, "open script": "<script>" + "</script " * 100_000,
    "spaces": "<p class" + " " * 300_000 + "class" * 1000 + ">x", "furniture": "<div class=ad-slot>x" * 50_000, "lone": "<" * 1_000_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages(name):
    source = HOSTILE[name]
    best = 9.0
    for _ in range(3):  # another process may hold the machine
        began = time.process_time()
        page = h.Page(source)
        page.text(page.path_of(page.climb(page.best()[0])) if page.best()[0] >= 0 else None)
        best = min(best, time.process_time() - began)
    assert best < 6, best  # about a second alone; the quadratic reader took minutes
    if name in ("nested", "list items", "unclosed tags"):
        tracemalloc.start()
        h.Page(source)
        assert tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()


def test_columns_with_clashing_names(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><article><p>Text {i} of it.</p></article></body>", "kept", "p", 7) for i in range(3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _path string, host int")
    found = h.extract(d)
    assert found.columns == [*d.columns, "text"]
    assert sorted(tuple(r) for r in found.select("page_id", "_host", "_path", "host", "text").collect()) == [(i, "kept", "p", 7, f"Text {i} of it.") for i in range(3)]
