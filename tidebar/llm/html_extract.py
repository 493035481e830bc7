"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored: a block of text gives its length to the container around it, half to the next one out, a third to
the next; text in links counts against. From the best container the page climbs to the article around it, or as far out as a container's own
text (its paragraphs, lists, tables, quotations and sections) goes on around it, so that a long list, table or quotation does not stand for its article. A container's path is generalised (tag and sorted classes, digits as N), and the page votes for the path of the container it
comes to with the best one's score. In Spark the votes are summed per host and path, and each host's winning path is looked up for every page, which is then
extracted again from the containers on that path. A page without a container on its host's path uses its own best one.

Menus, headers, footers, asides, forms, scripts, styles, comments and containers whose class, id or role names them as such are left out. A name
counts by its head word (`FURNITURE`): `ad-slot` and `post-comments` do, `has-sidebar`, `search-result` and `comments-open` do not. A container that is named
so but encloses more than half of a page's text (readers' comments: all of it) is a plain container. Character references are decoded, white space inside a block becomes one space, blocks are joined by one space in page order.

Time and memory follow the length of a page, however deep or broken: a tag that is never closed is text, with all behind it.

Results: null, empty and text-free html give an empty text. Pages without a host share the host ''. Repeated pages have their own rows (and
votes). Ties of votes go to the greater path in string order. Votes are summed before they move, so a hot host costs one row per task and path; winners are
written as a table, and Spark broadcasts it only while it is below its own size limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, small_batches, table, text_udf

#: What is between a tag's name and its end: quotes count behind an equals sign only, and an unclosed one is a plain character. Nothing is tried twice.
_INSIDE = r"((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|math|xmp)\b(?:{_INSIDE[1:-1]})>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+){_INSIDE}>|<[!?][^>]*+>",
    re.S | re.I,
)
#: What begins like a tag: where it does not end, nothing behind it is one.
_BEGINS = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that end one block of text and begin another.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body center dd details div dl figure html li main ol section table tbody td th tr ul".split())
#: Containers that are parts of a text, and those that also stand for a whole one.
PARTS = frozenset("blockquote center dd details dl figure li ol table tbody td th tr ul".split())
FLOW = PARTS | {"section"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("aside button dialog footer form head header menu nav select".split())
#: Words of a class, id or role that name a page's furniture.
FURNITURE = frozenset("ad ads adslot advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus dialog footer form header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split())
#: Words before a name that only say whether a page has such a part.
SWITCHES = frozenset("can disable enable has hide is no non not show with without".split())
#: Words behind a name that say only where or what kind of box it is; the word before them is the head.
BOXES = frozenset("area bar block body bottom box button buttons container content group holder icon icons inner item items left link links list outer panel right section slot slots top unit wrap wrapper zone".split())
#: First words that name furniture whatever is behind them.
QUALIFIERS = frozenset("disqus outbrain promoted related sponsored taboola".split())
REMARKS = frozenset("comment comments disqus replies reply respond".split())
_CLOSES_P = BLOCKS - {"br"}


def _head(token: str) -> str:
    """The word of a class, id or role that says what the container is."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
    if not SWITCHES.isdisjoint(words[:-1]):
        return ""
    if words and words[0] in QUALIFIERS:
        return words[0]
    while len(words) > 1 and words[-1] in BOXES:
        words.pop()
    return words[-1] if words else ""


def _names(tag: str, attributes: str) -> tuple[str, bool, str]:
    """(generalised step of a path, is it furniture by its tag, the word that names it furniture or '')."""
    classes, name = [], ""
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = html.unescape(m[2] or m[3] or m[4] or "")
            if m[1].lower() == "class":
                classes = value.split()
            words = map(_head, value.split())
            name = name or next((w for w in words if w in (FURNITURE if tag not in ("article", "main") else ("comment", "comments"))), "")
    step = ".".join([tag.replace(">", ""), *sorted(re.sub(r"\d+", "N", c).replace(">", "") for c in classes)])
    return step, tag in FURNITURE_TAGS, name if tag not in ("html", "body") else ""


def _tags(source: str) -> Iterator[re.Match]:
    """The markup of a page from left to right. One that is never closed is text, with all behind it, so each character is looked at once."""
    at = source.find("<")
    while at >= 0:
        m = _MARKUP.match(source, at)
        if m:
            yield m
        elif _BEGINS.match(source, at):
            return
        at = source.find("<", m.end() if m else at + 1)


class Page:
    """The blocks of a page's text outside furniture, and the containers around them.

    Containers are numbered in page order, so the one around another has a smaller number; each knows the one around it and the number of its path, and a block knows its innermost
    container. All figures are sums over that tree: time and memory follow the length of the page, however deep it is.
    """

    def __init__(self, source: str | None):
        named = self._read(source or "", frozenset())
        if named:
            whole = sum(map(len, self.texts)) + sum(size for _, size, _, outermost in named if outermost)
            plain = frozenset(at for at, size, word, _ in named if (size >= whole if word in REMARKS else 2 * size > whole) and size)
            if plain:
                self._read(source or "", plain)

    def _read(self, source: str, plain: frozenset[int]) -> list[tuple[int, int, str, bool]]:
        """Reads the page; elements that begin at `plain` are no furniture by name. Those that are: (where, characters, name, is it in no other)."""
        self.texts: list[str] = []  # by block
        self.linked: list[int] = []  # characters of link text by block
        self.within: list[int] = []  # innermost container by block, or -1
        self.around: list[int] = []  # by container, the one around it or -1
        self.tag: list[str] = []  # by container
        self.path: list[int] = []  # by container, its path's number
        self.steps: dict[tuple[int, str], int] = {}  # number of a path from that of the path above and its last step; 0 is the empty path
        # open elements: tag, number of path, container before it, is container, is furniture, is link, is furniture by its tag
        stack: list[tuple[str, int, int, bool, bool, bool, bool]] = []
        places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
        bounds: list[int] = []  # where in the stack containers are
        named: list[tuple[int, int, str, bool]] = []
        opened: list[tuple[int, int, int, str]] = []  # furniture by name: depth, where, characters before, name
        furniture = links = by_tag = hidden = 0
        parts: list[str] = []
        in_links = at = 0
        inner = -1

        def close_block() -> None:
            nonlocal in_links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.texts.append(text)
                    self.within.append(inner)
                    self.linked.append(in_links)
                parts.clear()
            in_links = 0

        def pop_to(depth: int) -> None:
            nonlocal furniture, links, by_tag, inner
            while len(stack) > depth:
                tag, _, before, bound, dull, link, tagged = stack.pop()
                places[tag].pop()
                furniture -= dull
                by_tag -= tagged
                if bound:
                    bounds.pop()
                if opened and opened[-1][0] == len(stack):
                    _, where, count, word = opened.pop()
                    named.append((where, hidden - count, word, not opened))
                links -= link
                inner = before

        last = lambda tag: places[tag][-1] if places.get(tag) else -1
        for m in _tags(source):
            if m.start() > at and not furniture:
                parts.append(html.unescape(source[at : m.start()]))
                in_links += (m.start() - at) * (links > 0)
            elif m.start() > at and not by_tag:
                hidden += len(" ".join(source[at : m.start()].split()))
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag in BLOCKS:
                close_block()
            if m[2]:
                if last(tag) >= 0:
                    pop_to(last(tag))
                continue
            if tag in _CLOSES_P or tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                ends = max(last("p"), last(tag) if tag in ("li", "option", "dd", "dt") else -1)
                if ends >= 0 and ends >= (bounds[-1] if bounds else -1):
                    pop_to(ends)
            if tag in VOID or m[4].endswith("/") and tag not in BLOCKS:
                continue
            step, tagged, word = _names(tag, m[4])
            if word and not tagged and not by_tag and m.start() not in plain:
                opened.append((len(stack), m.start(), hidden, word))
            dull = tagged or bool(word) and m.start() not in plain
            path, before, bound = stack[-1][1] if stack else 0, inner, tag in CONTAINERS
            if bound:
                path = self.steps.setdefault((path, step), len(self.steps) + 1)
                bounds.append(len(stack))
                if not furniture and not dull:
                    self.around.append(inner)
                    self.tag.append(tag)
                    self.path.append(path)
                    inner = len(self.path) - 1
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, path, before, bound, dull, tag == "a", tagged))
            furniture += dull
            by_tag += tagged
            links += tag == "a"
        if at < len(source) and not furniture:
            parts.append(html.unescape(source[at:]))
        elif at < len(source) and not by_tag:
            hidden += len(" ".join(source[at:].split()))
        close_block()
        pop_to(0)
        return named

    def best(self) -> tuple[int, int]:
        """(number of the best container or -1, its score in sixths of a character, so that sums are exact)."""
        score = [0] * len(self.path)
        for text, number, linked in zip(self.texts, self.within, self.linked, strict=True):
            worth = len(text) - 2 * linked
            for share in (6, 3, 2):
                if number >= 0:
                    score[number] += worth * share
                    number = self.around[number]
        if not score:
            return -1, 0
        top = max(range(len(score)), key=lambda i: (score[i], -i))
        return (top, score[top]) if score[top] > 0 else (-1, 0)

    def _sums(self) -> tuple[list[int], list[int], list[int]]:
        """By container: characters of text in it, those in links, and those that reach it through containers of FLOW alone."""
        whole, linked, flow = ([0] * len(self.path) for _ in range(3))
        for text, number, links in zip(self.texts, self.within, self.linked, strict=True):
            if number >= 0:
                whole[number] += len(text)
                linked[number] += links
                flow[number] += len(text)
        for i in range(len(self.path) - 1, -1, -1):  # inner ones first
            above = self.around[i]
            if above >= 0:
                whole[above] += whole[i]
                linked[above] += linked[i]
                flow[above] += flow[i] if self.tag[i] in FLOW else 0
        return whole, linked, flow

    def climb(self, top: int) -> int:
        """The container whose text the container `top` is a part of, or top."""
        number = self.around[top]
        while number >= 0:
            if self.tag[number] == "article":
                return number
            number = self.around[number]
        whole, linked, flow = self._sums()
        found, number = top, self.around[top]
        flows = self.tag[found] in FLOW  # whether all from found out to below number are
        while number >= 0:
            tag = self.tag[number]
            if tag == "html" or tag == "body" and self.tag[found] not in PARTS:
                break
            rest, links, own = whole[number] - whole[found], linked[number] - linked[found], flow[number] - (flow[found] if flows else 0)
            if rest and 2 * links < rest and (tag in PARTS or tag == "main" or 2 * own >= rest):
                found, flows = number, tag in FLOW
            else:
                flows = flows and tag in FLOW
            number = self.around[number]
        return found

    def path_of(self, number: int) -> str:
        """The path of a container as text."""
        above = {n: (before, step) for (before, step), n in self.steps.items()}
        steps, n = [], self.path[number]
        while n:
            n, step = above[n]
            steps.append(step)
        return ">".join(reversed(steps))

    def text(self, path: str | None) -> str:
        """The blocks in containers on the path, else in the best container, else all blocks."""
        n = 0
        for step in path.split(">") if path else []:
            n = self.steps.get((n, step), -1)
        kept = self._inside({i for i, p in enumerate(self.path) if p == n}) if path and n > 0 else []
        if not kept:
            top, _ = self.best()
            kept = self._inside({self.climb(top)}) if top >= 0 else self.texts
        return " ".join(kept)

    def _inside(self, chosen: set[int]) -> list[str]:
        """The blocks within any of the chosen containers, in page order."""
        held = [False] * len(self.path)
        for i, above in enumerate(self.around):
            held[i] = i in chosen or above >= 0 and held[above]
        return [text for text, number in zip(self.texts, self.within, strict=True) if number >= 0 and held[number]]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _vote(source: str | None) -> tuple[str | None, int]:
    page = Page(source)
    top, score = page.best()
    return (page.path_of(page.climb(top)), score) if top >= 0 else (None, 0)


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the greatest sum of its pages' scores."""

    def make():
        def run(sources: list) -> dict:
            votes = [_vote(s) for s in sources]
            return {"path": [v[0] for v in votes], "score": [v[1] for v in votes]}

        return run

    vote = text_udf(make, "path string, score long")(F.col(html_col))
    votes = pages.select(host_of(F.col(url_col)).alias("host"), vote.alias("v")).select("host", "v.path", "v.score").where("path is not null")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("score", "path")).alias("top")).select("host", F.col("top.path").alias("path"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", into: str = "text") -> DataFrame:
    """pages with a string column `into`: the main text of each whole html."""
    small_batches(pages.sparkSession)
    winners = materialize(winning_paths(pages, url_col, html_col), "host-paths")

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series([Page(s).text(p) for s, p in zip(sources, paths, strict=True)], dtype=object)

    own, host, path = free_names(pages, "own_host", "host", "path")
    winners = winners.toDF(host, path)
    found = pages.withColumn(own, host_of(F.col(url_col))).join(winners, F.col(own) == F.col(host), "left")
    return found.withColumn(into, main_text(F.col(html_col), F.col(path))).drop(own, host, path)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
