"""URL filters: rules by host and path, and for what no rule fits, per host a tree of path templates that is learned from the labelled urls.

A url's host is what follows its first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path goes on from there up to `?`, `#` or the end. A rule (host, path, verdict)
fits its host and all subdomains, if the url's path starts with the rule's; the longest rule (host and path together) wins, then the longer host, then `block`.
Urls with a rule, or with a value in a label column, are labelled.

1. A path becomes its shape: segments between `/`, in which runs of digits and long runs of hexadecimal digits are variable, at most `depth` of them and one for all that follow. Pages
   and labels are counted per (host, shape) where they are read.
2. The tree grows level by level over all hosts at once. Under each node a segment with at least `min_pages` pages and `share` of the node's is a branch (so a node has at most 1 / share
   branches); all others are one wildcard. Branches whose mix of next segments and of labels does not differ by a likelihood-ratio test (5 %) are merged: labelled ones with the
   largest like them, unlabelled ones only where a single labelled branch is like them, else among themselves.
3. A node's purity is the share of `block` among its labelled urls, smoothed toward its parent's by `strength` urls, hosts toward all hosts, all hosts toward one half. Templates
   with a purity of at least `reject` are rejected. A url without a rule takes its template's verdict.

Counts are partly added before each shuffle; nodes and their branches are joined on (host, node), where Spark splits the many shapes of one host, and the tree is as small as branches are.
No list holds more than a node's branches, and no table is collected. Rules are a short list of the caller's, part of the plan.

Results: a null url or one without `://` has an empty host and path, and the verdict of the template of empty paths. Repeated urls count each. No urls: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, table

#: host, path, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: 95 % points of chi-square for 1, 2 and 3 degrees of freedom.
CHI2 = {0: 0.0, 1: 3.841, 2: 5.991, 3: 7.815}
#: What comes after a segment: nothing, a trailing slash, a variable segment, a plain one.
NEXT = ("ends", "slashed", "variable", "plain")
COUNTS = ("pages", "labelled", "blocked", *NEXT)


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column, depth: int) -> Column:
    """A path's segments with their variable parts as {x} and {n}; `**` stands for all beyond `depth`. * and | are written as escapes, since templates use them."""
    plain = F.replace(F.replace(F.regexp_replace(path, "^/", ""), F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C"))
    marked = F.regexp_replace(F.regexp_replace(plain, "[0-9a-fA-F]{8}[0-9a-fA-F-]{4,}", "{x}"), "[0-9]+", "{n}")
    segments = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(marked, "/", -1))
    return F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(F.lit("**")))).otherwise(segments)


def likelihood_ratio(a: Sequence[int], b: Sequence[int]) -> tuple[float, int]:
    """G of two rows of counts, and its degrees of freedom (kinds that occur, less one)."""
    m, n = sum(a), sum(b)
    kinds = [(x, y) for x, y in zip(a, b, strict=True) if x + y]
    if not m or not n:
        return 0.0, 0
    g = sum(2 * c * math.log(c * (m + n) / (own * (x + y))) for x, y in kinds for c, own in ((x, m), (y, n)) if c)
    return g, max(len(kinds) - 1, 0)


def alike(a: dict, b: dict) -> bool:
    """Neither what comes next nor the labels differ."""
    tests = [([x[k] for k in NEXT] for x in (a, b)), ([x["blocked"], x["labelled"] - x["blocked"]] for x in (a, b))]
    return all(g <= CHI2[freedom] + 1e-9 for g, freedom in (likelihood_ratio(*t) for t in tests))


def merged(branches: list[dict]) -> list[dict]:
    """Groups of a node's branches (dicts with seg and COUNTS) that are alike: dicts of their summed counts, with `segs` and a name."""
    order = sorted(branches, key=lambda b: (-b["pages"], b["seg"]))
    groups: list[dict] = []

    def put(branch: dict, into: dict | None) -> None:
        if into is None:
            groups.append({"segs": [branch["seg"]], **{c: branch[c] for c in COUNTS}})
        else:
            into["segs"].append(branch["seg"])
            into.update({c: into[c] + branch[c] for c in COUNTS})

    for b in order:
        if b["labelled"]:
            put(b, next((g for g in groups if alike(b, g)), None))
    labelled = list(groups)
    learned = [dict(g) for g in labelled]  # unlabelled branches are held against what labelled ones gave
    for b in order:
        if not b["labelled"]:
            fit = [g for g, was in zip(labelled, learned, strict=True) if alike(b, was)]
            put(b, fit[0] if len(fit) == 1 else next((g for g in groups[len(labelled) :] if alike(b, g)), None))
    for g in groups:
        g["name"] = "|".join(sorted(g["segs"]))
    return groups


BRANCH = "struct<seg: string, name: string, labelled: long, blocked: long>"


def named_branches(nodes: DataFrame) -> DataFrame:
    """(host, node, branches): for each branch's segment the name and labels of the group that it is merged into."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("seg", pa.string()), ("name", pa.string()), ("labelled", pa.int64()), ("blocked", pa.int64())]))
        for b in batches:
            out = [[{"seg": s, "name": g["name"], "labelled": g["labelled"], "blocked": g["blocked"]} for g in merged(found) for s in g["segs"]] for found in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["host", "node", "branches"])

    return nodes.mapInArrow(name, f"host string, node string, branches array<{BRANCH}>")


def grown(tree: DataFrame, level: int, share: float, min_pages: int, strength: float) -> DataFrame:
    """Rows (host, shape, pages, labelled, blocked, node, purity) one level further down; those whose shape has ended stay."""
    seg, after = F.get("shape", F.lit(level)), F.get("shape", F.lit(level + 1))
    variable = after.contains("{") | (after == "**")
    kinds = [F.when(after.isNull(), "ends").when(after == "", "slashed").when(variable, "variable").otherwise("plain") == k for k in NEXT]
    going = tree.where(F.size("shape") > level).select("host", "node", seg.alias("seg"), "pages", "labelled", "blocked", *[F.when(k, F.col("pages")).otherwise(0).alias(n) for k, n in zip(kinds, NEXT, strict=True)])
    each = going.groupBy("host", "node", "seg").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    nodes = going.groupBy("host", "node").agg(F.sum("pages").alias("node_pages"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    large = each.where(F.col("pages") >= min_pages).join(nodes.select("host", "node", "node_pages"), ["host", "node"]).where(F.col("pages") >= F.col("node_pages") * share)
    listed = large.groupBy("host", "node").agg(F.collect_list(F.struct("seg", *COUNTS)).alias("branches"), F.sum("labelled").alias("in_labelled"), F.sum("blocked").alias("in_blocked"))
    named = named_branches(listed.select("host", "node", "branches")).join(listed.drop("branches"), ["host", "node"])
    known = nodes.join(named, ["host", "node"], "left").select(
        "host", "node", "branches", (F.col("all_labelled") - F.coalesce("in_labelled", F.lit(0))).alias("rest_labelled"), (F.col("all_blocked") - F.coalesce("in_blocked", F.lit(0))).alias("rest_blocked"),
    )
    t = tree.join(known, ["host", "node"], "left").withColumn("branch", F.get(F.filter("branches", lambda b: b["seg"] == seg), F.lit(0)))
    goes_on = F.size("shape") > level
    labelled, blocked = (F.coalesce(F.col(f"branch.{c}"), F.col(f"rest_{c}")) for c in ("labelled", "blocked"))
    node = F.when(goes_on, F.concat("node", F.lit("/"), F.coalesce("branch.name", F.lit("*")))).otherwise(F.col("node"))
    purity = F.when(goes_on, (blocked + strength * F.col("purity")) / (labelled + strength)).otherwise(F.col("purity"))
    return t.select("host", "shape", "pages", "labelled", "blocked", node.alias("node"), purity.alias("purity"))


def templates(shapes: DataFrame, share: float, min_pages: int, strength: float) -> DataFrame:
    """(host, shape, node, purity) out of (host, shape, pages, labelled, blocked)."""
    shapes = materialize(shapes, "url-shapes")
    whole = shapes.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max(F.size("shape")).alias("levels"))
    top = whole.select(((F.coalesce("b", F.lit(0)) + strength / 2) / (F.coalesce("l", F.lit(0)) + strength)).alias("top"))  # one row
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).crossJoin(F.broadcast(top))
    hosts = hosts.select("host", ((F.col("b") + strength * F.col("top")) / (F.col("l") + strength)).alias("purity"))
    tree = shapes.join(hosts, "host").withColumn("node", F.lit(""))
    for level in range(whole.first()["levels"] or 0):  # at most depth + 1
        tree = grown(materialize(tree, f"url-tree-{level}"), level, share, min_pages, strength)
    return tree.select("host", "shape", "node", "purity")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", label_col: str | None = None, into: str = "judged", depth: int = 6, share: float = 0.02, min_pages: int = 3, strength: float = 4.0, reject: float = 0.7,
) -> DataFrame:
    """pages with a struct column `into`: host, path, rule, verdict, template and purity. `label_col` may hold true for urls known to be bad and false for good ones."""
    own = free_names(pages, "own_host", "own_path", "own_rule", "own_shape", "tree_host", "tree_shape", "tree_node", "tree_purity")
    host, path, rule, shape, *tree = own
    url = F.col(url_col)
    p = pages.withColumns({host: host_of(url), path: path_of(url)})
    p = p.withColumns({rule: matched_rule(F.col(host), F.col(path), rules), shape: shape_of(F.col(path), depth)})
    bad = F.col(rule)["verdict"] == "block"
    if label_col is not None:
        bad = F.coalesce(bad, F.col(label_col).cast("boolean"))
    counted = p.groupBy(F.col(host).alias("host"), F.col(shape).alias("shape")).agg(F.count(F.lit(1)).alias("pages"), F.count(bad).alias("labelled"), F.count_if(bad).alias("blocked"))
    found = templates(counted, share, min_pages, strength)
    found = materialize(found.toDF(*tree), "url-templates")
    j = p.join(found, (F.col(host) == F.col(tree[0])) & (F.col(shape) == F.col(tree[1])))
    verdict = F.coalesce(F.col(rule)["verdict"], F.when(F.col(tree[3]) >= reject, "block").otherwise("allow"))
    result = F.struct(F.col(host).alias("host"), F.col(path).alias("path"), F.col(rule)["rule"].alias("rule"), verdict.alias("verdict"), F.col(tree[2]).alias("template"), F.col(tree[3]).alias("purity"))
    return j.select(*[F.col(f"`{c}`") for c in pages.columns], result.alias(into))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.template", "judged.purity")
