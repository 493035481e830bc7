"""Embedding near-duplicates: all pairs with a cosine of at least a threshold, by dual traversal of cover trees.

Vectors are put on the unit sphere in double precision, where a cosine of t is a distance of sqrt(2 - 2t). Equal vectors are one class (an aggregate).
Class representatives are dealt to cells: the nearest of at most `most_cells` pivots, which a farthest-first walk takes from a bounded sample, so that
prefixes of pivots are the nested upper levels. Cells are cut into blocks of about `block_rows` by a hash, so that a crowded cell is many blocks, and each
block becomes a cover tree (built once, and sent with the block): nested centers whose covering radii halve from level to level, with exact radii kept per node.

Two cells are compared only if their pivots are at most the link distance plus both covering radii apart. Blocks are lined up by cell and cut into strips; a
tile is a pair of strips with cells to compare, and one task's work. So a block moves once per tile and not once per partner, and its vectors move as they came
(single precision where the table has that). In a tile, pairs of trees are descended together, node pairs beyond the bound are pruned, node pairs wholly within it are
counted without descending, and points are compared by their cosines. A tile gives counts of links per class and one edge per linked class to the least class it is
joined with there, so a crowd of near copies never becomes a list of pairs.

Results: null vectors, zero vectors and vectors with null or non-finite components link with nothing. Vectors of other lengths than most are compared
only with those of their own length. Rows that share an id count as vectors of their own and belong to one component. Rows without an id are left out.

Pruning depends on the data: where unrelated vectors lie about as far apart as cells are wide, all pairs of blocks remain and the work is quadratic in
distinct vectors, as for every exact method there; with S strips each vector then moves S + 1 times. S is what keeps all cores busy and a strip within `strip_mb`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .components import components

SLACK = 1e-6  # more than rounding can move a distance


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class CoverTree:
    """Nodes in arrays: center (row number), exact covering radius, children (first, last), and the points below as a range of `order`."""

    def __init__(self, x: np.ndarray, leaf: int = 1, least_radius: float = 1e-3):
        self.x, self.single = x, x.astype(np.float32)
        self.order = np.arange(len(x))
        self.center: list[int] = [0]
        self.radius: list[float] = [0.0]
        self.children: list[tuple[int, int]] = [(0, 0)]
        self.points: list[tuple[int, int]] = [(0, len(x))]
        far = distances(x[:1], x)[0] if len(x) else np.zeros(0)
        self.radius[0] = float(far.max(initial=0.0))
        todo = [(0, far)]  # node, distances of its points (in order) from its center
        while todo:
            node, far = todo.pop()
            begin, end = self.points[node]
            if end - begin <= leaf or self.radius[node] <= least_radius:
                continue
            # the next level's centers: the node's own, then points farther than half its radius from all centers so far
            half, mine = self.radius[node] / 2, self.order[begin:end].copy()
            owner, near = np.full(len(mine), -1), np.full(len(mine), np.inf)
            centers: list[int] = []
            at = int(np.flatnonzero(mine == self.center[node])[0])
            vectors = x[mine]
            open_ = np.ones(len(mine), bool)
            while at >= 0:
                d = far if not centers else distances(vectors[at : at + 1], vectors)[0]
                take = open_ & (d <= half)
                take[at] = True
                owner[take], near[take] = len(centers), d[take]
                near[at] = 0.0
                open_ &= ~take
                centers.append(int(mine[at]))
                at = int(open_.argmax()) if open_.any() else -1
            sort = np.argsort(owner, kind="stable")
            self.order[begin:end] = mine[sort]
            sizes = np.bincount(owner, minlength=len(centers))
            ends = np.cumsum(sizes)
            first = len(self.center)
            self.children[node] = (first, first + len(centers))
            near = near[sort]
            for c, size, stop in zip(centers, sizes.tolist(), ends.tolist(), strict=True):
                part = near[stop - size : stop]
                self.center.append(c)
                self.radius.append(float(part.max()))
                self.children.append((0, 0))
                self.points.append((begin + stop - size, begin + stop))
                if size > leaf:
                    todo.append((len(self.center) - 1, part))
        self.center, self.radius = np.array(self.center), np.array(self.radius)


    def parts(self) -> bytes:
        """All but the points, small."""
        small = {"order": self.order, "center": self.center, "children": np.array(self.children), "points": np.array(self.points)}
        return pickle.dumps({k: v.astype(np.int32) for k, v in small.items()} | {"radius": self.radius})

    @classmethod
    def of_parts(cls, x: np.ndarray, parts: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(parts) | {"x": x, "single": x.astype(np.float32)}
        return tree


class Links:
    """Link counts and a forest of linked points over two blocks (or one)."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count = weights, np.zeros(len(weights), np.int64)
        self.parent = list(range(len(weights)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def traverse(a: CoverTree, b: CoverTree, threshold: float, links: Links, at_a: int, at_b: int) -> None:
    """Count the links between points of a and points of b on both sides, or of a with itself if b is a.

    Points of a and b are numbered from at_a and at_b in links. Bounds are tested on single-precision cosines with slack, links on double ones.
    """
    reach, alone = float(np.sqrt(2 - 2 * threshold)), a is b

    def whole(p: np.ndarray, q: np.ndarray) -> None:
        """All points p are linked with all points q."""
        links.count[p] += int(links.weights[q].sum())
        if not alone:
            links.count[q] += int(links.weights[p].sum())
        for i in p.tolist():
            links.join(i, int(q[0]))
        for j in q.tolist():
            links.join(j, int(p[0]))

    def below(t: CoverTree, node: int, at: int) -> np.ndarray:
        return t.order[slice(*t.points[node])] + at

    def parts(t: CoverTree, node: int) -> np.ndarray:
        first, last = t.children[node]
        return np.arange(first, last) if last > first else np.array([node])

    def by_point(t: CoverTree, nodes: np.ndarray) -> list[np.ndarray]:
        point = t.radius[nodes] == 0
        return [x for x in (nodes[point], nodes[~point]) if len(x)]

    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        ps, qs = parts(a, p), parts(b, q)
        if len(ps) == 1 and len(qs) == 1 and ps[0] == p and qs[0] == q:  # two leaves: compare their points
            i, j = below(a, p, at_a), below(b, q, at_b)
            near = a.x[i - at_a] @ b.x[j - at_b].T >= threshold
            links.count[i] += near @ links.weights[j]
            if not alone:
                links.count[j] += links.weights[i] @ near
            for r, c in zip(*np.nonzero(near), strict=True):
                links.join(int(i[r]), int(j[c]))
            continue
        for some in by_point(a, ps):
            for other in by_point(b, qs):
                far = reach + a.radius[some][:, None] + b.radius[other][None] if a.radius[some].any() or b.radius[other].any() else np.full((1, 1), reach)
                least = (1 - (far + SLACK) ** 2 / 2 - SLACK).astype(np.float32)
                r, c = np.nonzero(a.single[a.center[some]] @ b.single[b.center[other]].T >= least)
                i, j = some[r], other[c]
                spread = a.radius[i] + b.radius[j]
                cosine = np.einsum("ij,ij->i", a.x[a.center[i]], b.x[b.center[j]])
                d = np.sqrt(np.maximum(2 - 2 * cosine, 0))
                inside = np.where(spread == 0, cosine >= threshold, d + spread <= reach - SLACK)  # points, or nodes wholly in reach
                for x, y in zip(i[inside].tolist(), j[inside].tolist(), strict=True):
                    whole(below(a, x, at_a), below(b, y, at_b))
                deeper = ~inside & (spread > 0)
                todo += list(zip(i[deeper].tolist(), j[deeper].tolist(), strict=True))


def pivots_of(sample: np.ndarray, most: int) -> np.ndarray:
    """A farthest-first walk over the sample: every prefix covers the sample with a radius no point of it undercuts."""
    if not len(sample):
        return sample
    chosen, near = [0], distances(sample[:1], sample)[0]
    while len(chosen) < most and near.max() > 1e-9:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample[chosen[-1] : chosen[-1] + 1], sample)[0])
    return sample[chosen]


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """The vectors in raw on the unit sphere, in double precision. Dividing by the greatest component first keeps squares within a double's range."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block_rows: int = 4096, most_cells: int = 64, sample_rows: int = 2048, strip_mb: int = 32) -> DataFrame:
    """One row per row with an id: (id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if v is None else np.array([np.nan if c is None else c for c in v], kind) + 0.0 for v in b.column(1).to_pylist()]
            found = [v.tobytes() if v is not None and np.isfinite(v).all() and v.any() else None for v in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["id", "raw"])

    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    rows = plain.where("id is not null").mapInArrow(pack, "id long, raw binary")
    key = [F.xxhash64("raw").alias("h"), F.xxhash64("raw", F.lit(1)).alias("h2")]
    rows = materialize(rows.select("id", "raw", *key), "vectors")  # the key of a missing vector is of no use
    usable = rows.where("raw is not null")
    sizes = [r[0] for r in usable.select(F.length("raw")).distinct().collect()]  # lengths of vectors
    alone = rows.where("raw is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    done = [size_work(usable.where(F.length("raw") == size), kind, threshold, block_rows, most_cells, sample_rows, strip_mb << 20) for size in sizes]
    if not done:
        return alone.withColumn("kept", F.lit(True))
    classes, work = done[0]
    for more_classes, more_work in done[1:]:
        classes, work = classes.union(more_classes), work.union(more_work)
    work = materialize(work, "tile-links")
    counts = work.groupBy("node", "h").agg(F.sum("links").alias("links"))
    owner = usable.select("id", "h", "h2").join(classes, ["h", "h2"]).select("id", "node", "h", "n")
    owner = materialize(owner.join(counts, ["node", "h"], "left").select("id", "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-owners")
    shared = owner.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    edges = work.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").union(owner.join(shared, "id").select("a", F.col("node").alias("b")))
    found = components(edges)
    linked = owner.join(found, "node", "left").select("id", "n_links", F.coalesce("component", "node").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("id") == F.col("component_id"))


def size_work(rows: DataFrame, kind: str, threshold: float, block_rows: int, most_cells: int, sample_rows: int, strip_bytes: int) -> tuple[DataFrame, DataFrame]:
    """((h, h2, node, n) of each class of equal vectors, (node, h, links, root) per class and tile in which it has links) of vectors of one length."""
    spark = rows.sparkSession
    total = rows.count()
    low = F.lit(int(min(1.0, 2 * sample_rows / total) * (1 << 32)))
    sample = rows.where(F.shiftrightunsigned("h", 32) < low).select("raw").distinct().limit(sample_rows).collect()  # by a hash of the vector, so a copied one counts once
    if not sample:
        sample = rows.select("raw").limit(1).collect()
    pivots = pivots_of(unit(sorted(bytes(r[0]) for r in sample), kind), int(np.clip(total // block_rows, 1, most_cells)))
    shared = spark.sparkContext.broadcast(pivots)  # at most most_cells vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(unit(b.column(2).to_pylist(), kind), shared.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "far"])

    classes = rows.groupBy("h", "h2", "raw").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    placed = materialize(classes.mapInArrow(assign, "h long, h2 long, raw binary, node long, n long, cell int, far double"), "cells")
    stats = {r["cell"]: (r["rows"], r["radius"], r["bytes"]) for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"), F.sum(F.length("raw")).alias("bytes")).collect()}  # a row per cell
    cells = sorted(stats)
    blocks_in = {c: -(-stats[c][0] // block_rows) for c in cells}
    first = dict(zip(cells, np.cumsum([0, *[blocks_in[c] for c in cells]]).tolist(), strict=False))
    n_blocks = sum(blocks_in.values())
    cores = int(spark.conf.get("spark.executor.instances", "0")) * int(spark.conf.get("spark.executor.cores", "1")) or spark.sparkContext.defaultParallelism
    strips = max(int(np.ceil((4 * cores) ** 0.5)), -(-sum(x[2] for x in stats.values()) // strip_bytes))
    wide = max(1, n_blocks // strips)  # blocks of a strip
    reach, between = float(np.sqrt(2 - 2 * threshold)), distances(pivots, pivots)
    near = {(a, b) for a in cells for b in cells if a <= b and between[a, b] - stats[a][1] - stats[b][1] <= reach + SLACK}  # at most most_cells squared
    strip_of = lambda c: (first[c] // wide, (first[c] + blocks_in[c] - 1) // wide)
    ranges = spark.createDataFrame([(*strip_of(a), *strip_of(b)) for a, b in near], "a0 int, a1 int, b0 int, b1 int")
    pairs = ranges.select(F.explode(F.sequence("a0", "a1")).alias("a"), "b0", "b1").select("a", F.explode(F.sequence("b0", "b1")).alias("b"))
    tiles = pairs.where("a <= b").distinct().select(F.struct("a", "b").alias("tile"), F.explode(F.array_distinct(F.array("a", "b"))).alias("strip"))
    count = lambda of: F.create_map(*[x for c in cells for x in (F.lit(c), F.lit(of[c]))])[F.col("cell")]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "h"])
        tree = CoverTree(unit(group["raw"].tolist(), kind))
        return pd.DataFrame({"block": group["block"].iloc[:1].to_numpy(), "cell": group["cell"].iloc[:1].to_numpy(), "nodes": [group["node"].to_numpy("<i8").tobytes()], "hs": [group["h"].to_numpy("<i8").tobytes()], "ns": [group["n"].to_numpy("<i8").tobytes()], "raw": [b"".join(group["raw"])], "tree": [tree.parts()]})

    numbered = placed.select("node", "h", "n", "raw", "cell", (count(first) + F.pmod(F.xxhash64("node", "h"), count(blocks_in))).cast("int").alias("block"))
    blocks = numbered.groupBy("block").applyInPandas(pack, "block int, cell int, nodes binary, hs binary, ns binary, raw binary, tree binary")
    blocks = materialize(blocks.withColumn("strip", F.floor(F.col("block") / wide).cast("int")), "blocks")
    parts = int(np.clip(strips * (strips + 1) // 2, 1, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    place = F.pmod(F.col("tile.a") * (strips + 1) + F.col("tile.b"), F.lit(parts)).cast("int")
    dealt = blocks.join(tiles, "strip").repartitionById(parts, place).sortWithinPartitions("tile", "block")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}
                now = (row["a"], row["b"])
                if now != tile and held:
                    yield tile_links(held, near, kind, threshold, tile)
                    held = []
                tile = now
                held.append(row)
        if held:
            yield tile_links(held, near, kind, threshold, tile)

    sent = dealt.select("tile.a", "tile.b", "strip", "cell", "nodes", "hs", "ns", "raw", "tree")
    return placed.select("h", "h2", "node", "n"), sent.mapInArrow(link, "node long, h long, links long, root long")


def tile_links(rows: list[dict], near: set[tuple[int, int]], kind: str, threshold: float, tile: tuple[int, int]) -> pa.RecordBatch:
    """(node, h, links, root) of the classes of a tile that have links there: between its first strip and its second one."""
    of = lambda name: [np.frombuffer(r[name], "<i8") for r in rows]
    nodes, hs, ns = np.concatenate(of("nodes")), np.concatenate(of("hs")), np.concatenate(of("ns"))
    ends = np.cumsum([len(x) for x in of("nodes")])
    trees = []
    for r, x in zip(rows, of("nodes"), strict=True):
        size = len(r["raw"]) // len(x)
        trees.append(CoverTree.of_parts(unit([r["raw"][i : i + size] for i in range(0, len(r["raw"]), size)], kind), r["tree"]))
    links = Links(ns)
    for i, p in enumerate(rows):
        for j, q in enumerate(rows[i:], i):
            if (p["strip"], q["strip"]) != tile or (p["cell"], q["cell"]) not in near:
                continue
            at_i, at_j = int(ends[i]) - len(trees[i].x), int(ends[j]) - len(trees[j].x)
            traverse(trees[i], trees[j], threshold, links, at_i, at_j)
            if i == j:
                links.count[at_i : ends[i]] -= ns[at_i : ends[i]]  # a point's own class is counted apart
    root = np.array([links.root(i) for i in range(len(nodes))])
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, root, nodes)
    has = np.flatnonzero(links.count)
    return pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(hs[has]), pa.array(links.count[has]), pa.array(least[root[has]])], ["node", "h", "links", "root"])


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
