"""Edges of a spanning tree that split the population evenly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partigrid.functions.columns import within


def _walked(table: pa.Table) -> tuple[int, list[int], dict[int, int | None], dict[int, int]]:
    """A tree's id, its vertices from the root on, their parents and depths; the root is the smallest vertex."""
    adj: dict[int, list[int]] = {}
    for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    root = min(adj)
    order, parent, depth = [root], {root: None}, {root: 0}
    for v in order:
        for w in adj[v]:
            if w not in parent:
                parent[w], depth[w] = v, depth[v] + 1
                order.append(w)
    return table.column("tree_id")[0].as_py(), order, parent, depth


def _grouped(trees: DataFrame) -> DataFrame:
    return trees.select(F.col("tree_id").cast("long").alias("tree_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).groupBy("tree_id")


def rooted(trees: DataFrame) -> DataFrame:
    """(tree_id, v, parent, depth) of trees(tree_id, src, dst), each rooted at its smallest vertex; the root's parent is null.

    A group is one tree of a base graph, of any depth.
    """

    def run(table: pa.Table) -> pa.Table:
        tree_id, order, parent, depth = _walked(table)
        cols = [np.full(len(order), tree_id), order, [parent[v] for v in order], [depth[v] for v in order]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.int32()] * 3), strict=True)], names=["tree_id", "v", "parent", "depth"])

    return _grouped(trees).applyInArrow(run, "tree_id long, v int, parent int, depth int")


def ancestors(trees: DataFrame) -> DataFrame:
    """(tree_id, v, ancestor): every vertex with itself and all above it."""

    def run(table: pa.Table) -> pa.Table:
        tree_id, order, parent, depth = _walked(table)
        above: list[int] = []
        for v in order:
            while v is not None:
                above.append(v)
                v = parent[v]
        cols = [np.full(len(above), tree_id), np.repeat(order, [depth[v] + 1 for v in order]), above]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["tree_id", "v", "ancestor"])

    return _grouped(trees).applyInArrow(run, "tree_id long, v int, ancestor int")


def _splits(by_leaves: bool):
    """Each edge of one tree with the vertices and population on its lower side, by contracting leaves or by subtree sums."""

    def run(table: pa.Table) -> pa.Table:
        tree_id = table.column("tree_id")[0].as_py()
        adj: dict[int, set[int]] = {}
        for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
        weight = dict(zip(table.column("src").to_pylist(), table.column("src_weight").to_pylist(), strict=True))
        weight |= dict(zip(table.column("dst").to_pylist(), table.column("dst_weight").to_pylist(), strict=True))
        root, side, pop, out = min(adj), {v: [v] for v in adj}, dict(weight), []
        if by_leaves:
            degree = {v: len(n) for v, n in adj.items()}
            leaves, gone = [v for v, n in degree.items() if n == 1 and v != root], set()
            order = []
            while leaves:
                v = leaves.pop()
                up = next(w for w in adj[v] if w not in gone)
                gone.add(v)
                order.append((v, up))
                degree[up] -= 1
                if degree[up] == 1 and up != root:
                    leaves.append(up)
        else:
            walk, parent = [root], {root: root}
            for v in walk:
                for w in adj[v] - {parent[v]}:
                    parent[w] = v
                    walk.append(w)
            order = [(v, parent[v]) for v in reversed(walk[1:])]
        for v, up in order:
            out.append((tree_id, min(v, up), max(v, up), pop[v], sorted(side[v])))
            pop[up] += pop[v]
            side[up] += side[v]
        cols = list(zip(*out, strict=True))
        above = [pop[root] - x for x in cols[3]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip((*cols[:4], above, cols[4]), kinds, strict=True)], names=["tree_id", "src", "dst", "below", "above", "subset"])

    return run


def split_edges(trees: DataFrame, vertices: DataFrame, by_leaves: bool = False) -> DataFrame:
    """(tree_id, src, dst, below, above, subset): each tree edge with the populations of its two sides, and the lower side
    as seen from the smallest vertex.

    ``vertices`` holds (v, weight), or (tree_id, v, weight) where populations differ by tree. A group is one small tree.
    """
    keys = ["tree_id"] if "tree_id" in vertices.columns else []
    rows = trees.select(F.col("tree_id").cast("long").alias("tree_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    for end in ("src", "dst"):
        rows = rows.join(vertices.select(*keys, F.col("v").alias(end), F.col("weight").cast("long").alias(f"{end}_weight")), [*keys, end])
    return rows.groupBy("tree_id").applyInArrow(_splits(by_leaves), "tree_id long, src int, dst int, below long, above long, subset array<int>")


def balanced_cuts(trees: DataFrame, vertices: DataFrame, epsilon: float, ideal: float | None = None, by_leaves: bool = False) -> DataFrame:
    """The split edges with a side within ``epsilon`` of ``ideal`` (None: half of the tree's population)."""
    cuts = split_edges(trees, vertices, by_leaves)
    goal = F.lit(float(ideal)) if ideal is not None else (F.col("below") + F.col("above")) / 2
    return cuts.where(within(F.col("below"), goal, epsilon) | within(F.col("above"), goal, epsilon))


def same_cuts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two results hold the same (tree_id, src, dst)."""
    keys = ["tree_id", "src", "dst"]
    only = a.select(*keys).exceptAll(b.select(*keys)).unionAll(b.select(*keys).exceptAll(a.select(*keys)))
    return only.agg((F.count("*") == 0).alias("same"))
