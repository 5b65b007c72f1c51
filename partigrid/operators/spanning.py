"""Trees that span a graph: exact counts, enumeration, layers, exchanges and random trees.

A tree is the sorted list of its edges' positions, from 1 in the graph's native order, so graphs may have any number of edges.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.functions.columns import edge_key, sorted_union
from partigrid.operators.frontier import small_graph
from partigrid.session import materialise
from partigrid.sources.grids import Graph


def tree_count(vertices: list[int], edges: list[tuple[int, int]]) -> int:
    """The trees that span a graph: the determinant of a Laplacian minor, by fraction-free elimination in integers.

    A single vertex has one, a disconnected or empty graph none.
    """
    if not vertices:
        return 0
    place = {v: i - 1 for i, v in enumerate(sorted(vertices))}
    n = len(place) - 1
    m = [[0] * n for _ in range(n)]
    for a, b in edges:
        i, j = place[a], place[b]
        if i == j:
            continue
        for p, q in ((i, j), (j, i)):
            if p >= 0:
                m[p][p] += 1
                if q >= 0:
                    m[p][q] -= 1
    previous = 1
    for i in range(n):
        pivot = next((r for r in range(i, n) if m[r][i]), None)
        if pivot is None:
            return 0
        if pivot != i:
            m[i], m[pivot] = m[pivot], [-x for x in m[i]]
        for r in range(i + 1, n):
            row, top, lead = m[r], m[i], m[i][i]
            factor = row[i]
            for c in range(i + 1, n):
                row[c] = (row[c] * lead - factor * top[c]) // previous
        previous = m[i][i]
    return previous


def _counts(keys: list[str], exact: bool):
    def run(table: pa.Table) -> pa.Table:
        edges = [(a, b) for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True) if b is not None]
        vertices = sorted(set(table.column("src").to_pylist()) | {b for _, b in edges})
        head = [table.column(k)[:1] for k in keys]
        if exact:
            return pa.table([*head, pa.array([str(tree_count(vertices, edges))])], names=[*keys, "trees"])
        return pa.table([*head, pa.array([eigen_count(vertices, edges)])], names=[*keys, "trees"])

    return run


def eigen_count(vertices: list[int], edges: list[tuple[int, int]]) -> float:
    """The same count in floating point: the product of the Laplacian's non-zero eigenvalues over the number of vertices."""
    place = {v: i for i, v in enumerate(vertices)}
    lap = np.zeros((len(vertices), len(vertices)))
    for a, b in edges:
        lap[place[a], place[b]] -= 1
        lap[place[b], place[a]] -= 1
    lap -= np.diag(lap.sum(axis=1))
    values = np.sort(np.linalg.eigvalsh(lap))[1:]
    return float(np.exp(np.log(np.maximum(values, 1e-300)).sum() - np.log(len(vertices)))) if len(values) else 1.0


def count_trees(vertices: DataFrame, edges: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """(keys.., trees) for each group of vertices(keys.., v) and edges(keys.., src, dst); one small graph a group."""
    loose = vertices.select(*keys, F.col("v").alias("src"), F.lit(None).cast("int").alias("dst"))
    rows = edges.select(*keys, F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).unionByName(loose.withColumn("src", F.col("src").cast("int")))
    types = dict(rows.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["trees string" if exact else "trees double"])
    found = rows.groupBy(*keys).applyInArrow(_counts(keys, exact), schema)
    return found.withColumn("trees", F.col("trees").cast("decimal(38,0)")) if exact else found


class Grower:
    """All trees that span a graph as bits over its edges, grown edge by edge, many at a time; bit i is in word i // 64."""

    def __init__(self, edges: list[tuple[int, int]], vertices: list[int]):
        place = {v: i for i, v in enumerate(sorted(vertices))}
        self.edges = [(place[a], place[b]) for a, b in edges]
        self.n, self.words = len(place), -(-len(edges) // 64)
        last: dict[int, int] = {}
        for i, e in enumerate(self.edges):
            for a in e:
                last[a] = i
        self.closing = [[a for a in e if last[a] == i] for i, e in enumerate(self.edges)]
        self.open_after = [np.array([last.get(a, -1) > i for a in range(self.n)]) for i in range(len(self.edges))]

    def grow(self, bits: np.ndarray, label: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        for i in range(start, stop):
            a, b = self.edges[i]
            can = label[:, a] != label[:, b]
            joined, kept = label[can], bits[can]
            joined = np.where(joined == joined[:, [b]], joined[:, [a]], joined)
            kept[:, i // 64] |= np.uint64(1 << i % 64)
            bits, label = np.concatenate((bits, kept)), np.concatenate((label, joined))
            for v in self.closing[i]:
                live = (label == label[:, [v]]) & self.open_after[i]
                keep = live.any(axis=1)
                if not self.open_after[i].any():
                    keep |= (label == label[:, [0]]).all(axis=1)
                bits, label = bits[keep], label[keep]
        return bits, label

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((1, self.words), np.uint64), np.arange(self.n, dtype=np.int32)[None, :]

    def positions(self, bits: np.ndarray) -> list[np.ndarray]:
        """Edge positions of each row of bits."""
        flat = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
        return [np.flatnonzero(r).astype(np.int32) + 1 for r in flat]


def _grow(grower: Grower, depth: int):
    """Numbers of prefixes to their trees, in ascending order of their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, labels = grower.grow(*grower.start(), 0, depth)
        order = np.lexsort(prefixes.T)
        for b in batches:
            for p in b.column("id").to_pylist():
                if p < len(order):
                    at = order[p : p + 1]
                    bits, _ = grower.grow(prefixes[at], labels[at], depth, len(grower.edges))
                    bits = bits[np.lexsort(bits.T)]
                    for s in range(0, len(bits), 20_000):
                        edges = grower.positions(bits[s : s + 20_000])
                        cols = [pa.array(np.full(len(edges), p, np.int64)), pa.array(np.arange(s, s + len(edges))), pa.array(edges, pa.list_(pa.int32()))]
                        yield pa.RecordBatch.from_arrays(cols, names=["prefix", "place", "edges"])

    return run


def all_trees(spark: SparkSession, graph: Graph, depth: int = 8) -> DataFrame:
    """(tree_id, edges): every tree that spans the graph.

    Decisions on the first ``depth`` edges split the work into tasks. Ids count up over those prefixes.
    """
    edges, weights = small_graph(graph)
    if len(weights) == 1:
        return spark.createDataFrame([(0, [])], "tree_id long, edges array<int>")
    if not weights or len({v for e in edges for v in e}) < len(weights):
        return spark.createDataFrame([], "tree_id long, edges array<int>")
    depth = min(depth, len(edges))
    tasks = min(1 << depth, 4 * spark.sparkContext.defaultParallelism)
    rows = materialise(spark.range(0, 1 << depth, 1, tasks).mapInArrow(_grow(Grower(edges, sorted(weights)), depth), "prefix long, place long, edges array<int>"))
    counts = sorted((r.prefix, r.n) for r in rows.groupBy("prefix").agg(F.count("*").alias("n")).collect())  # 2^depth rows at most
    base, offsets = 0, []
    for p, n in counts:
        offsets.append((p, base))
        base += n
    known = spark.createDataFrame(offsets, "prefix long, base long")
    return rows.join(F.broadcast(known), "prefix").select((F.col("base") + F.col("place")).alias("tree_id"), "edges")


def write_trees(trees: DataFrame, path: str) -> None:
    trees.write.mode("overwrite").parquet(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Trees that were listed before, (tree_id, edges)."""
    return spark.read.schema("tree_id long, edges array<int>").parquet(path)


def tree_layers(trees: DataFrame, seed_id: int = 0) -> DataFrame:
    """(tree_id, layer): how many exchanges part a tree from the seed, the number of its edges that the seed lacks."""
    seed = trees.where(F.col("tree_id") == seed_id).select(F.col("edges").alias("seed"))
    return trees.join(F.broadcast(seed), F.lit(True)).select("tree_id", F.size(F.array_except("edges", "seed")).alias("layer"))  # one row, broadcast


def layer_sizes(layers: DataFrame) -> DataFrame:
    """(layer, trees), with the total in a row whose layer is null."""
    return layers.rollup("layer").agg(F.count("*").alias("trees"))


def tree_neighbours(trees: DataFrame, n_edges: int) -> DataFrame:
    """(tree_id, other_id): trees that differ by one exchange; each tree names its candidates, an equi-join keeps real ones."""
    spare = F.array_except(F.sequence(F.lit(1), F.lit(n_edges)), F.col("edges"))
    out = trees.select("tree_id", "edges", F.explode("edges").alias("out"), spare.alias("spare")).withColumn("into", F.explode("spare"))
    asked = out.select("tree_id", sorted_union(F.array_remove("edges", F.col("out")), F.array("into")).alias("edges"))
    return asked.join(trees.select(edge_key(F.col("edges")).alias("edges"), F.col("tree_id").alias("other_id")), "edges").select("tree_id", "other_id")


def missing_edges(trees: DataFrame, n_edges: int) -> DataFrame:
    """(tree_id, edge): the graph's edges that a tree lacks."""
    return trees.select("tree_id", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(n_edges)), F.col("edges"))).alias("edge"))


def parts(vertices: list[int], edges: list[tuple[int, int]]) -> int:
    """How many connected parts a small graph has."""
    up = {v: v for v in vertices}

    def find(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        up[find(a)] = find(b)
    return len({find(v) for v in vertices})


def wilson(adj: dict[int, list[tuple[int, int]]], rng: random.Random) -> list[int]:
    """Edges of a uniform spanning tree by loop-erased random walks; adj holds (neighbour, edge position) and is connected."""
    vertices = sorted(adj)
    inside, edges = {vertices[rng.randrange(len(vertices))]}, []
    for v in vertices:
        step: dict[int, tuple[int, int]] = {}
        at = v
        while at not in inside:  # a later visit overwrites the way out, which erases the loop
            step[at] = adj[at][rng.randrange(len(adj[at]))]
            at = step[at][0]
        at = v
        while at not in inside:
            inside.add(at)
            at, edge = step[at]
            edges.append(edge)
    return sorted(edges)


def light_tree(edges: list[tuple[int, int]], rng: random.Random) -> list[int]:
    """Edges (positions from 1) of the lightest spanning tree under random edge weights (not uniform over trees)."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    out = []
    for _, i in sorted((rng.random(), i) for i in range(len(edges))):
        a, b = find(edges[i][0]), find(edges[i][1])
        if a != b:
            up[a] = b
            out.append(i + 1)
    return sorted(out)


def _draw(edges: list[tuple[int, int]], vertices: list[int], kind: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adj: dict[int, list[tuple[int, int]]] = {v: [] for v in vertices}
        for i, (a, b) in enumerate(edges, 1):
            adj[a].append((b, i))
            adj[b].append((a, i))
        for b in batches:
            ids = b.column("id").to_pylist()
            trees = [wilson(adj, random.Random(f"{seed}:{i}")) if kind == "UST" else light_tree(edges, random.Random(f"{seed}:{i}")) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(trees, pa.list_(pa.int32()))], names=["trial", "edges"])

    return run


def random_trees(spark: SparkSession, graph: Graph, trials: int, kind: str = "UST", seed: int = 0) -> DataFrame:
    """(trial, edges): random trees that span the graph, ``UST`` uniform, ``MST`` the lightest under random weights. Reruns agree.

    A graph that is empty or not connected has no such tree and is an error.
    """
    if kind not in ("UST", "MST"):
        raise ValueError(kind)
    edges, weights = small_graph(graph)
    if parts(sorted(weights), edges) != 1:
        raise ValueError("no tree spans a graph that is not connected")
    return spark.range(trials).mapInArrow(_draw(edges, sorted(weights), kind, seed), "trial long, edges array<int>")


def sampled_tree_ids(drawn: DataFrame, trees: DataFrame) -> DataFrame:
    """(trial, tree_id): the place of each drawn tree in the enumeration."""
    return drawn.join(trees.select("edges", "tree_id"), "edges").select("trial", "tree_id")


def tree_edges(trees: DataFrame, order: DataFrame) -> DataFrame:
    """The trees' edges as rows, with their ends from order(pos, src, dst); other columns stay."""
    rows = trees.withColumn("pos", F.explode("edges")).drop("edges")
    return rows.join(order.select("pos", "src", "dst"), "pos")


def density(sampled: DataFrame) -> DataFrame:
    """(tree_id, n, share): histogram of sampled trees."""
    n = sampled.groupBy("tree_id").agg(F.count("*").alias("n"))
    total = sampled.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("tree_id", "n", (F.col("n") / F.col("total")).alias("share"))  # one row, broadcast
