"""Counting plans: the partitions of a graph into connected districts, with weights in bounds.

The computation goes over the edges. While the states are few, one task takes all levels it can; a count that ends within
QUICK_STATES states is one job. Beyond LOCAL_STATES they are dealt over the cluster, each task takes a few levels and merges what it has, and equal states of different tasks meet in
a hash aggregate over the exact state, written to the shared folder before the next levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.operators import states as st
from partigrid.session import materialise
from partigrid.sources.grids import Graph

QUICK_STATES, LOCAL_STATES, TASK_STATES, STRIDE, MAX_EDGES = 20_000, 150_000, 60_000, 2, 100_000
_SCHEMA = "level int, state binary, l0 long, l1 long, l2 long, l3 long"


def small_graph(graph: Graph, order: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Edges in order and vertex weights at the driver; a base graph is held to MAX_EDGES edges."""
    both = graph.edges.select("src", "dst", F.lit(None).cast("long").alias("weight"))
    both = both.union(graph.vertices.select("v", F.lit(None).cast("int"), F.col("weight").cast("long")))
    rows = both.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"a base graph of more than {MAX_EDGES} vertices and edges")
    weights = {r.src: r.weight for r in rows if r.dst is None}
    own = sorted((min(r.src, r.dst), max(r.src, r.dst)) for r in rows if r.dst is not None)
    if order is not None and sorted((min(e), max(e)) for e in order) != own:
        raise ValueError("the ordering does not hold the graph's edges")
    return list(order or own), weights


def bounds(weights: dict[int, int], k: int, d: float | None) -> tuple[int | None, int | None]:
    """Least and largest district weight: the mean less and plus ``d``, rounded down; None without ``d``."""
    if d is None:
        return None, None
    mean = sum(weights.values()) / k
    return int(np.floor(mean - d)), int(np.floor(mean + d))


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of equally many bytes as a binary column, without a copy for each row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _rows(level: int, rows: np.ndarray, paths: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(rows), 50_000):
        part = rows[s : s + 50_000]
        cols = [pa.array(np.full(len(part), level, np.int32)), packed(part)]
        cols += [pa.array(paths[s : s + 50_000, j].astype(np.int64)) for j in range(st.LIMBS)]
        yield pa.RecordBatch.from_arrays(cols, names=["level", "state", "l0", "l1", "l2", "l3"])


def _advance(problem: st.Problem, levels: int, stop: int):
    """Take states over at most ``levels`` levels, or until they are more than ``stop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        at = got[0].column("level")[0].as_py()
        paths = st.carry(np.concatenate([np.stack([b.column(f"l{j}").to_numpy() for j in range(st.LIMBS)], axis=1) for b in got]).astype(np.uint64))
        rows = np.concatenate([unpacked(b.column("state")) for b in got])
        end = min(at + levels, len(problem.levels))
        while at < end and len(rows) <= stop:
            made, counts = [], []
            f = len(problem.slots_after(at))
            for s in range(0, len(rows), 40_000):  # bounds the arrays of a step
                batch = st.decode(problem, f, rows[s : s + 40_000])
                for after, origin in st.step(problem, problem.levels[at], batch):
                    made.append(st.encode(problem, after))
                    counts.append(paths[s : s + 40_000][origin])
            rows, paths = np.concatenate(made), np.concatenate(counts)
            first, label = st.distinct(rows)
            rows, paths = rows[first], st.add_up(paths, label, len(first))
            at += 1
            if not len(rows):
                return
        yield from _rows(at, rows, paths)

    return run


def count_by_districts(spark: SparkSession, graph: Graph, ks: tuple[int, ...] | None = None, lower: int | None = None, upper: int | None = None, order: list[tuple[int, int]] | None = None) -> DataFrame:
    """(k, plans): the number of plans with k districts, for each k asked for (None: all) that has any.

    Defined cases: vertices without an edge are districts of their own; a graph without vertices has no plan; both bounds
    hold for every district, also for one of a single vertex.
    """
    edges, weights = small_graph(graph, order)
    return count_problem(spark, st.make_problem(edges, weights, lower, upper, ks))


def _begin(problem: st.Problem, stop: int):
    """The first task: from the empty state on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = st.encode(problem, st.start(problem))
        paths = np.zeros((len(rows), st.LIMBS), np.uint64)
        paths[:, 0] = 1
        for b in batches:
            if b.num_rows:
                yield from _advance(problem, len(problem.levels), stop)(_rows(0, rows, paths))

    return run


def count_problem(spark: SparkSession, problem: st.Problem) -> DataFrame:
    """(k, plans) of a problem whose graph is at the driver already."""
    total = len(problem.levels)
    got = spark.range(0, 1 if problem.weights else 0, 1, 1).mapInArrow(_begin(problem, QUICK_STATES), _SCHEMA).toArrow()  # at most what one level makes of QUICK_STATES
    done = spark.createDataFrame(got) if got.num_rows else spark.createDataFrame([], _SCHEMA)
    level = got.column("level")[0].as_py() if got.num_rows else total
    if level < total:
        done = materialise(done.coalesce(1).mapInArrow(_advance(problem, total, LOCAL_STATES), _SCHEMA))
    while level < total:
        now = done.agg(F.max("level").alias("level"), F.count("*").alias("n")).first()
        level = now.level if now.n else total
        if level == total:
            break
        merged = done.groupBy("level", "state").agg(*[F.sum(f"l{j}").alias(f"l{j}") for j in range(st.LIMBS)])
        tasks = max(spark.sparkContext.defaultParallelism, -(-now.n // TASK_STATES))
        done = materialise(merged.repartition(tasks, "state").mapInArrow(_advance(problem, STRIDE, 1 << 60), _SCHEMA))
    digits = [F.sum(F.col(f"l{j}").cast("decimal(38,0)") * F.lit(str(1 << (32 * j))).cast("decimal(38,0)")).cast("decimal(38,0)") for j in range(st.LIMBS)]
    byte = lambda i: F.conv(F.hex(F.substring("state", i, 1)), 16, 10).cast("int")
    k = (byte(1) + 256 * byte(2) + 65536 * byte(3) + 16777216 * byte(4)).alias("k")
    counts = done.groupBy(k).agg(sum(digits[1:], digits[0]).cast("decimal(38,0)").alias("plans"))
    return counts.where(F.col("k").isin(list(problem.ks))) if problem.ks else counts


def count_plans(spark: SparkSession, graph: Graph, k: int, d: float | None = None, order: list[tuple[int, int]] | None = None, share: float | None = None) -> DataFrame:
    """One row (k, plans): partitions into k connected districts, each within ``d`` of the mean weight, or within that
    ``share`` of it (None: any)."""
    edges, weights = small_graph(graph, order)
    if share is not None and weights:
        d = share * sum(weights.values()) / k
    lower, upper = bounds(weights, k, d) if weights else (None, None)
    found = count_problem(spark, st.make_problem(edges, weights, lower, upper, (k,)))
    return found.agg(F.lit(k).alias("k"), F.coalesce(F.sum("plans"), F.lit(0)).cast("decimal(38,0)").alias("plans"))
