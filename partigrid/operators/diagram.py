"""The decision diagram of all plans: its nodes and arcs as tables, walks in it, enumeration and uniform draws by rank.

Nodes are the states before each edge, in the order of levels; an arc is what leaving out (bit 0) or keeping (bit 1) the edge
leads to. Terminal -1 accepts, terminal -2 rejects.

A diagram of at most MAX_NODES nodes is built by one task, and listing and drawing hold it in each worker. A larger one is an
error there, and is built with ``distributed=True``: level by level, states meet in a hash aggregate, get dense numbers and are
joined to the arcs that lead to them; plans are then found by a join a level over all ranks at once. Both number the nodes of
a level in their own order and give the same diagram otherwise.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partigrid.functions.columns import keep_probability, readable_count, readable_edge, readable_pairs
from partigrid.operators import states as st
from partigrid.operators.frontier import bounds, count_problem, packed, small_graph, unpacked
from partigrid.session import materialise, numbered
from partigrid.sources.grids import Graph

ACCEPT, REJECT, MAX_NODES = -1, -2, 5_000_000


@dataclass
class Tables:
    """Arrays of a diagram: for each level its states, children by bit, and path counts from the root and to acceptance."""

    offsets: list[int]
    batches: list[st.Batch]
    children: list[np.ndarray]
    prefix: list[np.ndarray]
    suffix: list[np.ndarray]


def build(problem: st.Problem, max_nodes: int = MAX_NODES) -> Tables:
    rows = st.encode(problem, st.start(problem))
    t = Tables([0], [], [], [], [])
    paths = np.zeros((len(rows), st.LIMBS), np.uint64)
    paths[:, 0] = 1
    for i, level in enumerate(problem.levels):
        f = len(problem.slots_after(i))
        batch = st.decode(problem, f, rows)
        t.batches.append(batch)
        t.prefix.append(paths)
        t.offsets.append(t.offsets[-1] + len(batch))
        if t.offsets[-1] > max_nodes:
            raise ValueError(f"a diagram of more than {max_nodes} nodes; distributed=True builds it")
        child = np.full((len(batch), 2), REJECT, np.int64)
        made = st.step(problem, level, batch)
        codes = np.concatenate([st.encode(problem, b) for b, _ in made])
        origin = np.concatenate([o for _, o in made])
        bit = np.repeat((0, 1), [len(o) for _, o in made])
        first, label = st.distinct(codes)
        if i + 1 < len(problem.levels):
            child[origin, bit] = t.offsets[-1] + label
            rows, paths = codes[first], st.add_up(paths[origin], label, len(first))
        else:
            cc = np.concatenate([b.cc for b, _ in made])
            good = np.isin(cc, problem.ks) if problem.ks else np.ones(len(cc), bool)
            child[origin[good], bit[good]] = ACCEPT
        t.children.append(child)
    ahead = np.zeros((0, st.LIMBS), np.uint64)
    for i in range(len(t.children) - 1, -1, -1):
        own = np.zeros((len(t.children[i]), st.LIMBS), np.uint64)
        for b in (0, 1):
            c = t.children[i][:, b]
            own[c == ACCEPT, 0] += np.uint64(1)
            inner = np.flatnonzero(c >= 0)
            own[inner] += ahead[c[inner] - t.offsets[i + 1]]
        ahead = st.carry(own)
        t.suffix.insert(0, ahead)
    return t


_CACHE: dict[st.Problem, Tables] = {}


def _tables(problem: st.Problem) -> Tables:
    """The diagram of a problem, built once in each worker process."""
    key = (problem.levels, tuple(sorted(problem.weights.items())), problem.lower, problem.upper, problem.ks)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = build(problem)
    return _CACHE[key]


_NODE = "node long, level int, src int, dst int, cc int, open array<int>, labels array<int>, weights array<long>, pairs array<struct<a:int,b:int>>, prefix string, suffix string, child0 long, child1 long"
_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_TYPES = [pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(_PAIR), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _emit(problem: st.Problem):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            t = build(problem)
            for i, b in enumerate(t.batches):
                yield from _described(problem, i, list(range(t.offsets[i], t.offsets[i + 1])), b, st.to_ints(t.prefix[i]), st.to_ints(t.suffix[i]), t.children[i])

    return run


@dataclass(frozen=True)
class Diagram:
    """Tables of a diagram: nodes(node, level, src, dst, cc, open, labels, weights, pairs, prefix, suffix), arcs(parent, bit, child)."""

    nodes: DataFrame
    arcs: DataFrame
    problem: st.Problem


def make_problem(graph: Graph, ks: tuple[int, ...] | None, d: float | None = None, order: list[tuple[int, int]] | None = None) -> st.Problem:
    edges, weights = small_graph(graph, order)
    lower, upper = bounds(weights, ks[0], d) if d is not None else (None, None)
    return st.make_problem(edges, weights, lower, upper, ks)


def build_diagram(spark: SparkSession, graph: Graph, ks: tuple[int, ...] | None, d: float | None = None, order: list[tuple[int, int]] | None = None, distributed: bool = False) -> Diagram:
    """All nodes and arcs. Path counts are decimals: ``prefix`` from the root, ``suffix`` to acceptance."""
    problem = make_problem(graph, ks, d, order)
    if distributed:
        return _build_by_level(spark, problem)
    rows = materialise(spark.range(0, 1, 1, 1).mapInArrow(_emit(problem), _NODE))
    exact = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("prefix", "suffix")]
    nodes = rows.select("node", "level", "src", "dst", "cc", "open", "labels", "weights", "pairs", *exact)
    arcs = rows.select(F.col("node").alias("parent"), F.posexplode(F.array("child0", "child1")).alias("bit", "child"))
    return Diagram(nodes, arcs, problem)


def _described(problem: st.Problem, i: int, ids: list[int], b: st.Batch, before: list[int], after: list[int], children: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _NODE for states before edge i."""
    slots, level = problem.slots_after(i), problem.levels[i]
    up = np.triu_indices(len(slots), 1)
    out = []
    for j, node in enumerate(ids):
        labels = [slots[c] for c in b.comp[j]]
        pairs = [{"a": slots[p], "b": slots[q]} for p, q in zip(*(u[b.bad[j][up]] for u in up), strict=True)]
        wts = b.wts[j].tolist() if problem.weighted else [0] * len(slots)
        out.append((node, i + 1, level.src, level.dst, int(b.cc[j]), list(slots), labels, wts, pairs, str(before[j]), str(after[j]), int(children[j, 0]), int(children[j, 1])))
    for s in range(0, len(out), 20_000):
        cols = zip(*out[s : s + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES, strict=True)], names=[x.split()[0] for x in _NODE.split(", ")])


_LIMBS = [f"l{j}" for j in range(st.LIMBS)]
_STEPPED = "parent long, bit int, child binary, accepted boolean, " + ", ".join(f"{x} long" for x in _LIMBS)


def _paths(b: pa.RecordBatch) -> np.ndarray:
    return st.carry(np.stack([b.column(x).to_numpy() for x in _LIMBS], axis=1).astype(np.uint64))


def _stepped(problem: st.Problem, i: int):
    """States before edge i (node, state, digits of their path counts) to what both decisions lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, paths = b.column("node").to_numpy(), _paths(b)
            made = st.step(problem, problem.levels[i], st.decode(problem, len(problem.slots_after(i)), unpacked(b.column("state"))))
            for bit, (after, origin) in enumerate(made):
                good = np.isin(after.cc, problem.ks) if problem.ks else np.ones(len(after), bool)
                cols = [pa.array(node[origin]), pa.array(np.full(len(origin), bit, np.int32)), packed(st.encode(problem, after)), pa.array(good)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(paths[origin, j].astype(np.int64)) for j in range(st.LIMBS)]], names=["parent", "bit", "child", "accepted", *_LIMBS])

    return run


def _build_by_level(spark: SparkSession, problem: st.Problem) -> Diagram:
    first = [(0, bytearray(r.tobytes()), 1, 0, 0, 0) for r in st.encode(problem, st.start(problem))] if problem.levels else []
    now = spark.createDataFrame(first, "node long, state binary, " + ", ".join(f"{x} long" for x in _LIMBS))
    levels, arcs, offset, last = [], [], len(first), len(problem.levels) - 1
    for i in range(len(problem.levels)):
        made = materialise(now.mapInArrow(_stepped(problem, i), _STEPPED))
        bits = now.select(F.col("node").alias("parent"), F.explode(F.array(F.lit(0), F.lit(1))).alias("bit"))
        if i < last:
            merged = made.groupBy(F.col("child").alias("state")).agg(*[F.sum(x).alias(x) for x in _LIMBS])
            ahead = materialise(numbered(merged, "n").withColumn("node", F.col("n") + offset).select("node", "state", *_LIMBS))
            found = made.select("parent", "bit", F.col("child").alias("state")).join(ahead.select("state", F.col("node").alias("child")), "state").drop("state")
        else:
            ahead, found = None, made.where("accepted").select("parent", "bit", F.lit(ACCEPT).cast("long").alias("child"))
        arcs.append(materialise(bits.join(found, ["parent", "bit"], "left").select("parent", "bit", F.coalesce("child", F.lit(REJECT)).alias("child"), F.lit(i + 1).alias("level"))))
        levels.append(now)
        if ahead is not None:
            offset, now = offset + ahead.count(), ahead
    empty = spark.createDataFrame([], "parent long, bit int, child long, level int")
    all_arcs = empty
    for a in arcs:
        all_arcs = all_arcs.unionByName(a)
    below = spark.createDataFrame([(ACCEPT,)], "child long").withColumn("paths", F.lit(1).cast("decimal(38,0)"))
    nodes = spark.createDataFrame([], _NODE)
    for i in range(last, -1, -1):
        joined = arcs[i].join(below, "child", "left").groupBy("parent")
        one = lambda bit, c: F.max(F.when(F.col("bit") == bit, F.col(c)))
        own = joined.agg(F.coalesce(F.sum("paths"), F.lit(0)).cast("decimal(38,0)").alias("suffix"), one(0, "child").alias("child0"), one(1, "child").alias("child1"))
        own = materialise(own)
        below = own.select(F.col("parent").alias("child"), F.col("suffix").alias("paths"))
        whole = levels[i].join(own.withColumn("suffix", F.col("suffix").cast("string")), levels[i].node == own.parent).drop("parent")
        nodes = nodes.unionByName(whole.mapInArrow(_detailed(problem, i), _NODE))
    exact = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("prefix", "suffix")]
    nodes = materialise(nodes.select("node", "level", "src", "dst", "cc", "open", "labels", "weights", "pairs", *exact))
    return Diagram(nodes, all_arcs.select("parent", "bit", "child"), problem)


def _detailed(problem: st.Problem, i: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                states = st.decode(problem, len(problem.slots_after(i)), unpacked(b.column("state")))
                children = np.stack([b.column(c).to_numpy() for c in ("child0", "child1")], axis=1)
                yield from _described(problem, i, b.column("node").to_pylist(), states, st.to_ints(_paths(b)), [int(x) for x in b.column("suffix").to_pylist()], children)

    return run


def plans_of_ranks(made: Diagram, ranks: DataFrame) -> DataFrame:
    """(plan_id, rank, edges, districts) of ranks(plan_id, rank decimal) in a diagram's tables: a join a level over all ranks.

    Plans are ranked depth first with bit 0 before bit 1, in the diagram's own numbering of plans.
    """
    suffix = made.nodes.select(F.col("node").alias("child"), F.col("suffix").alias("inner"))
    left = made.arcs.where("bit = 0").join(suffix, "child", "left")
    zero = left.select(F.col("parent").alias("node"), F.col("child").alias("child0"), F.when(F.col("child") == ACCEPT, F.lit(1)).otherwise(F.coalesce("inner", F.lit(0))).cast("decimal(38,0)").alias("below"))
    table = materialise(zero.join(made.arcs.where("bit = 1").select(F.col("parent").alias("node"), F.col("child").alias("child1")), "node"))
    now = ranks.select("plan_id", F.col("rank").cast("string").alias("rank"), F.col("rank").cast("decimal(38,0)").alias("left"), F.lit(0).cast("long").alias("node"), F.expr("cast(array() as array<int>)").alias("edges"))
    for i in range(len(made.problem.levels)):
        keep = F.col("left") >= F.col("below")
        step = now.join(table, "node")
        now = step.select(
            "plan_id", "rank", F.when(keep, F.col("left") - F.col("below")).otherwise(F.col("left")).cast("decimal(38,0)").alias("left"), F.when(keep, F.col("child1")).otherwise(F.col("child0")).alias("node"),
            F.when(keep, F.array_append("edges", F.lit(i + 1))).otherwise(F.col("edges")).alias("edges"),
        )
        if i % 8 == 7:
            now = materialise(now)
    return now.select("plan_id", "rank", "edges").mapInArrow(_divided(made.problem), _PLAN)


def _divided(problem: st.Problem):
    """Plans with their kept edges, to the districts that these make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vertices = sorted(problem.weights)
        place = {v: i for i, v in enumerate(vertices)}
        for b in batches:
            districts = []
            for edges in b.column("edges").to_pylist():
                label = np.arange(len(vertices))
                for e in edges:
                    x, y = label[place[problem.levels[e - 1].src]], label[place[problem.levels[e - 1].dst]]
                    label[label == max(x, y)] = min(x, y)
                districts.append(np.unique(label, return_inverse=True)[1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(districts, pa.list_(pa.int32()))], names=["plan_id", "rank", "edges", "districts"])

    return run


def size(diagram: Diagram) -> DataFrame:
    """One row: the number of nodes with both terminals."""
    return diagram.nodes.agg((F.count("*") + 2).alias("nodes"))


def level_sizes(diagram: Diagram) -> DataFrame:
    return diagram.nodes.groupBy("level").agg(F.count("*").alias("nodes"))


def count_backward(diagram: Diagram) -> DataFrame:
    """(node, paths): plans below each node, a join and a sum per level from the last one up."""
    arcs = diagram.arcs.join(diagram.nodes.select(F.col("node").alias("parent"), "level"), "parent")
    one = F.lit(1).cast("decimal(38,0)")
    known = arcs.sparkSession.createDataFrame([(ACCEPT,)], "node long").withColumn("paths", one)
    out = None
    for level in range(len(diagram.problem.levels), 0, -1):
        own = arcs.where(F.col("level") == level).join(known.withColumnRenamed("node", "child"), "child", "left")
        now = materialise(own.groupBy(F.col("parent").alias("node")).agg(F.coalesce(F.sum("paths"), F.lit(0)).cast("decimal(38,0)").alias("paths")))
        known = now.unionByName(known.where(F.col("node") == ACCEPT))
        out = now if out is None else out.unionByName(now)
    return out


def keep_probabilities(diagram: Diagram) -> DataFrame:
    """(node, level, probability): the share of plans below a node that keep its edge; nodes without plans are left out."""
    below = diagram.nodes.select(F.col("node").alias("child"), F.col("suffix").alias("inner"))
    kept = diagram.arcs.where("bit = 1").join(below, "child", "left")
    kept = kept.select(F.col("parent").alias("node"), F.when(F.col("child") == ACCEPT, 1).otherwise(F.coalesce("inner", F.lit(0))).cast("decimal(38,0)").alias("paths"))
    return diagram.nodes.where("suffix > 0").join(kept, "node").select("node", "level", keep_probability(F.col("paths"), F.col("suffix")).alias("probability"))


def summary(diagram: Diagram) -> DataFrame:
    """(node, text): one readable line for each node."""
    n = diagram.nodes
    labels = F.concat_ws(" ", F.zip_with("open", "labels", lambda v, c: F.format_string("%d:%d", v, c)))
    text = F.format_string("e_%d %s cc=%d [%s] {%s} paths=%s", "level", readable_edge(n.src, n.dst), "cc", labels, readable_pairs(n.pairs), readable_count(n.suffix))
    return n.select("node", text.alias("text"))


def follow(diagram: Diagram, bits: list[int]) -> DataFrame:
    """(node): where a sequence of decisions leads from the root; a terminal ends the walk early. A step is a look-up."""
    node = 0 if not diagram.nodes.isEmpty() else REJECT
    for bit in bits:
        if node < 0:
            break
        node = diagram.arcs.where((F.col("parent") == node) & (F.col("bit") == bit)).select("child").first().child
    return diagram.nodes.sparkSession.createDataFrame([(node,)], "node long")


def layout(diagram: Diagram, width: float = 100.0) -> DataFrame:
    """(node, level, x, y, label): each level's nodes evenly spread, terminals at a third and two thirds below."""
    by_level = Window.partitionBy("level")
    place = F.row_number().over(by_level.orderBy("node"))
    inner = diagram.nodes.select("node", "level", (place * F.lit(width) / (F.count("*").over(by_level) + 1)).alias("x"), F.col("level").cast("double").alias("y"), F.format_string("e_%d", "level").alias("label"))
    last = len(diagram.problem.levels) + 1
    ends = diagram.nodes.sparkSession.createDataFrame([(REJECT, last, width / 3, float(last), "0"), (ACCEPT, last, 2 * width / 3, float(last), "1")], "node long, level int, x double, y double, label string")
    return inner.unionByName(ends)


def coloured_arcs(diagram: Diagram) -> DataFrame:
    return diagram.arcs.withColumn("color", F.when(F.col("bit") == 0, "red").otherwise("green")).withColumn("style", F.when(F.col("bit") == 0, "dashed").otherwise("solid"))


def unrank(problem: st.Problem, ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Kept edges (ranks x edges) and district of each vertex (in id order) of the plans of given ranks.

    Plans are ranked depth first with bit 0 before bit 1.
    """
    t = _tables(problem)
    big = sum(int(d) << (32 * j) for j, d in enumerate(t.suffix[0][0])) >= 1 << 62 if len(t.suffix) and len(t.suffix[0]) else False
    value = (lambda x: np.array(st.to_ints(x), object)) if big else (lambda x: (x[:, 0] | (x[:, 1] << np.uint64(32))).astype(np.int64))
    left, node = np.array(ranks, object if big else np.int64), np.zeros(len(ranks), np.int64)
    vertices = sorted(problem.weights)
    place = {v: i for i, v in enumerate(vertices)}
    label = np.tile(np.arange(len(vertices)), (len(ranks), 1))
    kept = np.zeros((len(ranks), len(problem.levels)), bool)
    for i, level in enumerate(problem.levels):
        child = t.children[i][node - t.offsets[i]]
        below = np.zeros(len(ranks), left.dtype)
        below[child[:, 0] == ACCEPT] = 1
        inner = np.flatnonzero(child[:, 0] >= 0)
        if i + 1 < len(t.suffix) and len(inner):
            below[inner] = value(t.suffix[i + 1][child[inner, 0] - t.offsets[i + 1]])
        one = left >= below
        left = np.where(one, left - below, left)
        node = child[np.arange(len(ranks)), one.astype(int)]
        kept[:, i] = one
        a, b = label[:, place[level.src]], label[:, place[level.dst]]
        lo, hi = np.minimum(a, b)[:, None], np.maximum(a, b)[:, None]
        label = np.where(one[:, None] & (label == hi), lo, label)
    return kept, label


def _plans(problem: st.Problem, total: int | None, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 20_000):
                ids = b.column("id").to_pylist()[s : s + 20_000]
                ranks = ids if total is None else [random.Random(f"{seed}:{i}").randrange(total) for i in ids]
                kept, label = unrank(problem, ranks)
                edges = [np.flatnonzero(k).astype(np.int32) + 1 for k in kept]
                district = [np.unique(x, return_inverse=True)[1].astype(np.int32) for x in label]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([str(r) for r in ranks]), pa.array(edges, pa.list_(pa.int32())), pa.array(district, pa.list_(pa.int32()))], names=["plan_id", "rank", "edges", "districts"])

    return run


def total_plans(spark: SparkSession, problem: st.Problem) -> int:
    return int(count_problem(spark, problem).agg(F.sum("plans")).first()[0] or 0)


_PLAN = "plan_id long, rank string, edges array<int>, districts array<int>"


def enumerate_plans(spark: SparkSession, graph: Graph, ks: tuple[int, ...] | None, d: float | None = None, order: list[tuple[int, int]] | None = None, distributed: bool = False) -> DataFrame:
    """Every plan: plan_id = rank from 0, ``edges`` the positions (from 1) of its kept edges, ``districts`` by vertex.

    Each plan is found from its rank alone, so any number of tasks list them without talking to one another.
    """
    problem = make_problem(graph, ks, d, order)
    n = total_plans(spark, problem)
    if not problem.levels:
        raise ValueError("a graph without edges has one plan at most; see count_by_districts")
    if distributed:
        return plans_of_ranks(_build_by_level(spark, problem), spark.range(n).select(F.col("id").alias("plan_id"), F.col("id").alias("rank")))
    return spark.range(n).mapInArrow(_plans(problem, None, 0), _PLAN)


def sample_plans(spark: SparkSession, graph: Graph, draws: int, ks: tuple[int, ...] | None, d: float | None = None, order: list[tuple[int, int]] | None = None, seed: int = 0, distributed: bool = False) -> DataFrame:
    """Uniform independent plans: draw i is the plan of a random rank, the same in every run with one seed (but for the
    numbering of a distributed diagram)."""
    problem = make_problem(graph, ks, d, order)
    n = total_plans(spark, problem)
    ids = spark.range(draws if n else 0)
    if distributed:
        return plans_of_ranks(_build_by_level(spark, problem), ids.mapInArrow(_random_ranks(n, seed), "plan_id long, rank string"))
    return ids.mapInArrow(_plans(problem, n, seed), _PLAN)


def _random_ranks(total: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([str(random.Random(f"{seed}:{i}").randrange(total)) for i in ids], pa.string())], names=["plan_id", "rank"])

    return run


def assignment(plans: DataFrame, graph: Graph) -> DataFrame:
    """(plan_id, v, district) of plans: districts are listed by vertex in ascending id order."""
    place = graph.vertices.select("v").distinct().orderBy("v").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # one bounded row
    long = plans.select("plan_id", F.posexplode("districts").alias("i", "district")).join(F.broadcast(place), F.lit(True))
    return long.select("plan_id", F.element_at("vs", F.col("i") + 1).alias("v"), "district")
