"""Edge orderings of grids, and the frontiers that they lead to.

An ordering is planned at the driver, where the graph is a short list of edges; what follows from it is a DataFrame.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.functions.columns import endpoints

Point = tuple[int, int]
PointEdge = tuple[Point, Point]


def _turned(order: Callable[[int, int], list[PointEdge]]) -> Callable[[int, int], list[PointEdge]]:
    """The ordering for X >= Y, also used with x and y swapped where Y is larger."""

    def both(x_max: int, y_max: int) -> list[PointEdge]:
        if x_max >= y_max:
            return order(x_max, y_max)
        return [((a[1], a[0]), (b[1], b[0])) for a, b in order(y_max, x_max)]

    return both


@_turned
def diagonal(x_max: int, y_max: int) -> list[PointEdge]:
    """Sweeps along falling diagonals, from the corner (0, 0) to the opposite one."""
    out: list[PointEdge] = []
    for s in range(1, x_max + y_max + 1):
        x0 = max(0, s - y_max)
        if x0:
            out.append(((x0 - 1, y_max), (x0, y_max)))
        for x in range(x0, min(s, x_max) + 1):
            y = s - x
            if y > 0:
                out.append(((x, y), (x, y - 1)))
                if x < x_max:
                    out.append(((x, y - 1), (x + 1, y - 1)))
    return out


@_turned
def lines(x_max: int, y_max: int) -> list[PointEdge]:
    """Column by column: its vertical edges, then the edges to the next column."""
    out: list[PointEdge] = []
    for x in range(x_max + 1):
        out += [((x, y), (x, y + 1)) for y in range(y_max)]
        out += [((x, y), (x + 1, y)) for y in range(y_max + 1) if x < x_max]
    return out


def _boxes(x: int, y_max: int) -> list[PointEdge]:
    out = [((x, 0), (x + 1, 0))]
    for y in range(y_max):
        out += [((x, y + 1), (x + 1, y + 1)), ((x + 1, y), (x + 1, y + 1))]
    return out


@_turned
def boxes_after_side(x_max: int, y_max: int) -> list[PointEdge]:
    """The first column's vertical edges, then box after box."""
    return [((0, y), (0, y + 1)) for y in range(y_max)] + [e for x in range(x_max) for e in _boxes(x, y_max)]


@_turned
def boxes_from_corner(x_max: int, y_max: int) -> list[PointEdge]:
    """Box after box, the first column of boxes with its left sides as they come."""
    if not x_max:
        return [((0, y), (0, y + 1)) for y in range(y_max)]
    out = [((0, 0), (1, 0))]
    for y in range(y_max):
        out += [((0, y), (0, y + 1)), ((0, y + 1), (1, y + 1)), ((1, y), (1, y + 1))]
    return out + [e for x in range(1, x_max) for e in _boxes(x, y_max)]


@_turned
def queen_cells(x_max: int, y_max: int) -> list[PointEdge]:
    """Cell after cell of a queen grid, with both of its diagonals."""
    if not x_max:
        return [((0, y), (0, y + 1)) for y in range(y_max)]
    out: list[PointEdge] = []
    for x in range(x_max):
        for y in range(y_max):
            if x == 0:
                out.append(((0, y), (0, y + 1)))
            out += [((x, y), (x + 1, y)), ((x + 1, y), (x, y + 1)), ((x, y), (x + 1, y + 1)), ((x + 1, y), (x + 1, y + 1))]
        out.append(((x, y_max), (x + 1, y_max)))
    return out


def native(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted((min(e), max(e)) for e in edges)


ROOK_ORDERS = {"diagonal": diagonal, "lines": lines, "boxes_after_side": boxes_after_side, "boxes_from_corner": boxes_from_corner}


def grid_order(kind: str, rows: int, cols: int) -> list[tuple[int, int]]:
    """Edges (src < dst) of a grid in one of the orders, by vertex id x * cols + y."""
    points = queen_cells(rows - 1, cols - 1) if kind == "queen" else ROOK_ORDERS[kind](rows - 1, cols - 1)
    ids = [(a[0] * cols + a[1], b[0] * cols + b[1]) for a, b in points]
    return [(min(e), max(e)) for e in ids]


def _vertex_cut(adj: dict[int, set[int]], s: int, t: int) -> set[int]:
    """A smallest set of vertices that parts s from t (not adjacent), by augmenting paths: a vertex is an arc of capacity one
    from its entry (v, 0) to its exit (v, 1), an edge has no limit."""
    arcs: dict[tuple, set[tuple]] = {}
    for v in adj:
        arcs.setdefault((v, 0), set()).add((v, 1))
        arcs.setdefault((v, 1), set()).update((w, 0) for w in adj[v])

    def reached() -> dict[tuple, tuple | None]:
        back: dict[tuple, tuple | None] = {(s, 1): None}
        todo = deque(back)
        while todo:
            a = todo.popleft()
            for b in sorted(arcs.get(a, ())):
                if b not in back and b[0] != s:
                    back[b] = a
                    todo.append(b)
        return back

    while (t, 0) in (back := reached()):
        b = (t, 0)
        while (a := back[b]) is not None:
            if not (a[1] == 1 and b[1] == 0 and a[0] != b[0]):  # all but an edge's own direction are used up
                arcs[a].discard(b)
            arcs.setdefault(b, set()).add(a)
            b = a
    return {v for v in adj if (v, 0) in back and (v, 1) not in back}


def _distances(adj: dict[int, set[int]], s: int) -> dict[int, int]:
    out, todo = {s: 0}, deque([s])
    while todo:
        v = todo.popleft()
        for w in adj[v] - out.keys():
            out[w] = out[v] + 1
            todo.append(w)
    return out


def min_cut_order(edges: list[tuple[int, int]], seed: int = 0) -> list[tuple[int, int]]:
    """Recursive halving: between two vertices that lie farthest apart a smallest vertex cut is put in the middle.

    The cut, as one vertex, is the end of the first half and the start of the second. Edges among the cut's vertices come
    between the halves, so few vertices are open at a time. Parts that are not connected come one after another.
    """
    rng = random.Random(seed)
    fresh = iter(range(-1, -(1 << 60), -1))  # names of contracted cuts

    def neighbours(part: list[tuple]) -> dict[int, set[int]]:
        adj: dict[int, set[int]] = {}
        for _, a, b in part:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
        return adj

    def halves(part: list[tuple], s: int, t: int) -> tuple[list[tuple], list[tuple], list[tuple], int]:
        """The side of s up to the cut, what lies between cut vertices or s and t, the rest, and the cut's new name."""
        apart = [e for e in part if {e[1], e[2]} != {s, t}]
        adj = neighbours(apart)
        for v in (s, t):
            adj.setdefault(v, set())
        cut = _vertex_cut(adj, s, t)
        near, todo = {s}, deque([s])
        while todo:
            for w in adj[todo.popleft()] - near - cut:
                near.add(w)
                todo.append(w)
        name = next(fresh)
        ends = lambda e: (e[0], *(name if v in cut else v for v in e[1:]))
        first = [ends(e) for e in apart if e[1] in near or e[2] in near]
        inside = [e for e in part if {e[1], e[2]} == {s, t} or e[1] in cut and e[2] in cut]
        rest = [ends(e) for e in apart if not (e[1] in near or e[2] in near) and not (e[1] in cut and e[2] in cut)]
        return first, inside, rest, name

    out: list[tuple[int, int]] = []
    work: list[tuple] = []  # parts still to be ordered, the next one last: (edges, ends or None)
    adj = neighbours([(e, *e) for e in edges])
    seen: set[int] = set()
    for v in sorted(adj):
        if v not in seen:
            own = _distances(adj, v).keys()
            seen |= own
            part = [(e, *e) for e in native(edges) if e[0] in own]
            far = {(a, b): d for a in sorted(own) for b, d in _distances(adj, a).items()}
            longest = max(far.values())
            work.insert(0, (part, rng.choice([p for p, d in far.items() if d == longest])))
    while work:
        part, ends = work.pop()
        adj = neighbours(part)
        if ends is None or len(adj) <= 2:
            out += sorted(e for e, _, _ in part)
            continue
        s, t = ends
        if s not in adj:
            s = max(_distances(adj, t).items(), key=lambda x: (x[1], -x[0]))[0] if t in adj else min(adj)
        if t not in adj or s == t:
            t = max(_distances(adj, s).items(), key=lambda x: (x[1], -x[0]))[0]
        first, inside, rest, cut = halves(part, s, t)
        work += [(rest, (cut, t)), (inside, None), (first, (s, cut))]
    return out


def edge_order(spark: SparkSession, order: list[tuple[int, int]]) -> DataFrame:
    """(pos, src, dst), positions from 1."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(order, 1)], "pos int, src int, dst int")


def same_edges(order: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: whether an ordering holds each edge of the graph once and nothing else."""
    a, b = order.select("src", "dst"), edges.select("src", "dst")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    both = one(a.join(b, ["src", "dst"], "left_anti"), "extra").join(one(b.join(a, ["src", "dst"], "left_anti"), "missing"), F.lit(True)).join(one(a.groupBy("src", "dst").count().where("count > 1"), "twice"), F.lit(True))
    return both.select(((F.col("extra") + F.col("missing") + F.col("twice")) == 0).alias("same"))


def frontiers(order: DataFrame) -> DataFrame:
    """(pos, v): v is open before position pos, that is it has edges before pos and at or behind it."""
    ends = endpoints(order).groupBy("v").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return ends.where("last > first").select(F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("pos"), "v")


def frontier_stats(order: DataFrame) -> DataFrame:
    """(max_width, total_width) of an ordering's frontiers."""
    width = frontiers(order).groupBy("pos").agg(F.count("*").alias("width"))
    return width.agg(F.max("width").alias("max_width"), F.sum("width").alias("total_width"))


def frontier_widths(order: DataFrame) -> DataFrame:
    """(width, levels): how many positions have a frontier of each width."""
    width = order.select("pos").join(frontiers(order).groupBy("pos").agg(F.count("*").alias("w")), "pos", "left").select(F.coalesce("w", F.lit(0)).alias("width"))
    return width.groupBy("width").agg(F.count("*").alias("levels"))


def farthest_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, length): vertex pairs of largest distance. A base graph goes to all tasks, each searches from its vertices and
    hands on those farthest from each."""
    from partigrid.operators.frontier import MAX_EDGES

    spark = edges.sparkSession
    rows = edges.select("src", "dst").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"a base graph of more than {MAX_EDGES} edges")
    adj: dict[int, set[int]] = {}
    for a, b in rows:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    vertices = sorted(adj)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for i in batch.column("id").to_pylist():
                far = _distances(adj, vertices[i])
                longest = max(far.values())
                out += [(vertices[i], v, longest) for v, d in far.items() if d == longest]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], names=["a", "b", "length"])

    found = spark.range(len(vertices)).mapInArrow(run, "a int, b int, length int")
    top = found.agg(F.max("length").alias("top"))
    return found.join(F.broadcast(top), F.col("length") == F.col("top")).select("a", "b", "length")  # one row, broadcast
