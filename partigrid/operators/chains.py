"""Markov chains over plans by reversible recombination: many independent chains, each a sequence by nature.

What a chain may do is pluggable: ``constraints`` (a proposal that breaks one is rejected), ``accept`` (whether to go to a
valid proposal; by default always) and ``updaters`` (figures of each step). All get a Step, plain Python, in the workers.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from partigrid.operators.frontier import small_graph
from partigrid.operators.spanning import parts, wilson
from partigrid.sources.grids import Graph

MOST_CUTS = 10


@dataclass(frozen=True)
class Step:
    """A plan in a chain: the district of each vertex, and the graph that it divides."""

    plan: dict[int, int]
    edges: list[tuple[int, int]]
    weights: dict[int, int]

    def cut_edges(self) -> list[tuple[int, int]]:
        return [(a, b) for a, b in self.edges if self.plan[a] != self.plan[b]]

    def populations(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for v, d in self.plan.items():
            out[d] = out.get(d, 0) + self.weights[v]
        return out

    def connected(self) -> bool:
        inner = [(a, b) for a, b in self.edges if self.plan[a] == self.plan[b]]
        return parts(sorted(self.plan), inner) == len(set(self.plan.values()))


def within_share(share: float) -> Callable[[Step], bool]:
    """Constraint: every district within ``share`` of the mean population."""

    def check(step: Step) -> bool:
        held = step.populations().values()
        ideal = sum(held) / len(held)
        return all(abs(p - ideal) <= share * ideal for p in held)

    return check


def at_most_cut(edges: int) -> Callable[[Step], bool]:
    """Constraint: at most so many cut edges."""
    return lambda step: len(step.cut_edges()) <= edges


def always(_now: Step, _next: Step, _rng: random.Random) -> bool:
    return True


def _recombine(edges: list[tuple[int, int]], weights: dict[int, int], plan: dict[int, int], low: float, high: float, rng: random.Random) -> dict[int, int]:
    """One proposal: two neighbouring districts are joined, a uniform spanning tree is drawn in them, and one of its balanced
    cuts is taken with probability (balanced cuts / MOST_CUTS); otherwise the plan stays."""
    crossing = [(a, b) for a, b in edges if plan[a] != plan[b]]
    if not crossing:
        return plan
    pairs = sorted({tuple(sorted((plan[a], plan[b]))) for a, b in crossing})
    p, q = pairs[rng.randrange(len(pairs))]
    inside = [v for v in weights if plan[v] in (p, q)]
    own = [(a, b) for a, b in edges if plan[a] in (p, q) and plan[b] in (p, q)]
    adj: dict[int, list[tuple[int, int]]] = {v: [] for v in inside}
    for i, (a, b) in enumerate(own):
        adj[a].append((b, i))
        adj[b].append((a, i))
    drawn = set(wilson(adj, rng))
    tree: dict[int, list[int]] = {v: [] for v in inside}
    for i, (a, b) in enumerate(own):
        if i in drawn:
            tree[a].append(b)
            tree[b].append(a)
    order, parent = [inside[0]], {inside[0]: None}
    for v in order:
        for w in tree[v]:
            if w not in parent:
                parent[w] = v
                order.append(w)
    below = dict(weights)
    for v in reversed(order[1:]):
        below[parent[v]] += below[v]
    total = sum(weights[v] for v in inside)
    cuts = [v for v in order[1:] if low <= below[v] <= high and low <= total - below[v] <= high]
    pick = rng.randrange(max(MOST_CUTS, len(cuts)))
    if pick >= len(cuts):
        return plan
    side = {cuts[pick]}
    for v in order:
        if parent[v] in side:
            side.add(v)
    return {v: (p if v in side else q) if d in (p, q) else d for v, d in plan.items()}


def _chain(edges: list[tuple[int, int]], weights: dict[int, int], start: dict[int, int], steps: int, share: float, seed: int, constraints: tuple, accept: Callable, updaters: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ideal = sum(weights.values()) / len(set(start.values()))
        vertices = sorted(weights)
        for b in batches:
            for chain in b.column("id").to_pylist():
                rng, now, rows = random.Random(f"{seed}:{chain}"), Step(dict(start), edges, weights), []
                for step in range(steps):
                    if step:
                        ahead = Step(_recombine(edges, weights, now.plan, ideal * (1 - share), ideal * (1 + share), rng), edges, weights)
                        if all(c(ahead) for c in constraints) and accept(now, ahead, rng):
                            now = ahead
                    figures = [(k, float(f(now))) for k, f in updaters.items()]
                    rows.append((chain, step, len(now.cut_edges()), [now.plan[v] for v in vertices], figures))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chain", "step", "cut_edges", "districts", "figures"])

    return run


def run_chains(
    spark: SparkSession, graph: Graph, assignment: DataFrame, chains: int, steps: int = 1000, share: float = 0.02, seed: int = 0,
    constraints: tuple[Callable[[Step], bool], ...] = (), accept: Callable[[Step, Step, random.Random], bool] = always, updaters: dict[str, Callable[[Step], float]] | None = None,
) -> DataFrame:
    """(chain, step, cut_edges, districts by vertex, figures): ``chains`` chains from one plan, in population bounds.

    The plan must assign every vertex, each of its districts must be connected, and it must keep the constraints.
    """
    edges, weights = small_graph(graph)
    start = {r.v: r.district for r in assignment.select("v", "district").collect()}  # one plan of a bounded graph
    first = Step(start, edges, weights)
    if set(start) != set(weights):
        raise ValueError("the plan does not assign the graph's vertices")
    if not first.connected():
        raise ValueError("a district of the first plan is not connected")
    if not all(c(first) for c in constraints):
        raise ValueError("the first plan breaks a constraint")
    tasks = max(1, min(chains, spark.sparkContext.defaultParallelism))
    made = _chain(edges, weights, start, steps, share, seed, constraints, accept, updaters or {})
    return spark.range(0, chains, 1, tasks).mapInArrow(made, "chain long, step int, cut_edges int, districts array<int>, figures map<string,double>")
