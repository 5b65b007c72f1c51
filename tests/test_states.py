"""The state computation against brute force over set partitions, without Spark."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from partigrid.operators import diagram
from partigrid.operators import states as st
from partigrid.plans import orders

MERGED = {("rook", 2, 0): 9, ("rook", 3, 0): 79, ("rook", 4, 0): 1120, ("queen", 2, 0): 18, ("queen", 3, 0): 336, ("rook", 2, None): 12, ("rook", 3, None): 175, ("rook", 4, None): 2175, ("queen", 2, None): 29, ("queen", 3, None): 544}


def connected(block, edges):
    block = set(block)
    seen, todo = set(), [min(block)]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [b if a == v else a for a, b in edges if v in (a, b) and a in block and b in block]
    return seen == block


def set_partitions(items):
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for n in range(len(rest) + 1):
        for mates in itertools.combinations(rest, n):
            left = [x for x in rest if x not in mates]
            for others in set_partitions(left):
                yield [(first, *mates), *others]


def brute(weights, edges, k, lower=None, upper=None):
    n = 0
    for blocks in set_partitions(sorted(weights)):
        sums = [sum(weights[v] for v in b) for b in blocks]
        if len(blocks) == k and all((lower is None or s >= lower) and (upper is None or s <= upper) for s in sums) and all(connected(b, edges) for b in blocks):
            n += 1
    return n


def count(problem):
    t = diagram.build(problem)
    return st.to_ints(t.suffix[0])[0] if t.suffix and len(t.suffix[0]) else 0


@pytest.mark.parametrize(("kind", "n", "d"), MERGED)
def test_states_merge_as_published(kind, n, d):
    order = orders.grid_order("queen" if kind == "queen" else "diagonal", n, n)
    lower, upper = (n, n) if d == 0 else (None, None)
    assert diagram.build(st.make_problem(order, dict.fromkeys(range(n * n), 1), lower, upper, (n,))).offsets[-1] + 2 == MERGED[kind, n, d]


@settings(max_examples=40, deadline=None)
@given(hs.data())
def test_random_weighted_graphs(data):
    n = data.draw(hs.integers(2, 6))
    pairs = list(itertools.combinations(range(n), 2))
    edges = data.draw(hs.lists(hs.sampled_from(pairs), min_size=1, unique=True))
    weights = {v: data.draw(hs.integers(0, 4)) for v in range(n)}
    k = data.draw(hs.integers(1, n))
    lower, upper = data.draw(hs.sampled_from([(None, None), (1, 5), (0, 3), (2, 9)]))
    order = data.draw(hs.permutations(edges))
    assert count(st.make_problem(list(order), weights, lower, upper, (k,))) == brute(weights, edges, k, lower, upper)


def test_path_has_binomially_many_plans():
    order = [(i, i + 1) for i in range(9)]
    assert [count(st.make_problem(order, dict.fromkeys(range(10), 1), ks=(k,))) for k in (1, 2, 3)] == [1, 9, 36]


@pytest.mark.parametrize("kind", orders.ROOK_ORDERS)
@pytest.mark.parametrize("shape", [(3, 3), (2, 4), (4, 2), (1, 5)])
def test_counts_do_not_depend_on_the_order(kind, shape):
    order = orders.grid_order(kind, *shape)
    n = shape[0] * shape[1]
    native = orders.native(order)
    assert len(set(order)) == len(order)
    assert count(st.make_problem(order, dict.fromkeys(range(n), 1), ks=(3,))) == count(st.make_problem(native, dict.fromkeys(range(n), 1), ks=(3,)))


def test_distinct_is_exact():
    rows = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [0, 0, 0]], np.uint8)
    first, label = st.distinct(rows)
    assert len(first) == 3 and (rows[first][label] == rows).all()


def test_path_counts_carry_beyond_64_bits():
    paths = np.array([[0xFFFFFFFF, 0xFFFFFFFF, 0, 0]] * 3, np.uint64)
    assert st.to_ints(st.add_up(paths, np.zeros(3, np.intp), 1)) == [3 * (2**64 - 1)]


def widths(order):
    first, last = {}, {}
    for i, e in enumerate(order):
        for v in e:
            first.setdefault(v, i)
            last[v] = i
    return [sum(first[v] < i <= last[v] for v in first) for i in range(len(order))]


def test_min_cut_order_holds_every_edge_and_is_narrow():
    for shape in ((3, 3), (4, 4), (2, 5), (1, 4), (6, 6)):
        own = orders.grid_order("diagonal", *shape)
        for seed in range(3):
            made = orders.min_cut_order(own, seed)
            assert sorted(made) == sorted(own) and sum(widths(made)) <= sum(widths(orders.native(own)))
    assert orders.min_cut_order([]) == []


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from(list(itertools.combinations(range(9), 2))), unique=True), hs.integers(0, 3))
def test_min_cut_order_of_any_graph(edges, seed):
    assert sorted(orders.min_cut_order(edges, seed)) == sorted(edges)


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from(list(itertools.combinations(range(7), 2))), unique=True))
def test_vertex_cuts_are_smallest(edges):
    adj = {v: set() for v in range(7)}
    for a, b in edges:
        if (a, b) != (0, 6):
            adj[a].add(b)
            adj[b].add(a)

    def parted(cut):
        seen, todo = set(), [0]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += adj[v] - cut
        return 6 not in seen

    cut = orders._vertex_cut(adj, 0, 6)
    assert parted(cut) and not cut & {0, 6}
    assert not any(parted(set(c)) for n in range(len(cut)) for c in itertools.combinations(range(1, 6), n))
