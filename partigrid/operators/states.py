"""States of the frontier computation, many at a time.

A plan of a graph is a partition of its vertices into connected districts. Edges are decided in a fixed order, and what the
decisions so far mean for the rest is a state: the number of closed districts, for each open vertex the component it is in,
the pairs of components that must not meet again (an edge between them was left out), and, if bounds are set, the weight of
each open component. States that are equal are one, with their path counts added. Here a batch of states is a few numpy
arrays, and a step over an edge is array arithmetic on all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMBS = 4  # path counts are four 32-bit digits: sums of many fit 64 bits, products never occur


@dataclass(frozen=True)
class Level:
    """One edge: ``slots`` are the open vertices with it, ``u``, ``v`` its ends' places there, ``enter`` the places that are
    new, ``leave`` those that close behind it, ``before`` the places of the old slots."""

    src: int
    dst: int
    slots: tuple[int, ...]
    u: int
    v: int
    before: tuple[int, ...]
    enter: tuple[int, ...]
    leave: tuple[int, ...]


@dataclass(frozen=True)
class Problem:
    """Edges in order, vertex weights, bounds (None: unbounded) and the numbers of districts that are asked for."""

    levels: tuple[Level, ...]
    weights: dict[int, int]
    lower: int | None
    upper: int | None
    ks: tuple[int, ...] | None
    alone: int  # vertices without an edge: a district each
    feasible: bool  # whether those keep the bounds

    @property
    def weighted(self) -> bool:
        return self.lower is not None or self.upper is not None

    @property
    def most(self) -> int:
        return max(self.ks) if self.ks else 1 << 30

    @property
    def label(self) -> type:
        """What a place among the open vertices fits into."""
        return np.uint8 if max((len(x.slots) for x in self.levels), default=0) <= 256 else np.uint16

    def slots_after(self, level: int) -> tuple[int, ...]:
        """Open vertices behind a level (0: before the first)."""
        if level == 0:
            return ()
        x = self.levels[level - 1]
        return tuple(s for i, s in enumerate(x.slots) if i not in x.leave)


def make_problem(order: list[tuple[int, int]], weights: dict[int, int], lower: int | None = None, upper: int | None = None, ks: tuple[int, ...] | None = None) -> Problem:
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, e in enumerate(order):
        for a in e:
            first.setdefault(a, i)
            last[a] = i
    levels, open_ = [], []
    for i, (a, b) in enumerate(order):
        new = [x for x in (a, b) if first[x] == i]
        slots = sorted(open_ + new)
        levels.append(Level(a, b, tuple(slots), slots.index(a), slots.index(b), tuple(slots.index(x) for x in open_), tuple(slots.index(x) for x in new), tuple(slots.index(x) for x in (a, b) if last[x] == i)))
        open_ = [x for x in slots if last[x] != i]
    alone = [w for x, w in weights.items() if x not in first]
    ok = all((lower is None or w >= lower) and (upper is None or w <= upper) for w in alone)
    return Problem(tuple(levels), dict(weights), lower, upper, ks, len(alone), ok)


@dataclass
class Batch:
    """States behind a level: closed districts, component of each slot (the place of its largest vertex), forbidden pairs,
    component weights (at that place, else 0)."""

    cc: np.ndarray
    comp: np.ndarray
    bad: np.ndarray
    wts: np.ndarray

    def __len__(self) -> int:
        return len(self.cc)

    def take(self, at) -> Batch:
        return Batch(self.cc[at], self.comp[at], self.bad[at], self.wts[at])


def start(problem: Problem) -> Batch:
    n = int(problem.feasible)
    return Batch(np.full(n, problem.alone, np.int32), np.zeros((n, 0), problem.label), np.zeros((n, 0, 0), bool), np.zeros((n, 0), np.int64))


def _relabel(b: Batch, rows: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """In ``rows`` component ``old`` becomes ``new``: its members, weight and forbidden pairs move there."""
    comp = b.comp[rows]
    b.comp[rows] = np.where(comp == old[:, None], new[:, None], comp).astype(comp.dtype)
    b.wts[rows, new] += b.wts[rows, old]
    b.wts[rows, old] = 0
    b.bad[rows, new] |= b.bad[rows, old]
    b.bad[rows, old] = False
    b.bad[rows, :, new] |= b.bad[rows, :, old]
    b.bad[rows, :, old] = False


def _open(problem: Problem, level: Level, b: Batch) -> Batch:
    n, e = len(b), len(level.slots)
    comp, bad, wts = np.zeros((n, e), problem.label), np.zeros((n, e, e), bool), np.zeros((n, e), np.int64)
    old = np.array(level.before, np.intp)
    if len(old):
        comp[:, old] = old.astype(problem.label)[b.comp]
        bad[:, old[:, None], old[None, :]] = b.bad
        wts[:, old] = b.wts
    for s in level.enter:
        comp[:, s] = s
        wts[:, s] = problem.weights[level.slots[s]] if problem.weighted else 0
    return Batch(b.cc, comp, bad, wts)


def _close(problem: Problem, level: Level, b: Batch, at: np.ndarray) -> tuple[Batch, np.ndarray]:
    """Vertices that no later edge touches go; a component without another open vertex becomes a district."""
    gone = np.zeros(len(level.slots), bool)
    for a in level.leave:
        gone[a] = True
        rows = np.arange(len(b))
        label = b.comp[:, a].astype(np.intp)
        others = (b.comp == label[:, None]) & ~gone
        last = ~others.any(axis=1)
        weight = b.wts[rows, label]
        fits = np.ones(len(b), bool)
        if problem.lower is not None:
            fits &= weight >= problem.lower
        if problem.upper is not None:
            fits &= weight <= problem.upper
        cc = b.cc + last
        keep = ~last | (fits & (cc <= problem.most))
        b = Batch(cc, b.comp, b.bad, b.wts).take(keep)
        at, label, others, last = at[keep], label[keep], others[keep], last[keep]
        done = np.flatnonzero(last)
        b.wts[done, label[done]] = 0
        b.bad[done, label[done]] = False
        b.bad[done, :, label[done]] = False
        moved = np.flatnonzero(~last & (label == a))
        if len(moved):
            new = others.shape[1] - 1 - others[moved, ::-1].argmax(axis=1)
            _relabel(b, moved, label[moved], new)
    stay = np.flatnonzero(~gone)
    place = np.full(len(level.slots), 0, problem.label)
    place[stay] = np.arange(len(stay))
    flat = np.ascontiguousarray
    return Batch(b.cc, flat(place[b.comp[:, stay]]), flat(b.bad[:, stay[:, None], stay[None, :]]), flat(b.wts[:, stay])), at


def step(problem: Problem, level: Level, b: Batch) -> list[tuple[Batch, np.ndarray]]:
    """For bit 0 (the edge is left out) and bit 1 (kept): the states that follow, and which state each comes from."""
    b = _open(problem, level, b)
    rows = np.arange(len(b))
    cu, cv = b.comp[:, level.u].astype(np.intp), b.comp[:, level.v].astype(np.intp)
    apart = cu != cv
    out = []
    zero_at = rows[apart]
    zero = b.take(zero_at)
    i, p, q = np.arange(len(zero)), cu[apart], cv[apart]
    zero.bad[i, p, q] = True
    zero.bad[i, q, p] = True
    out.append(_close(problem, level, zero, zero_at))
    lo, hi = np.minimum(cu, cv), np.maximum(cu, cv)
    ok = ~(apart & b.bad[rows, lo, hi])
    if problem.upper is not None:
        ok &= np.where(apart, b.wts[rows, lo] + b.wts[rows, hi], b.wts[rows, hi]) <= problem.upper
    one_at = rows[ok]
    one = b.take(one_at)
    join = np.flatnonzero(apart[ok])
    if len(join):
        _relabel(one, join, lo[ok][join], hi[ok][join])
    out.append(_close(problem, level, one, one_at))
    return out


def encode(problem: Problem, b: Batch) -> np.ndarray:
    """Each state as a row of bytes; equal states have equal rows."""
    f = b.comp.shape[1]
    up = np.triu_indices(f, 1)
    comp = np.ascontiguousarray(b.comp).view(np.uint8).reshape(len(b), f * b.comp.itemsize)
    parts = [b.cc.astype("<u4").view(np.uint8).reshape(len(b), 4), comp, np.packbits(b.bad[:, up[0], up[1]], axis=1)]
    if problem.weighted:
        parts.append(b.wts.astype("<i8").view(np.uint8).reshape(len(b), 8 * f))
    return np.ascontiguousarray(np.concatenate(parts, axis=1))


def decode(problem: Problem, f: int, rows: np.ndarray) -> Batch:
    n, pairs = len(rows), f * (f - 1) // 2
    up = np.triu_indices(f, 1)
    packed, kind = -(-pairs // 8), np.dtype(problem.label)
    cc = np.ascontiguousarray(rows[:, :4]).view("<u4").ravel().astype(np.int32)
    at = 4 + f * kind.itemsize
    comp = np.ascontiguousarray(rows[:, 4:at]).view(kind).reshape(n, f).copy()
    bad = np.zeros((n, f, f), bool)
    if pairs:
        bits = np.unpackbits(rows[:, at : at + packed], axis=1, count=pairs).astype(bool)
        bad[:, up[0], up[1]] = bits
        bad[:, up[1], up[0]] = bits
    wts = np.ascontiguousarray(rows[:, at + packed :]).view("<i8").reshape(n, f).copy() if problem.weighted and f else np.zeros((n, f), np.int64)
    return Batch(cc, comp, bad, wts)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each distinct row, and for every row the number of its class; exact, whatever the hashes."""
    n, width = rows.shape
    if n <= 1:
        return np.arange(n), np.zeros(n, np.intp)
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words.shape[1]):
            h = (h ^ words[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s = words[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1)))
    if new[1:].sum() != (h[order][1:] != h[order][:-1]).sum():  # two states with one hash may alternate
        order = np.lexsort(words.T[::-1])
        s = words[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1)))
    label = np.empty(n, np.intp)
    label[order] = np.cumsum(new) - 1
    return order[new], label


def add_up(paths: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """Path counts (rows, LIMBS) summed by label, digits carried."""
    out = np.zeros((n, LIMBS), np.uint64)
    order = np.argsort(label, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(label[order])) + 1)) if len(label) else np.empty(0, np.intp)
    if len(edges):
        out[label[order][edges]] = np.add.reduceat(paths[order], edges, axis=0)
    return carry(out)


def carry(paths: np.ndarray) -> np.ndarray:
    low = np.uint64(0xFFFFFFFF)
    for j in range(LIMBS - 1):
        paths[:, j + 1] += paths[:, j] >> np.uint64(32)
        paths[:, j] &= low
    if len(paths) and int(paths[:, -1].max()) >> 32:
        raise OverflowError("a path count is beyond 128 bits")
    return paths


def to_ints(paths: np.ndarray) -> list[int]:
    return [sum(int(d) << (32 * j) for j, d in enumerate(row)) for row in paths]
