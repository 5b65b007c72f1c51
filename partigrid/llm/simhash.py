"""SimHash fingerprints and near-duplicate classes (operator 3); these checked by shingle sets, and widened (pipeline).

Distinct fingerprints are searched with a Gray-order hierarchical index. Four rotated copies of each fingerprint bring each
16-bit block to the front once; two fingerprints that differ in three bits or fewer agree in one block at least, so they
meet under one top node of one copy. Below a top node the fingerprints stand in Gray-code order, which puts those that share
many bits next to each other; leaves of neighbours and the nodes above them hold the bits that all their members share (a
mask and a pattern), and a pair of nodes is left as soon as the differences on shared bits exceed the limit. Nodes whose
members are already in one class are not compared again, so a dense ball of near copies costs about its size, and each task
emits a spanning forest of its links instead of all pairs. Classes follow by alternating large-star and small-star steps
over DataFrames that are written to the shared folder between steps; few links are finished by one task.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; a text with fewer
words than a shingle gives its whole word sequence; repeated rows share a fingerprint, hence a class; a null document id
takes part, and a class of null ids only has a null component id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.llm.common import Repeats, fresh, kept, let_go, one_row_each, remove_dir, slices, small_batches, stage, work_dir

SEED, LEAF, FAN, LIMIT = 42, 32, 8, 3
#: Sampled texts and common shingles that order keys; sets of a key whose pairs are all candidates at once; sets that each of
#: more is compared with first; sets of a block; bits of a set.
SAMPLE, MOST_COMMON, FEW, ENDS, BLOCK, BITS = 50_000, 200_000, 32, 4, 512, 1024
#: Fingerprints of a block that one task takes; rows that it holds at a time.
HOT, FLUSH = 500_000, 200_000
#: Rows of a file of edges while components are sought, and edges that one task finishes; rows of keys that a task holds at a time, and
#: of which it makes pairs at a time.
EDGES, HELD, CUT = 500_000, 200_000, 20_000
_LOW, _LOW48 = np.uint64(0x0101010101010101), np.uint64((1 << 48) - 1)


def _shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of the word shingles of a UTF-8 text, repeats included; of all its words if they are fewer; none without words."""
    from xxhash import xxh64_intdigest as xx

    found = data.lower().split()
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xx(line, SEED)] if found else [], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    starts = [0, *[g + 1 for g in gaps[: len(gaps) - words + 1]]]
    ends = [*gaps[words - 1 :], len(line)]
    return np.array([xx(line[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)


def _majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n = len(h)
    h = np.concatenate((h, np.zeros(-n % 255, np.uint64))).reshape(-1, 255)
    counts = np.empty(64, np.int64)
    for s in range(8):  # eight byte-wide counters in each word; 255 hashes can't overflow them
        sums = ((h >> np.uint64(s)) & _LOW).sum(axis=1, dtype=np.uint64)
        counts[s::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > n))


def simhash(data: bytes, words: int = 3) -> int:
    """Fingerprint of a UTF-8 text: majority bits of the XXH64 hashes of its word shingles, repeats included."""
    return _majority(_shingle_hashes(data, words))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("sets", None, dict)  # what other operators keep in this worker goes
        for b in slices(batches, "text", 8_000_000):
            fps = np.array([simhash(t or b"", words) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of each 64-bit code in the order of the binary reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Classes:
    """Union-find over 0..n-1, with the links that joined two classes."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


class GrayIndex:
    """Nodes over consecutive distinct fingerprints in Gray order; ``at`` are their places in ``classes``."""

    def __init__(self, fps: np.ndarray, at: list[int], classes: Classes, limit: int = LIMIT):
        self.fps, self.at, self.classes, self.limit = fps, at, classes, limit
        starts = np.arange(0, len(fps), LEAF)
        first = fps[starts]
        differ = np.bitwise_or.reduceat(fps ^ np.repeat(first, np.diff(np.append(starts, len(fps)))), starts)
        self.masks, self.patterns = [[int(x) for x in ~differ]], [[int(x) for x in first & ~differ]]
        full = (1 << 64) - 1
        while len(self.masks[-1]) > 1:
            m, p = self.masks[-1], self.patterns[-1]
            up_m, up_p = [], []
            for i in range(0, len(m), FAN):
                mask = m[i]
                for j in range(i + 1, min(i + FAN, len(m))):
                    mask &= m[j] & ~(p[i] ^ p[j]) & full
                up_m.append(mask)
                up_p.append(p[i] & mask)
            self.masks.append(up_m)
            self.patterns.append(up_p)
        self.one = [[False] * len(x) for x in self.masks]

    def join(self) -> None:
        self._own(len(self.masks) - 1, 0)

    def _members(self, level: int, i: int) -> tuple[int, int]:
        width = LEAF * FAN**level
        return i * width, min((i + 1) * width, len(self.fps))

    def _root(self, level: int, i: int) -> int:
        return self.classes.find(self.at[self._members(level, i)[0]])

    def _own(self, level: int, i: int) -> None:
        s, e = self._members(level, i)
        if 64 - self.masks[level][i].bit_count() <= self.limit:  # what its members don't share is within the limit
            for j in range(s + 1, e):
                self.classes.link(self.at[s], self.at[j])
            self._mark(level, i)
            return
        if level == 0:
            x = self.fps[s:e]
            a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= self.limit, 1))
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                self.classes.link(self.at[s + p], self.at[s + q])
            root = self._root(0, i)
            self.one[0][i] = all(self.classes.find(self.at[j]) == root for j in range(s + 1, e))
            return
        kids = range(i * FAN, min((i + 1) * FAN, len(self.masks[level - 1])))
        for k in kids:
            self._own(level - 1, k)
        for k in kids:
            for j in range(k + 1, kids.stop):
                self._cross(level - 1, k, j)
        root = self._root(level, i)
        self.one[level][i] = all(self.one[level - 1][k] and self._root(level - 1, k) == root for k in kids)

    def _mark(self, level: int, i: int) -> None:
        self.one[level][i] = True
        if level:
            for k in range(i * FAN, min((i + 1) * FAN, len(self.masks[level - 1]))):
                self._mark(level - 1, k)

    def _cross(self, level: int, i: int, j: int) -> None:
        """Links between two nodes of a level; the differences on bits that both share bound all their members'."""
        m = self.masks[level][i] & self.masks[level][j]
        if ((self.patterns[level][i] ^ self.patterns[level][j]) & m).bit_count() > self.limit:
            return
        one = self.one[level]
        if one[i] and one[j] and self._root(level, i) == self._root(level, j):
            return
        if level == 0:
            (s, e), (t, f) = self._members(0, i), self._members(0, j)
            a, b = np.nonzero(np.bitwise_count(self.fps[s:e, None] ^ self.fps[None, t:f]) <= self.limit)
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                self.classes.link(self.at[s + p], self.at[t + q])
                if one[i] and one[j]:
                    return
            return
        n = len(self.masks[level - 1])
        for k in range(i * FAN, min((i + 1) * FAN, n)):
            for h in range(j * FAN, min((j + 1) * FAN, n)):
                self._cross(level - 1, k, h)


def _runs(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.flatnonzero(np.diff(top)) + 1))
    return starts, np.diff(np.append(starts, len(top)))


def link_runs(fps: np.ndarray, top: np.ndarray, at: np.ndarray, classes: Classes, limit: int, again: int = 1) -> None:
    """Link fingerprints that stand in Gray order in runs of equal ``top``."""
    if not len(fps):
        return
    starts, sizes = _runs(top)
    run = np.repeat(np.arange(len(starts)), sizes)
    small = np.flatnonzero((sizes <= LEAF)[run] & (sizes > 1)[run])
    x, r = fps[small], run[small]
    for d in range(1, LEAF):  # runs of one leaf, all of them at once
        if d >= len(x):
            break
        hit = np.flatnonzero((r[d:] == r[:-d]) & (np.bitwise_count(x[d:] ^ x[:-d]) <= limit))
        for p in hit.tolist():
            classes.link(int(at[small[p]]), int(at[small[p + d]]))
    for s, n in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        x, own = fps[s : s + n], at[s : s + n]
        if n > 4096 and again:  # the other 48 bits agree in one of four blocks of 12
            low = x & np.uint64((1 << 48) - 1)
            for k in range(4):
                turn = ((low << np.uint64(12 * k)) | (low >> np.uint64(48 - 12 * k))) & np.uint64((1 << 48) - 1) if k else low
                order = np.argsort(gray_rank(turn), kind="stable")
                link_runs(x[order], turn[order] >> np.uint64(36), own[order], classes, limit, again - 1)
        else:
            GrayIndex(x, own.tolist(), classes, limit).join()


def _link_rows(turn: np.ndarray, block: np.ndarray, part: np.ndarray, fp: np.ndarray, limit: int) -> np.ndarray:
    """Links (rows of two fingerprints) of a spanning forest of whole runs, sorted by turn, block and part."""
    fp, shift = fp.view(np.uint64), turn.astype(np.uint64) * np.uint64(16)
    values, place = np.unique(fp, return_inverse=True)
    x = np.where(turn == 0, fp, (fp << shift) | (fp >> (np.uint64(64) - np.maximum(shift, np.uint64(1)))))
    run = np.cumsum(np.concatenate(([0], (np.diff(turn) != 0) | (np.diff(block) != 0) | (np.diff(part) != 0))))
    classes = Classes(len(values))
    for split in (False, True):  # a part of a split block is a run of its own: its other 48 bits, turned
        at = np.flatnonzero((part >= 0) == split)
        y = x[at]
        if split:
            low, by = y & _LOW48, (part[at] >> 12).astype(np.uint64) * np.uint64(12)
            y = np.where(by == 0, low, ((low << by) | (low >> (np.uint64(48) - np.maximum(by, np.uint64(1))))) & _LOW48)
        order = np.lexsort((gray_rank(y), run[at]))
        link_runs(y[order], run[at][order], place[at][order], classes, limit, 0 if split else 1)
    pairs = np.array(classes.links, np.int64).reshape(-1, 2)
    return values.view(np.int64)[pairs]


def _links(limit: int, flush: int):
    """Rows (turn, block, part, fp), sorted, to links (a, b); about ``flush`` rows of whole runs are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("turn", "block", "part", "fp")
        held, n = [], 0

        def linked(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pairs = _link_rows(*rows, limit)
            for s in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[s : s + 50_000, 0]), pa.array(pairs[s : s + 50_000, 1])], names=["a", "b"])

        for b in batches:
            held.append([b.column(c).to_numpy() for c in names])
            n += b.num_rows
            if n < flush:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            changes = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield from linked([x[:cut] for x in rows])
                rows = [x[cut:] for x in rows]
            held, n = [rows], len(rows[0])
        if n:
            yield from linked([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _least_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) of a graph, in one task, to each node but the smallest of its component (a) with that smallest (b)."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not held:
        return
    nodes, place = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    for s in range(0, len(own), 50_000):
        i = own[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[root[i]])], names=["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with an edge; root is the smallest node of its component.

    Alternating large-star and small-star steps; each is written to the shared folder, and the loop ends when a round
    changes nothing. A node's neighbours are only ever aggregated and joined, never gathered in one row. EDGES edges or
    fewer, which is a file's worth, are finished by one task: a round is some ten shuffles, whose tasks may take pages of
    16 MB from their executor however few rows they get.
    """
    spark = edges.sparkSession
    base = work_dir(spark, "components")

    def few_files(df: DataFrame, rows: int) -> DataFrame:
        return df.coalesce(max(1, -(-rows // EDGES)))  # as many files as the rows need, whatever the shuffle's partitions

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"{base}/0")
    was, step = signature(now), 0
    while was[0] > EDGES:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        step += 1
        now = stage(few_files(small, was[0]), f"{base}/{step}")
        remove_dir(f"{base}/{step - 1}")
        if (is_now := signature(now)) == was:
            break
        was = is_now
    if 0 < was[0] <= EDGES:
        now = stage(now.coalesce(1), f"{base}/least", _least_nodes, "a long, b long")
        remove_dir(f"{base}/{step}")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _gray_links(nodes: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) between fingerprints of nodes(fp) that differ in ``limit`` bits or fewer: spanning forests of the runs.

    A block of more than HOT fingerprints is split once more: what differs in three bits at most within it agrees in one of
    four parts of twelve of the other bits, so each of its fingerprints goes to four smaller runs.
    """
    if not 0 <= limit <= 3:
        raise ValueError("four blocks find differences of at most three bits")
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * nodes.count() // (4 * FLUSH))
    at = lambda bits, first: F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1)
    blocks = [F.struct(F.lit(t).alias("turn"), at(16, 48 - 16 * t).cast("int").alias("block")) for t in range(4)]
    turned = nodes.select("fp", F.explode(F.array(*blocks)).alias("x")).select("fp", "x.turn", "x.block")
    hot = turned.groupBy("turn", "block").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("turn", "block", F.lit(True).alias("hot"))
    whole = F.array(F.lit(-1))
    ends = [[(48 - 16 * t - 12 * (k + 1)) % 64 for k in range(4)] for t in range(4)]  # lowest bit of each part, before the turn
    part = lambda t, k: (F.lit(k << 12) + (at(12, ends[t][k]) if ends[t][k] <= 52 else F.shiftleft(at(ends[t][k] + 12 - 64, 0), 64 - ends[t][k]).bitwiseOR(at(64 - ends[t][k], ends[t][k])))).cast("int")
    split = F.coalesce(*[F.when(F.col("turn") == t, F.array(*[part(t, k) for k in range(4)])) for t in range(4)])
    turned = turned.join(F.broadcast(hot), ["turn", "block"], "left").withColumn("part", F.explode(F.when(F.col("hot"), split).otherwise(whole)))  # 2^18 rows at most
    keys = ["turn", "block", "part"]
    return turned.repartition(n, *keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(_links(limit, FLUSH), "a long, b long")


def _classes(coded: DataFrame, nodes: DataFrame, links: DataFrame, base: str) -> DataFrame:
    """``coded`` (doc_id, .., fp) with class, the smallest fingerprint that is linked, and component_id, the smallest id there."""
    roots = connected_components(links)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, f"{base}/placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return coded.join(placed.join(names, "root").select("fp", F.col("root").alias("class"), "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, class, component_id) of every row; component_id is the smallest id of the row's class."""
    base = work_dir(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    coded = stage(rows, f"{base}/fingerprints", _fingerprints(words), "doc_id long, text_hash long, fp long")
    nodes = stage(coded.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{base}/nodes")
    return _classes(coded, nodes, _gray_links(nodes, limit), base)


def _set_of(data: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, sorted."""
    return np.unique(_shingle_hashes(data, words))


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            sets = [_set_of(t or b"", words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["key"])

    return run


def _common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least four of about SAMPLE texts hold, sorted, and in how many. They only order keys: any sample is right."""
    every = max(1, rows.count() // SAMPLE)
    texts = rows.where(F.pmod("text_hash", F.lit(every)) == 0).select("text_hash", "text").dropDuplicates(["text_hash"])
    counts = texts.mapInArrow(_shingle_rows(words), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n >= 4")
    got = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("n").to_numpy()[order]


def _prefixes(words: int, common: np.ndarray, held: np.ndarray):
    """Rows to a hash of the text's shingle set, the set's size, and its rarest shingles: one more than a fifth of them, null
    where the task has met the set before."""

    def prefix(h: np.ndarray) -> np.ndarray:
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            h = h[np.lexsort((h, np.where(common[at] == h, held[at], 0)))]
        return h[: len(h) // 5 + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xx

        kept("sets", None, dict)
        repeats = Repeats()
        for b in slices(batches, "text", 8_000_000):
            sets = [_set_of(t or b"", words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            fps = np.array([xx(h.tobytes(), SEED) for h in sets], np.uint64)
            again, fps = repeats.number(fps).tolist(), fps.view(np.int64)
            n = pa.array([len(h) for h in sets], pa.int32())
            keys = pa.array([None if k else prefix(h).view(np.int64) for h, k in zip(sets, again, strict=True)], pa.list_(pa.int64()))
            cols = [b.column("doc_id"), b.column("text_hash"), b.column("mark"), pa.array(fps), n, keys]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "mark", "fp", "n", "keys"])

    return run


def _may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can have a similarity of 0.8 if places ``at`` and ``to`` are the first they share."""
    return 9 * np.minimum(n - at, m - to) >= 4 * (n + m)


def _met(key: np.ndarray, fp: np.ndarray, n: np.ndarray, at: np.ndarray, split: int | None) -> Iterator[pa.RecordBatch]:
    """Candidates of rows sorted by key and fp, of which key ``split`` has more elsewhere: see _meet."""
    names = ["key", "a", "b", "n", "at"]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))  # a set that several tasks have met
    key, fp, n, at = key[new], fp[new], n[new], at[new]
    _, sizes = _runs(key)
    size, run = np.repeat(sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
    if split is not None:
        size = np.where(key == split, FEW + size, size)
    key, fp, n, at, run, size = (x[size > 1] for x in (key, fp, n, at, run, size))
    def made(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The distinct pairs of the sets at i and j."""
        x, y = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
        none = pa.nulls(int(new.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(x[new]), pa.array(y[new]), none, none], names=names)

    few = np.flatnonzero(size <= FEW)
    edges = np.flatnonzero(np.diff(run[few])) + 1
    edges = [0, *edges[np.flatnonzero(np.diff(edges // CUT, prepend=0))].tolist(), len(few)]  # whole runs, about CUT rows at a time
    for s, e in zip(edges, edges[1:], strict=False):
        some, left, right = few[s:e], [], []
        for d in range(1, min(FEW, len(some))):
            i, j = some[:-d], some[d:]
            hit = (run[i] == run[j]) & _may_link(n[i], at[i], n[j], at[j])
            left.append(i[hit])
            right.append(j[hit])
        if left:
            yield from made(np.concatenate(left), np.concatenate(right))
    many = np.flatnonzero(size > FEW)
    with np.errstate(over="ignore"):
        for s, z in zip(*(x.tolist() for x in _runs(run[many])), strict=True) if len(many) else ():
            i = many[s : s + z]
            for k in range(ENDS):
                x = fp[i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
                j = np.full(z, i[np.argmin(x ^ (x >> np.uint64(29)))])
                hit = (i != j) & _may_link(n[i], at[i], n[j], at[j])
                yield from made(i[hit], j[hit])
    for s in range(0, len(many), 100_000):
        i = many[s : s + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(fp[i]), pa.nulls(len(i), pa.int64()), pa.array(n[i]), pa.array(at[i])], names=names)


def _meet(flush: int):
    """Rows (key, fp, n, at), sorted by key and fp, to candidate pairs (a, b): all of a key with FEW sets or fewer; of another
    each with a few of its sets, and also its sets themselves (key, a, n, at). About ``flush`` rows are held at a time; a key
    of more is taken in parts, each with sets of its own to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, split = [], 0, None
        for b in batches:
            held.append([b.column(c).to_numpy().astype(np.int64) for c in ("key", "fp", "n", "at")])
            size += b.num_rows
            if size < flush:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            changes = np.flatnonzero(np.diff(rows[0]))
            cut = int(changes[-1]) + 1 if len(changes) else size
            split = split if len(changes) else int(rows[0][0])
            yield from _met(*(x[:cut] for x in rows), split)
            held, size = [[x[cut:] for x in rows]], size - cut
        if size:
            yield from _met(*(np.concatenate(x) for x in zip(*held, strict=True)), split)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole pairs of blocks, sorted by pair (side 0 and 1; 2: a block with itself), to the pairs of sets of two classes
    that may be similar by places, sizes and bits. One pair of blocks is held at a time."""

    def compared(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, fp, root, n, at = (np.concatenate([b.column(c).to_numpy() for b in rows]).astype(np.int64) for c in ("side", "fp", "root", "n", "at"))
        bits = np.concatenate([np.frombuffer(b"".join(b.column("bits").to_pylist()), "<u8").reshape(-1, BITS // 64) for b in rows])
        for i in np.flatnonzero(side != 1).tolist():
            j = np.flatnonzero((side > 0) & (root != root[i]) & ((side == 1) | (fp > fp[i])))
            j = j[_may_link(n[i], at[i], n[j], at[j])]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            j = j[9 * (n[i] + n[j] - apart) >= 8 * (n[i] + n[j])]  # shingles that one set alone holds are as many at least
            if len(j):
                x = np.full(len(j), fp[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, fp[j])), pa.array(np.maximum(x, fp[j]))], names=["a", "b"])

    held, now = [], None
    for b in batches:
        pair = b.column("pair").to_pylist()
        cuts = [0, *[i for i in range(1, len(pair)) if pair[i] != pair[i - 1]], len(pair)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s and pair[s] != now and held:
                yield from compared(held)
                held = []
            if e > s:
                now = pair[s]
                held.append(b.slice(s, e - s))
    if held:
        yield from compared(held)


def _block_pairs(rest: DataFrame) -> DataFrame:
    """(pair, side, fp, root, n, at, bits) of rest(key, fp, n, at, root, bits): the sets of each key in blocks of about BLOCK,
    and each two blocks that may hold sets of different classes.

    A class of more than BLOCK sets has blocks of its own, which are never compared with one another; the others share
    blocks. So a large class costs its size times the other blocks of its key, not its square.
    """
    sizes = rest.groupBy("key", "root").agg(F.count("*").alias("c"))
    some = sizes.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1").select("key")
    sizes = sizes.join(some, "key", "left_semi")
    own = sizes.where(F.col("c") > BLOCK).select("key", "root", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    pool = sizes.where(F.col("c") <= BLOCK).groupBy("key").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("pooled"))
    name = lambda root, i: F.concat_ws(".", root.cast("string"), i.cast("string"))
    rows = rest.join(some, "key", "left_semi").join(own, ["key", "root"], "left").join(pool, "key", "left")
    block = F.when(F.col("blocks").isNotNull(), name(F.col("root"), F.pmod(F.xxhash64("fp"), "blocks"))).otherwise(name(F.lit("pool"), F.pmod(F.xxhash64("root"), "pooled")))
    rows = rows.select("key", "fp", "root", "n", "at", "bits", block.alias("block"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    other = own.select("key", F.col("root").alias("other"), F.col("blocks").alias("others"))
    large = own.join(other, "key").where("root < other").withColumn("i", upto("blocks")).withColumn("j", upto("others")).select("key", name(F.col("root"), F.col("i")).alias("x"), name(F.col("other"), F.col("j")).alias("y"))
    mixed = own.join(pool, "key").withColumn("i", upto("blocks")).withColumn("j", upto("pooled")).select("key", name(F.col("root"), F.col("i")).alias("x"), name(F.lit("pool"), F.col("j")).alias("y"))
    small = pool.withColumn("i", upto("pooled")).withColumn("j", upto("pooled")).where("i <= j").select("key", name(F.lit("pool"), F.col("i")).alias("x"), name(F.lit("pool"), F.col("j")).alias("y"))
    pairs = large.union(mixed).union(small).withColumn("pair", F.concat_ws("|", F.col("key").cast("string"), "x", "y"))
    first = pairs.select("key", F.col("x").alias("block"), "pair", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    second = pairs.where("x <> y").select("key", F.col("y").alias("block"), "pair", F.lit(1).alias("side"))
    return rows.join(first.union(second), ["key", "block"]).select("pair", "side", "fp", "root", "n", "at", "bits")


def _sets(words: int, marked: np.ndarray):
    """Rows whose mark is among ``marked`` bits, to their shingle sets (each once in a task) and which of BITS bits these set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xx

        kept("sets", None, dict)
        repeats = Repeats()
        for b in batches:
            at = b.column("mark").to_numpy().view(np.uint64) & np.uint64(64 * len(marked) - 1)
            b = b.filter(pa.array((marked[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1))
            for c in slices(iter([b]), "text", 2_000_000):
                sets = [_set_of(t or b"", words) for t in c.column("text").cast(pa.binary()).to_pylist()]
                fps = np.array([xx(h.tobytes(), SEED) for h in sets], np.uint64)
                first = np.flatnonzero(repeats.number(fps) == 0).tolist()
                sets, fps = [sets[i] for i in first], fps[first].view(np.int64)
                held = np.zeros((len(sets), BITS), np.uint8)
                for i, h in enumerate(sets):
                    held[i, (h % np.uint64(BITS)).astype(np.int64)] = 1
                bits = [x.tobytes() for x in np.packbits(held, axis=1, bitorder="little")]
                cols = [pa.array(fps), pa.array([len(h) for h in sets], pa.int32()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["fp", "n", "shingles", "bits"])

    return run


def _sets_of(rows: DataFrame, wanted: DataFrame, words: int, path: str) -> DataFrame:
    """(fp, n, shingles, bits) of wanted(fp, mark), and of some others; a set may be there more than once.

    Marks go to the rows as a table of bits: only texts that are wanted are cut again, and they are not shuffled.
    """
    size = 1 << min(26, max(16, (8 * wanted.count()).bit_length()))
    at = F.col("mark").bitwiseAND(size - 1)
    got = wanted.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(mark & 63))")).alias("bits")).toArrow()
    marked = np.zeros(size // 64, np.uint64)
    marked[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return stage(rows.select("mark", "text"), path, _sets(words, marked), "fp long, n int, shingles array<long>, bits binary")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their sizes and bits, to those that may have a similarity of 0.8."""
    for b in batches:
        n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8").reshape(-1, BITS // 64) for c in ("x", "y"))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        keep = pa.array(9 * (n + m - apart) >= 8 * (n + m))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def _similar(pairs: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more, counted over all their shingles.

    Bits and sizes drop most of the others before any set travels.
    """
    bits = sets.select("fp", "n", "bits").dropDuplicates(["fp"])
    short = lambda fp, n, of: bits.select(F.col("fp").alias(fp), F.col("n").alias(n), F.col("bits").alias(of))
    near = stage(pairs.join(short("b", "m", "y"), "b").join(short("a", "n", "x"), "a").select("a", "b", "n", "m", "x", "y"), f"{path}-near", _near, "a long, b long")
    asked = near.select(F.col("a").alias("fp")).union(near.select("b")).distinct()
    sets = sets.select("fp", "shingles").join(asked, "fp", "left_semi").dropDuplicates(["fp"])
    a = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = near.join(b, "b").join(a, "a").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
    return stage(found, path)


def _alike(coded: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the sets of coded(text_hash, fp) that one class of ``found`` holds: its least with each other."""
    of = found.groupBy("text_hash").agg(F.min("class").alias("class"))
    sets = coded.select("text_hash", "fp").distinct().join(of, "text_hash").select("class", "fp").distinct()
    least = sets.groupBy("class").agg(F.min("fp").alias("a"))
    return sets.join(least, "class").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def _apart(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """``pairs`` (a, b) less those that links (a, b) of ``same`` to one set join already."""
    to = lambda c: same.groupBy(F.col("b").alias(c)).agg(F.min("a").alias(f"root_{c}"))
    both = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_documents(docs: DataFrame, found: DataFrame | None = None, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, class, component_id) as near_duplicates, whose classes (``found``; sought here if None) it checks
    and widens to texts that differ in more than a few shingles.

    Two texts are linked if 0.8 or more of their distinct shingles are in common (Jaccard similarity), counted exactly; ``fp``
    is a hash of the set. The classes of fingerprints are checked first, and what they join rightly is not compared again.
    For texts whose fingerprints are further apart: of two such sets each has one of the common shingles among its rarest
    fifth and one more, in any order of all shingles, so the texts meet under those. Where at most FEW sets meet, all pairs
    are candidates. Where more do, each is first compared with a few of them; then all that are still in different classes
    are, in pairs of blocks. Places, sizes and bits only drop pairs that can't be similar enough. No pair is left out,
    whatever is frequent.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col) if found is None else found
    base = work_dir(docs.sparkSession, "similar")
    let_go(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("mark", F.xxhash64("text_hash", "doc_id"))
    shape = "doc_id long, text_hash long, mark long, fp long, n int, keys array<long>"
    coded = stage(rows, f"{base}/prefixes", _prefixes(words, *_common_shingles(rows, words)), shape)
    n_keys = coded.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    nodes = stage(coded.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark")), f"{base}/nodes")
    held = coded.where("keys is not null").select("fp", "n", F.posexplode("keys").alias("at", "key")).select("key", "fp", "n", "at")
    held = held.repartition(max(parts, n_keys // (4 * HELD)), "key").sortWithinPartitions("key", "fp")
    met = stage(held, f"{base}/met", _meet(HELD), "key long, a long, b long, n long, at long")
    let_go(docs.sparkSession)
    coded = stage(coded.select("doc_id", "text_hash", "fp"), f"{base}/coded")
    remove_dir(f"{base}/prefixes")
    alike = stage(_alike(coded, found), f"{base}/alike")
    pairs = stage(met.where("key is null").select("a", "b").distinct(), f"{base}/pairs")
    many = met.where("key is not null").select("key", F.col("a").alias("fp"), "n", "at")
    seen = alike.union(pairs).select(F.explode(F.array("a", "b")).alias("fp")).union(many.select("fp")).distinct()
    wanted = stage(nodes.select("fp", "mark").join(seen, "fp", "left_semi"), f"{base}/wanted")
    sets = _sets_of(rows, wanted, words, f"{base}/sets")
    same = _similar(alike, sets, f"{base}/same")
    links = same.union(_similar(_apart(pairs, same), sets, f"{base}/links"))
    if not many.isEmpty():
        roots = connected_components(links).withColumnRenamed("node", "fp")
        rest = stage(many.distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), f"{base}/many")
        blocks = _block_pairs(rest.join(sets.select("fp", "bits").dropDuplicates(["fp"]), "fp"))
        across = blocks.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(_across, "a long, b long").distinct()
        links = links.union(_similar(stage(across, f"{base}/across"), sets, f"{base}/more"))
    for done in ("met", "sets"):
        remove_dir(f"{base}/{done}")
    let_go(docs.sparkSession)
    return _classes(coded, nodes.select("fp", "least"), links, base)


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each class of ``found``: the one of smallest id, then text hash.

    Rows of one id and text are one of them. Only ids and hashes of the rows that stay are joined to the rows.
    """
    alike = found.groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = alike.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("x"))
    h, z, k, n = names = [fresh(c, docs.columns) for c in ("text_hash", "no_id", "id_or_zero", "times")]
    first = first.select(F.col("x.text_hash").alias(h), F.col("x.none").alias(z), F.coalesce("x.doc_id", F.lit(0)).alias(k), F.col("x.n").alias(n))
    first = stage(first, work_dir(docs.sparkSession, "first"))
    keys = F.xxhash64(F.col("text").cast("string")).alias(h), F.col("doc_id").isNull().alias(z), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(k)
    return one_row_each(docs.select("*", *keys), first, names[:3], n).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of three-word shingles and class of every document, linked at three differing bits or fewer."""
    found = near_duplicates(small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
