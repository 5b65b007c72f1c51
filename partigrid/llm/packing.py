"""Packing documents into sequences (operator 2).

Documents are dealt into randomised groups by a hash of their id, their token ids and how often the same row came before in
its task, so equal rows are dealt out too. In each group a document longer than a sequence gives full pieces,
and what remains is placed by first-fit decreasing: a tournament tree over the bins' free capacities finds the first bin
that holds a piece in logarithmic time. The emptiest bins are then cut up to fill the gaps of the others, and the one bin
that stays partly filled is cut into runs of power-of-two length, which need no padding.

Defined cases: a null or empty text has its end id only; repeated rows are documents of their own; a null document id is
kept as null; an empty table gives no rows; other columns of the input are never touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.llm.common import Repeats, slices, small_batches, tokenizer

GROUP_DOCS = 2048


class CapacityTree:
    """Tournament tree over bins in order of opening: each inner node holds the largest free capacity below it."""

    def __init__(self, capacity: int, size: int = 64):
        self.capacity, self.size, self.bins = capacity, size, 0
        self.best = [0] * (2 * size)

    def _grow(self) -> None:
        leaves = self.best[self.size :] + [0] * self.size
        self.size *= 2
        self.best = [0] * self.size + leaves
        for i in range(self.size - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def place(self, length: int) -> int:
        """Put a piece into the first bin that holds it, or open one; returns the bin."""
        if self.best[1] >= length:
            i = 1
            while i < self.size:
                i *= 2
                if self.best[i] < length:
                    i += 1
            free = self.best[i] - length
        else:
            if self.bins == self.size:
                self._grow()
            i = self.size + self.bins
            self.bins += 1
            free = self.capacity - length
        at = i - self.size
        self.best[i] = free
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])
        return at


def plan_group(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each id of the documents once.

    All sequences are full, but for a few whose length is a power of two.
    """
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // capacity
        full += [[(d, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = CapacityTree(capacity)
    bins: list[list[tuple[int, int, int]]] = []
    fill: list[int] = []
    for n, d, start in rest:
        at = tree.place(n)
        if at == len(bins):
            bins.append([])
            fill.append(0)
        bins[at].append((d, start, n))
        fill[at] += n
    # The emptiest bins fill the others' gaps: the order is by fill, donors are taken from the end.
    order = sorted(range(len(bins)), key=lambda i: (-fill[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, donor = order[lo], order[hi]
        gap = capacity - fill[to]
        if gap == 0:
            lo += 1
            continue
        if fill[donor] == 0:
            hi -= 1
            continue
        d, start, n = bins[donor].pop()
        take = min(n, gap)
        if take < n:
            bins[donor].append((d, start + take, n - take))
        bins[to].append((d, start, take))
        fill[to] += take
        fill[donor] -= take
    out = full + [bins[i] for i in range(len(bins)) if fill[i] == capacity]
    for i in range(len(bins)):
        left, pieces = fill[i] if fill[i] < capacity else 0, bins[i]
        while left:
            run = 1 << (left.bit_length() - 1)
            left -= run
            seq = []
            while run:
                d, start, n = pieces.pop(0)
                take = min(n, run)
                if take < n:
                    pieces.insert(0, (d, start + take, n - take))
                seq.append((d, start, take))
                run -= take
            out.append(seq)
    return out


def _tokenise(tokens: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xx

        tok, repeats = tokenizer(tokens), Repeats()
        for b in slices(batches, "text"):
            ids = tok.encode([t or "" for t in b.column("text").to_pylist()])
            if end_id is not None:
                ids = [np.append(x, np.uint16(end_id)) for x in ids]
            packed, doc_ids = [x.astype("<u2").tobytes() for x in ids], b.column("doc_id").to_pylist()
            keys = np.array([xx(x, 0 if i is None else (i << 1 | 1) & (1 << 64) - 1) for i, x in zip(doc_ids, packed, strict=True)], np.uint64)
            key, again = pa.array(keys.view(np.int64)), pa.array(repeats.number(keys))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary()), key, again], names=["doc_id", "ids", "key", "again"])

    return run


def _pack(capacity: int, with_ids: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("key", "ascending")])
        group, doc_ids = key[0].as_py(), table.column("doc_id").to_pylist()
        ids = [np.frombuffer(x.as_py(), "<u2") for x in table.column("ids")]
        cols: list[list] = [[] for _ in range(8)]
        for s, seq in enumerate(plan_group([len(x) for x in ids], capacity)):
            at = 0
            for d, start, n in seq:
                piece = ids[d][start : start + n].astype("<u4")
                row = (doc_ids[d], start, n, zlib.crc32(piece.tobytes()), len(ids[d]), (group << 32) + s, at, piece.astype(np.int32).tolist() if with_ids else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                at += n
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else [])
        return pa.table(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

    return run


def pack_documents(docs: DataFrame, tokens: str, end_id: int | None = None, capacity: int = 2048, seed: int = 7, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    The number of groups follows the number of rows, so a group holds about GROUP_DOCS documents whatever the input, and a
    task holds one group.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = max(1, round(docs.select(id_col).count() / GROUP_DOCS))
    coded = rows.mapInArrow(_tokenise(tokens, end_id), "doc_id long, ids binary, key long, again long")
    coded = coded.withColumn("group", F.pmod(F.xxhash64("key", "again", F.lit(seed)), F.lit(groups)).cast("int"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return coded.repartitionById(groups, F.col("group")).groupBy("group").applyInArrow(_pack(capacity, with_ids), schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack_documents(small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json", end_id=1)
