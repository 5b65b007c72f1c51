"""Document fingerprints by quartile bucket digests (operator 5).

Hashed byte triplets of a text are counted in 256 buckets. The digest holds for each bucket the quartile of its count among
all buckets (two bits), the length on a logarithmic scale and the ratios of the quartiles, so moving or replacing a part of a
text moves a part of the digest. Two digests are compared by a difference score that is bounded: 0 for equal digests, BOUND
or more for unrelated ones, given as a likeness between 0 and 1.

The query needs for every document its neighbour in descending id order. Rows are range-partitioned and sorted once; each
task links the rows it holds and hands on its first and last row, and the last row of a partition is joined with the first of
the next one that has rows. Equal rows may go to several ranges, by the input partition that they come from.

Defined cases: a null text is empty; a text under four bytes has empty buckets and differs by length alone; repeated ids
stand in order of a hash of their text; null ids come last; one row is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.llm.common import slices, small_batches, stage, work_dir

BUCKETS, BOUND = 256, 416
_MUL = (np.uint16(0x9E37), np.uint16(0x85EB), np.uint16(0xC2B3))
_BLOCK = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets (1,2,3), (1,2,4), (1,3,4) of all windows of four bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    for s in range(0, max(len(data) - 3, 0), _BLOCK):
        x = np.frombuffer(data, np.uint8, min(_BLOCK + 3, len(data) - s), s).astype(np.uint16)
        a, b, c, d = x[:-3], x[1:-2], x[2:-1], x[3:]
        for salt, (p, q) in enumerate(((b, c), (b, d), (c, d))):
            h = a * _MUL[0] + p * _MUL[1] + q * _MUL[2] + np.uint16(salt * 0x3D4D)
            counts += np.bincount(h >> np.uint16(8), minlength=BUCKETS)
    return counts


class Digest:
    """Quartile codes of the buckets, length code and quartile ratios of a text."""

    __slots__ = ("codes", "length", "ratios")

    def __init__(self, data: bytes):
        counts = bucket_counts(data)
        q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        self.codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
        self.length = min(int(np.log1p(len(data)) * 10), 255)
        self.ratios = (int(q1 * 15 // q3), int(q2 * 15 // q3)) if q3 else (0, 0)

    def hex(self) -> str:
        c = self.codes.reshape(-1, 4)
        body = (c[:, 0] << 6) | (c[:, 1] << 4) | (c[:, 2] << 2) | c[:, 3]
        return f"{self.length:02x}{self.ratios[0]:x}{self.ratios[1]:x}" + body.astype(np.uint8).tobytes().hex()

    def likeness(self, other: Digest) -> float:
        """1 less the bounded difference: quartile steps (three count twice), lengths over one step, ratios over one step."""
        gap = np.abs(self.codes.astype(np.int8) - other.codes.astype(np.int8))
        diff = int(gap.sum()) + 3 * int((gap == 3).sum())
        diff += max(abs(self.length - other.length) - 1, 0)
        diff += sum(max(abs(p - q) - 1, 0) for p, q in zip(self.ratios, other.ratios, strict=True))
        return 1 - min(diff, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_HELD = f"{_OUT}, part int, role int, text string"
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _row(doc_id: int | None, text: str, own: Digest, following: str, beside: Digest) -> tuple:
    data = edited(text, following).encode("utf-8")
    changed = Digest(data)
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), own.hex(), changed.hex(), own.likeness(changed), own.likeness(beside)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the row behind them; its first (role 1) and last row (role 2) are handed on."""
    part, last = TaskContext.get().partitionId(), None
    empty = (None,) * 6
    for b in slices(batches, "text"):
        rows: list[tuple] = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            own = Digest(text.encode("utf-8"))
            if last is None:
                rows.append((doc_id, *empty, part, 1, text))
            else:
                rows.append((*_row(*last, text, own), part, 0, None))
            last = (doc_id, text, own)
        if rows:
            yield _batch(rows, _HELD)
    if last is not None:
        yield _batch([(last[0], *empty, part, 2, last[1])], _HELD)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions with the text of the row behind them, to result rows."""
    for b in slices(batches, "text"):
        rows = []
        for doc_id, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            rows.append(_row(doc_id, text, Digest(text.encode("utf-8")), following, Digest(following.encode("utf-8"))))
        yield _batch(rows, _OUT)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they and the next document's are."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("at", F.spark_partition_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("at")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    held = stage(rows, work_dir(spark, "quartile"), _inside, _HELD)
    firsts = held.where("role = 1").select(F.col("part").alias("behind"), F.col("text").alias("following"))
    parts = sorted(r.behind for r in firsts.select("behind").collect())  # a number for each partition
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, behind int")
    lasts = held.where("role = 2").select("part", "doc_id", "text").join(pairs.hint("merge"), "part").join(firsts.hint("merge"), "behind")
    names = [x.split()[0] for x in _OUT.split(", ")]
    return held.where("role = 0").select(*names).unionByName(lasts.select("doc_id", "text", "following").mapInArrow(_between, _OUT))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile digests of all documents and their edited texts."""
    return fingerprint_neighbours(small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"))
