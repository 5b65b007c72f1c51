"""Exact top-k search by MaxScore (operator 7).

Vectors are packed into shards of rows and blocks of queries. A query's terms are its dimensions; over a shard each term's
contribution lies between two bounds, and what it can add above the lower one is its score bound. While a query holds k
results, its terms are split: the non-essential ones are those of smallest bounds whose sum stays below what is missing to
the k-th score, the others are essential. The essential terms' postings (the shard's columns) are traversed for all rows;
rows that could still reach the k-th score are probed in the non-essential terms, a few at a time, as long as they stay
competitive. Each task goes on with its thresholds from shard to shard; the shards' results are merged by rank.

Shards and query blocks meet in an equi-join on (block, salt), so neither side is ever broadcast.

Components are scaled and floored as doubles, so every finite one is kept. Products that could pass 2^53 are bounded in
floating point with the proven error of the sum added to every bound, and what may reach the k-th score is summed exactly in
integers of any size.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, nor do null ids; a missing
component of a shorter vector counts as 0; every row but the query's own is a candidate, so a row with the same id is one;
each row that is asked for is a query, repeated ones too; ties go to the smaller id; fewer candidates than k are all
returned; a score among a query's results that 64 bits can't hold is an error; empty tables give no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partigrid.llm.common import small_batches

SHARD, BLOCK, PROBE = 8192, 4096, 8
FLOAT32, FLOAT64 = 1 << 24, 1 << 53  # integers below are exact


def _valid() -> F.Column:
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)


def floors(rows: pa.ListArray, scale: float) -> tuple[str, np.ndarray]:
    """Floors of ``scale`` times each component, short rows filled up with 0, and the kind they are held in: 32-bit integers,
    doubles, or integers of any size where a product leaves the doubles."""
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    flat, dims = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64), int(sizes.max(initial=0))
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    out = np.zeros((len(sizes), dims))
    there = np.arange(dims) < sizes[:, None]
    if not np.isfinite(scaled).all():
        out = out.astype(object)
        out[there] = [math.floor(Fraction(x) * Fraction(scale)) for x in flat.tolist()]
        return "o", np.where(there, out, 0)
    out[there] = scaled
    return ("i", out.astype("<i4")) if np.abs(scaled).max(initial=0) < 1 << 31 else ("d", out.astype("<f8"))


def pack_rows(kind: str, rows: np.ndarray) -> bytes:
    return pickle.dumps(rows.tolist()) if kind == "o" else rows.tobytes()


def unpack_rows(kind: str, data: bytes, n: int, dims: int) -> np.ndarray:
    if kind != "o":
        return np.frombuffer(data, "<i4" if kind == "i" else "<f8").reshape(n, dims)
    out = np.zeros((n, dims), object)
    out[:] = pickle.loads(data)
    return out


def _pack(limit: int, scale: float):
    """Rows (vec_id, v, qb), sorted by qb, to packed rows (qb, part, seq, n, dims, kind, ids, data) of one qb each."""

    def flush(rows: list[pa.RecordBatch], part: int, seq: int) -> pa.RecordBatch:
        qb = rows[0].column("qb")[0].as_py()
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in rows])
        kind, data = floors(pa.chunked_array([b.column("v") for b in rows]).combine_chunks(), scale)
        cols = [[qb], [part], [seq], [len(ids)], [data.shape[1]], [kind], [ids.astype("<i8").tobytes()], [pack_rows(kind, data)]]
        kinds = (*[pa.int32()] * 5, pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["qb", "part", "seq", "n", "dims", "kind", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            while b.num_rows:
                qb = b.column("qb").to_numpy()
                if held and held[0].column("qb")[0].as_py() != qb[0]:
                    yield flush(held, part, seq)
                    seq, held, size = seq + 1, [], 0
                take = b.slice(0, min(limit - size, int(np.searchsorted(qb, qb[0], side="right"))))
                b = b.slice(take.num_rows)
                held.append(take)
                size += take.num_rows
                if size == limit:
                    yield flush(held, part, seq)
                    seq, held, size = seq + 1, [], 0
        if size:
            yield flush(held, part, seq)

    return run


_PACKED = "qb int, part int, seq int, n int, dims int, kind string, ids binary, data binary"


def _whole(rows: np.ndarray) -> np.ndarray:
    """The same integers as Python's, which never overflow."""
    if rows.dtype == object:
        return rows
    out = np.empty(rows.shape, object)
    out[:] = [[int(x) for x in r] for r in rows.tolist()]
    return out


class Search:
    """Top k of a block of queries over the shards that it is shown; a query's own row may be among them."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
        self.numbers, self.ids, self.queries, self.k = numbers, ids, queries, k + 1  # one more: its own row goes in the end
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def shard(self, vec_ids: np.ndarray, rows: np.ndarray) -> None:
        dims = max(rows.shape[1], self.queries.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
        queries, rows = wide(self.queries), wide(rows)
        top = np.inf
        if queries.dtype != object and rows.dtype != object:
            high, low = rows.max(axis=0).astype(np.float64), rows.min(axis=0).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                size, far = np.abs(queries.astype(np.float64)), np.maximum(np.abs(high), np.abs(low))
                top = max(float((size @ far).max(initial=0)), float(size.max(initial=0)), float(far.max(initial=0)))
        if not np.isfinite(top):  # beyond doubles: no bounds, all sums in integers of any size
            columns = _whole(rows).T
            for i, q in enumerate(_whole(queries)):
                self._merge(i, np.arange(len(vec_ids)), q @ columns, vec_ids)
            return
        exact = top < FLOAT64
        columns = np.ascontiguousarray(rows.T).astype(np.float32 if top < FLOAT32 else np.float64)
        slack = 0.0 if exact else (4 * dims + 8) * 2.0**-52 * top  # more than the sums and their bounds can be off
        for i, q in enumerate(queries):
            cand, got = self._query(i, q.astype(columns.dtype), columns, high, low, slack)
            if not exact and len(cand):
                got = _whole(rows[cand]) @ _whole(q[None])[0]
            self._merge(i, cand, got, vec_ids)

    def _query(self, i: int, q: np.ndarray, columns: np.ndarray, high: np.ndarray, low: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the best, and their scores, each ``slack`` off at most."""
        scores = self.best[i][0]
        n = columns.shape[1]
        weight = q.astype(np.float64)
        most, least = np.maximum(weight * high, weight * low), np.minimum(weight * high, weight * low)
        if len(scores) < self.k:
            cand, got = np.arange(n), q @ columns
        else:
            worst = float(scores[-1]) - slack - (abs(float(scores[-1])) * 2.0**-52 if slack else 0)
            order = np.argsort(most - least, kind="stable")  # ascending score bounds
            missing = worst - least.sum()
            free = int(np.searchsorted(np.cumsum((most - least)[order]), missing, side="left"))
            rest, essential = order[:free][::-1], order[free:]
            got = q[essential] @ columns[essential] if len(essential) else np.zeros(n, columns.dtype)
            cand = np.flatnonzero(got + most[rest].sum() >= worst)
            got = got[cand]
            for s in range(0, len(rest), PROBE):
                if not len(cand):
                    break
                now = rest[s : s + PROBE]
                got = got + q[now] @ columns[np.ix_(now, cand)]
                keep = got + most[rest[s + PROBE :]].sum() >= worst
                cand, got = cand[keep], got[keep]
        if len(cand) > 4 * self.k:
            keep = got >= np.partition(got, len(got) - self.k)[len(got) - self.k] - 2 * slack
            cand, got = cand[keep], got[keep]
        return cand, got

    def _merge(self, i: int, cand: np.ndarray, got: np.ndarray, vec_ids: np.ndarray) -> None:
        if not len(cand):
            return
        scores, ids = self.best[i]
        kind = object if got.dtype == object or scores.dtype == object else np.int64
        scores, ids = np.concatenate((scores.astype(kind), got.astype(kind))), np.concatenate((ids, vec_ids[cand]))
        first = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])) if kind is object else np.lexsort((ids, -scores))
        self.best[i] = scores[first[: self.k]], ids[first[: self.k]]

    def results(self) -> pa.RecordBatch:
        """Rows (number, query_id, own, vec_id, score); ``own`` is the query's score with itself, as text."""
        own = [str(sum(int(y) ** 2 for y in x)) for x in self.queries.tolist()]
        n = [len(s) for s, _ in self.best]
        cols = [
            pa.array(np.repeat(self.numbers, n), pa.int64()), pa.array(np.repeat(self.ids, n), pa.int64()), pa.array([o for o, m in zip(own, n, strict=True) for _ in range(m)], pa.string()),
            pa.array(np.concatenate([x for _, x in self.best] or [np.empty(0, np.int64)]), pa.int64()), pa.array([str(x) for s, _ in self.best for x in s.tolist()], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["number", "query_id", "own", "vec_id", "score"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(c)[r].as_py()  # noqa: B023, E731
                if (key := (get("qb"), get("salt"))) != now:
                    if search:
                        yield search.results()
                    ids = np.frombuffer(get("q_ids"), "<i8")
                    numbers = (np.int64(get("qb")) << np.int64(32)) + np.arange(len(ids))
                    now, search = key, Search(numbers, ids, unpack_rows(get("q_kind"), get("q_data"), get("q_n"), get("q_dims")), k)
                search.shard(np.frombuffer(get("ids"), "<i8"), unpack_rows(get("kind"), get("data"), get("n"), get("dims")))
        if search:
            yield search.results()

    return run


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products of the floors of ``scale`` times the vectors."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(_valid())
    asked = valid.where(is_query)
    blocks = max(1, -(-asked.count() // BLOCK))
    queries = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).select("vec_id", "v", "qb")
    salts = max(1, n // blocks)
    # Sorted by all they hold: a query's number is the same whichever task packs the block again.
    packed_q = queries.repartition(blocks, "qb").sortWithinPartitions("qb", "vec_id", "v").mapInArrow(_pack(1 << 30, scale), _PACKED)
    packed_q = packed_q.select("qb", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "kind", "ids", "data")])
    shards = valid.select("vec_id", "v", F.lit(0).alias("qb")).mapInArrow(_pack(SHARD, scale), _PACKED)
    shards = shards.withColumn("salt", F.pmod(F.col("part") * 7919 + F.col("seq"), F.lit(salts))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("part", "seq")
    both = shards.repartition(n, "qb", "salt").join(packed_q.repartition(n, "qb", "salt").hint("merge"), ["qb", "salt"])
    found = both.mapInArrow(_search(k), "number long, query_id long, own string, vec_id long, score string")
    found = found.select("number", "query_id", "vec_id", F.col("score").try_cast("long").alias("score"), F.col("score").try_cast("decimal(38,0)").alias("wide"), F.length("score").alias("digits"), F.col("score").startswith("-").alias("below"), (F.col("score") == F.col("own")).alias("self"))
    largest = [F.col("below").asc(), F.when(F.col("below"), F.col("digits")).otherwise(-F.col("digits")), F.desc("wide"), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*largest))).where(F.col("rank") <= k + 1)
    alike = F.col("self") & (F.col("vec_id") == F.col("query_id"))  # of its own row and its like, one goes: the first of them
    own = F.min(F.when(alike, F.col("rank"))).over(Window.partitionBy("number"))
    ranked = ranked.withColumn("own", F.coalesce(own, F.lit(k + 1))).where(F.col("rank") != F.col("own"))
    ranked = ranked.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("own"), 1).otherwise(0))
    wide = F.raise_error(F.lit("a score among the results is beyond 64 bits")).cast("long")
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("score").isNull(), wide).otherwise(F.col("score")).alias("score"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each row whose id is divisible by 20, against all rows."""
    return top_k(small_batches(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as f from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.n, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.f, c.f) as bigint) as score
  from v q join v c on c.n <> q.n where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by n order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
