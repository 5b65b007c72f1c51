"""Mixing sources to target weights by the cube method (operator 10).

Each source's target is its share of all words by weight, at most MOST times its own words; what exceeds that is shared out
again by weight. A document is taken floor(target / words of its source) times for sure and once more with the fraction that
remains. Those last copies are drawn by the cube method: probabilities move along directions of the null space of two
constraints, the words and the number of documents taken, until each is 0 or 1 but for two at most.

The flight runs in randomised groups of about GROUP rows of a source. Each move is led by the largest row that is undecided
and balanced by all others, so the last to be decided are small. What stays undecided goes on to a next round in fewer
groups, so no task ever holds more than a group. The last two rows of a source are the landing problem: of the joint draws
that keep both probabilities, the one with the least expected error in words and documents is taken, so every row is drawn
with its own probability to the end. Draws come from hashes of the rows and a seed, so reruns agree.

Equal rows are counted, numbered and dealt to groups one by one; a row that is repeated very often is numbered in chunks by
many tasks. Sources are ranked and their targets found by aggregates over a table of sources, never at the driver.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 take part with 0
words; repeated rows are drawn each; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partigrid.llm.common import fresh, one_row_each, small_batches, stage, work_dir

#: Rows of a group; equal rows that one task numbers; sources up to which their table is broadcast.
WEIGHTS, MOST, GROUP, CHUNK, FEW_SOURCES = (5.0, 2.0, 1.0), 3, 2048, 1024, 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def flight(x: list[float], p: list[float], rng: np.random.Generator, eps: float = 1e-9) -> list[float]:
    """Move probabilities to 0 or 1 with Σp and Σx·p unchanged, until two rows at most are undecided.

    A move is the projection of the first undecided row's direction on the null space, with p(1-p) as the metric.
    """
    p, x = np.array(p, float), np.array(x, float)
    at = np.flatnonzero((p > eps) & (p < 1 - eps))
    p[(p <= eps) | (p >= 1 - eps)] = np.round(p[(p <= eps) | (p >= 1 - eps)])
    q, y, lead = p[at], x[at], 0
    while len(at) > 1:
        w = q * (1 - q)
        total = w.sum()
        z = y - (w @ y) / total
        wz = w * z
        spread = wz @ z
        u = -w * (w[lead] / total)
        if spread > 1e-9 * total:
            u -= wz * (wz[lead] / spread)
        u[lead] += w[lead]
        largest = np.abs(u).max()
        if largest < 1e-9 * w[lead]:  # all others are of one size: it can't move, they can
            if lead or len(at) < 3:
                break
            lead = 1
            continue
        u[np.abs(u) < 1e-9 * largest] = 0
        with np.errstate(divide="ignore"):
            to_one, to_zero = (1 - q) / np.abs(u), q / np.abs(u)
        up, down = np.where(u > 0, to_one, to_zero).min(), np.where(u > 0, to_zero, to_one).min()
        q = q + u * (up if rng.random() * (up + down) < down else -down)
        still = (q > eps) & (q < 1 - eps)
        p[at] = np.where(still, q, np.round(q))
        lead = 1 if lead and still[0] else 0
        at, q, y = at[still], q[still], y[still]
    return p.tolist()


def land(x: list[float], p: list[float], rng: np.random.Generator) -> list[float]:
    """Decide the rows that a flight leaves open, each with its own probability. They are two at most (others would go one by
    one before them); of the joint draws of two the one with the least expected error is taken: words, in sizes of the rows,
    and documents."""
    p, open_ = list(p), [i for i, v in enumerate(p) if 0 < v < 1]
    while len(open_) > 2 or len(open_) == 1:
        i = open_.pop(0)
        p[i] = float(rng.random() < p[i])
    if open_:
        i, j = open_
        words, n, size = x[i] * p[i] + x[j] * p[j], p[i] + p[j], max((x[i] + x[j]) / 2, 1.0)
        cost = lambda a, b: abs(a * x[i] + b * x[j] - words) / size + abs(a + b - n)
        slope = cost(1, 1) + cost(0, 0) - cost(1, 0) - cost(0, 1)
        both = max(0.0, n - 1) if slope > 0 else min(p[i], p[j])
        edges = np.cumsum([both, p[i] - both, p[j] - both])
        p[i], p[j] = [(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)][int(np.searchsorted(edges, rng.random(), side="right"))]
    return p


def _source_plan(sized: DataFrame, weights: tuple[float, ...], most: float, base: str) -> tuple[DataFrame, int]:
    """(source_id, name, source_size, target) of the sources in code point order, null last, and how many there are."""
    spark = sized.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = sized.groupBy(F.col("source").alias("name")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = [F.col("name").isNull(), F.col("name")]
    dealt = stage(sums.repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id()), f"{base}/dealt")
    offsets, before = [], 0
    for r in sorted(dealt.groupBy("bucket").count().collect()):  # a row for each partition
        offsets.append((r[0], before))
        before += r[1]
    known = spark.createDataFrame(offsets, "bucket int, before long")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1
    ranked = dealt.join(F.broadcast(known), "bucket").withColumn("source_id", F.col("before") + place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source_id", "name", "source_size", weight.alias("weight")), f"{base}/sources")
    limit = F.lit(float(most)) * F.col("source_size")
    total, free = (float(v or 0) for v in ranked.agg(F.sum("source_size"), F.sum("weight")).first())
    left, capped = total, 0
    while True:  # what is above its limit is held there, the rest shares again; that only raises the others
        share = F.col("weight") * F.lit(left) / F.lit(free or 1.0)
        held, others, now = ranked.agg(F.sum(F.when(share > limit, limit)), F.sum(F.when(share > limit, 0.0).otherwise(F.col("weight"))), F.count_if(share > limit)).first()
        if now <= capped or not others:
            return ranked.select("source_id", "name", "source_size", F.least(limit, share).alias("target")), before
        left, free, capped = total - held, others, now


_ROW = "doc_id long, text_hash long, source_id long, size long, p double"


def _fly(seed: int):
    """Rows of whole groups, sorted by source and group, to the rows with their new probabilities; one group is held at a time."""

    def flown(table: pa.Table) -> pa.RecordBatch:
        source_id, group, last, step = (table.column(c)[0].as_py() for c in ("source_id", "group", "last", "step"))
        table = table.sort_by([("size", "descending"), ("draw", "ascending"), ("doc_id", "ascending"), ("text_hash", "ascending"), ("p", "ascending")])
        x, p = table.column("size").to_numpy().astype(float).tolist(), table.column("p").to_pylist()
        rng = np.random.default_rng([seed, source_id, group, step])
        p = flight(x, p, rng)
        if last:
            p = land(x, p, rng)
        return table.select(["doc_id", "text_hash", "source_id", "size"]).append_column("p", pa.array(p, pa.float64())).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            source, group = (b.column(c).to_numpy() for c in ("source_id", "group"))
            cuts = [0, *(np.flatnonzero((np.diff(source) != 0) | (np.diff(group) != 0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if held and (source[s], group[s]) != now:
                        yield flown(pa.Table.from_batches(held))
                        held = []
                    now = (source[s], group[s])
                    held.append(b.slice(s, e - s))
        if held:
            yield flown(pa.Table.from_batches(held))

    return run


def one_by_one(counted: DataFrame, table: DataFrame, n: str, number: str, keys: list[str]) -> DataFrame:
    """Each row of ``counted`` as often as its column ``n`` says, ``number`` counting from 0; rows that come more than CHUNK
    times are first split into chunks and dealt out. ``table`` holds the same counts, ready to be read."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = lambda df: df.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    if table.where(F.col(n) > CHUNK).isEmpty():
        return few(counted)
    chunks = counted.where(F.col(n) > CHUNK).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    first = F.col(number) * CHUNK
    many = chunks.repartition(parts, *keys, number).withColumn(number, F.explode(F.sequence(first, F.least(first + CHUNK, F.col(n)) - 1)))
    return few(counted.where(F.col(n) <= CHUNK)).unionByName(many)


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, copies, taken) of every row; weights repeat over the sources."""
    spark = docs.sparkSession
    base = work_dir(spark, "cube")
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), size)
    sized = stage(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), f"{base}/sizes")
    plan, n_sources = _source_plan(sized, weights, most, base)
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    sure = F.least(F.floor(ratio + 1e-9), F.lit(most)).cast("int")
    plan = plan.withColumn("sure", sure).withColumn("rest", F.when(sure < most, F.greatest(ratio - sure, F.lit(0.0))).otherwise(0.0))
    checked = lambda df: F.broadcast(df) if n_sources <= FEW_SOURCES else df
    named = sized.join(checked(plan.select("source_id", "name", F.col("rest").alias("p"))), sized.source.eqNullSafe(F.col("name"))).select("doc_id", "text_hash", "source_id", "size", "p", "n")
    open_ = one_by_one(named, sized, "n", "number", ["doc_id", "text_hash"]).drop("n")
    decided: DataFrame | None = None
    step = 0
    while True:
        counts = open_.groupBy("source_id").agg(F.greatest(F.lit(1), F.round(F.count("*") / GROUP)).cast("int").alias("groups"))
        draw = F.xxhash64("doc_id", "text_hash", "size", *(["number"] if not step else ["p"]), F.lit(seed), F.lit(step))
        dealt = open_.join(checked(counts), "source_id").withColumn("draw", draw)
        dealt = dealt.withColumn("group", F.pmod(F.shiftrightunsigned("draw", 20), F.col("groups")).cast("int"))
        dealt = dealt.select("source_id", "group", (F.col("groups") == 1).alias("last"), F.lit(step).alias("step"), "doc_id", "text_hash", "size", "draw", "p")
        dealt = dealt.repartition("source_id", "group").sortWithinPartitions("source_id", "group")
        flown = stage(dealt, f"{base}/round-{step}", _fly(seed), _ROW)
        done = flown.where("p in (0.0, 1.0)")
        decided = done if decided is None else decided.union(done)
        open_, step = flown.where("p not in (0.0, 1.0)"), step + 1
        if open_.isEmpty():
            break
    out = decided.join(checked(plan), "source_id").withColumn("copies", F.col("sure") + F.col("p").cast("int"))
    return out.select("doc_id", "text_hash", F.col("name").alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; of equal rows (id, source and text) one is taken as often as
    the mix takes all of them, and what comes very often is dealt out."""
    names = [fresh(c, docs.columns) for c in ("text_hash", "no_id", "id_or_zero", "no_source", "source_or_none")]
    times, alike, number = (fresh(c, [*docs.columns, *names]) for c in ("times", "alike", "number"))

    def keyed(text_hash: F.Column) -> list[F.Column]:
        own = (text_hash, F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("source").isNull(), F.coalesce(F.col("source").cast("string"), F.lit("")))
        return [c.alias(n) for c, n in zip(own, names, strict=True)]

    mixed = mix_documents(docs).select("doc_id", "source", F.col("text_hash").alias("of_text"), F.col("copies").alias("m"))
    mixed = mixed.select(*keyed(F.col("of_text")), "m").groupBy(*names).agg(F.sum("m").alias(times), F.count("*").alias(alike)).where(F.col(times) > 0)
    mixed = stage(mixed, work_dir(docs.sparkSession, "mixed"))
    rows = one_row_each(docs.select("*", *keyed(F.xxhash64(F.col("text").cast("string")))), mixed, names, alike)
    return one_by_one(rows, mixed, times, number, names).select(*docs.columns)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: doc_id, size, source_size, target, taken, source, copies."""
    mixed = mix_documents(small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
