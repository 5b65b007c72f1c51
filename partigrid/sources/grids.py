"""Base graphs as DataFrames: vertices(v, x, y, weight) and edges(src, dst) with src < dst."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.functions.columns import edge_ids, vertex_id


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame


def grid_vertices(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Vertex x * cols + y for 0 <= x < rows and 0 <= y < cols, each of weight 1."""
    v = F.col("id").cast("int")
    return spark.range(rows * cols).select(v.alias("v"), F.floor(F.col("id") / cols).cast("int").alias("x"), (F.col("id") % cols).cast("int").alias("y"), F.lit(1).cast("long").alias("weight"))


def neighbour_edges(vertices: DataFrame, queen: bool = False) -> DataFrame:
    """Edges between cells that touch by a side, or with ``queen`` by a side or a corner.

    Each cell names its neighbours' coordinates, so the join is an equi-join on (x, y) and not a comparison of all pairs.
    """
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * queen
    ahead = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("to")
    a = vertices.select(F.col("v").alias("a"), ahead).select("a", "to.x", "to.y")
    both = a.join(vertices.select(F.col("v").alias("b"), "x", "y"), ["x", "y"])
    src, dst = edge_ids(F.col("a"), F.col("b"))
    return both.select(src.alias("src"), dst.alias("dst"))


def rook_grid(spark: SparkSession, rows: int, cols: int) -> Graph:
    v = grid_vertices(spark, rows, cols)
    return Graph(v, neighbour_edges(v))


def queen_grid(spark: SparkSession, rows: int, cols: int) -> Graph:
    v = grid_vertices(spark, rows, cols)
    return Graph(v, neighbour_edges(v, queen=True))


def nation_grid(spark: SparkSession, sf_dir: str, size: int = 5, queen: bool = False, populated: bool = False) -> Graph:
    """The nations as a grid: x = key % 5, y = key div 5, cut to size x size; weight 1, or the nation's customers."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    v = n.select(key.alias("key"), (key % 5).alias("x"), F.floor(key / 5).cast("int").alias("y"), F.col("n_regionkey").alias("district")).where((F.col("x") < size) & (F.col("y") < size))
    if populated:
        held = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("weight"))
        v = v.join(held, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    else:
        v = v.withColumn("weight", F.lit(1).cast("long"))
    v = v.select(vertex_id(F.col("x"), F.col("y"), size).cast("int").alias("v"), "x", "y", "weight", "district")
    return Graph(v, neighbour_edges(v, queen))


def read_graph(spark: SparkSession, vertices_path: str, edges_path: str) -> Graph:
    """A graph from Parquet tables (v, weight, ..) and (src, dst, ..), whatever their other columns."""
    e = spark.read.parquet(edges_path)
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    return Graph(spark.read.parquet(vertices_path), e.where("src <> dst").select(*ends).distinct())


def trade_edges(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """(src, dst, orders): each customer nation's ``top`` supplier nations by line count, undirected, without loops."""
    from pyspark.sql import Window

    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    order = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("a"))
    supp = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("b"))
    lines = line.join(supp, line.l_suppkey == supp.s_suppkey).join(order.join(cust, order.o_custkey == cust.c_custkey), line.l_orderkey == order.o_orderkey)
    flow = lines.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    best = flow.withColumn("place", place).where(F.col("place") <= top)
    return best.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("n").alias("orders"))


def populate(vertices: DataFrame, kind: str, seed: int = 1) -> DataFrame:
    """Grid vertices with the weights ``ones``, ``zeros``, ``corners`` (1 at corners, else 0) or ``random`` (1 to 3, from a hash)."""
    if kind in ("ones", "zeros"):
        return vertices.withColumn("weight", F.lit(int(kind == "ones")).cast("long"))
    if kind == "corners":
        ends = vertices.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")])  # one row
        at_end = lambda c: (F.col(c) == F.col(f"min_{c}")) | (F.col(c) == F.col(f"max_{c}"))
        placed = vertices.join(F.broadcast(ends), F.lit(True)).withColumn("weight", F.when(at_end("x") & at_end("y"), 1).otherwise(0).cast("long"))
        return placed.drop(*ends.columns)
    if kind == "random":
        return vertices.withColumn("weight", F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(3)) + 1)
    raise ValueError(kind)
