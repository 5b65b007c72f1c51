"""Column expressions on edges, keys, components and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_key(edges: Column) -> Column:
    """Canonical key of a collection of edge positions: its sorted array."""
    return F.array_sort(edges)


def sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def vertex_id(x: Column, y: Column, cols: int, first: int = 0) -> Column:
    """Id of a grid cell; ``first`` = 1 for one-based ids."""
    return x * cols + y + first


def edge_ids(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge's ends as rows (.., v), beside the edges' other columns."""
    return edges.withColumn("v", F.explode(F.array("src", "dst"))).drop("src", "dst")


def dimensions(vertices: DataFrame) -> DataFrame:
    """(rows, cols) of a grid from its coordinates."""
    return vertices.agg((F.max("x") + 1).alias("rows"), (F.max("y") + 1).alias("cols"))


def population_bounds(vertices: DataFrame, k: int, d: float) -> DataFrame:
    """(lower, upper): floor of total weight over k, less and plus d."""
    total = F.sum("weight")
    return vertices.agg(F.floor(total / k - d).cast("long").alias("lower"), F.floor(total / k + d).cast("long").alias("upper"))


def within(pop: Column, ideal: Column, share: float) -> Column:
    """Whether a population is within ``share`` of the ideal one."""
    return F.abs(pop - ideal) <= ideal * share


def keep_probability(paths_one: Column, paths: Column) -> Column:
    """Probability that a uniformly drawn plan keeps an edge: plans below the 1-child over plans below the node."""
    return paths_one.cast("double") / paths.cast("double")


def readable_edge(src: Column, dst: Column) -> Column:
    return F.format_string("%s - %s", src.cast("string"), dst.cast("string"))


def readable_pairs(pairs: Column) -> Column:
    return F.concat_ws(", ", F.transform(pairs, lambda p: F.format_string("%s/%s", p["a"].cast("string"), p["b"].cast("string"))))


def readable_count(paths: Column) -> Column:
    return paths.cast("string")


def laplacian(edges: DataFrame) -> DataFrame:
    """Degree matrix less adjacency matrix as (i, j, val), without zeros."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(F.col("src").alias("i")).agg(F.count("*").cast("int").alias("val")).select("i", F.col("i").alias("j"), "val")
    return degree.unionByName(both.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1).alias("val")))


def drop_row_and_column(matrix: DataFrame, index: int) -> DataFrame:
    """Minor of a matrix (i, j, val): rows and columns other than ``index``."""
    return matrix.where((F.col("i") != index) & (F.col("j") != index))
