"""Plan files: a row per plan, a column per cell with its district; sinks of counts and diagram states; job sweeps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.operators.frontier import count_plans
from partigrid.plans.orders import grid_order
from partigrid.session import numbered
from partigrid.sources import grids


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(plan_id, v, district) of a headerless CSV file: plan_id is the line's number from 0 (empty lines don't count), so equal
    lines are plans of their own; districts are renamed in order of appearance. Any number of files is read in parallel."""
    line = F.transform(F.split(F.trim("value"), r"\s*,\s*"), lambda x: x.try_cast("int"))
    plans = numbered(spark.read.text(path).where(F.trim("value") != ""), "plan_id")
    return plans.select("plan_id", F.posexplode(canonical_districts(line)).alias("v", "district"))


def canonical_districts(labels):
    """Districts renamed 0, 1, .. in order of first appearance: equal for plans that differ in district names only."""
    seen = F.array_distinct(labels)
    return F.transform(labels, lambda d: (F.array_position(seen, d) - 1).cast("int"))


def write_plans(assignment: DataFrame, path: str) -> None:
    """(plan_id, v, district) as one CSV line a plan."""
    line = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("v", "district"))), lambda x: x["district"].cast("string")))
    assignment.groupBy("plan_id").agg(line.alias("line")).select("line").write.mode("overwrite").text(path)


def append_result(df: DataFrame, path: str) -> None:
    """Append result rows (a count and its parameters) to a table of results."""
    df.write.mode("append").parquet(path)


def write_states(nodes: DataFrame, path: str, vertices: list[int]) -> None:
    """Diagram states as tab-separated text with a header: level from 0, edge, cc, fps (pairs that must stay apart), and for
    each of ``vertices`` its component and the weight at that place. Vertices are numbered from 1; 0 stands for none."""
    number = {v: i for i, v in enumerate(vertices, 1)}
    one = lambda v: F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), v)
    at = lambda v: F.array_position("open", F.lit(v)).cast("int")
    of = lambda values, v: F.when(at(v) > 0, F.element_at(values, at(v))).otherwise(F.lit(None))
    arrow = lambda a, b: F.format_string("%d -> %d", one(a), one(b))
    listed = lambda cells: F.concat_ws(", ", *[c.cast("string") for c in cells])
    flat = nodes.select(
        (F.col("level") - 1).alias("level"), arrow(F.col("src"), F.col("dst")).alias("edge"), "cc",
        F.concat_ws(", ", F.transform("pairs", lambda p: arrow(p["a"], p["b"]))).alias("fps"),
        listed([F.coalesce(one(of("labels", v)), F.lit(0)) for v in vertices]).alias("comp_assign"), listed([F.coalesce(of("weights", v), F.lit(0)) for v in vertices]).alias("comp_weights"),
    )
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_states`` wrote."""
    return spark.read.option("sep", "\t").option("header", True).option("emptyValue", "").schema("level int, edge string, cc int, fps string, comp_assign string, comp_weights string").csv(path).fillna("", ["fps"])


def sweep(spark: SparkSession, cases: Iterable[tuple[str, int, int, int | None]]) -> DataFrame:
    """(contiguity, n, k, d, plans) of a job sweep: the count of each case, d None for any sizes, on n x n grids of weight 1."""
    out = None
    for contiguity, n, k, d in cases:
        if contiguity not in ("rook", "queen"):
            raise ValueError(contiguity)
        graph = (grids.queen_grid if contiguity == "queen" else grids.rook_grid)(spark, n, n)
        found = count_plans(spark, graph, k, d, grid_order("queen" if contiguity == "queen" else "diagonal", n, n))
        row = found.select(F.lit(contiguity).alias("contiguity"), F.lit(n).alias("n"), "k", F.lit(d).cast("int").alias("d"), "plans")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "contiguity string, n int, k int, d int, plans decimal(38,0)")
