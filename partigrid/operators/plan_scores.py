"""Scores of plans: cut edges, populations, balance, spanning-tree score, contiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partigrid.functions.columns import within
from partigrid.operators.spanning import count_trees
from partigrid.session import materialise


def _ends(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, src, dst, a, b): every edge in every plan with its ends' districts."""
    first = assignment.select("plan_id", F.col("v").alias("src"), F.col("district").alias("a"))
    second = assignment.select("plan_id", F.col("v").alias("dst"), F.col("district").alias("b"))
    return edges.select("src", "dst").join(first, "src").join(second, ["plan_id", "dst"])


def cut_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, src, dst): edges whose ends lie in different districts."""
    return _ends(edges, assignment).where("a <> b").select("plan_id", "src", "dst")


def cut_edge_counts(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, cut_edges) for every plan, 0 where none is cut."""
    return _ends(edges, assignment).groupBy("plan_id").agg(F.count_if(F.col("a") != F.col("b")).alias("cut_edges"))


def inner_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, district, src, dst): the edges of the districts' subgraphs."""
    return _ends(edges, assignment).where("a = b").select("plan_id", F.col("a").alias("district"), "src", "dst")


def populations(vertices: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, district, population)."""
    return assignment.join(vertices.select("v", "weight"), "v").groupBy("plan_id", "district").agg(F.sum("weight").alias("population"))


def balance(vertices: DataFrame, assignment: DataFrame, share: float) -> DataFrame:
    """(plan_id, ideal, largest_gap, balanced): whether every district is within ``share`` of the plan's mean."""
    pop = populations(vertices, assignment)
    ideal = pop.groupBy("plan_id").agg((F.sum("population") / F.count("*")).alias("ideal"))
    gap = F.abs(F.col("population") - F.col("ideal"))
    return pop.join(ideal, "plan_id").groupBy("plan_id", "ideal").agg(F.max(gap).alias("largest_gap"), F.bool_and(within(F.col("population"), F.col("ideal"), share)).alias("balanced"))


def tree_scores(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, score): the product over the districts of how many trees span each; exact, 0 if one is not connected."""
    trees = count_trees(assignment.select("plan_id", "district", "v"), inner_edges(edges, assignment), ["plan_id", "district"])
    one = F.lit(1).cast("decimal(38,0)")
    score = F.aggregate(F.collect_list("trees"), one, lambda a, x: (a * x).cast("decimal(38,0)"))
    return trees.groupBy("plan_id").agg(score.alias("score"))


def plan_scores(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, cut_edges, score)."""
    return cut_edge_counts(edges, assignment).join(tree_scores(edges, assignment), "plan_id")


def components(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, district, v, root): root is the smallest vertex of v's component inside its district.

    Every round each vertex takes the smallest label around it, then the label of its label; a round is an aggregate and two
    joins, cut from its past by a checkpoint. Edges are reduced to those between labels that differ, so rounds get cheaper.
    """
    inner = inner_edges(edges, assignment)
    both = materialise(inner.select("plan_id", F.col("src").alias("v"), F.col("dst").alias("w")).union(inner.select("plan_id", F.col("dst"), F.col("src"))))
    near = both.groupBy("plan_id", "v").agg(F.min("w").alias("near"))
    now = assignment.select("plan_id", "district", "v").join(near, ["plan_id", "v"], "left").select("plan_id", "district", "v", F.least("v", F.coalesce("near", "v")).alias("root"))
    while True:
        label = now.select("plan_id", F.col("v").alias("root"), F.col("root").alias("further"))
        now = materialise(now.join(label, ["plan_id", "root"]).select("plan_id", "district", "v", F.col("further").alias("root")))
        ends = now.select("plan_id", F.col("v").alias("w"), F.col("root").alias("other"))
        apart = both.join(now.select("plan_id", "v", "root"), ["plan_id", "v"]).join(ends, ["plan_id", "w"]).where("root <> other")
        lower = materialise(apart.groupBy("plan_id", "root").agg(F.min("other").alias("other")).where("other < root"))
        if lower.isEmpty():
            return now
        hooked = now.join(lower.withColumnRenamed("root", "v"), ["plan_id", "v"], "left")  # a root takes the smallest root beside its vertices
        now = hooked.select("plan_id", "district", "v", F.least("root", F.coalesce("other", "root")).alias("root"))


def district_components(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(plan_id, district, components): 1 where a district is connected."""
    return components(edges, assignment).groupBy("plan_id", "district").agg(F.countDistinct("root").alias("components"))
