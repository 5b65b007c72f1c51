"""Registered queries of the graph operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.functions import columns as fc
from partigrid.operators import balanced_cuts as bc
from partigrid.operators import chains, diagram, frontier, plan_scores, spanning
from partigrid.plans import oracles, orders
from partigrid.session import shared_path
from partigrid.sources import grids, plan_files
from partigrid.streaming import tally

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "cut_edges_by_region"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _districts(graph: grids.Graph) -> DataFrame:
    """The regions as one plan of the nation grid."""
    return graph.vertices.select(F.lit(0).cast("long").alias("plan_id"), "v", "district")


def _nations(spark: SparkSession, sf_dir: str, size: int = 5, **kind) -> grids.Graph:
    return grids.nation_grid(spark, sf_dir, size, **kind)


# Base graphs


@_query("grid_rook_edges", f"with {oracles.cells(5)}, {oracles.edges(5)} select src, dst from edge")
def grid_rook_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).edges


@_query("grid_queen_edges", f"with {oracles.cells(5)}, {oracles.edges(5, True)} select src, dst from edge")
def grid_queen_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir, queen=True).edges


@_query("grid_dimensions", f"with {oracles.cells(5)} select max(x) + 1 as \"rows\", max(y) + 1 as cols from cell")
def grid_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.dimensions(_nations(spark, sf_dir).vertices)


@_query("population_distributions", f"""with {oracles.cells(5)} select v, 1::bigint as ones, 0::bigint as zeros, (x in (0, 4) and y in (0, 4))::bigint as corners from cell""")
def population_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _nations(spark, sf_dir).vertices.select("v", "x", "y")
    for kind in ("ones", "zeros", "corners"):
        out = grids.populate(out, kind).withColumnRenamed("weight", kind)
    return out.drop("x", "y")


@_query("trade_graph", """
with flow as (
  select c_nationkey as a, s_nationkey as b, count(*) as n from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey group by all
), best as (select *, row_number() over (partition by a order by n desc, b) as place from flow)
select least(a, b) as src, greatest(a, b) as dst, sum(n)::bigint as orders from best where place <= 3 group by 1, 2
""")
def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.trade_edges(spark, sf_dir)


# Edge orderings and frontiers


def _ordered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(pos, src, dst) of the nation grid's edges in one of the orders."""
    own = _nations(spark, sf_dir, queen=kind == "queen").edges
    if kind == "native":
        return orders.edge_order(spark, orders.native([(r.src, r.dst) for r in own.collect()]))  # a base graph
    return orders.edge_order(spark, orders.grid_order(kind, 5, 5)).join(own, ["src", "dst"], "left_semi").select("pos", "src", "dst")


def _order(kind: str) -> Query:
    return lambda spark, sf_dir: _ordered(spark, sf_dir, kind)


for _kind in oracles.ORDER_KEYS:
    _query(f"edge_order_{_kind}", f"with {oracles.order(_kind)} select pos, src, dst from ord")(_order(_kind))


@_query("edge_order_is_complete", f"""with {oracles.order('diagonal')}
select (select count(*) from ord) = (select count(*) from edge) and not exists (select src, dst from edge except select src, dst from ord) as same""")
def edge_order_is_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.same_edges(orders.edge_order(spark, orders.grid_order("diagonal", 5, 5)), _nations(spark, sf_dir).edges)


@_query("frontier_by_level", f"with {oracles.frontier()} select pos, v from front")
def frontier_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.frontiers(_ordered(spark, sf_dir, "diagonal"))


_STATS = "select max(w) as max_width, sum(w)::bigint as total_width from (select pos, count(*) as w from front group by pos)"


@_query("frontier_stats", f"with {oracles.frontier()} {_STATS}")
def frontier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.frontier_stats(_ordered(spark, sf_dir, "diagonal"))


_KINDS = ("diagonal", "lines", "boxes_after_side", "boxes_from_corner", "native", "queen")


@_query("frontier_stats_by_order", " union all ".join(f"select '{k}' as kind, * from (with {oracles.frontier(k)} {_STATS})" for k in _KINDS))
def frontier_stats_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in _KINDS:
        own = orders.frontier_stats(_ordered(spark, sf_dir, kind)).select(F.lit(kind).alias("kind"), "max_width", "total_width")
        out = own if out is None else out.unionByName(own)
    return out


@_query("frontier_widths", f"""with {oracles.frontier()} select width, count(*) as levels from (
  select o.pos, count(f.v) as width from ord o left join front f on f.pos = o.pos group by o.pos) group by width""")
def frontier_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.frontier_widths(_ordered(spark, sf_dir, "diagonal"))


@_query("edge_order_min_cut", f"with {oracles.frontier()} select true as same, max_width, total_width from ({_STATS})")
def edge_order_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order by smallest vertex cuts holds every edge, and on a grid it is as narrow as the diagonal sweep."""
    g = _nations(spark, sf_dir)
    order = orders.edge_order(spark, orders.min_cut_order(frontier.small_graph(g)[0]))
    return orders.same_edges(order, g.edges).join(orders.frontier_stats(order), F.lit(True))


@_query("farthest_pairs", f"""with {oracles.cells(5)}, d as (select a.v as a, b.v as b, (abs(a.x - b.x) + abs(a.y - b.y))::int as length from cell a, cell b)
select a, b, length from d where length = (select max(length) from d)""")
def farthest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.farthest_pairs(_nations(spark, sf_dir).edges)


# Laplacians and tree counts

_LAPLACIAN = f"""with {oracles.cells(5)}, {oracles.edges(5)}, both_ as (select src as i, dst as j from edge union all select dst, src from edge),
lap as (select i, i as j, count(*)::int as val from both_ group by i union all select i, j, -1 from both_)"""


@_query("laplacian", f"{_LAPLACIAN} select i, j, val from lap")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.laplacian(_nations(spark, sf_dir).edges)


@_query("laplacian_minor", f"{_LAPLACIAN} select i, j, val from lap where i <> 0 and j <> 0")
def laplacian_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.drop_row_and_column(fc.laplacian(_nations(spark, sf_dir).edges), 0)


def _trees_of(graph: grids.Graph) -> DataFrame:
    whole = F.lit(0).alias("graph")
    return spanning.count_trees(graph.vertices.select(whole, "v"), graph.edges.select(whole, "src", "dst"), ["graph"])


def _closed_form(size: int) -> str:
    """Trees that span a grid: the product of its Laplacian's eigenvalues, which are known, over its number of cells."""
    return f"""select round(exp(sum(ln(4 - 2 * cos(pi() * i / {size}) - 2 * cos(pi() * j / {size})))) / {size * size})::bigint as trees
from range({size}) a(i), range({size}) b(j) where i + j > 0"""


@_query("tree_count_3x3", f"with recursive {oracles.forests(3)} select count(*) as trees from tree")
def tree_count_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees_of(_nations(spark, sf_dir, 3)).select(F.col("trees").cast("long").alias("trees"))


@_query("tree_count_5x5", _closed_form(5))
def tree_count_5x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees_of(_nations(spark, sf_dir)).select(F.col("trees").cast("long").alias("trees"))


@_query("tree_count_float", f"with recursive {oracles.forests(3)} select count(*) as trees from tree")
def tree_count_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, whole = _nations(spark, sf_dir, 3), F.lit(0).alias("graph")
    found = spanning.count_trees(g.vertices.select(whole, "v"), g.edges.select(whole, "src", "dst"), ["graph"], exact=False)
    return found.select(F.round("trees").cast("long").alias("trees"))


# Plans: cut edges, populations, balance, contiguity

_CUT = f"with {oracles.cells(5)}, {oracles.edges(5)}"


@_query("cut_edges_by_region", f"{_CUT} select src, dst from edge join cell a on a.v = src join cell b on b.v = dst where a.district <> b.district")
def cut_edges_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir)
    return plan_scores.cut_edges(g.edges, _districts(g)).select("src", "dst")


@_query("cut_edge_count", f"{_CUT} select count(*) as cut_edges from edge join cell a on a.v = src join cell b on b.v = dst where a.district <> b.district")
def cut_edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir)
    return plan_scores.cut_edge_counts(g.edges, _districts(g)).select("cut_edges")


@_query("district_edges", f"{_CUT} select a.district, src, dst from edge join cell a on a.v = src join cell b on b.v = dst where a.district = b.district")
def district_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir)
    return plan_scores.inner_edges(g.edges, _districts(g)).select("district", "src", "dst")


@_query("district_population", f"with {oracles.cells(5)} select district, sum(weight)::bigint as population from cell group by district")
def district_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir, populated=True)
    return plan_scores.populations(g.vertices, _districts(g)).select("district", "population")


@_query("population_balance", f"""with {oracles.cells(5)}, p as (select district, sum(weight)::bigint as pop from cell group by district), i as (select sum(pop) / count(*) as ideal from p)
select ideal::double as ideal, max(abs(pop - ideal))::double as largest_gap, bool_and(abs(pop - ideal) <= 0.05 * ideal) as balanced from p, i group by ideal""")
def population_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir, populated=True)
    return plan_scores.balance(g.vertices, _districts(g), 0.05).select("ideal", "largest_gap", "balanced")


@_query("population_bounds", f"with {oracles.cells(5)} select floor(sum(weight) / 5 - 15)::bigint as lower, floor(sum(weight) / 5 + 15)::bigint as upper from cell")
def population_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.population_bounds(_nations(spark, sf_dir, populated=True).vertices, 5, 15).select("lower", "upper")


@_query("district_components", f"""
with recursive trade as (select src, dst from ({_SQL['trade_graph']})), link as (
  select t.src as a, t.dst as b from trade t join nation x on x.n_nationkey = t.src join nation y on y.n_nationkey = t.dst where x.n_regionkey = y.n_regionkey
  union select t.dst, t.src from trade t join nation x on x.n_nationkey = t.src join nation y on y.n_nationkey = t.dst where x.n_regionkey = y.n_regionkey
), reach(v, w) as (select n_nationkey, n_nationkey from nation union select r.v, l.b from reach r join link l on l.a = r.w),
root as (select v, min(w) as root from reach group by v)
select n_regionkey as district, count(distinct root) as components from root join nation on n_nationkey = v group by n_regionkey
""")
def district_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit(0).cast("long").alias("plan_id"), F.col("n_nationkey").alias("v"), F.col("n_regionkey").alias("district"))
    return plan_scores.district_components(grids.trade_edges(spark, sf_dir), n).select("district", "components")


# Counting plans


def _all_k(size: int, queen: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = frontier.count_by_districts(spark, _nations(spark, sf_dir, size, queen=queen))
        return found.select("k", F.col("plans").cast("long").alias("plans"))

    return run


for _name, _size, _queen in (("plans_count_3x3_all_k", 3, False), ("plans_count_queen_3x3_all_k", 3, True)):
    _query(_name, f"with recursive {oracles.plans(_size, _queen, 9)} select k::int as k, count(*) as plans from plan group by k")(_all_k(_size, _queen))


def _count(size: int, queen: bool, k: int, d: float | None, populated: bool = False, order: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _nations(spark, sf_dir, size, queen=queen, populated=populated)
        found = frontier.count_plans(spark, g, k, d, orders.grid_order(order, size, size) if order else None)
        return found.select("k", F.col("plans").cast("string").alias("plans"))

    return run


def _counted(size: int, queen: bool, k: int, lower: str = "0", upper: str = "9223372036854775807", weight: str = "1") -> str:
    return f"with recursive {oracles.plans(size, queen, k, lower, upper, weight)} select {k}::int as k, count(*)::varchar as plans from plan where k = {k}"


_query("plans_count_4x4_k2", _counted(4, False, 2))(_count(4, False, 2, None))
_query("plans_count_4x4_balanced", _counted(4, False, 4, "4", "4"))(_count(4, False, 4, 0, order="diagonal"))
_query("plans_count_queen_4x4_balanced", _counted(4, True, 4, "4", "4"))(_count(4, True, 4, 0, order="queen"))
_query("plans_count_3x3_balanced", _counted(3, False, 3, "3", "3"))(_count(3, False, 3, 0, order="lines"))
_bound = lambda sign: f"(select floor(sum(weight) / 3 {sign} 60) from cell)"
_query("plans_count_3x3_populated", _counted(3, False, 3, _bound("-"), _bound("+"), "weight"))(_count(3, False, 3, 60, populated=True))


def _counted_by_states(kind: str, size: int, k: int, *bounds: str, plain: bool = False) -> str:
    return f"""with recursive {oracles.states(kind, size, k, *bounds, plain=plain)}
select {k}::int as k, coalesce(sum(paths), 0)::varchar as plans from state where i = (select count(*) from ord) + 1 and cc = {k}"""


_query("plans_count_5x5_populated", _counted_by_states("diagonal", 5, 5, *(f"(select floor(sum(weight) / 5 {sign} 15) from cell)" for sign in "-+"), "weight"))(_count(5, False, 5, 15, populated=True, order="diagonal"))


@_query("plans_count_5x5_share", _counted_by_states("diagonal", 5, 5, *(f"(select floor(sum(weight) / 5 {sign} 0.1 * sum(weight) / 5) from cell)" for sign in "-+"), "weight"))
def plans_count_5x5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the nations with every district within a tenth of the mean number of customers."""
    g = _nations(spark, sf_dir, populated=True)
    found = frontier.count_plans(spark, g, 5, order=orders.grid_order("diagonal", 5, 5), share=0.1)
    return found.select("k", F.col("plans").cast("string").alias("plans"))


def _unit(queen: bool, size: int, k: int, d: int | None, sql: bool = True) -> None:
    """A count with weight 1: of the nations for a 5x5 grid, of a generated grid beyond."""
    kind = "queen" if queen else "diagonal"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _nations(spark, sf_dir, queen=queen) if size == 5 else (grids.queen_grid if queen else grids.rook_grid)(spark, size, size)
        found = frontier.count_plans(spark, g, k, d, orders.grid_order(kind, size, size))
        return found.select("k", F.col("plans").cast("string").alias("plans"))

    bounds = () if d is None else (str(size * size // k - d), str(size * size // k + d), "1")
    name = f"plans_count_{'queen' if queen else 'rook'}_{size}x{size}_k{k}" + (f"_d{d}" if d is not None else "")
    _query(name, _counted_by_states(kind, size, k, *bounds, plain=size != 5) if sql else None)(run)


for _case in (
    (False, 5, 5, None), (False, 5, 5, 0), (False, 5, 5, 3), (True, 5, 5, None), (True, 5, 5, 0), (True, 5, 5, 3),
    (False, 6, 6, None), (False, 6, 6, 0), (True, 6, 6, None), (False, 6, 9, None), (False, 7, 7, None), (False, 7, 7, 0, False), (False, 8, 8, None, False),
):
    _unit(*_case)

_CASES = (("rook", 3, 2, None), ("rook", 3, 3, 0), ("queen", 3, 3, None), ("rook", 4, 4, 1))


def _case_sql(contiguity: str, n: int, k: int, d: int | None) -> str:
    bounds = () if d is None else (str(n * n // k - d), str(n * n // k + d), "1")
    counted = _counted_by_states("queen" if contiguity == "queen" else "diagonal", n, k, *bounds, plain=True)
    return f"select '{contiguity}' as contiguity, {n}::int as n, k, {'null' if d is None else d}::int as d, plans from ({counted})"


@_query("plan_count_sweep", " union all ".join(_case_sql(*c) for c in _CASES))
def plan_count_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_files.sweep(spark, _CASES).withColumn("plans", F.col("plans").cast("string"))


@_query("appended_counts", " union all ".join(f"select k, plans from ({_counted_by_states('diagonal', 3, k)})" for k in (2, 3, 4)))
def appended_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts appended to a table of results one by one, and read from there."""
    path = shared_path(spark, "counts")
    for k in (2, 3, 4):
        plan_files.append_result(_count(3, False, k, None)(spark, sf_dir), path)
    return spark.read.parquet(path)


# Listing and drawing plans


def _plan_text(plans: DataFrame) -> DataFrame:
    return plans.select(F.concat_ws(",", F.col("districts").cast("array<string>")).alias("districts"))


@_query("plans_enum_3x3", f"with recursive {oracles.plans(3, False, 3)} select {oracles.plan_text(3)} as districts from plan where k = 3")
def plans_enum_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_text(diagram.enumerate_plans(spark, _nations(spark, sf_dir, 3), (3,)))


@_query("plans_enum_4x4_balanced", f"with recursive {oracles.plans(4, False, 4, '4', '4')} select {oracles.plan_text(4)} as districts from plan where k = 4")
def plans_enum_4x4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_text(diagram.enumerate_plans(spark, _nations(spark, sf_dir, 4), (4,), 0, orders.grid_order("diagonal", 4, 4)))


@_query("plan_file_4x4_balanced", f"with recursive {oracles.plans(4, False, 4, '4', '4')} select {oracles.plan_text(4)} as districts from plan where k = 4")
def plan_file_4x4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All balanced plans, written to a plan file and read from there."""
    g, path = _nations(spark, sf_dir, 4), shared_path(spark, "plans")
    plans = diagram.enumerate_plans(spark, g, (4,), 0, orders.grid_order("diagonal", 4, 4))
    plan_files.write_plans(diagram.assignment(plans, g), path)
    cells = plan_files.read_plans(spark, path).groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("v", "district"))).alias("d"))
    return cells.select(F.concat_ws(",", F.col("d.district").cast("array<string>")).alias("districts"))


@_query("sample_plans")
def sample_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.sample_plans(spark, _nations(spark, sf_dir), 1000, (5,), order=orders.grid_order("diagonal", 5, 5))


def _even(drawn: DataFrame, by: str, kinds: int) -> DataFrame:
    """(kinds, draws, even): how many kinds were drawn, and whether their numbers lie within five deviations of the mean each."""
    n = drawn.groupBy(by).agg(F.count("*").alias("n"))
    mean = F.sum("n") / kinds
    return n.agg(F.count("*").alias("kinds"), F.sum("n").alias("draws"), ((F.max("n") < mean + 5 * F.sqrt(mean)) & (F.min("n") > mean - 5 * F.sqrt(mean))).alias("even"))


@_query("sample_plans_fit", f"with recursive {oracles.plans(4, False, 4, '4', '4')} select count(*) as kinds, 20000::bigint as draws, true as even from plan where k = 4")
def sample_plans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform draws of the balanced 4x4 plans reach all of them, about as often each."""
    return _even(diagram.sample_plans(spark, _nations(spark, sf_dir, 4), 20_000, (4,), 0, orders.grid_order("diagonal", 4, 4)), "rank", 117)


@_query("plan_scores_3x3", f"""with recursive {oracles.forests(3)}, scored as (
  select labels, list_sort(list_distinct(labels)) as own, count(*) as score from forest group by labels having len(list_distinct(labels)) = 3
) select array_to_string(list_transform(labels, lambda l: list_position(own, l) - 1), ',') as districts,
  (select count(*) from edge where labels[src + 1] <> labels[dst + 1]) as cut_edges, score from scored""")
def plan_scores_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _nations(spark, sf_dir, 3)
    plans = diagram.enumerate_plans(spark, g, (3,))
    scored = plan_scores.plan_scores(g.edges, diagram.assignment(plans, g))
    text = plans.select("plan_id", F.concat_ws(",", F.col("districts").cast("array<string>")).alias("districts"))
    return scored.join(text, "plan_id").select("districts", "cut_edges", F.col("score").cast("long").alias("score"))


# Diagrams

_D3, _D4 = oracles.diagram("diagonal", 3, 3, "3", "3", "1"), oracles.diagram("diagonal", 4, 4, "4", "4", "1")
_NODES = "node n join ord on ord.pos = n.i"


def _diagram(spark: SparkSession, sf_dir: str, size: int = 3, d: float | None = 0) -> diagram.Diagram:
    return diagram.build_diagram(spark, _nations(spark, sf_dir, size), (size,), d, orders.grid_order("diagonal", size, size))


def _state(nodes: DataFrame) -> DataFrame:
    """Nodes with their state as text, which identifies them in any numbering."""
    cells = F.concat_ws(" ", F.zip_with("open", "labels", lambda v, c: F.format_string("%d:%d", v, c)))
    pairs = F.concat_ws(", ", F.transform("pairs", lambda p: F.format_string("%d/%d", p["a"], p["b"])))
    text = F.format_string("%d %d - %d %d [%s] {%s} (%s)", "level", "src", "dst", "cc", cells, pairs, F.concat_ws(" ", F.col("weights").cast("array<string>")))
    return nodes.withColumn("state", text)


def _level_sizes(size: int) -> Query:
    return lambda spark, sf_dir: diagram.level_sizes(_diagram(spark, sf_dir, size))


for _size, _cte in ((3, _D3), (4, _D4)):
    _query(f"zdd_level_sizes_{_size}x{_size}", f"with recursive {_cte} select i as level, count(*) as nodes from node group by i")(_level_sizes(_size))


@_query("zdd_size_4x4", f"with recursive {_D4} select count(*) + 2 as nodes from node")
def zdd_size_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.size(_diagram(spark, sf_dir, 4))


@_query("zdd_size_unbounded_4x4", f"with recursive {oracles.diagram('diagonal', 4, 4)} select count(*) + 2 as nodes from node")
def zdd_size_unbounded_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.size(_diagram(spark, sf_dir, 4, None))


@_query("zdd_size_5x5", f"with recursive {oracles.diagram('diagonal', 5, 5, '5', '5', '1')} select count(*) + 2 as nodes from node")
def zdd_size_5x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.size(_diagram(spark, sf_dir, 5))


@_query("zdd_size_unbounded_5x5", f"with recursive {oracles.diagram('diagonal', 5, 5)} select count(*) + 2 as nodes from node")
def zdd_size_unbounded_5x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.size(_diagram(spark, sf_dir, 5, None))


@_query("zdd_paths_backward_3x3", f"with recursive {_D3} select {oracles.node_text()} as state, coalesce(below.paths, 0)::bigint as plans from {_NODES} left join below on below.key = n.key")
def zdd_paths_backward_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _diagram(spark, sf_dir)
    return _state(made.nodes).join(diagram.count_backward(made), "node").select("state", F.col("paths").cast("long").alias("plans"))


@_query("zdd_states_3x3", f"""with recursive {_D3} select {oracles.node_text()} as state, n.paths::bigint as prefix, coalesce(below.paths, 0)::bigint as suffix
from {_NODES} left join below on below.key = n.key""")
def zdd_states_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_diagram(spark, sf_dir).nodes).select("state", F.col("prefix").cast("long").alias("prefix"), F.col("suffix").cast("long").alias("suffix"))


@_query("zdd_states_by_level_3x3", _SQL["zdd_states_3x3"])
def zdd_states_by_level_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from the diagram that is built level by level over the cluster."""
    made = diagram.build_diagram(spark, _nations(spark, sf_dir, 3), (3,), 0, orders.grid_order("diagonal", 3, 3), distributed=True)
    return _state(made.nodes).select("state", F.col("prefix").cast("long").alias("prefix"), F.col("suffix").cast("long").alias("suffix"))


@_query("zdd_state_dump_3x3", f"""with recursive {_D3} select n.i - 1 as level, (ord.src + 1) || ' -> ' || (ord.dst + 1) as edge, cc,
  array_to_string(list_transform(bad, lambda p: (p // 1000 + 1) || ' -> ' || (p % 1000 + 1)), ', ') as fps,
  array_to_string(list_transform(comp, lambda c: c + 1), ', ') as comp_assign, array_to_string(list_transform(wts, lambda w: w), ', ') as comp_weights from {_NODES}""")
def zdd_state_dump_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states written as text and read from there."""
    path = shared_path(spark, "states")
    plan_files.write_states(_diagram(spark, sf_dir).nodes, path, list(range(9)))
    return plan_files.read_states(spark, path)


@_query("zdd_layout_3x3", f"""with recursive {_D3}, placed as (
  select i as level, row_number() over (partition by i order by key) as place, count(*) over (partition by i) as nodes from node
)
select row_number() over (order by level, place) - 1 as node, level, place * 100.0::double / (nodes + 1) as x, level::double as y, 'e_' || level as label from placed
union all select -2, 13, 100.0::double / 3, 13, '0' union all select -1, 13, 200.0::double / 3, 13, '1'""")
def zdd_layout_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.layout(_diagram(spark, sf_dir))


@_query("zdd_arcs_3x3", f"""with recursive {_D3}, named as (select n.key, {oracles.node_text()} as state from {_NODES})
select p.state as parent, bit, case child when 'yes' then '1' when 'no' then '0' else c.state end as child, case bit when 0 then 'red' else 'green' end as color, case bit when 0 then 'dashed' else 'solid' end as style
from arc join named p on p.key = arc.parent left join named c on c.key = arc.child""")
def zdd_arcs_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _diagram(spark, sf_dir)
    named = _state(made.nodes)
    arcs = diagram.coloured_arcs(made).join(named.select(F.col("node").alias("parent"), F.col("state").alias("from")), "parent")
    arcs = arcs.join(named.select(F.col("node").alias("child"), F.col("state").alias("to")), "child", "left")
    end = F.when(F.col("child") == diagram.ACCEPT, "1").when(F.col("child") == diagram.REJECT, "0").otherwise(F.col("to"))
    return arcs.select(F.col("from").alias("parent"), "bit", end.alias("child"), "color", "style")


@_query("zdd_walk_3x3", f"""with recursive {_D3}, walk(step, key) as (
  select 0, key from node where i = 1 union all select step + 1, child from walk join arc on arc.parent = walk.key and arc.bit = [1, 0, 1][step + 1] where step < 3
) select {oracles.node_text()} as state from walk join {_NODES} on n.key = walk.key where step = 3""")
def zdd_walk_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _diagram(spark, sf_dir)
    return _state(made.nodes).join(diagram.follow(made, [1, 0, 1]), "node", "left_semi").select("state")


@_query("zdd_summary_3x3", f"""with recursive {_D3} select 'e_' || n.i || ' ' || ord.src || ' - ' || ord.dst || ' cc=' || cc || ' ['
  || array_to_string(list_transform(list_filter(range(9), lambda v: comp[v + 1] >= 0), lambda v: v || ':' || comp[v + 1]), ' ') || '] {{'
  || array_to_string(list_transform(bad, lambda p: (p // 1000) || '/' || (p % 1000)), ', ') || '}} paths=' || coalesce(below.paths, 0) as text
from {_NODES} left join below on below.key = n.key""")
def zdd_summary_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.summary(_diagram(spark, sf_dir)).select("text")


@_query("zdd_root_keep_probability_3x3", f"""with recursive {oracles.plans(3, False, 3, '3', '3')}
select count_if(len(list_filter(blocks, lambda b: (b & 3) = 3)) = 1) / count(*) as probability from plan where k = 3""")
def zdd_root_keep_probability_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.keep_probabilities(_diagram(spark, sf_dir)).where("node = 0").select("probability")


# Trees that span a graph


def _trees(spark: SparkSession, sf_dir: str, size: int = 3) -> DataFrame:
    """(tree_id, edges, mask) of the nations' trees; bit i of the mask is the edge at position i + 1."""
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e - 1)
    mask = F.aggregate("edges", F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(bit(e)))
    return spanning.all_trees(spark, _nations(spark, sf_dir, size)).withColumn("mask", mask)


def _native(spark: SparkSession, graph: grids.Graph) -> DataFrame:
    return orders.edge_order(spark, frontier.small_graph(graph)[0])


@_query("tree_list_3x3", f"with recursive {oracles.forests(3)} select mask from tree")
def tree_list_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir).select("mask")


@_query("saved_trees_3x3", f"with recursive {oracles.forests(3)} select mask from tree")
def saved_trees_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of trees, written and read again."""
    path = shared_path(spark, "trees")
    trees = _trees(spark, sf_dir)
    spanning.write_trees(trees.select("tree_id", "edges"), path)
    return spanning.read_trees(spark, path).join(trees.select("tree_id", "edges", "mask"), ["tree_id", "edges"]).select("mask")


_SEED = "(select min(mask) from tree)"


@_query("tree_layers_3x3", f"with recursive {oracles.forests(3)} select mask, bit_count(mask & ~{_SEED})::int as layer from tree")
def tree_layers_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = _trees(spark, sf_dir)
    least = trees.agg(F.min_by("tree_id", "mask")).first()[0]
    return spanning.tree_layers(trees, least).join(trees.select("tree_id", "mask"), "tree_id").select("mask", "layer")


@_query("tree_layer_sizes_3x3", f"""with recursive {oracles.forests(3)}, l as (select bit_count(mask & ~{_SEED})::int as layer from tree)
select layer, count(*) as trees from l group by rollup (layer)""")
def tree_layer_sizes_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanning.layer_sizes(tree_layers_3x3(spark, sf_dir))


@_query("tree_neighbours_3x3", f"with recursive {oracles.forests(3)} select a.mask as mask, b.mask as other from tree a, tree b where bit_count(xor(a.mask, b.mask)) = 2")
def tree_neighbours_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = _trees(spark, sf_dir)
    names = trees.select(F.col("tree_id").alias("other_id"), F.col("mask").alias("other"))
    return spanning.tree_neighbours(trees, 12).join(trees.select("tree_id", "mask"), "tree_id").join(names, "other_id").select("mask", "other")


@_query("tree_missing_edges_3x3", f"with recursive {oracles.forests(3)} select mask, (i + 1)::int as edge from tree, numbered where (mask >> i) & 1 = 0")
def tree_missing_edges_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = _trees(spark, sf_dir)
    return spanning.missing_edges(trees, 12).join(trees.select("tree_id", "mask"), "tree_id").select("mask", "edge")


@_query("tree_list_4x4_count", _closed_form(4))
def tree_list_4x4_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanning.all_trees(spark, _nations(spark, sf_dir, 4)).agg(F.count("*").alias("trees"))


_WALK = f"""with recursive {oracles.forests(3)}, link as (
  select mask, n.src as a, n.dst as b from tree join numbered n on (mask >> n.i) & 1 = 1 union all select mask, n.dst, n.src from tree join numbered n on (mask >> n.i) & 1 = 1
), walk(mask, v, parent, depth) as (
  select mask, 0, null::int, 0 from tree union all
  select l.mask, l.b, l.a, w.depth + 1 from walk w join link l on l.mask = w.mask and l.a = w.v and (w.parent is null or l.b <> w.parent)
)"""


@_query("rooted_trees_3x3", f"{_WALK} select mask, v, parent, depth from walk")
def rooted_trees_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees, order = _trees(spark, sf_dir), _native(spark, _nations(spark, sf_dir, 3))
    found = bc.rooted(spanning.tree_edges(trees.select("tree_id", "edges"), order))
    return found.join(trees.select("tree_id", "mask"), "tree_id").select("mask", "v", "parent", "depth")


@_query("tree_ancestors_3x3", f"{_WALK}, up(mask, v, ancestor) as (select mask, v, v from walk union all select u.mask, u.v, w.parent from up u join walk w on w.mask = u.mask and w.v = u.ancestor where w.parent is not null) select mask, v, ancestor from up")
def tree_ancestors_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees, order = _trees(spark, sf_dir), _native(spark, _nations(spark, sf_dir, 3))
    found = bc.ancestors(spanning.tree_edges(trees.select("tree_id", "edges"), order))
    return found.join(trees.select("tree_id", "mask"), "tree_id").select("mask", "v", "ancestor")


def _drawn(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    drawn = spanning.random_trees(spark, _nations(spark, sf_dir, 3), 20_000, kind)
    return spanning.sampled_tree_ids(drawn, _trees(spark, sf_dir))


for _kind in ("UST", "MST"):
    _query(f"sample_{_kind.lower()}")(lambda spark, sf_dir, kind=_kind: spanning.density(_drawn(spark, sf_dir, kind)))


@_query("sample_ust_fit", f"with recursive {oracles.forests(3)} select count(*) as kinds, 20000::bigint as draws, true as even from tree")
def sample_ust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform random trees reach every tree of the list, about as often each."""
    return _even(_drawn(spark, sf_dir, "UST"), "tree_id", 192)


@_query("sample_mst_fit", "select 20000::bigint as draws, 1.0::double as share, true as listed")
def sample_mst_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightest trees under random weights are trees of the list; their shares add up to one."""
    d = spanning.density(_drawn(spark, sf_dir, "MST"))
    return d.agg(F.sum("n").alias("draws"), F.round(F.sum("share"), 9).alias("share"), (F.count("*") <= 192).alias("listed"))


@_query("random_trees_8x8", "select i::bigint as trial, 63::bigint as edges, 1::bigint as trees from range(20) t(i)")
def random_trees_8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random trees of a grid of 112 edges: each has 63, and as a graph exactly one tree that spans it."""
    g = grids.rook_grid(spark, 8, 8)
    drawn = spanning.random_trees(spark, g, 20)
    own = spanning.tree_edges(drawn, _native(spark, g))
    every = drawn.select("trial").join(F.broadcast(g.vertices.select("v")), F.lit(True))  # 64 vertices
    trees = spanning.count_trees(every, own, ["trial"]).withColumn("trees", F.col("trees").cast("long"))
    return own.groupBy("trial").agg(F.count("*").alias("edges")).join(trees, "trial")


def _balanced(kind: str, weight: str, by_leaves: bool = False) -> None:
    """Balanced cuts of all trees of the 3x3 grid under one population."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _nations(spark, sf_dir, 3, populated=kind == "customers")
        v = g.vertices if kind == "customers" else grids.populate(g.vertices, kind)
        trees = _trees(spark, sf_dir)
        own = spanning.tree_edges(trees.select("tree_id", "edges"), _native(spark, g))
        cuts = bc.balanced_cuts(own, v, 0.3, by_leaves=by_leaves)
        ends = F.least("below", "above").cast("long"), F.greatest("below", "above").cast("long")
        return cuts.join(trees.select("tree_id", "mask"), "tree_id").select("mask", "src", "dst", ends[0].alias("low"), ends[1].alias("high"))

    total = "(select sum(w) from c)"
    _query(f"balanced_cuts_{kind}" + "_by_leaves" * by_leaves, f"""with recursive {oracles.forests(3)}, c as (select v, ({weight})::bigint as w from cell), link as (
  select mask, n.src, n.dst, n.i from tree join numbered n on (mask >> n.i) & 1 = 1
), reach(mask, i, v) as (
  select mask, i, dst from link
  union
  select r.mask, r.i, case when l.src = r.v then l.dst else l.src end from reach r join link l on l.mask = r.mask and l.i <> r.i and (l.src = r.v or l.dst = r.v)
), side as (select mask, i, sum(w) as below from reach join c on c.v = reach.v group by mask, i)
select l.mask, l.src, l.dst, least(below, {total} - below)::bigint as low, greatest(below, {total} - below)::bigint as high from side s join link l on l.mask = s.mask and l.i = s.i
where abs(below - {total} / 2) <= 0.3 * ({total} / 2) or abs({total} - below - {total} / 2) <= 0.3 * ({total} / 2)""")(run)


_balanced("ones", "1")
_balanced("zeros", "0")
_balanced("corners", "case when x in (0, 2) and y in (0, 2) then 1 else 0 end")
_balanced("customers", "weight")
_balanced("customers", "weight", by_leaves=True)


@_query("balanced_cuts_agree", "select true as same")
def balanced_cuts_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracting leaves and adding up subtrees find the same cuts."""
    g = _nations(spark, sf_dir, 3, populated=True)
    own = spanning.tree_edges(_trees(spark, sf_dir).select("tree_id", "edges"), _native(spark, g))
    return bc.same_cuts(bc.balanced_cuts(own, g.vertices, 0.3), bc.balanced_cuts(own, g.vertices, 0.3, by_leaves=True))


# Chains and streams


def _chains(spark: SparkSession, sf_dir: str, **more) -> tuple[grids.Graph, DataFrame]:
    g = _nations(spark, sf_dir, populated=True)
    return g, chains.run_chains(spark, g, _districts(g), 4, 250, 0.25, **more)


@_query("markov_chain")
def markov_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir)[1].select("chain", "step", "cut_edges", F.concat_ws(",", F.col("districts").cast("array<string>")).alias("districts"))


@_query("markov_chain_valid", "select i::bigint as chain, 250::bigint as steps, true as balanced, true as connected, true as counted, true as few_cut from range(4) t(i)")
def markov_chain_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step keeps the population bounds, connected districts and the constraint; figures agree with the scores of its plan."""
    limits = {"constraints": (chains.within_share(0.25), chains.at_most_cut(26)), "updaters": {"cut": lambda step: len(step.cut_edges())}}
    g, found = _chains(spark, sf_dir, **limits)
    steps = found.withColumn("plan_id", F.col("chain") * 1000 + F.col("step"))
    plans = diagram.assignment(steps.select("plan_id", "districts"), g)
    valid = plan_scores.balance(g.vertices, plans, 0.25).select("plan_id", "balanced").join(plan_scores.cut_edge_counts(g.edges, plans).withColumnRenamed("cut_edges", "own"), "plan_id")
    whole = plan_scores.district_components(g.edges, plans).groupBy("plan_id").agg(F.bool_and(F.col("components") == 1).alias("connected"))
    rows = steps.join(valid, "plan_id").join(whole, "plan_id")
    counted = (F.col("own") == F.col("cut_edges")) & (F.col("figures")["cut"] == F.col("own"))
    return rows.groupBy("chain").agg(F.count("*").alias("steps"), F.bool_and("balanced").alias("balanced"), F.bool_and("connected").alias("connected"), F.bool_and(counted).alias("counted"), F.bool_and(F.col("own") <= 26).alias("few_cut"))


@_query("moved_cells", """select time_bucket(interval 1 hour, ts) as start, (user_id % 25)::int as v, arg_max(event_id % 5, (ts, event_id))::int as district from events group by 1, 2""")
def moved_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last district of each cell an hour, from events that reassign it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("user_id") % 25).cast("int").alias("v"), (F.col("event_id") % 5).cast("int").alias("district"))
    return tally.moved_cells(changes).withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("district_event_tally", """select time_bucket(interval 1 hour, ts) as start, (user_id % 25 % 5)::int as district, count(*) as events from events group by 1, 2""")
def district_event_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tally.district_tally(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "district", "events")
