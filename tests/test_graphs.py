"""Graph operators on Spark: goldens, and comparisons of independent ways."""

import pytest
from pyspark.sql import functions as F

from partigrid.operators import balanced_cuts as bc
from partigrid.operators import chains, diagram, frontier, plan_scores, spanning
from partigrid.plans import orders
from partigrid.session import numbered
from partigrid.sources import grids, plan_files
from partigrid.streaming import tally

DATA = "/root/testdata/sf0.001"
COUNTS = [("rook", 2, 2, None, 6), ("rook", 3, 3, 0, 10), ("rook", 3, 3, 3, 226), ("rook", 4, 4, None, 62741), ("rook", 4, 8, 1, 34444), ("queen", 3, 3, 0, 36), ("queen", 4, 4, 3, 710622), ("rook", 5, 5, 0, 4006)]


def grid(spark, kind, n):
    return (grids.queen_grid if kind == "queen" else grids.rook_grid)(spark, n, n)


@pytest.mark.parametrize("case", COUNTS)
def test_plan_counts(spark, case):
    kind, n, k, d, plans = case
    assert int(frontier.count_plans(spark, grid(spark, kind, n), k, d).first().plans) == plans


@pytest.mark.parametrize("quick", [0, 5, 20_000])
def test_counts_beyond_one_task(spark, monkeypatch, quick):
    monkeypatch.setattr(frontier, "QUICK_STATES", quick)
    monkeypatch.setattr(frontier, "LOCAL_STATES", 20)
    found = frontier.count_by_districts(spark, grid(spark, "rook", 4), (4,), 1, 7)
    assert [(r.k, int(r.plans)) for r in found.collect()] == [(4, 29069)]


def test_small_and_edgeless_graphs(spark):
    one = grids.Graph(grids.grid_vertices(spark, 1, 1), spark.createDataFrame([], "src int, dst int"))
    assert [(r.k, int(r.plans)) for r in frontier.count_by_districts(spark, one).collect()] == [(1, 1)]
    two = grids.Graph(grids.grid_vertices(spark, 1, 2), spark.createDataFrame([], "src int, dst int"))
    assert [(r.k, int(r.plans)) for r in frontier.count_by_districts(spark, two).collect()] == [(2, 1)]
    none = grids.Graph(grids.grid_vertices(spark, 0, 0), spark.createDataFrame([], "src int, dst int"))
    assert frontier.count_by_districts(spark, none).count() == 0


def test_plans_are_listed_once_and_keep_the_bounds(spark):
    g = grid(spark, "rook", 4)
    plans = diagram.enumerate_plans(spark, g, (4,), 0)
    assert plans.count() == 117 == plans.select("districts").distinct().count()
    long = diagram.assignment(plans, g)
    assert plan_scores.populations(g.vertices, long).where("population <> 4").count() == 0
    assert plan_scores.district_components(g.edges, long.where("plan_id < 20")).where("components <> 1").count() == 0


def test_draws_are_uniform_and_agree(spark):
    g = grid(spark, "rook", 3)
    a = diagram.sample_plans(spark, g, 4000, (3,), 0).groupBy("rank").count().collect()
    assert len(a) == 10 and all(300 < r["count"] < 500 for r in a)
    assert diagram.sample_plans(spark, g, 5, (3,)).collect() == diagram.sample_plans(spark, g, 5, (3,)).collect()


def test_diagram_tables(spark):
    made = diagram.build_diagram(spark, grid(spark, "rook", 3), (3,), 0, orders.grid_order("diagonal", 3, 3))
    below = {r.node: int(r.paths) for r in diagram.count_backward(made).collect()}
    assert below == {r.node: int(r.suffix) for r in made.nodes.collect()} and below[0] == 10
    assert diagram.layout(made).count() == 79
    arcs = {(r.parent, r.bit): r.child for r in made.arcs.collect()}
    assert diagram.follow(made, [1, 0]).first().node == arcs[arcs[0, 1], 0]


def test_distributed_diagram_is_the_same(spark):
    g, order = grid(spark, "rook", 3), orders.grid_order("diagonal", 3, 3)
    one, many = (diagram.build_diagram(spark, g, (3,), 0, order, distributed=x) for x in (False, True))
    state = ["level", "src", "dst", "cc", "open", "labels", "weights", "pairs", "prefix", "suffix"]
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert text(one.nodes.select(*state)) == text(many.nodes.select(*state)) and many.nodes.select("node").distinct().count() == 77
    named = lambda m: m.nodes.select("node", F.concat_ws(";", *[F.to_json(F.struct(c)) for c in state]).alias("s"))
    arcs = lambda m: m.arcs.join(named(m).select(F.col("node").alias("parent"), F.col("s").alias("p")), "parent").join(named(m).select(F.col("node").alias("child"), F.col("s").alias("c")), "child", "left").select("p", "bit", F.coalesce("c", F.col("child").cast("string")))
    assert text(arcs(one)) == text(arcs(many))
    plans = [{tuple(r.districts) for r in diagram.enumerate_plans(spark, g, (3,), 0, order, distributed=x).collect()} for x in (False, True)]
    assert plans[0] == plans[1] and len(plans[0]) == 10
    drawn = diagram.sample_plans(spark, g, 300, (3,), 0, order, distributed=True).collect()
    assert {tuple(r.districts) for r in drawn} == plans[0] and len(drawn) == 300


@pytest.mark.parametrize(("rows", "cols", "trees"), [(2, 2, 4), (2, 3, 15), (3, 3, 192), (3, 4, 2415)])
def test_all_trees(spark, rows, cols, trees):
    g = grids.rook_grid(spark, rows, cols)
    listed = spanning.all_trees(spark, g)
    assert listed.select("edges").distinct().count() == trees == listed.count() == listed.agg(F.max("tree_id") + 1).first()[0]
    whole = F.lit(0).alias("g")
    assert int(spanning.count_trees(g.vertices.select(whole, "v"), g.edges.select(whole, "src", "dst"), ["g"]).first().trees) == trees


def path_graph(spark, n, ring=False):
    edges = [(i, i + 1) for i in range(n - 1)] + [(0, n - 1)] * ring
    return grids.Graph(grids.grid_vertices(spark, 1, n), spark.createDataFrame(edges, "src int, dst int"))


def test_trees_of_graphs_with_many_edges(spark):
    assert [r.edges for r in spanning.all_trees(spark, path_graph(spark, 130)).collect()] == [list(range(1, 130))]
    ring = spanning.all_trees(spark, path_graph(spark, 90, ring=True))
    assert ring.select("edges").distinct().count() == 90 and {len(r.edges) for r in ring.collect()} == {89}


def test_tree_counts_are_exact_where_floats_are_not():
    own = orders.grid_order("diagonal", 7, 7)
    assert spanning.tree_count(list(range(49)), own) == 19872369301840986112
    assert spanning.tree_count([3], []) == 1 and spanning.tree_count([1, 2], []) == 0 and spanning.tree_count([], []) == 0


def test_random_trees(spark):
    g = grid(spark, "rook", 3)
    trees = spanning.all_trees(spark, g)
    uniform = spanning.density(spanning.sampled_tree_ids(spanning.random_trees(spark, g, 9600), trees)).collect()
    assert len(uniform) == 192 and sum((r.n - 50) ** 2 / 50 for r in uniform) < 290  # chi-square, 191 degrees of freedom
    light = spanning.sampled_tree_ids(spanning.random_trees(spark, g, 500, "MST"), trees)
    assert light.count() == 500
    large = spanning.random_trees(spark, grid(spark, "queen", 12), 3).collect()
    assert [len(r.edges) for r in large] == [143] * 3 and large == spanning.random_trees(spark, grid(spark, "queen", 12), 3).collect()


def test_random_trees_need_a_connected_graph(spark):
    apart = grids.Graph(grids.grid_vertices(spark, 1, 4), spark.createDataFrame([(0, 1), (2, 3)], "src int, dst int"))
    for graph in (apart, grids.Graph(grids.grid_vertices(spark, 0, 0), spark.createDataFrame([], "src int, dst int"))):
        with pytest.raises(ValueError, match="not connected"):
            spanning.random_trees(spark, graph, 1)
    one = grids.Graph(grids.grid_vertices(spark, 1, 1), spark.createDataFrame([], "src int, dst int"))
    assert [r.edges for r in spanning.random_trees(spark, one, 2).collect()] == [[], []]


def cuts_by_hand(edges, weight, epsilon):
    """Edges whose removal leaves a side within epsilon of half of all, side by side search."""
    total, out = sum(weight.values()), set()
    for e in edges:
        side, todo = set(), [e[0]]
        while todo:
            v = todo.pop()
            if v not in side:
                side.add(v)
                todo += [b if a == v else a for a, b in edges if (a, b) != e and v in (a, b)]
        below = sum(weight[v] for v in side)
        if min(abs(below - total / 2), abs(total - below - total / 2)) <= epsilon * total / 2:
            out.add((min(e), max(e)))
    return out


@pytest.mark.parametrize("by_leaves", [False, True])
def test_balanced_cuts(spark, by_leaves):
    import random

    rng, rows, pops, want = random.Random(4), [], [], set()
    for k in range(30):
        n = rng.randrange(2, 18)
        names = rng.sample(range(100), n)
        edges = [(names[rng.randrange(i)], names[i]) for i in range(1, n)]
        weight = {v: rng.randrange(4) for v in names}
        rows += [(k, *e) for e in edges]
        pops += [(k, v, w) for v, w in weight.items()]
        want |= {(k, *e) for e in cuts_by_hand(edges, weight, 0.3)}
    trees, vertices = spark.createDataFrame(rows, "tree_id int, src int, dst int"), spark.createDataFrame(pops, "tree_id int, v int, weight long")
    found = {(r.tree_id, r.src, r.dst) for r in bc.balanced_cuts(trees, vertices, 0.3, by_leaves=by_leaves).collect()}
    assert found == want and len(want) > 20


def test_both_ways_of_cutting_agree(spark):
    g = grid(spark, "rook", 3)
    trees = spanning.tree_edges(spanning.all_trees(spark, g), orders.edge_order(spark, frontier.small_graph(g)[0]))
    for kind in ("ones", "zeros", "corners", "random"):
        v = grids.populate(g.vertices, kind)
        assert bc.same_cuts(bc.balanced_cuts(trees, v, 0.02), bc.balanced_cuts(trees, v, 0.02, by_leaves=True)).first().same


def test_plan_files_round_trip(spark, tmp_path):
    (tmp_path / "plans.csv").write_text("1,1,2,2\n2,2,1,1\n1,2,1,2\n\n1,2,1,2\n")
    plans = plan_files.read_plans(spark, str(tmp_path / "plans.csv"))
    by_plan = {r.plan_id: r.d for r in plans.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("v", "district"))).alias("d")).collect()}
    assert {k: [x.district for x in d] for k, d in by_plan.items()} == {0: [0, 0, 1, 1], 1: [0, 0, 1, 1], 2: [0, 1, 0, 1], 3: [0, 1, 0, 1]}
    plan_files.write_plans(plans, str(tmp_path / "out"))
    again = plan_files.read_plans(spark, str(tmp_path / "out"))
    assert again.select("plan_id").distinct().count() == 4 and again.drop("plan_id").exceptAll(plans.drop("plan_id")).count() == 0
    plan_files.append_result(plans.limit(1), str(tmp_path / "results"))
    plan_files.append_result(plans.limit(1), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2


def test_numbers_are_dense_over_many_partitions(spark):
    rows = numbered(spark.range(0, 1000, 1, 7).where("id % 3 = 0"), "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(334)) and [r.id for r in rows] == list(range(0, 1000, 3))


def test_states_are_written_as_text(spark, tmp_path):
    made = diagram.build_diagram(spark, grid(spark, "rook", 3), (3,), 0, orders.grid_order("diagonal", 3, 3))
    plan_files.write_states(made.nodes, str(tmp_path / "nodes"), list(range(9)))
    rows = plan_files.read_states(spark, str(tmp_path / "nodes")).collect()
    assert len(rows) == 77
    assert [tuple(r) for r in rows if r.level == 0] == [(0, "1 -> 2", 0, "", ", ".join(["0"] * 9), ", ".join(["0"] * 9))]
    assert {len(r.comp_assign.split(", ")) for r in rows} == {9}


def test_chains_keep_districts_connected_and_balanced(spark):
    g = grids.nation_grid(spark, DATA)
    start = g.vertices.select(F.lit(0).cast("long").alias("plan_id"), "v", "district")
    steps = chains.run_chains(spark, g, start, 2, 60, 0.21)
    assert steps.count() == 120 and steps.select("districts").distinct().count() > 3
    long = diagram.assignment(steps.select((F.col("chain") * 1000 + F.col("step")).alias("plan_id"), "districts"), g)
    assert plan_scores.populations(g.vertices, long).where("population not between 4 and 6").count() == 0
    assert plan_scores.district_components(g.edges, long).where("components <> 1").count() == 0


def test_chains_check_their_first_plan_and_what_is_plugged_in(spark):
    g = grid(spark, "rook", 4)
    halves = g.vertices.select("v", F.when(F.col("x") < 2, 0).otherwise(1).alias("district"))
    split = halves.withColumn("district", F.when(F.col("v").isin(0, 15), 1).otherwise(0))
    with pytest.raises(ValueError, match="not connected"):
        chains.run_chains(spark, g, split, 1, 10)
    with pytest.raises(ValueError, match="constraint"):
        chains.run_chains(spark, g, halves, 1, 10, constraints=(chains.at_most_cut(3),))
    with pytest.raises(ValueError, match="assign"):
        chains.run_chains(spark, g, halves.where("v < 9"), 1, 10)
    free = chains.run_chains(spark, g, halves, 2, 80, 0.5, updaters={"cut": lambda s: len(s.cut_edges()), "large": lambda s: max(s.populations().values())})
    assert free.where("figures['cut'] <> cut_edges or figures['large'] > 12").count() == 0 and free.select("districts").distinct().count() > 5
    few = chains.run_chains(spark, g, halves, 2, 80, 0.5, constraints=(chains.at_most_cut(5),))
    assert few.agg(F.max("cut_edges")).first()[0] <= 5
    stay = chains.run_chains(spark, g, halves, 2, 80, 0.5, accept=lambda now, ahead, rng: False)
    assert stay.select("districts").distinct().count() == 1


def test_distances_have_no_limit(spark):
    far = orders.farthest_pairs(path_graph(spark, 100).edges).collect()
    assert sorted((r.a, r.b, r.length) for r in far) == [(0, 99, 99), (99, 0, 99)]


def test_deep_trees(spark):
    trees = spark.createDataFrame([(7, i, i + 1) for i in range(199)] + [(8, 3, 4)], "tree_id int, src int, dst int")
    rows = bc.rooted(trees).collect()
    assert {(r.v, r.parent, r.depth) for r in rows if r.tree_id == 7} == {(i, i - 1 if i else None, i) for i in range(200)}
    assert len(rows) == 202 and bc.ancestors(trees).where("tree_id = 7").count() == 200 * 201 // 2


def test_many_districts_and_wide_frontiers(spark):
    many = grids.Graph(grids.grid_vertices(spark, 1, 70_000), spark.createDataFrame([], "src int, dst int"))
    assert [(r.k, int(r.plans)) for r in frontier.count_by_districts(spark, many).collect()] == [(70_000, 1)]
    star = grids.Graph(grids.grid_vertices(spark, 1, 301), spark.createDataFrame([(0, i) for i in range(1, 301)], "src int, dst int"))
    assert [int(r.plans) for r in frontier.count_by_districts(spark, star, (2,)).collect()] == [300]


def test_components_of_long_and_split_districts(spark):
    n = 60
    edges = path_graph(spark, n).edges
    plans = spark.createDataFrame([(p, v, d) for p, f in enumerate((lambda v: 0, lambda v: v // 20, lambda v: v % 2, lambda v: (v // 7) % 3)) for v in range(n) for d in [f(v)]], "plan_id long, v int, district int")
    found = {(r.plan_id, r.v): r.root for r in plan_scores.components(edges, plans).collect()}
    for p, f in enumerate((lambda v: 0, lambda v: v // 20, lambda v: v % 2, lambda v: (v // 7) % 3)):
        root = 0
        for v in range(n):
            root = root if v and f(v) == f(v - 1) else v
            assert found[p, v] == root


def test_moved_cells_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", 1, 5, 0), ("2024-01-01 10:59:00", 2, 5, 1), ("2024-01-01 10:59:00", 3, 5, 2), ("2024-01-01 11:00:00", 4, 5, 0), ("2024-01-01 10:30:00", 5, 6, 1)]
    changes = spark.createDataFrame(rows, "ts string, seq long, v int, district int").withColumn("ts", F.col("ts").cast("timestamp"))
    changes.write.parquet(str(tmp_path / "in"))
    stream = tally.moved_cells(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("moved").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r.start), r.v, r.district) for r in spark.table("moved").collect())
    assert got == [("2024-01-01 10:00:00", 5, 2), ("2024-01-01 10:00:00", 6, 1), ("2024-01-01 11:00:00", 5, 0)]
    assert got == sorted((str(r.start), r.v, r.district) for r in tally.moved_cells(changes).collect())


def test_streamed_tally_equals_the_table(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in/a.parquet")
    rows = tally.event_stream(spark, str(tmp_path / "in"))
    q = tally.district_tally(rows, late="400 days").writeStream.outputMode("complete").format("memory").queryName("tally").start()
    q.processAllAvailable()
    q.stop()
    table = tally.district_tally(spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("tally").exceptAll(table).count() == 0 and table.count() == spark.table("tally").count()


def test_rooted_trees(spark):
    trees = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 1, 3), (2, 4, 5)], "tree_id int, src int, dst int")
    rows = {(r.tree_id, r.v): (r.parent, r.depth) for r in bc.rooted(trees).collect()}
    assert rows == {(1, 0): (None, 0), (1, 1): (0, 1), (1, 2): (1, 2), (1, 3): (1, 2), (2, 4): (None, 0), (2, 5): (4, 1)}
    above = sorted((r.v, r.ancestor) for r in bc.ancestors(trees).where("tree_id = 1").collect())
    assert above == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 3)]


def test_readable_nodes(spark):
    made = diagram.build_diagram(spark, grid(spark, "rook", 3), (3,), 0, orders.grid_order("diagonal", 3, 3))
    text = {r.node: r.text for r in diagram.summary(made).collect()}
    assert text[0] == "e_1 0 - 1 cc=0 [] {} paths=10" and len(text) == 77


def test_saved_tables(spark, tmp_path):
    g = grid(spark, "rook", 3)
    trees = spanning.all_trees(spark, g)
    spanning.write_trees(trees, str(tmp_path / "trees"))
    assert spanning.read_trees(spark, str(tmp_path / "trees")).exceptAll(trees).count() == 0
    g.vertices.write.parquet(str(tmp_path / "v"))
    g.edges.union(g.edges.select("dst", "src")).write.parquet(str(tmp_path / "e"))
    again = grids.read_graph(spark, str(tmp_path / "v"), str(tmp_path / "e"))
    assert [int(r.plans) for r in frontier.count_plans(spark, again, 3, 0).collect()] == [10]
