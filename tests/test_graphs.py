"""Graphs in one row each: the same as from tables of edges, and no edge is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from catalume.operators import graphs as g
from catalume.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    walks = [(str(k), [[f"n{x}" for x in rng.choices(range(9), k=rng.randrange(1, 5))] for _ in range(rng.randrange(1, 7))]) for k in range(80)]
    table = spark.createDataFrame(walks, "k string, walks array<array<string>>")
    return table.repartition(3), sorted({(k, a, b) for k, ws in walks for w in ws for a, b in zip(w, w[1:], strict=False)})


def _same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_graphs_in_rows_equal_tables_of_edges(spark, rows):
    table, want = rows
    edges = spark.createDataFrame(want, "k string, src string, dst string")
    _same(g.edges_of(table, "k"), edges)
    _same(g.undirected_graphs(table, "k"), g.undirected(edges, "k"))
    _same(g.degrees(table, "k"), g.out_degree(edges, "k").join(g.neighbors(edges, "k"), ["k", "node"]).select("k", "node", "out_degree", "n_neighbors"))
    starts = table.withColumn("starts", F.array(F.lit("n1"), F.lit("n4"), F.lit("elsewhere")))
    for directed in (True, False):
        _same(g.reachable_in_graphs(starts, "k", directed=directed), g.reachable(edges, starts.select("k", F.explode("starts").alias("start")), "k", directed=directed).select("k", "start", "node"))


@pytest.mark.parametrize("name", ["g4_undirected", "g5_degrees", "g6_reachable", "g6_reachable_either_way", "g10_node_roles"])
def test_nothing_is_shuffled_behind_the_graphs(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("name", ["g7_remove_isolated", "g8_remove_tails", "g9_overlap_graph"])
def test_lists_join_recipes_and_not_unions(spark, name):
    """Two joins make the unions; lists and graphs of recipes are joined before."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FullOuter")]
    assert above.count("LeftOuter") == 2
