"""What is shuffled grows with the recipes, not with what they are compared by."""

import pytest
from pyspark.sql import functions as F

from catalume.operators import similarity as j
from catalume.plans import queries

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_matches_are_found_where_the_pairs_lie(spark):
    plan = _plan(spark, "j3_best_match")
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("name", ["j2_directed_similarity", "j4_similarity", "j5_score_all"])
def test_tiles_are_read_and_not_shuffled(spark, name):
    """Blocks of recipes are written once; tiles read them."""
    plan = _plan(spark, name)
    assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_pairs_of_recipes_are_dealt_by_tiles(spark):
    """However few bytes the recipes have, their pairs aren't the work of one task; each pair once, by order."""
    recipes = spark.range(120).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("recipe_id"), (F.col("id") * 7 % 120).alias("ord")).coalesce(1)
    pairs = j.recipe_pairs(recipes, block=20)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 6
    order = {f"S{x}": x * 7 % 120 for x in range(120)}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) == 120 * 119 // 2 and all(order[a] < order[b] for a, b in got)


def _held(monkeypatch):
    """The columns of every table that is written in between, by name."""
    from catalume.operators import threshold as th

    seen, write = [], th.stage
    monkeypatch.setattr(th, "stage", lambda df, name: (seen.append((name, df)), write(df, name))[1])
    return seen


def _joins_profiles_last(df):
    """Whether the pairs of a table are scored without another exchange between their meeting and the scoring."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "MapInArrow" in plan and "Aggregate" not in plan[plan.index("MapInArrow") : plan.index("Join")]


@pytest.mark.parametrize(("name", "tables"), [("j8_strong_edges", 1), ("j6_find_similar", 2)])
def test_pairs_are_scored_where_their_postings_meet(spark, monkeypatch, name, tables):
    seen = _held(monkeypatch)
    queries.QUERIES[name](spark, SF)
    met = [df for what, df in seen if what == "met"]
    assert len(met) >= tables and all(df.columns == ["a", "b", "score"] and _joins_profiles_last(df) for df in met)


def test_nearest_keeps_ties_among_the_best(spark):
    """Many equal scores, of which the earliest in order count, though batches keep only a shape's best."""
    from catalume.operators import hierarchy as h
    from catalume.operators import threshold as th

    up = {"r": None} | {f"r.{x}": "r" for x in range(3)} | {f"r.{x}.{y}": f"r.{x}" for x in range(3) for y in range(9)}
    leaves = sorted(n for n in up if n.count(".") == 2)
    lines = [(str(r), leaves[(r * s) % 27]) for r in range(90) for s in (1, 2, 5)]
    nodes = spark.createDataFrame([(n, a, "Liquor") for n, a in up.items()], "node_id string, parent_id string, kind string")
    recipes = spark.createDataFrame([(str(r), r * 31 % 97) for r in range(90)], "recipe_id string, ord long")
    table, paths = spark.createDataFrame(lines, "recipe_id string, node_id string"), h.lineage_paths(nodes)
    asked = recipes.where("ord % 4 = 0")
    got = {tuple(r) for r in th.nearest(asked, recipes, table, nodes, paths, k=4).collect()}
    assert got == {tuple(r) for r in j.find_similar(asked, recipes, table, nodes, paths, k=4).collect()}


def test_shared_edges_are_those_of_the_candidates(spark, monkeypatch):
    """Each pair once, though most share several ancestors and blocks are small; no pair is shuffled behind the scoring."""
    from catalume.sources.catalog import OrderCatalog
    from catalume.operators import hierarchy as h

    monkeypatch.setattr(j, "CROWD", 40)
    t = OrderCatalog(spark, SF)
    paths, lines = h.lineage_paths(t.nodes), t.lines.where("CAST(recipe_id AS INT) < 260")
    want = j.similarity_edges(j.candidate_pairs(lines, t.nodes, paths, 3), lines, t.nodes, paths)
    found = j.shared_edges(lines, t.nodes, paths, 3)
    rounded = lambda df: sorted((r.r1, r.r2, round(r.score, 12), round(r.weight, 9)) for r in df.collect())
    assert rounded(found) == rounded(want)
    plan = _plan(spark, "j8_similarity_edges")
    assert "Exchange" not in plan[: plan.index("CoGroup")]
