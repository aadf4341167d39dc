"""Threshold joins, exact search, medians and lineages against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from catalume.functions.units import score_to_weight
from catalume.operators import hierarchy as h
from catalume.operators import similarity as j
from catalume.operators import threshold as th


def catalog(spark, seed, *, roots=1, recipes=70, deep=4):
    """A random forest whose lines lie at any depth, with copies and one popular branch."""
    rng = random.Random(seed)
    up = {f"r{r}": None for r in range(roots)}
    for depth in range(deep):
        for n in [n for n in up if n.count(".") == depth]:
            up |= {f"{n}.{i}": n for i in range(rng.choice([1, 2, 3]) if depth else 3)}
    names = list(up)
    popular = [n for n in names if n.startswith("r0.1")]
    lines = [(str(r), rng.choice(popular if rng.random() < 0.4 else names)) for r in range(recipes) for _ in range(rng.choice([1, 1, 2, 3, 6]))]
    lines += [(str(recipes + r), n) for r in range(25) for n in ("r0.1", "r0.0.0", "r0.0.0")]  # one recipe that is a quarter of all
    nodes = spark.createDataFrame([(n, p, "Liquor") for n, p in up.items()], "node_id string, parent_id string, kind string")
    return up, lines, nodes, spark.createDataFrame(lines, "recipe_id string, node_id string")


def scores(up, lines):
    """Every pair by definition."""
    path = lambda n: (path(up[n]) if up[n] else []) + [n]
    above = {n: set(path(n)) for n in up}
    one = lambda x, y: 1.0 if x == y else 1 - 0.5 ** (len(above[x] & above[y]) - 1)
    own = {}
    for r, n in lines:
        own.setdefault(r, []).append(n)
    table = {(x, y): one(x, y) for x in up for y in up}
    directed = {(a, b): sum(max(table[x, y] for y in own[b]) for x in own[a]) / len(own[a]) for a in own for b in own}
    return {(a, b): (directed[a, b] + directed[b, a]) / 2 for a in own for b in own}


@pytest.mark.parametrize(("seed", "roots", "score"), [(1, 1, 0.71), (2, 1, 0.52), (3, 2, 0.33), (4, 1, 0.93), (5, 3, 0.999)])
def test_strong_edges_equal_the_definition(spark, monkeypatch, seed, roots, score):
    monkeypatch.setattr(th, "CROWD", 5)  # crowded postings are split
    up, lines, nodes, table = catalog(spark, seed, roots=roots)
    least = spark.range(1).select(score_to_weight(F.lit(score))).first()[0]
    want = {(a, b): s for (a, b), s in scores(up, lines).items() if a < b and s >= score}
    got = {(r.r1, r.r2): r.score for r in th.strong_edges(table, nodes, h.lineage_paths(nodes), min_weight=least).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_strong_edges_ask_for_a_score_above_zero(spark):
    _, _, nodes, table = catalog(spark, 1)
    with pytest.raises(ValueError, match="above 0"):
        th.strong_edges(table, nodes, h.lineage_paths(nodes), min_weight=1e-9)
    assert th.strong_edges(table.limit(0), nodes, h.lineage_paths(nodes), min_weight=0.5).count() == 0


@pytest.mark.parametrize(("seed", "roots", "k"), [(1, 1, 3), (2, 2, 7), (3, 3, 60)])
def test_nearest_equals_the_whole_ranking(spark, seed, roots, k):
    up, lines, nodes, table = catalog(spark, seed, roots=roots)
    by = scores(up, lines)
    names = sorted({r for r, _ in lines}, key=int)
    recipes = spark.createDataFrame([(r, int(r) * 7 % 101) for r in names], "recipe_id string, ord long")
    asked = [r for r in names if int(r) % 5 == 0]
    want = set()
    for q in asked:
        order = sorted((x for x in names if x != q), key=lambda x: (-round(by[q, x], 12), int(x) * 7 % 101))
        want |= {(q, x, round(by[q, x], 12), i + 1) for i, x in enumerate(order[:k])}
    counts = {}
    got = th.nearest(recipes.where(F.col("recipe_id").isin(asked)), recipes, table, nodes, h.lineage_paths(nodes), k=k, counts=counts)
    assert {tuple(r) for r in got.collect()} == want
    assert counts["scored"] < len(asked) * len(names)
    if k == 7:
        assert {tuple(r) for r in j.find_similar(recipes.where(F.col("recipe_id").isin(asked)), recipes, table, nodes, h.lineage_paths(nodes), k=k, block=9).collect()} == want


def test_nearest_looks_at_few_pairs(spark):
    """In a catalog of many branches."""
    rng = random.Random(8)
    up = {"r": None} | {f"r.{i}": "r" for i in range(40)} | {f"r.{i}.{k}": f"r.{i}" for i in range(40) for k in range(10)}
    leaves = [n for n in up if n.count(".") == 2]
    lines = [(str(r), n) for r in range(2000) for n in rng.sample(leaves, 3)]
    nodes = spark.createDataFrame([(n, p, "Liquor") for n, p in up.items()], "node_id string, parent_id string, kind string")
    recipes = spark.range(2000).select(F.col("id").cast("string").alias("recipe_id"), F.col("id").alias("ord"))
    counts = {}
    th.nearest(recipes.where("ord % 100 = 0"), recipes, spark.createDataFrame(lines, "recipe_id string, node_id string"), nodes, h.lineage_paths(nodes), k=3, counts=counts).count()
    assert counts["left"] == 0 and counts["scored"] < 0.1 * 20 * 2000


def test_medians_by_narrowing(spark):
    rng = random.Random(2)
    rows = [("even", float(x)) for x in range(40)] + [("one", 3.0), ("same", 2.0), ("same", 2.0)]
    rows += [("wide", x) for x in [1e-300, -1e300, 1e300, 5.0, 5.0, 7.0, *[rng.lognormvariate(0, 9) for _ in range(300)]]] + [("ties", 1.0)] * 50 + [("ties", float(x)) for x in range(30)]
    rows += [("odd", rng.random()) for _ in range(301)]
    got = {r.node_id: r.median for r in h.medians(spark.createDataFrame(rows, "node_id string, x double"), narrow=4, bins=7).collect()}
    for name in {n for n, _ in rows}:
        assert got[name] == pytest.approx(statistics.median(x for n, x in rows if n == name), rel=1e-15)


def test_deep_lineages_take_few_rounds(spark):
    n = 3000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("node_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    paths = h.lineage_paths(nodes)
    assert paths.agg(F.count(F.lit(1)), F.sum(F.size("path"))).first() == (n, n * (n + 1) // 2)
    assert paths.where(F.col("node_id") == str(n - 1)).first().path == [str(i) for i in range(n)]


def test_best_match_equals_all_lines(spark):
    for roots in (1, 2):
        up, lines, nodes, _ = catalog(spark, 7, roots=roots, recipes=25)
        path = lambda n: (path(up[n]) if up[n] else []) + [n]  # noqa: B023, E731
        own = {}
        for r, n in lines:
            own.setdefault(r, []).append(n)
        table = spark.createDataFrame([(r, i + 1, n) for r, ns in own.items() for i, n in enumerate(ns)], "recipe_id string, pos int, node_id string")
        pairs = [(a, b) for a in own for b in own if (int(a) + int(b)) % 3 == 0]
        want = set()
        for a, b in pairs:
            for i, x in enumerate(own[a]):
                shared = [tuple(p for p, q in zip(path(x), path(y), strict=False) if p == q) for y in own[b]]
                score = [1.0 if x == y else 1 - 0.5 ** (len(s) - 1) for y, s in zip(own[b], shared, strict=True)]
                k = score.index(max(score))
                want.add((a, b, i + 1, x, k + 1, own[b][k], shared[k], score[k]))
        got = j.best_match(spark.createDataFrame(pairs, "r1 string, r2 string"), table, nodes, h.lineage_paths(nodes)).select("r1", "r2", "pos1", "node1", "pos2", "node2", "shared", "score")
        assert {(*r[:6], tuple(r.shared), r.score) for r in got.collect()} == want


@pytest.mark.parametrize(("roots", "tile"), [(1, 7), (2, 7), (1, 1000)])
def test_tiles_score_every_ordered_pair_once(spark, roots, tile):
    up, lines, nodes, table = catalog(spark, 9, roots=roots, recipes=30)
    want = scores(up, lines)
    rows = j.score_tiles(j.packed(table, nodes, h.lineage_paths(nodes)), tile=tile).collect()
    assert len(rows) == len(want)
    assert all(abs((r.k12 + r.k21) / 2 - want[r.r1, r.r2]) < 1e-12 for r in rows)
    directed = {(r.r1, r.r2): r.k12 for r in rows}
    assert all(abs(r.k21 - directed[r.r2, r.r1]) < 1e-12 for r in rows)
    assert j.score_tiles(j.packed(table.limit(0), nodes, h.lineage_paths(nodes))).count() == 0
