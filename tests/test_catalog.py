import json
import math
import random

import pytest
from pyspark.sql import functions as F

from catalume.functions import units
from catalume.operators import graphs as g
from catalume.operators import hierarchy as h
from catalume.operators import nodes as p
from catalume.operators import similarity as j
from catalume.operators import strength as a
from catalume.sources import catalog

V = lambda x, u="mL": {"amount": float(x), "unit": u}
NODES = [
    ("root", None, "Ingredient"), ("Liquor", "root", "Ingredient"), ("Gin", "Liquor", "Liquor"), ("Gin A", "Gin", "Liquor"), ("Gin B", "Gin", "Liquor"), ("Rum", "Liquor", "Liquor"),
    ("Juice", "root", "Ingredient"), ("Lemon", "Juice", "Juice"), ("Lime", "Juice", "Juice"), ("Bitters", "root", "Bitters"), ("Orange Bitters", "Bitters", "Bitters"), ("Cherry", "root", "Garnish"), ("Coffee", "root", "Ingredient"),
]
RECIPES = {
    "1": [("Gin A", 2, "oz"), ("Lemon", 1, "oz"), ("Cherry", 1, "count")],
    "2": [("Gin B", 2, "oz"), ("Lime", 1, "oz"), ("Orange Bitters", 2, "dash")],
    "3": [("Gin", 1, "oz"), ("Rum", 1, "oz"), ("Gin", 1, "oz")],
    "4": [("Cherry", 1, "count"), ("Orange Bitters", 1, "dash")],
    "5": [("Coffee", 1, "oz")],
    "6": [("Gin A", 1, "bucket")],
}


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    class Tables:
        pass

    folder = tmp_path_factory.mktemp("catalog")
    (folder / "nodes.json").write_text("\n".join(json.dumps({"node_id": n, "parent_id": up, "name": n, "kind": k, "ord": i, "unit_cost": 10.0 + i if n in ("Gin A", "Gin B", "Rum", "Lemon", "Cherry") else None, "unit_volume": V(750), "unit_count": 4, "volume_per_count": V(30)}) for i, (n, up, k) in enumerate(NODES)))
    (folder / "recipes.json").write_text("\n".join(json.dumps({"recipe_id": r, "ord": int(r), "name": "No. " + r, "ingredients": [{"node": n, "amount_unit": V(x, u)} for n, x, u in lines]}) for r, lines in RECIPES.items()))
    out = Tables()
    out.nodes = catalog.load_nodes(spark, str(folder / "nodes.json"))
    out.recipes = catalog.load_recipes(spark, str(folder / "recipes.json"))
    out.lines = catalog.explode_lines(out.recipes)
    out.paths = h.lineage_paths(out.nodes)
    out.folder = folder
    return out


UP = {n: up for n, up, _ in NODES}
KIND = {n: k for n, _, k in NODES}


def path(n):
    return (path(UP[n]) if UP[n] else []) + [n]


def score(x, y):
    return 1.0 if x == y else 1 - 0.5 ** (len(set(path(x)) & set(path(y))) - 1)


def scorable(r):
    return [n for n, *_ in RECIPES[r] if KIND[n] not in ("Garnish", "Bitters")]


def directed(r1, r2):
    return sum(max(score(x, y) for y in scorable(r2)) for x in scorable(r1)) / len(scorable(r1))


def test_lineage_and_distances(t):
    assert {r.node_id: r.path for r in t.paths.collect()} == {n: path(n) for n in UP}
    pairs = t.nodes.sparkSession.createDataFrame([(x, y) for x in UP for y in UP], "a string, b string")
    for r in h.with_paths(pairs, t.paths).select("a", "b", h.tree_distance("path_a", "path_b").alias("d"), h.shared_depth("path_a", "path_b").alias("s")).collect():
        assert r.d == len(set(path(r.a)) ^ set(path(r.b))) and r.s == len(set(path(r.a)) & set(path(r.b)))
    assert {(r.src, r.dst) for r in h.subtree_edges(t.paths, "Liquor").collect()} == {("Liquor", "Gin"), ("Gin", "Gin A"), ("Gin", "Gin B"), ("Liquor", "Rum")}


def test_cycles_raise(spark):
    with pytest.raises(ValueError, match="cycle"):
        h.lineage_paths(spark.createDataFrame([("r", None), ("a", "b"), ("b", "a")], "node_id string, parent_id string"))


def test_similarity_equals_the_definition(t):
    got = {(r.r1, r.r2): r.score for r in j.directed_similarity(t.lines, t.nodes, t.paths).collect()}
    some = [r for r in RECIPES if scorable(r)]
    assert set(got) == {(x, y) for x in some for y in some}
    for (x, y), s in got.items():
        assert s == pytest.approx(directed(x, y), abs=1e-12)


def test_find_similar_ranks_and_ties(t):
    got = [(r.r2, r.score) for r in j.find_similar(t.recipes.where("recipe_id = '1'"), t.recipes, t.lines, t.nodes, t.paths).orderBy("rank").collect()]
    want = sorted(((r, round((directed("1", r) + directed(r, "1")) / 2, 12)) for r in RECIPES if r != "1" and scorable(r)), key=lambda x: (-x[1], int(x[0])))
    assert got == want


@pytest.mark.parametrize("roots", [1, 2])
def test_the_best_k_are_the_first_of_the_whole_ranking(spark, roots):
    rng = random.Random(roots)
    nodes = [(f"r{r}", None, "Liquor") for r in range(roots)]
    for depth in range(4):
        nodes += [(f"{n}.{i}", n, "Liquor") for n, *_ in nodes if n.count(".") == depth for i in range(2 if depth else 3)]
    lines = [(str(r), rng.choice(nodes)[0]) for r in range(60) for _ in range(rng.choice([1, 1, 2, 5]))] + [(str(r), "r0.1") for r in range(60, 64)] + [(str(r), "r0.1.0.0.0") for r in range(64, 66)]
    nodes, lines = spark.createDataFrame(nodes, "node_id string, parent_id string, kind string"), spark.createDataFrame(lines, "recipe_id string, node_id string")
    recipes, paths = spark.range(66).select(F.col("id").cast("string").alias("recipe_id"), F.col("id").alias("ord")), h.lineage_paths(nodes)
    whole = j.find_similar(recipes, recipes, lines, nodes, paths)
    want = {tuple(r) for r in whole.where("rank <= 4").collect()}
    assert {tuple(r) for r in j.find_similar(recipes, recipes, lines, nodes, paths, k=4, block=20).collect()} == want
    if roots == 1:
        assert whole.count() == 66 * 65 and {r.score == 0 for r in whole.where("r1 = r2 OR score = 0").collect()} == {True}  # those that share only the root are listed


def test_forests_score_minus_one(spark):
    nodes = spark.createDataFrame([("a", None, "Liquor"), ("b", None, "Liquor")], "node_id string, parent_id string, kind string")
    lines = spark.createDataFrame([("1", "a"), ("2", "b")], "recipe_id string, node_id string")
    pairs = spark.createDataFrame([("1", "2")], "r1 string, r2 string")
    assert j.directed_similarity(lines, nodes, h.lineage_paths(nodes), candidates=pairs).first().score == -1


def test_best_match_prefers_the_first_of_equals(t):
    pairs = t.nodes.sparkSession.createDataFrame([("1", "3")], "r1 string, r2 string")
    first = j.best_match(pairs, t.lines, t.nodes, t.paths).orderBy("pos1").first()
    assert (first.node1, first.node2, first.pos2, first.shared) == ("Gin A", "Gin", 1, ["root", "Liquor", "Gin"])


def test_strength(t):
    rated = p.with_kind_defaults(t.nodes.withColumn("abv_stated", F.lit(None).cast("double")))
    got = {r.recipe_id: r.abv for r in a.recipe_abv(t.lines, rated).collect()}
    assert got["1"] == pytest.approx(0.8 / 3) and got["5"] is None and math.isnan(got["6"])
    dash = 2 / 1.62 / 29.57
    assert got["2"] == pytest.approx((0.8 + dash * 0.4) / (3 + dash))


def test_costs_and_guesses(t):
    priced = p.with_costs(t.nodes)
    got = {r.node_id: (r.cost_oz, r.cost_count) for r in priced.collect()}
    assert got["Gin A"][0] == pytest.approx(13 / (750 / 29.57)) and got["Lemon"][0] == pytest.approx(17 / 4 / (30 / 29.57)) and got["Cherry"][1] == pytest.approx(21 / 4)
    guess = {r.node_id: r.cost_oz_guess for r in h.cost_guess(priced, t.paths).collect()}
    assert guess["Gin"] == round((13 + 14) / 2 / (750 / 29.57), 2) and "Lime" not in guess


def test_labels_and_weights(spark):
    row = spark.range(1).select(*[units.measure_label(F.lit(x), F.lit(u)).alias(f"c{i}") for i, (x, u) in enumerate([(1.0, "dash"), (2.0, "dash"), (0.75, "oz"), (2.0, "count")])]).first()
    assert list(row) == ["1 dash", "2 dashes", "0.75 oz", "2 "]
    weights = spark.createDataFrame([(0.0,), (0.5,), (0.7,), (1.0,)], "x double").select(units.score_to_weight("x").alias("w")).collect()
    assert [w.w for w in weights] == pytest.approx([9.461646686636919e-08, 0.009747190309736763, 0.5, 0.9990243902439024])
    assert [r[0] for r in spark.createDataFrame([(0.12345,), (None,)], "x double").select(units.percent_label("x", 1)).collect()] == ["12.3%", None]


def test_overlap_graphs_keep_their_properties(t):
    pairs = t.nodes.sparkSession.createDataFrame([("1+2", "1", "2"), ("1+3", "1", "3")], "pair_id string, r1 string, r2 string")
    graphs, lists = g.packed_graphs(t.lines, t.nodes, t.paths), p.recipe_ingredients(t.lines, t.nodes)
    whole = {tuple(r) for r in g.union_graph(pairs, graphs).collect()}
    got = g.overlap_graph(pairs, graphs, lists).collect()
    assert {(r.pair_id, r.src, r.dst) for r in got} <= whole and not any("root" in (r.src, r.dst) for r in got)
    role = {(r.pair_id, r.src): r.src_role for r in got} | {(r.pair_id, r.dst): r.dst_role for r in got}
    assert role["1+2", "Gin"] == "top" and role["1+2", "R:1"] == "recipe1" and role["1+2", "Gin A"] == "recipe1_ingredient"
    with pytest.raises(Exception, match="one recipe twice"):
        g.overlap_graph(pairs.withColumn("r2", F.col("r1")), graphs, lists).collect()


def brute_isolated(nodes, edges, r1, r2):
    """Pruning node by node, in any order, from the graph as it was at the start of a pass."""
    while True:
        keep, links = list(nodes), set(edges)
        linked = lambda n, to, shut: n == to or _walk(links, n, to, shut)
        gone = [n for n in keep if sum(a == n for a, _ in links) > 1 and not (n not in (r1, r2) and linked(n, r1, r2) and linked(n, r2, r1))]
        if not gone:
            return set(keep), links
        nodes = [n for n in keep if n not in gone]
        edges = {e for e in links if not set(e) & set(gone)}


def _walk(links, start, to, shut):
    seen = {start}
    while True:
        more = {b for a, b in links | {(b, a) for a, b in links} if a in seen and b not in seen and b != shut}
        if not more:
            return to in seen
        seen |= more


def brute_tails(nodes, edges, r1, r2):
    """Pass by pass: nodes with one neighbour that is neither recipe go, and those without any."""
    while True:
        near = {n: {b for a, b in edges | {(b, a) for a, b in edges} if a == n} for n in nodes}
        gone = {n for n in nodes if not near[n] or (len(near[n]) == 1 and not near[n] & {r1, r2})}
        if not gone:
            return edges
        nodes, edges = [n for n in nodes if n not in gone], {e for e in edges if not set(e) & gone}


def brute_roles(edges, r1, r2, list1, list2):
    nodes = {n for e in edges for n in e}

    def leads(n, to):
        seen = {n}
        while more := {b for a, b in edges if a in seen} - seen:
            seen |= more
        return to in seen

    def role(n):
        if sum(a == n for a, _ in edges) >= 2 and n not in list1 and n not in list2 and leads(n, r1) and leads(n, r2):
            return "top"
        if n in (r1, r2):
            return "recipe1" if n == r1 else "recipe2"
        if n in list1 and n in list2 and list1 != list2:
            return "common"
        return "recipe1_ingredient" if n in list1 else "recipe2_ingredient" if n in list2 else "other"

    return {n: role(n) for n in nodes}


def test_pruning_and_roles_equal_brute_force(spark):
    """Many graphs in one go, each against passes over it alone."""
    rng = random.Random(3)
    pairs, graphs, lists, want = [], [], [], {}
    for k in range(150):
        n = rng.randrange(4, 12)
        one, two = f"{k}a", f"{k}b"
        names = [str(i) for i in range(n)] + [f"R:{one}", f"R:{two}"]
        edges = {(names[x], names[y]) for x, y in ((rng.randrange(n), rng.randrange(n + 2)) for _ in range(rng.randrange(4, 24))) if x < y}
        if not edges:
            continue
        some = lambda: rng.sample(names[:n], 2)  # noqa: B023, E731
        list1, list2 = some(), some()
        if rng.random() < 0.2:
            list2 = list1
        pairs.append((str(k), one, two))
        graphs += [(one, [e for e in edges if e[1] != f"R:{two}"]), (two, [e for e in edges if e[1] != f"R:{one}"])]
        lists += [(one, list1), (two, list2)]
        for isolated in (True, False):
            for tails in (True, False):
                left = brute_isolated(sorted({x for e in edges for x in e}), set(edges), names[-2], names[-1])[1] if isolated else set(edges)
                left = brute_tails(sorted({x for e in edges for x in e}), left, names[-2], names[-1]) if tails else left
                role = brute_roles(left, names[-2], names[-1], list1, list2)
                want[str(k), isolated, tails] = {(a, b, role[a], role[b]) for a, b in left}
    frames = spark.createDataFrame(pairs, "pair_id string, r1 string, r2 string"), spark.createDataFrame(graphs, "recipe_id string, edges array<struct<src:string,dst:string>>"), spark.createDataFrame(lists, "recipe_id string, node_ids array<string>")
    for isolated in (True, False):
        for tails in (True, False):
            got = {}
            for r in g.overlap_graph(*frames, isolated=isolated, tails=tails).collect():
                got.setdefault(r.pair_id, set()).add((r.src, r.dst, r.src_role, r.dst_role))
            assert all(got.get(k, set()) == want[k, isolated, tails] for k, _, _ in pairs)


def test_visible_tree_and_carry_forward(t, spark):
    shown = lambda clicks: {(r.src, r.dst) for r in g.visible_tree(t.nodes, t.paths, "root", clicks).collect()}
    first = {(u, n) for n, u in UP.items() if u == "root"}
    assert shown(["Liquor", "Gin"]) == first | {("Liquor", "Gin"), ("Liquor", "Rum"), ("Gin", "Gin A"), ("Gin", "Gin B")}
    assert shown(["Liquor", "Gin", "Liquor"]) == first
    new, old = spark.createDataFrame([(1, "n"), (2, "n")], "id int, v string"), spark.createDataFrame([(2, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, v string, at int")
    assert {tuple(r) for r in g.carry_forward(new, old, order="at").collect()} == {(1, "n"), (2, "b")}


def test_reachable_and_write(t, spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "d", "c")], "k int, src string, dst string")
    starts = spark.createDataFrame([(1, "a")], "k int, start string")
    assert {r.node for r in g.reachable(edges, starts, "k").collect()} == {"a", "b", "c"}
    assert {r.node for r in g.reachable(edges, starts, "k", directed=False).collect()} == {"a", "b", "c", "d"}
    catalog.write_result(edges, str(t.folder / "out"), ["k"])
    assert spark.read.parquet(str(t.folder / "out")).count() == 3


def test_registry_and_matches(t, spark):
    twice = t.nodes.unionByName(t.nodes.where("name = 'Gin'").withColumn("ord", F.lit(99).cast("long")).withColumn("node_id", F.lit("Gin*")))
    assert p.node_registry(twice).where("name = 'Gin'").first().node_id == "Gin*" and p.node_registry(twice).count() == len(NODES)
    picked = spark.createDataFrame([("Gin",), ("Juice",)], "node_id string")
    count = lambda cmp, n: {r.recipe_id for r in j.ingredients_match(t.recipes, t.lines, t.paths, picked, n, cmp).collect()}
    assert count("gte", 2) == {"1", "2"} and count("lt", 1) == {"4", "5"}
