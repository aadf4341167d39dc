"""Sums and labels that must not depend on the order in which rows arrive."""

import itertools

from pyspark.sql import functions as F

from catalume.functions import units
from catalume.operators import strength as a

LINES = [(2, 13.0, 0.27), (3, 14.0, 0.48), (4, 25.0, 0.48)]


def test_strength_sums_lines_in_their_order(spark):
    orders = list(itertools.permutations(LINES))
    rows = [(str(k), pos, f"n{pos}", amount, "dash") for k, order in enumerate(orders) for pos, amount, _ in order]
    lines = spark.createDataFrame(rows, "recipe_id string, pos int, node_id string, amount double, unit string").coalesce(1)
    nodes = spark.createDataFrame([(f"n{pos}", abv) for pos, _, abv in LINES], "node_id string, abv double")
    x = y = 0.0
    for _, amount, abv in LINES:
        ounces = amount / units.PER_ML["dash"] * units.PER_ML["oz"]
        x, y = x + ounces * abv, y + ounces
    assert {r.abv for r in a.recipe_abv(lines, nodes).collect()} == {x / y}
    recipes = spark.createDataFrame([(str(k), "x") for k in range(len(orders))], "recipe_id string, name string")
    assert {r.abv_label for r in a.list_abv(recipes.select("recipe_id"), recipes, lines, nodes).collect()} == {"42.8%"}


def test_percent_labels_round_after_scaling(spark):
    """As the SQL's round does: 61.449999999999996 times ten is 614.5 in doubles."""
    shares = spark.createDataFrame([(0.6144999999999999,), (0.5335,), (0.0,)], "x double")
    assert [r[0] for r in shares.select(units.percent_label(F.col("x"), 1)).collect()] == ["61.5%", "53.4%", "0.0%"]
