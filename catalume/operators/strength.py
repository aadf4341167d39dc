"""Strength of recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.functions.units import convert_volume, percent_label


def recipe_abv(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """A1: (recipe_id, abv): by volume over the lines whose node has an ``abv``.

    Null for a recipe without such lines, NaN where one of them has an unknown unit.
    Lines are summed in their order (``pos``): a sum in the order in which rows happen
    to arrive can differ in its last bit, and labels round what lies on a half.
    """
    rows = lines.join(nodes.where("abv IS NOT NULL").select("node_id", "abv"), "node_id", "left")
    ounces = F.when(F.col("abv").isNotNull(), convert_volume("amount", "unit", F.lit("oz")))
    listed = rows.withColumn("oz", ounces).groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.when(F.col("oz").isNotNull(), F.struct("pos", "oz", "abv")))).alias("ls"))
    total = lambda of: F.when(F.size("ls") > 0, F.aggregate("ls", F.lit(0.0), lambda sum_, x: sum_ + of(x)))
    return listed.select("recipe_id", F.try_divide(total(lambda x: x["oz"] * x["abv"]), total(lambda x: x["oz"])).alias("abv"))


def list_abv(recipe_ids: DataFrame, recipes: DataFrame, lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """A2: (recipe_id, name, abv_label) for the chosen recipes."""
    chosen = recipe_ids.select("recipe_id").distinct()
    found = recipe_abv(lines.join(chosen, "recipe_id", "left_semi"), nodes)
    return recipes.join(chosen, "recipe_id", "left_semi").join(found, "recipe_id", "left").select("recipe_id", "name", percent_label("abv", 1).alias("abv_label"))


def mean(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A3: arithmetic mean; null of nothing."""
    return values.groupBy(*(by or [])).agg(F.avg(value).alias("mean"))
