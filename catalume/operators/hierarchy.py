"""Lineages and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.sources.shared import discard, stage


def lineage_paths(nodes: DataFrame) -> DataFrame:
    """H1, array form: (node_id, path) from the root to the node itself.

    By pointer doubling: what a node knows of its path is put behind what the node above
    it knows, which doubles it, so rounds grow with the logarithm of the depth. Each
    round is written to the shared folder. A node whose parent isn't in the table is a
    root. A cycle raises.
    """
    edges = stage(nodes.select("node_id", "parent_id").dropDuplicates(["node_id"]), "edges")
    known = edges.select(F.col("node_id").alias("above"), F.lit(True).alias("there"))
    # path: the known end of a node's path; above: the node before it, null once the path is whole
    rows = edges.withColumnRenamed("parent_id", "above").join(known, "above", "left").select("node_id", F.when(F.col("there"), F.col("above")).alias("above"), F.array("node_id").alias("path"))
    whole, rows = [], stage(rows, "paths")
    discard(edges)
    while True:
        open_ = rows.where("above IS NOT NULL")
        whole.append(rows.where("above IS NULL").select("node_id", "path"))
        if open_.isEmpty():
            break
        if not open_.where(F.array_contains("path", F.col("above"))).isEmpty():
            raise ValueError("the parents form a cycle")
        done = whole[0]
        for part in whole[1:]:
            done = done.unionByName(part)
        upper = done.select(F.col("node_id").alias("above"), F.lit(None).cast("string").alias("next"), F.col("path").alias("upper"))
        upper = upper.unionByName(open_.select(F.col("node_id").alias("above"), F.col("above").alias("next"), F.col("path").alias("upper")))
        rows = stage(open_.join(upper, "above").select("node_id", F.col("next").alias("above"), F.concat("upper", "path").alias("path")), "paths")
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out


def numbered_paths(paths: DataFrame) -> DataFrame:
    """(node_id, up): the numbers of a node's ancestors from the root to itself. Numbers are given once a call, to every node its own."""
    rows = stage(paths.select("node_id", "path", F.monotonically_increasing_id().alias("no")), "numbered")
    steps = rows.select("node_id", F.posexplode("path").alias("depth", "above"))
    named = steps.join(rows.select(F.col("node_id").alias("above"), "no"), "above")
    up = F.transform(F.array_sort(F.collect_list(F.struct("depth", "no"))), lambda x: x["no"])
    return named.groupBy("node_id").agg(up.alias("up"))


def lineage(nodes: DataFrame) -> DataFrame:
    """H1: (node_id, ancestor_id, depth), the node itself included; a root has depth 1."""
    return closure(lineage_paths(nodes))


def closure(paths: DataFrame) -> DataFrame:
    return paths.select("node_id", F.posexplode("path").alias("depth", "ancestor_id")).select("node_id", "ancestor_id", (F.col("depth") + 1).alias("depth"))


def child_edges(nodes: DataFrame, node: str) -> DataFrame:
    """H2: (src, dst) from a node to its children."""
    return nodes.where(F.col("parent_id") == node).select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"))


def descendants(paths: DataFrame, node: str | None = None) -> DataFrame:
    """H4: (ancestor_id, node_id) strictly below ``node``, or below every node.

    A path tells what a node is below of, so the nodes below one are a filter; only
    "below every node" lists all ancestors, as its result does.
    """
    if node is not None:
        return _below(paths, node).select(F.lit(node).alias("ancestor_id"), "node_id")
    return closure(paths).where("node_id <> ancestor_id").select("ancestor_id", "node_id")


def _below(paths: DataFrame, node: str) -> DataFrame:
    return paths.where(F.array_contains("path", node) & (F.col("node_id") != node))


def subtree_edges(paths: DataFrame, node: str | None = None) -> DataFrame:
    """H3: (ancestor_id, src, dst): all edges below ``node``, or below every node."""
    src = F.element_at("path", -2).alias("src")
    if node is not None:
        return _below(paths, node).select(F.lit(node).alias("ancestor_id"), src, F.col("node_id").alias("dst"))
    above = F.explode(F.slice("path", 1, F.size("path") - 1)).alias("ancestor_id")
    return paths.where(F.size("path") > 1).select(above, src, F.col("node_id").alias("dst"))


def layered_edges(paths: DataFrame, node: str) -> DataFrame:
    """H5: (layer, src, dst) below a node; its children are layer 1."""
    inside = paths.where(F.array_contains("path", node) & (F.element_at("path", -1) != node))
    return inside.select((F.size("path") - F.array_position("path", node)).cast("int").alias("layer"), F.element_at("path", -2).alias("src"), F.col("node_id").alias("dst"))


def shared_depth(a: str | Column, b: str | Column) -> Column:
    """H6: how many ancestors two paths share."""
    return F.size(F.array_intersect(a, b))


def tree_distance(a: str | Column, b: str | Column) -> Column:
    """H7: steps between two nodes, from their paths."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def with_paths(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """Add path_a and path_b to (a, b)."""
    own = lambda x: paths.select(F.col("node_id").alias(x), F.col("path").alias(f"path_{x}"))
    return pairs.join(own("a"), "a").join(own("b"), "b")


#: Distinct costs below one node that are ranked in one window.
NARROW = 1 << 16


def cost_guess(nodes: DataFrame, paths: DataFrame, *, exact: bool = True, narrow: int = NARROW) -> DataFrame:
    """H8: (node_id, cost_oz_guess): median cost of the priced nodes below those without a cost of their own, 2 decimals.

    Exact, for all nodes at once: costs below a node are counted by value, and where
    there are more than ``narrow`` values, the range that holds the middle ones is
    narrowed by histograms of 4,096 bins until it has fewer. So no task holds the costs
    of a whole tree. ``exact=False`` estimates instead.
    """
    wanted = nodes.where(F.col("cost_oz").isNull()).select("node_id")
    below = descendants(paths).join(nodes.where(F.col("cost_oz").isNotNull() & ~F.isnan("cost_oz")).select("node_id", "cost_oz"), "node_id")
    below = below.select(F.col("ancestor_id").alias("node_id"), F.col("cost_oz").alias("x")).join(wanted, "node_id", "left_semi")
    if not exact:
        return below.groupBy("node_id").agg(F.round(F.percentile_approx("x", 0.5, 10000), 2).alias("cost_oz_guess"))
    middle = medians(below, narrow=narrow)
    return middle.select("node_id", F.round("median", 2).alias("cost_oz_guess"))


def medians(rows: DataFrame, *, narrow: int = NARROW, bins: int = 4096) -> DataFrame:
    """(node_id, median) of (node_id, x), x finite: the mean of the two middle values, or the middle one."""
    values = stage(rows.groupBy("node_id", "x").agg(F.count(F.lit(1)).alias("n")), "values")
    sides = F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))
    state = values.groupBy("node_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("several"), F.min("x").alias("low"), F.max("x").alias("high"))
    # rank: how many of the values from low on lie before the one looked for
    state = stage(state.select("node_id", sides.alias("rank"), "several", "low", "high").withColumn("side", F.row_number().over(Window.partitionBy("node_id").orderBy("rank"))), "ranks")
    ready = state.where(F.col("several") <= narrow)
    while True:
        wide = state.where(F.col("several") > narrow)
        if wide.isEmpty():
            break
        inside = values.join(wide, "node_id").where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
        at = F.least(F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        counted = inside.groupBy("node_id", "side", "rank", at.alias("bin")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("several"), F.min("x").alias("low"), F.max("x").alias("high"))
        through = F.sum("n").over(Window.partitionBy("node_id", "side").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("through", through).where((F.col("through") > F.col("rank")) & (F.col("through") - F.col("n") <= F.col("rank")))
        state = stage(found.select("node_id", (F.col("rank") - F.col("through") + F.col("n")).alias("rank"), "several", "low", "high", "side"), "ranks")
        ready = ready.unionByName(state.where(F.col("several") <= narrow))
    near = values.join(ready, "node_id").where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    through = F.sum("n").over(Window.partitionBy("node_id", "side").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    picked = near.withColumn("through", through).where((F.col("through") > F.col("rank")) & (F.col("through") - F.col("n") <= F.col("rank")))
    return picked.groupBy("node_id").agg(F.avg("x").alias("median"))
