"""Pairs of similar recipes without looking at most pairs: threshold joins and exact top-k search.

Recipes with the same lines are one shape; all work is on shapes. A similarity is half
the sum, over shared ancestors and nodes, of both sides' shares of lines there times
what the depth is worth, less 1. It is a join of weighted sets, with these bounds for a
pair that scores ``t`` or more:

- Some line matches at least ``t`` well. So the pair shares an ancestor at a depth D
  with ``1 - 0.5**(D - 1) >= t``, or the very node of a line that lies higher. Keys
  deeper than D + 1 aren't needed: what they are worth is added to the key at D + 1.
- In an order of all keys, deepest and rarest first, let c be the first key that the
  pair shares. With it the keys above it are shared. Let d be the first shared key
  besides. Then all else that is shared comes after d, so what c and the keys above it
  and all keys from d on are worth comes to ``2 t`` over both sides.

Hence a pair meets by the two keys (c, d), or by c alone if that suffices, and only if
both sides' bounds come to ``2 t``. A posting whose bound doesn't reach that with the
highest of its key is dropped before anything meets, so that popular ancestors list no
pairs. Postings that are crowded still are split into blocks, and every two blocks meet
in a task of their own. What meets is scored exactly, where it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.units import score_to_weight
from catalume.operators.hierarchy import numbered_paths
from catalume.operators.nodes import scorable_lines
from catalume.operators.similarity import best_by_blocks, packed
from catalume.sources.shared import discard, stage

#: Postings of one key that meet in one task.
CROWD = 2000
#: Stands for no other category; numbers of nodes are never as low.
ALONE = -(1 << 62)
EPS = 1e-9


def required_depth(score: float) -> int:
    """The depth at which a pair of that score must share an ancestor."""
    return math.ceil(-math.log2(max(1.0 - score + EPS, 1e-12))) + 1


class Shapes:
    """Recipes by shape. members: (shape, recipe_id); items: (shape, lines, items), the nodes with their ancestors and numbers of lines; profiles: (shape, keys, worth), all that can be shared."""

    def __init__(self, lines: DataFrame, nodes: DataFrame, paths: DataFrame):
        counted = scorable_lines(lines, nodes).groupBy("recipe_id", "node_id").agg(F.count(F.lit(1)).alias("n")).join(numbered_paths(paths), "node_id")
        each = F.struct(F.element_at("up", -1).alias("no"), "n", "up")
        rows = counted.groupBy("recipe_id").agg(F.array_sort(F.collect_list(each)).alias("items"), F.sum("n").alias("lines"))
        sign = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["no"], x["n"])), ",")
        rows = stage(rows.withColumn("shape", F.unhex(F.substring(F.sha2(sign.cast("binary"), 256), 1, 32))), "recipes")
        self.members = rows.select("shape", "recipe_id")
        self.items = stage(rows.drop("recipe_id").dropDuplicates(["shape"]), "shapes")
        one = self.items.repartition("shape").select("shape", "lines", F.inline("items"))  # dealt once, before there are many rows
        gains = one.select("shape", (F.col("n") / F.col("lines")).alias("share"), F.posexplode(F.concat("up", F.array("no"))).alias("depth", "at"), F.size("up").alias("own"))
        itself = F.col("depth") == F.col("own")
        keys = gains.select("shape", (F.col("at") * 2 + itself.cast("int")).alias("key"), (F.col("share") * F.pow(F.lit(0.5), F.when(itself, F.col("own") - 1).otherwise(F.col("depth")))).alias("worth"))
        keys = keys.groupBy("shape", "key").agg(F.sum("worth").alias("worth"))
        packed_ = keys.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("key", "worth"))).alias("x"))
        self.profiles = stage(packed_.select("shape", F.col("x.key").alias("keys"), F.col("x.worth").alias("worth")), "profiles")
        self._tables, self._sets = [rows, self.items, self.profiles], {}

    def discard(self) -> None:
        discard(*self._tables)

    def key_sets(self, depth: int) -> DataFrame:
        """(shape, ks): each shape's keys for a required depth, deepest and rarest first: (place, key, level, worth, after, above). A table in the shared folder, made once."""
        if depth in self._sets:
            return self._sets[depth]
        size, whole = F.size("up"), depth + 1
        each = F.transform(F.sequence(F.lit(2), F.lit(whole)), lambda d: F.when(size >= d, F.struct(F.get("up", d - 1).alias("key"), d.alias("level"), F.pow(F.lit(0.5), F.when(d == whole, d - 2).otherwise(d - 1)).alias("worth"))))
        itself = F.when(size < whole, F.struct((-1 - F.col("no")).alias("key"), F.lit(1 << 20).alias("level"), F.pow(F.lit(0.5), size - 1).alias("worth")))
        chain = F.filter(F.concat(each, F.array(itself)), lambda x: x.isNotNull())
        lines = self.items.repartition("shape").select("shape", "lines", F.inline("items")).select("shape", (F.col("n") / F.col("lines")).alias("share"), chain.alias("chain"))
        at = lines.select("shape", "share", F.posexplode("chain").alias("place", "x"), "chain")
        above = F.transform(F.slice("chain", 1, F.col("place")), lambda x: x["key"])
        keys = at.select("shape", F.col("x.key").alias("key"), F.col("x.level").alias("level"), (F.col("x.worth") * F.col("share")).alias("worth"), above.alias("above"))
        keys = stage(keys.groupBy("shape", "key").agg(F.sum("worth").alias("worth"), F.first("level").alias("level"), F.first("above").alias("above")), "keys")
        ranked = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "key")  # a key of one shape is shared with none
        order = Window.partitionBy("shape").orderBy(F.desc("level"), "often", "key")
        after = F.sum("worth").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        ranked = ranked.select("shape", F.struct(F.row_number().over(order).alias("place"), "key", "level", "worth", after.alias("after"), "above").alias("k"))
        out = self._sets[depth] = stage(ranked.groupBy("shape").agg(F.array_sort(F.collect_list("k")).alias("ks")), "key-sets")
        self._tables.append(out)
        discard(keys)
        return out

    @staticmethod
    def postings(sets: DataFrame, depth: int, need: float, only: DataFrame | None = None) -> DataFrame:
        """(shape, first, second, bound): the keys by which shapes (``key_sets`` of a depth) meet others that they may score ``need / 2`` with; if given, those whose first key is in ``only``."""
        firsts = sets.select("shape", "ks", F.explode(F.filter("ks", lambda k: k["level"] >= depth)).alias("c"))
        if only is not None:
            firsts = firsts.join(only.select("first").distinct(), F.col("c.key") == F.col("first"), "left_semi")
        firsts = firsts.withColumn("over", F.filter("ks", lambda k: F.array_contains(F.col("c.above"), k["key"])))
        sums = lambda xs: F.aggregate(xs, F.lit(0.0), lambda total, x: total + x["worth"])
        firsts = firsts.withColumn("own", F.col("c.worth") + sums("over"))
        others = F.transform(
            F.filter("ks", lambda k: (k["place"] > F.col("c.place")) & ~F.array_contains(F.col("c.above"), k["key"])),
            lambda k: F.struct(k["key"].alias("second"), (F.col("own") + k["after"] - sums(F.filter("over", lambda x: x["place"] >= k["place"]))).alias("bound")),
        )
        seconds = F.concat(others, F.array(F.struct(F.lit(ALONE).alias("second"), F.col("own").alias("bound"))))
        return firsts.select("shape", F.col("c.key").alias("first"), F.inline(F.filter(seconds, lambda x: x["bound"] >= need - 1 - EPS)))

    def scored(self, left: DataFrame, right: DataFrame, *, ordered: bool, least: float | None = None, best: int | None = None) -> DataFrame:
        """(a, b, score): different shapes whose postings meet with bounds that come to the need of the left one; if ordered, a before b. A pair that meets by several keys may come several times.

        ``left``: postings with ``need``. Postings bring their profiles, and pairs are scored
        where they meet: what is shuffled grows with postings, and only what is left of the
        pairs is written. Left are those that score ``least``, or of each batch what may be
        among the ``best`` of a shape, ties included.
        """
        by = ["first", "second"]
        tops = left.groupBy(*by).agg(F.max("bound").alias("top"), F.min("need").alias("least"))
        able = stage(right.join(tops, by).where(F.col("bound") + F.col("top") >= F.col("least") - EPS).select(*by, "shape", "bound"), "able")
        right = able
        crowds = right.groupBy(*by).agg(F.max("bound").alias("most"), F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("blocks"))
        left = left.join(crowds, by).where(F.col("bound") + F.col("most") >= F.col("need") - EPS)
        right = right.join(crowds.where("blocks > 1").select(*by, "blocks"), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own, every = F.pmod(F.xxhash64("shape"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        held = lambda df: df.join(self.profiles, "shape")
        profile = lambda x: [F.col("shape").alias(x), F.col("keys").alias(f"keys_{x}"), F.col("worth").alias(f"worth_{x}"), F.col("bound").alias(f"bound_{x}")]
        one = held(left).select(*by, own.alias("i"), every.alias("j"), "need", *profile("a"))
        two = held(right).select(*by, own.alias("j"), every.alias("i"), *profile("b"))
        both = one.join(two, [*by, "i", "j"]).where(F.col("bound_a") + F.col("bound_b") >= F.col("need") - EPS).where(F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b"))
        found = both.select("a", "b", "keys_a", "worth_a", "keys_b", "worth_b").mapInArrow(_scorer(least, best), "a binary, b binary, score double")
        found = stage(found, "met")
        discard(able)
        return found


def _scorer(least: float | None, best: int | None):
    """Scores of pairs of profiles, without those that are of no use: under ``least``, or not among the ``best`` of a shape in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _score(batches):
            score = batch.column(2).to_numpy()
            if least is not None:
                batch = batch.filter(pa.array(score >= least))
            if best is not None:
                a, b = (batch.column(c).dictionary_encode().indices.to_numpy().astype(np.int64) for c in (0, 1))
                _, once = np.unique(a * (b.max(initial=0) + 1) + b, return_index=True)
                once = once[np.lexsort((-score[once], a[once]))]
                first = np.searchsorted(a[once], np.arange(a.max(initial=-1) + 1))
                last = np.minimum(first + best, np.append(first[1:], len(once))) - 1
                batch = batch.take(pa.array(once[score[once] >= score[once[last]][a[once]] - EPS]))
            yield batch

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        sides = []
        for c in (2, 4):
            sizes = np.diff(batch.column(c).offsets.to_numpy())
            sides.append((np.repeat(np.arange(n), sizes), batch.column(c).flatten().to_numpy(), batch.column(c + 1).flatten().to_numpy()))
        (row_a, key_a, worth_a), (row_b, key_b, worth_b) = sides
        known, number = np.unique(np.concatenate([key_a, key_b]), return_inverse=True)
        code_a, code_b = row_a * len(known) + number[: len(key_a)], row_b * len(known) + number[len(key_a) :]  # sorted, as lists are sorted by key
        place = np.searchsorted(code_a, code_b)
        met = np.flatnonzero(place < len(code_a))
        met = met[code_a[place[met]] == code_b[met]]
        shared = np.bincount(row_b[met], worth_b[met] + worth_a[place[met]], n)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared / 2 - 1.0)], ["a", "b", "score"])


def weight_to_score(weight: float, *, p: float = 0.5, h: float = 0.7, k: float = 1.0, r: float = math.log(2) / 0.03) -> float:
    """The score that has a logistic weight (the inverse of P11)."""
    return h + math.log(weight * (k - p) / (p * (k - weight))) / r


def strong_edges(lines: DataFrame, nodes: DataFrame, paths: DataFrame, *, min_weight: float, enabled: float = 1.0) -> DataFrame:
    """(r1, r2, score, weight), r1 < r2, for all pairs of recipes whose weight is at least ``min_weight``, before ``enabled`` is applied.

    Exact, and without the pairs that only share a popular ancestor. The weight must
    stand for a score above 0: every pair has at least that.
    """
    least = weight_to_score(min_weight)
    if not 0 < least <= 1:
        raise ValueError("the weight must stand for a score above 0 and up to 1")
    own = Shapes(lines, nodes, paths)
    posted = stage(own.postings(own.key_sets(required_depth(least)), required_depth(least), 2 * least), "postings")
    found = own.scored(posted.withColumn("need", F.lit(2 * least)), posted, ordered=True, least=least - 1e-12).dropDuplicates(["a", "b"])
    discard(posted)
    one, two = own.members.select(F.col("shape").alias("a"), F.col("recipe_id").alias("x")), own.members.select(F.col("shape").alias("b"), F.col("recipe_id").alias("y"))
    across = found.join(one, "a").join(two, "b").select(F.least("x", "y").alias("r1"), F.greatest("x", "y").alias("r2"), "score")
    edges = across.unionByName(_within(own.members))
    return edges.select("r1", "r2", "score", (score_to_weight("score") * enabled).alias("weight"))


def _within(members: DataFrame) -> DataFrame:
    """(r1, r2, score 1) of recipes that have one shape, in blocks."""
    crowds = members.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shape", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks"))
    rows = members.join(crowds, "shape").withColumn("own", F.pmod(F.xxhash64("recipe_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rows.select("shape", F.col("own").alias("i"), every.alias("j"), F.col("recipe_id").alias("r1"))
    two = rows.select("shape", F.col("own").alias("j"), every.alias("i"), F.col("recipe_id").alias("r2"))
    return one.join(two, ["shape", "i", "j"]).where("r1 < r2").select("r1", "r2", F.lit(1.0).alias("score"))


#: Scores down to which a search looks in turn. What is left then is scored against all recipes.
FALLING = (0.72, 0.58, 0.42, 0.25, 0.1)


def nearest(queries: DataFrame, recipes: DataFrame, lines: DataFrame, nodes: DataFrame, paths: DataFrame, *, k: int, falling: tuple[float, ...] = FALLING, counts: dict[str, int] | None = None) -> DataFrame:
    """(r1, r2, score, rank): the ``k`` recipes most similar to each of ``queries`` (recipe_id); ties in catalog order.

    The same rows as ``find_similar``, found by a threshold that falls: a round finds
    all recipes that score at least a query's threshold, and the query is settled if
    they are ``k``. Otherwise what it has found is a lower bound of its k-th best score,
    which is the next threshold, if the round's is not higher. Queries that are still
    open after the last round (fewer than k recipes are at all alike) are scored against
    all recipes, in blocks. Whatever their root, all recipes can be listed: what shares
    none scores -1. Recipes without scorable lines neither ask nor are listed.
    ``counts``, if given, gets the numbers of pairs scored and of queries left to blocks;
    for that all pairs scored are kept, else those that can be among a shape's best.
    """
    own = Shapes(lines, nodes, paths)
    best_of = k + 1 if counts is None else None
    members = own.members.join(recipes.select("recipe_id", F.col("ord").cast("long").alias("ord")), "recipe_id")
    first = Window.partitionBy("shape").orderBy("ord", "recipe_id")
    members = stage(members.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k + 1).select(F.col("shape").alias("b"), "recipe_id", "ord"), "first-members")
    asked = stage(queries.select("recipe_id").distinct().join(own.members, "recipe_id"), "asked")
    open_ = stage(asked.select("shape").distinct().withColumn("need", F.lit(2 * falling[0])), "open")
    pairs = stage(open_.select(F.col("shape").alias("a"), F.col("shape").alias("b"), F.lit(1.0).alias("score")), "scored")
    best = Window.partitionBy("a").orderBy(F.desc("score"), "ord", "recipe_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(members, "b").select("a", "recipe_id", F.round("score", 12).alias("score"), "ord")
        return rows.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1)

    for turn in range(len(falling)):
        depth = (F.ceil(-F.log2(F.greatest(F.lit(1 + EPS) - F.col("need") / 2, F.lit(1e-12)))) + 1).cast("int")  # as required_depth
        wanted = open_.groupBy(depth.alias("depth")).agg(F.min("need").alias("least")).collect()
        if not wanted:
            break
        for r in wanted:
            sets, mine = own.key_sets(r.depth), open_.where(depth == r.depth)
            left = own.postings(sets.join(mine.select("shape"), "shape", "left_semi"), r.depth, r.least)
            left = stage(left.join(mine, "shape").where(F.col("bound") >= F.col("need") - 1 - EPS), "wanted")
            pairs = pairs.unionByName(own.scored(left, own.postings(sets, r.depth, r.least, left), ordered=False, best=best_of))
            discard(left)
        pairs = pairs.groupBy("a", "b").agg(F.max("score").alias("score"))
        if best_of is not None:  # every shape has a recipe, so that no other can be among the best k + 1
            place = F.rank().over(Window.partitionBy("a").orderBy(F.desc(F.round("score", 12))))
            pairs = pairs.withColumn("_r", place).where(F.col("_r") <= best_of).drop("_r")
        pairs = stage(pairs, "scored")
        kth = ranked(pairs).groupBy(F.col("a").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        state = open_.join(kth, "shape").withColumn("reached", F.when(F.col("n") > k, F.col("kth")).otherwise(-2.0))
        last = turn + 1 == len(falling)
        following = F.greatest(2 * (F.col("reached") - EPS), F.lit(2 * falling[min(turn + 1, len(falling) - 1)]))
        open_ = stage(state.where(F.col("reached") < F.col("need") / 2 + EPS / 2).select("shape", (F.lit(0.0) if last else F.least(F.col("need"), following)).alias("need")), "open")
    top = ranked(pairs).select(F.col("a").alias("shape"), F.col("recipe_id").alias("r2"), "score", "ord")
    done = asked.join(open_.select("shape"), "shape", "left_anti").withColumnRenamed("recipe_id", "r1").join(top, "shape").where("r1 <> r2").select("r1", "r2", "score", "ord")
    rest = stage(asked.join(open_.select("shape"), "shape", "left_semi").select("recipe_id"), "rest")
    if counts is not None:
        counts["scored"], counts["left"] = pairs.count(), rest.count()
    if not rest.isEmpty():
        done = done.unionByName(best_by_blocks(rest, recipes, packed(lines, nodes, paths), k))
    order = Window.partitionBy("r1").orderBy(F.desc("score"), "ord", "r2")
    return done.select("r1", "r2", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
