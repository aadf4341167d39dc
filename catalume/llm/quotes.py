"""Conversations without quotations, in reply order.

Messages that quote earlier ones (lines that start with ``>``, as deep as they
nest) are cut into passages of one quote level. Normalised passages and their
lines, sentences and word windows are hashed and joined to the hashes of what messages say themselves. The
message that most of a reply's first-level quotation comes from is its parent;
reply order follows from the parents by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.common import stage

MARK = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)\b[^\n]{0,40}:[ \t]*$"
#: Words of a window; a passage of fewer words is one window.
WINDOW = 5


def _normal(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))


def _hashed(df: DataFrame, text: str, units: Column, chars: Column) -> DataFrame:
    one = df.withColumn("_unit", F.explode(F.array_distinct(units)))
    return one.withColumn("hash", F.md5(F.col("_unit").cast("binary"))).withColumn("chars", chars).drop("_unit", text)


def _units(df: DataFrame, text: str) -> DataFrame:
    """Each text as a whole, each of its lines and each of its sentences, as distinct hashes with their length."""
    whole = F.array(_normal(F.col(text)))
    lines = F.transform(F.split(F.col(text), "\n"), _normal)
    parts = F.array_union(F.array_union(whole, lines), F.split(_normal(F.col(text)), r"(?<=[.!?]) "))
    return _hashed(df, text, F.filter(parts, lambda x: F.length(x) > 0), F.length("_unit"))


def _windows(df: DataFrame, text: str, shorter: bool = False) -> DataFrame:
    """Windows of ``WINDOW`` words of each text, or all its words if they are fewer; with ``shorter`` those of fewer words, too. Lines and punctuation don't count."""
    df = df.withColumn("_words", F.array_remove(F.split(F.regexp_replace(_normal(F.col(text)), r"[^\p{L}\p{N}]+", " "), " "), ""))
    n = F.size("_words")

    def of(k: Column) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit("\n"), F.array_join(F.slice("_words", i, k), " ")))  # no other unit has a line end

    units = F.concat(*[of(F.lit(k)) for k in range(1, WINDOW + 1)]) if shorter else of(F.greatest(F.lit(1), F.least(F.lit(WINDOW), n)))
    # a text's windows together count about as much as the text
    chars = F.when(n < WINDOW, F.length("_unit") - 1).otherwise(F.length(F.substring_index("_unit", " ", 1)))
    return _hashed(df, text, units, chars).drop("_words")


def _sortable(turn: str) -> Column:
    """A turn as text of a fixed width that sorts as the number does."""
    n = F.col(turn).cast("long")
    lowest = F.lit(-(1 << 63)).cast("long")
    return F.when(n >= 0, F.lpad(n.cast("string"), 20, "0")).otherwise(F.concat(F.lit("-"), F.lpad((n - lowest).cast("string"), 19, "0")))


def link_quotations(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, and its place among replies.

    parent_turn is the earlier message of the same conversation that the quotation
    comes from (null without one), root_turn, depth and reply_path (turns from the
    root, of a fixed width each, so that ordering by conv_id and reply_path gives
    replies below what they answer, whatever the turns' signs and sizes). Where the
    conversation itself has no source, linked_conv and linked_turn name the first
    message of the first other conversation that has the passage, and linked_among in
    how many conversations it was said: a short answer is said in many. n_quotes and
    n_linked count passages. Null text counts as empty, and a null turn or
    conversation links to nothing. Passages of any length link; within a conversation
    also re-wrapped ones and parts of a line, in other conversations whole messages,
    lines and sentences. What was said several times counts for the first message
    that says it. Where passages come from several messages the one with most
    characters wins, then the later. Repeated messages each get their row; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = stage(messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_id", F.monotonically_increasing_id()), "messages")
    has = F.col("text").rlike(r"(?m)^[ \t]*>")
    lines = rows.where(has).select("_id", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", MARK, 1), "[^>]", ""))).withColumn("said", F.regexp_replace("line", MARK, ""))
    order = Window.partitionBy("_id").orderBy("pos")
    deeper = F.lead("level").over(order) > F.col("level")
    lines = lines.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("_id", "level").orderBy("pos"))).withColumn("attribution", F.coalesce(deeper, F.lit(False)) & F.col("said").rlike(ATTRIBUTION))
    lines = stage(lines.where(~F.col("attribution")), "lines")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "\n")
    own = lines.where("level = 0").groupBy("_id").agg(joined.alias("_own"))
    bare = rows.join(own, "_id", "left").withColumn("text", F.when(~has, F.col("text")).otherwise(F.regexp_replace(F.coalesce("_own", F.lit("")), r"^\s+|\s+$", ""))).drop("_own")
    bare = stage(bare, "bare")
    passages = stage(lines.where("level > 0").groupBy("_id", "conv_id", "turn", "level", "run").agg(joined.alias("passage")), "passages")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asked = stage(_units(passages.where(placed), "passage"), "quoted")
    # what was quoted anywhere, then who said it first: one row for each key, however often it was said
    said = _units(bare.select("conv_id", "turn", "text"), "text").join(asked.select("hash").distinct(), "hash", "left_semi").where(placed)
    said = stage(said.groupBy("hash", "conv_id").agg(F.min("turn").alias("first")), "said")
    near = stage(_windows(passages.where(placed), "passage"), "quoted")
    talk = bare.select("conv_id", "turn", "text").join(passages.select("conv_id").distinct(), "conv_id", "left_semi").where(placed)
    heard = _windows(talk, "text", shorter=True).join(near.select("hash").distinct(), "hash", "left_semi").groupBy("hash", "conv_id").agg(F.min("turn").alias("first"))
    heard = stage(heard, "heard")
    here = asked.unionByName(near).join(said.unionByName(heard), ["conv_id", "hash"]).where(F.col("first") < F.col("turn"))
    votes = here.groupBy("_id", "level", "first").agg(F.sum("chars").alias("chars"))
    parent = votes.where("level = 1").groupBy("_id").agg(F.max(F.struct("chars", "first")).alias("best")).select("_id", F.col("best.first").alias("parent_turn"))
    found = here.select("_id", "level", "run").distinct()
    # the first conversation that said it, and the first of the others for those that quote in that one
    at = F.min(F.struct("conv_id", "first"))
    one = said.groupBy("hash").agg(at.alias("one"), F.count(F.lit(1)).alias("among"))
    two = said.join(one, "hash").where(F.col("conv_id") != F.col("one.conv_id")).groupBy("hash").agg(at.alias("two"))
    anywhere = one.join(two, "hash", "left")
    away = asked.join(found, ["_id", "level", "run"], "left_anti").join(anywhere, "hash")
    away = away.withColumn("at", F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))).where("at IS NOT NULL")
    linked = away.groupBy("_id").agg(F.max(F.struct("chars", "at", "among")).alias("best"), F.count_distinct("level", "run").alias("n_away"))
    linked = linked.select("_id", F.col("best.at.conv_id").alias("linked_conv"), F.col("best.at.first").alias("linked_turn"), F.col("best.among").alias("linked_among"), "n_away")
    counts = passages.groupBy("_id").agg(F.count(F.lit(1)).alias("n_quotes")).join(found.groupBy("_id").agg(F.count(F.lit(1)).alias("n_here")), "_id", "left").join(linked, "_id", "left").join(parent, "_id", "left")
    full = stage(bare.join(counts, "_id", "left"), "linked")
    paths = reply_paths(full.where(F.col("parent_turn").isNotNull()).select("conv_id", "turn", "parent_turn").distinct())
    out = full.join(paths, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("reply_path", _sortable("turn")).alias("reply_path"), "linked_conv", "linked_turn", "linked_among", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), (F.coalesce("n_here", F.lit(0)) + F.coalesce("n_away", F.lit(0))).alias("n_linked"),
    )


def reply_paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth, reply_path) for messages with a parent, by pointer doubling.

    A message that is repeated with different parents follows the latest.
    """
    at = parents.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("root_turn"))
    at = stage(at.select("conv_id", "turn", "root_turn", F.lit(1).cast("long").alias("depth"), _sortable("turn").alias("tail")), "replies")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_up"), F.col("depth").alias("_depth"), F.col("tail").alias("_tail"))
        both = at.join(up, ["conv_id", "root_turn"], "left")
        at = stage(both.select("conv_id", "turn", F.coalesce("_up", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.concat_ws("/", "_tail", "tail").alias("tail"), F.col("_up").isNotNull().alias("_moved")), "replies")
        if at.where("_moved").isEmpty():
            return at.select("conv_id", "turn", "root_turn", "depth", F.concat_ws("/", _sortable("root_turn"), F.col("tail")).alias("reply_path"))
        at = at.drop("_moved")
