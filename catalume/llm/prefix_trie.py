"""Conversation prefix trie: every common opening of conversations, counted by ROLLUP over columns of turns.

Turns become ids of 16 bytes (SHA-256, cut). A conversation is cut into blocks of
``WIDTH`` turns, one row a block with a column for each turn and the key of the node
before it, so that one ``GROUP BY block, prior, ROLLUP(t1, ..., t8)`` over all blocks
counts the prefixes of all depths together, and ``grouping_id`` tells a row's depth. The
keys of all blocks come from a tree of digests over each conversation's blocks, in as
many rounds as the logarithm of the longest conversation, not one round a block.

A node belongs to its smallest member. What a conversation owns is the end of its own
path, hung on a node of another one, so sums over subtrees are running sums along owned
paths plus sums handed upward, once for each level of hanging.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.common import discard, stage

#: Turns in a block, and digests that one row of the tree of digests brings together.
WIDTH, FAN = 8, 64
#: Nodes along an owned path that are summed in one window, and ids joined to one string, as powers of two.
RUN, CHUNK = 12, 12


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _root() -> Column:
    return F.unhex(F.lit("00" * 16))


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id, bytes): the turns of each conversation in order, from 1, by id and bytes of their text.

    Null turns come first; equal ones go by role, then by the text's first 64
    characters, then by digest; of equal rows any is first. A null role or text is
    empty. Rows are sorted over all conversations at once and numbered in two levels,
    so that no task holds one conversation's turns.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(role).cast("string")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("start"),
        _digest(F.encode(F.concat(size, F.lit(":"), role, text), "UTF-8")).alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("start"), F.col("id"), F.col("row")]
    at = F.monotonically_increasing_id()
    found = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "id", "bytes", at.alias("at"), F.shiftright(at, 33).alias("part")), "turns")
    pieces = found.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    return found.withColumn("k", own).join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("k") + F.col("before")).alias("pos"), "id", "bytes")


def share_openings(numbered: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that neighbours open alike: (conv_id, pos, id, bytes), and (conv_id, n) with each one's number of turns, 0 included.

    Conversation c gets the first h turns of conversation c - c % ``every`` (all of
    them if fewer, none if it isn't there), h = crc32(c) % ``most``, and then its own
    turns after its first h.
    """
    sizes = stage(numbered.groupBy("conv_id").agg(F.max("pos").alias("own")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    wanted = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    lead = F.least(F.col("h"), F.coalesce(F.col("theirs"), F.lit(0)))
    wanted = wanted.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs")), "base", "left").select("conv_id", "base", "own", "h", lead.alias("lead"))
    heads = numbered.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    first = wanted.select("conv_id", "base", "h").join(heads, "base").where("pos <= h").select("conv_id", "pos", "id", "bytes")
    rest = numbered.join(wanted.where("own > h").select("conv_id", "h", "lead"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "id", "bytes")
    return first.unionByName(rest), wanted.select("conv_id", (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def _turn_columns() -> list[str]:
    return [f"t{k + 1}" for k in range(WIDTH)]


def _key() -> Column:
    """A node's key, from the key before its block and its turns in it."""
    return _digest(F.col("prior"), *[F.coalesce(F.col(t)["id"], F.lit(b"")) for t in _turn_columns()])


def block_columns(turns: DataFrame) -> DataFrame:
    """(conv_id, block, t1 .. t8, prior, next): a row for each block of a conversation; t: (id, bytes) or null; prior: the key before the block, next: that of the following block, if there is one."""
    sorted_ = F.array_sort(F.collect_list(F.struct(((F.col("pos") - 1) % WIDTH).alias("k"), "id", "bytes")))
    rows = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(sorted_.alias("ts"))
    cell = lambda k: F.when(F.size("ts") > k, F.struct(F.col("ts")[k]["id"].alias("id"), F.col("ts")[k]["bytes"].alias("bytes")))
    rows = stage(rows.select("conv_id", "block", *[cell(k).alias(t) for k, t in enumerate(_turn_columns())], _digest(F.lit(b"\x01"), *[F.coalesce(F.get("ts.id", F.lit(k)), F.lit(b"")) for k in range(WIDTH)]).alias("digest")), "blocks")
    keys = _prior_keys(rows.select("conv_id", F.col("block").alias("i"), "digest")).withColumnRenamed("i", "block")
    return rows.drop("digest").join(keys, ["conv_id", "block"])


def _prior_keys(digests: DataFrame) -> DataFrame:
    """(conv_id, i, prior, next) for (conv_id, i, digest): the key of what comes before each digest of a conversation, and of what comes before the following one."""
    levels = []
    while True:
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
        levels.append(stage(digests.groupBy("conv_id", F.floor(F.col("i") / FAN).alias("j")).agg(pieces.alias("below")), "digests"))
        if levels[-1].where("j > 0").isEmpty():
            break
        digests = levels[-1].select("conv_id", F.col("j").alias("i"), _digest(F.lit(b"\x02"), F.array_join(F.transform("below", F.hex), "").cast("binary")).alias("digest"))
    above = levels[-1].select("conv_id", "j", _root().alias("prior"), F.lit(None).cast("binary").alias("next"))
    for level in reversed(levels):
        grown = lambda k: F.when(k == 0, F.col("prior")).otherwise(_digest(F.lit(b"\x03"), F.col("prior"), F.array_join(F.transform(F.slice("below", 1, k), F.hex), "").cast("binary")))
        priors = F.transform(F.sequence(F.lit(0), F.size("below") - 1), grown)
        rows = level.join(above, ["conv_id", "j"]).select("conv_id", "j", "next", priors.alias("priors"))
        rows = rows.select("conv_id", "j", "next", "priors", F.posexplode("priors").alias("k", "prior"))
        following = F.when(F.col("k") + 1 < F.size("priors"), F.get("priors", F.col("k") + 1)).otherwise(F.col("next"))
        above = rows.select("conv_id", (F.col("j") * FAN + F.col("k")).alias("j"), "prior", following.alias("next"))
    return above.withColumnRenamed("j", "i")


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256) of strings that come sorted by key and place, joined by commas; a string at a time is held."""
    now, hashed = None, None
    for batch in batches:
        done = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if hashed:
                    done.append((now, hashed.hexdigest()))
                now, hashed = key, hashlib.sha256(text.encode())
            else:
                hashed.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["key", "ends_sha256"])
    if hashed:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([hashed.hexdigest()], pa.string())], ["key", "ends_sha256"])


def _ends(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, ends_sha256) for the nodes at which conversations end; at most 4,096 ids come together in a row."""
    last = blocks.select("conv_id", _key().alias("key")).unionByName(sizes.where("n = 0").select("conv_id", _root().alias("key")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = stage(last.groupBy("key", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(ids.alias("ids")), "ends")
    several = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    alone = several.where("n = 1").select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    rest = chunks.join(several.where("n > 1").select("key"), "key", "left_semi")
    streamed = rest.repartition(F.col("key")).sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(_hash_streams, "key binary, ends_sha256 string")
    return alone.unionByName(streamed)


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The trie of all prefixes of conversations given as ``turns`` (conv_id, pos, id, bytes) and ``sizes`` (conv_id, n; conversations without turns included).

    Per node: conv_id (the smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversations, no rows.
    """
    columns = _turn_columns()
    blocks = stage(block_columns(turns), "keyed")
    spark = turns.sparkSession
    rolled = spark.sql(f"SELECT block, prior, {', '.join(columns)}, {WIDTH} - bit_count(grouping_id()) AS level, min(conv_id) AS conv_id, count(*) AS n_convs, min(next) AS next FROM {{blocks}} GROUP BY block, prior, ROLLUP({', '.join(columns)})", blocks=blocks)
    deepest = F.array(*columns)[F.col("level") - 1]  # null where shorter conversations have ended
    above = _digest(F.col("prior"), *[F.when(F.col("level") > k + 1, F.coalesce(F.col(t)["id"], F.lit(b""))).otherwise(F.lit(b"")) for k, t in enumerate(columns)])
    nodes = rolled.where((F.col("level") > 0) & F.isnotnull(deepest)).select(
        "conv_id", (F.col("block") * WIDTH + F.col("level")).alias("depth"), "n_convs", _key().alias("key"), F.when(F.col("level") == 1, F.col("prior")).otherwise(above).alias("under"),
        F.when(F.col("level") == WIDTH, F.col("next")).otherwise(_key()).alias("over"), ((F.col("n_convs") - 1) * deepest["bytes"]).alias("saved"),
    )
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", _root().alias("key"), F.lit(None).cast("binary").alias("under"), _root().alias("over"), F.lit(0).cast("long").alias("saved"))
    nodes = stage(nodes.unionByName(root), "nodes")
    children = nodes.where("under IS NOT NULL").groupBy(F.col("under").alias("over")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.where("over IS NOT NULL").select(F.col("over").alias("under"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(children, "over", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).join(parents, "under", "left")
    rows = stage(rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "key", "saved", (F.col("n_children") == 0).cast("long").alias("leaf")), "family")
    ends = _ends(blocks.where("next IS NULL"), sizes)
    none = hashlib.sha256(b"").hexdigest()
    out = rows.join(_subtree_sums(rows), ["conv_id", "depth"]).join(ends, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _subtree_sums(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node, over itself and all below it."""
    hung = rows.where("parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("to"), (F.col("depth") - 1).alias("depth"))
    hung = stage(hung, "hung")
    front = rows.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    given = []
    while True:
        front = stage(front.join(hung, "conv_id").groupBy(F.col("to").alias("conv_id"), "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "given")
        if front.isEmpty():
            break
        given.append(front)
        front = front.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    every = rows.select("conv_id", "depth", "leaf", "saved")
    for part in given:
        every = every.unionByName(part)
    run = F.shiftright("depth", RUN)
    every = every.groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).withColumn("run", run)
    runs = every.groupBy("conv_id", "run").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *[F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"_{c}") for c in ("leaf", "saved")])
    within = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = every.select("conv_id", "run", "depth", *[F.sum(c).over(within).alias(c) for c in ("leaf", "saved")])
    return sums.join(runs, ["conv_id", "run"]).select("conv_id", "depth", (F.col("leaf") + F.col("_leaf")).alias("n_leaves"), (F.col("saved") + F.col("_saved")).alias("saved_tokens"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text), rebuilt by ``share_openings``.

    Rows without conv_id are in no conversation. Null role and text are empty, null
    turns come first, repeated rows are turns of their own. Other columns are not read.
    An empty table gives no rows.
    """
    numbered = stage(number_turns(turns), "numbered")
    rebuilt, sizes = share_openings(numbered)
    rebuilt, sizes = stage(rebuilt, "rebuilt"), stage(sizes, "lengths")
    discard(numbered)
    return prefix_trie(rebuilt, sizes)


#: The same in DuckDB SQL; prefixes are lists and every node is listed under all its ancestors.
SQL = """WITH RECURSIVE lettered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM lettered GROUP BY 1),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM own
  UNION ALL SELECT conv_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, CAST(ord(substr(s, i // 9 + 1, 1)) AS BIGINT)) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM crc WHERE i < 9 * length(s)),
heads AS (SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 9 * length(s)),
built AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(b.ts[:h], []), o.ts[h + 1:]) AS ts FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
members AS (SELECT conv_id, d, ts[:d] AS p, len(ts) AS n FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM built)),
nodes AS MATERIALIZED (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
family AS MATERIALIZED (SELECT n.*, coalesce(k.c, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[depth].text) END AS saved FROM nodes n LEFT JOIN (SELECT p[:depth - 1] AS q, count(*) AS c FROM nodes WHERE depth > 0 GROUP BY 1) k ON k.q = n.p),
below AS (SELECT q, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, p[:unnest(range(0, depth + 1))] AS q FROM family) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM family n JOIN below b ON b.q = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[:n.depth - 1]"""
