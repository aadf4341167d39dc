"""Shards of near-equal bytes by a k-d tree over document metadata.

Every node of the tree is split at the weighted median (by bytes) along its widest
dimension, until it is one shard. The medians of all nodes of a level are found
together by narrowing histograms: each pass sums bytes in at most ``BINS`` bins of
a node's interval and keeps the bin that the median falls into; running sums go over
coarse bins first, then over the fine bins of one. Only sums move; no node is ever
sorted or gathered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalume.llm.common import stage

#: Fine bins of a node's interval in a pass, and how many of them make a coarse one.
BINS, COARSE = 4096, 64
#: Bins of a category's hashes, by whose bytes categories get their coordinates.
CATEGORIES = 4096
#: A row's place in a node is one whole number: the widest dimension, then a hash of the text that keeps copies together, then a hash of the row's number that lets copies be cut apart.
DIM_BITS, GROUP_BITS, ROW_BITS = 20, 20, 22
KEY_BITS = DIM_BITS + GROUP_BITS + ROW_BITS
#: Buckets of a shard within which rows are numbered.
SLOT_BUCKETS = 4096
DIMENSIONS = ("_d0", "_d1", "_d2", "_d3")


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, one for each node, without Python on executors."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    values = ", ".join("(" + ", ".join(f"CAST({x!r} AS {k})" for x, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def metadata(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, the dimensions and the hashes that break ties; _id numbers the rows. Written once, so that numbers stay.

    The dimensions: source and language, each by the share of all bytes that lies
    before it (in an order of hashes), the logarithm of the size, and doc_id (as a
    number, or a hash of it where it is none).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(t).cast("long") + 1
    category = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    number = F.coalesce(F.col(doc_id).try_cast("double"), F.crc32(F.col(doc_id).cast("string").cast("binary")).cast("double"), F.lit(0.0))
    rows = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), category(source).alias("_c0"), category(lang).alias("_c1"),
            F.log2(size.cast("double")).alias("_d2"), number.alias("_d3"), low(F.xxhash64(t), GROUP_BITS).alias("_group"), F.monotonically_increasing_id().alias("_id"),
        ), "metadata",
    )
    for k in (0, 1):
        rows = rows.join(F.broadcast(_shares(rows, f"_c{k}", k)), F.pmod(f"_c{k}", F.lit(CATEGORIES)) == F.col(f"_bin{k}"))
        inside = F.floor(F.col(f"_c{k}") / CATEGORIES) / float((1 << 32) // CATEGORIES)
        rows = rows.withColumn(f"_d{k}", F.col(f"_before{k}") + inside * F.col(f"_share{k}"))
    return rows.select("doc_id", "size", "text_crc32", *DIMENSIONS, "_group", low(F.xxhash64("_id"), ROW_BITS).alias("_row"), "_id")


def _shares(rows: DataFrame, category: str, k: int) -> DataFrame:
    """Each bin of category hashes with its share of the bytes and the share before it: at most ``CATEGORIES`` rows."""
    bins = rows.groupBy(F.pmod(category, F.lit(CATEGORIES)).alias(f"_bin{k}")).agg(F.sum("size").cast("double").alias("_bytes"))
    all_bytes, upto = F.sum("_bytes").over(Window.partitionBy()), F.sum("_bytes").over(Window.orderBy(f"_bin{k}"))
    return bins.select(f"_bin{k}", (F.col("_bytes") / all_bytes).alias(f"_share{k}"), ((upto - F.col("_bytes")) / all_bytes).alias(f"_before{k}"))


def _widest(rows: DataFrame, open_nodes: dict[int, int], scale: list[float]) -> dict[int, tuple[int, float, float, int]]:
    """For each node to split: its widest dimension, that dimension's range, its bytes. One row for each node reaches the driver."""
    spans = [f(d) for d in DIMENSIONS for f in (F.min, F.max)]
    found = rows.groupBy("_node").agg(F.sum("size").alias("bytes"), *spans).collect()
    out = {}
    for r in found:
        if r[0] in open_nodes:
            widths = [(r[3 + 2 * k] - r[2 + 2 * k]) / scale[k] if scale[k] else 0.0 for k in range(len(DIMENSIONS))]
            best = max(range(len(DIMENSIONS)), key=lambda k: (widths[k], -k))
            out[r[0]] = (best, r[2 + 2 * best], r[3 + 2 * best], r[1])
    return out


def _medians(keyed: DataFrame, goals: dict[int, float], tolerance: float) -> dict[int, int]:
    """For each node the cut: rows with a smaller key come to about ``goals[node]`` bytes."""
    spark = keyed.sparkSession
    inside = {n: (0, 1 << KEY_BITS, 0) for n in goals}  # from, to, bytes before
    cuts: dict[int, int] = {}
    while inside:
        width = {n: -(-(b - a) // BINS) for n, (a, b, _) in inside.items()}
        at = _local(spark, [(n, inside[n][0], inside[n][1], width[n]) for n in inside], "_node bigint, _from bigint, _to bigint, _width bigint")
        bins = (
            keyed.join(F.broadcast(at), "_node").where((F.col("_key") >= F.col("_from")) & (F.col("_key") < F.col("_to")))
            .groupBy("_node", F.expr("(_key - _from) div _width").alias("_bin")).agg(F.sum("size").alias("_bytes"))
        )
        # the bin where the running sum passes the goal; sums run over the coarse bins, and over the fine ones in each
        goal = _local(spark, [(n, goals[n] - inside[n][2]) for n in inside], "_node bigint, _goal double")
        bins = bins.withColumn("_coarse", F.expr(f"_bin div {COARSE}"))
        coarse = bins.groupBy("_node", "_coarse").agg(F.sum("_bytes").alias("_all"))
        before = coarse.select("_node", "_coarse", (_running("_all", ["_node"], "_coarse") - F.col("_all")).alias("_less"))
        upto = bins.withColumn("_part", _running("_bytes", ["_node", "_coarse"], "_bin")).join(before, ["_node", "_coarse"]).withColumn("_upto", F.col("_less") + F.col("_part"))
        reached = upto.join(F.broadcast(goal), "_node").where(F.col("_upto") >= F.col("_goal"))
        crossing = reached.groupBy("_node").agg(F.min(F.struct("_bin", "_bytes", "_upto")).alias("b")).select("_node", "b.*").collect()
        seen = {r[0]: r for r in crossing}
        for n in list(inside):
            a, b, before = inside.pop(n)
            if n not in seen:  # nothing left above the goal: everything goes left
                cuts[n] = b
                continue
            _, k, weight, upto = seen[n]
            low, high = a + k * width[n], min(b, a + (k + 1) * width[n])
            less = before + upto - weight
            if width[n] == 1 or weight <= tolerance * goals[n]:
                cuts[n] = high if before + upto - goals[n] <= goals[n] - less else low
            else:
                inside[n] = (low, high, less)
    return cuts


def _running(x: str, by: list[str], order: str) -> Column:
    return F.sum(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def kd_shards(docs: DataFrame, shards: int = 16, *, tolerance: float = 0.0005, target_bytes: int | None = None, max_shards: int = 4096, **columns: str) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal size in bytes.

    With ``target_bytes`` the number of shards follows from the total size; more than
    ``max_shards`` raise, as so many rows describe the tree on the driver. Returns
    doc_id, size (UTF-8 bytes of the text plus 1; null text counts as empty),
    text_crc32, shard from 0 and slot (gapless from 0 in each shard). Along a
    dimension, rows with equal values are ordered by a hash of the text, so that
    copies with equal metadata are cut apart only where a shard must end; then by a
    hash of the row's number, so that even rows that are equal in all columns are
    cut where it must be. Null source, lang or doc_id count as empty or 0; a doc_id
    may be of any type that casts to a string. An empty table gives an empty result. Other columns are ignored.
    """
    rows = stage(metadata(docs, **columns).withColumn("_node", F.lit(0).cast("long")), "kdtree")
    total, *spans = rows.agg(F.sum("size"), *[F.max(d) - F.min(d) for d in DIMENSIONS]).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
        if shards > max_shards:
            raise ValueError(f"{shards} shards of {target_bytes} bytes; max_shards is {max_shards}")
    leaves = {0: (0, shards)}  # node: its first shard and how many shards it becomes
    names = 1
    while total and (split := {n: k for n, (_, k) in leaves.items() if k > 1}):
        facts = _widest(rows, split, spans)
        ranges = _local(rows.sparkSession, [(n, d, lo, hi) for n, (d, lo, hi, _) in facts.items()], "_node bigint, _dim int, _lo double, _hi double") if facts else None
        if ranges is None:
            break
        value = F.coalesce(*[F.when(F.col("_dim") == k, F.col(d)) for k, d in enumerate(DIMENSIONS)])
        place = F.when(F.col("_hi") > F.col("_lo"), F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * float((1 << DIM_BITS) - 1))).otherwise(0).cast("long")
        key = F.shiftleft(place, GROUP_BITS + ROW_BITS) + F.shiftleft(F.col("_group"), ROW_BITS) + F.col("_row")
        keyed = rows.join(F.broadcast(ranges), "_node", "left").withColumn("_key", F.coalesce(key, F.lit(0).cast("long"))).drop("_dim", "_lo", "_hi")
        cuts = _medians(keyed, {n: facts[n][3] * ((split[n] + 1) // 2) / split[n] for n in facts}, tolerance)
        moves = []
        for n, k in split.items():
            first, _ = leaves.pop(n)
            left = (k + 1) // 2
            leaves[names], leaves[names + 1] = (first, left), (first + left, k - left)
            moves.append((n, cuts.get(n, 0), names, names + 1))
            names += 2
        where = _local(rows.sparkSession, moves, "_node bigint, _cut bigint, _left bigint, _right bigint")
        rows = stage(
            keyed.join(F.broadcast(where), "_node", "left")
            .withColumn("_node", F.when(F.col("_cut").isNull(), F.col("_node")).when(F.col("_key") < F.col("_cut"), F.col("_left")).otherwise(F.col("_right")))
            .drop("_key", "_cut", "_left", "_right"), "kdtree",
        )
    at = _local(rows.sparkSession, [(n, first) for n, (first, _) in leaves.items()], "_node bigint, shard int")
    placed = rows.join(F.broadcast(at), "_node").select("doc_id", "size", "text_crc32", "shard", "_id")
    return number_slots(placed, F.pmod(F.xxhash64("_id"), F.lit(SLOT_BUCKETS))).drop("_id")


def number_slots(placed: DataFrame, bucket: Column) -> DataFrame:
    """Add ``slot`` to rows (shard, _id): rows are numbered within small hashed buckets, and buckets start where the ones before end."""
    placed = placed.withColumn("_bucket", bucket)
    own = Window.partitionBy("shard", "_bucket")
    rank = F.row_number().over(own.orderBy("_id"))
    sizes = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    starts = sizes.select("shard", "_bucket", before.alias("_before"))
    return placed.withColumn("_rank", rank).join(starts, ["shard", "_bucket"]).withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_rank", "_before", "_bucket")
