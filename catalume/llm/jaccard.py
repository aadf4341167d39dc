"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, linked exactly.

SimHash finds most of them cheaply: fingerprints over the same shingles are linked by
multi-index hashing, and every link is verified on the shingles. Texts at 0.8 differ
by about ten of 64 bits, though, which no small Hamming ball reaches, so a prefix
filter completes the links: of two sets that are that much alike, each has one of the
other's shingles among its first ``n - ceil(0.8 n) + 1`` in any order that all sets
share, and the first one that they share stands so early in both that enough can
follow it. The order is by how many texts have a shingle, rare first; counts by bucket
of hashes serve for that, as only the order must be the same for all. The more texts
there are, the less such a count says about one shingle, so those that turn out to
stand early in many texts are put behind all others, and the texts that had them early
get new first ones. Equal sets are folded first; what SimHash left apart is held against the most typical text, and only
texts that aren't linked by then are paired. No link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm import simhash
from catalume.llm.common import discard, free_name, release, shelve, stage
from catalume.llm.simhash import SEED, components

WIDTH, LEAST = 5, 0.8
#: Buckets of shingle hashes, counted to tell rare from frequent.
BUCKETS = 1 << 16
#: A shingle that so many different texts, not all linked, have early is put last in the order.
CROWDED = 8
#: Words that a task remembers.
CACHE = 200_000
#: Bits of the sieve that tells most shingles of one text from those of several; its size doesn't grow with the data.
BITS = 1 << 25
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles; words as in ``simhash.fingerprint``."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        if len(self.known) > CACHE:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        w = (text or "").encode().lower().split()
        if not w:
            return np.empty(0, np.uint64)
        for x in set(w).difference(known):
            known[x] = digest(x, SEED)
        h = np.array([known[x] for x in w], np.uint64)
        size = min(self.width, len(h))  # a shorter text is one shingle
        out = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            out = (out + h[k : k + len(out)]) * MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def _bucket(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return ((shingles >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)


def _prefix(shingles: np.ndarray, least: float, *ranks: np.ndarray) -> np.ndarray:
    """The shingles of which one at least is in every set that is alike, in the order of the last of ``ranks``, then the one before it, then the hashes."""
    return shingles[np.lexsort((shingles, *ranks))[: len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1]]


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``least`` or more; sets without words are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _popularity(rows: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many texts have shingles of each bucket. Its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, total = Shingles(width), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                np.add.at(total, _bucket(own(value.as_py()), buckets), 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    got = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _described(rows: DataFrame, shared: Broadcast[np.ndarray], width: int, least: float) -> DataFrame:
    """(row, name, size, digest, code, fp, typical, prefix) of each row: code is a part of the digest, fp the SimHash, typical the mean logarithm of the shingles' popularity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        popular, own = shared.value, Shingles(width)
        for batch in batches:
            size, digest, prints, typical, prefix = [], [], [], [], []
            for value in batch.column(2):
                s = own(value.as_py())
                n = popular[_bucket(s, len(popular))]
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                prints.append(simhash.majority(len(s), [s]))
                typical.append(float(np.log2(n).mean()) if len(s) else 0.0)
                prefix.append(_prefix(s, least, n).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(np.array([int.from_bytes(x[:8]) for x in digest], np.uint64).view(np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(typical, pa.float64()), pa.array(prefix, pa.list_(pa.int64()))], ["row", "name", "size", "digest", "code", "fp", "typical", "prefix"])

    kind = rows.schema["name"].dataType.simpleString()
    return stage(rows.select("row", "name", "text").mapInArrow(run, f"row long, name {kind}, size long, digest binary, code long, fp long, typical double, prefix array<long>"), "shingles")


def _verified(pairs: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are alike by their shingles.

    The same plan at every size: where ``rows`` lie in buckets of ``row``, they aren't
    shuffled to be looked up, and only texts of pairs travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, last, at = Shingles(width), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, at = a[k], own(batch.column(2)[k].as_py())
                if alike(at, own(batch.column(3)[k].as_py()), least):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    # the pairs go to the texts: first to b's, with which they travel on to a's
    needed = pairs.select(F.col("a").alias("row")).distinct().hint("shuffle_hash")
    firsts = stage(rows.join(needed, "row", "left_semi").select(F.col("row").alias("a"), F.col("text").alias("text_a")), "compared")
    seconds = rows.join(pairs.hint("shuffle_hash"), F.col("row") == F.col("b")).select("a", "b", F.col("text").alias("text_b"))
    both = seconds.join(firsts.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    alike_pairs = stage(both.mapInArrow(run, "a long, b long"), "alike")
    discard(firsts)
    return alike_pairs


def _bitmap(keys: DataFrame) -> Broadcast[np.ndarray]:
    """A bitmap of fixed size with the bits of all ``keys`` (key) set."""
    word = F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(BITS - 1).cast("long")), 6)
    bit = F.expr("bit_or(shiftleft(1L, CAST(key & 63 AS INT)))")
    got = keys.groupBy(word.alias("word")).agg(bit.alias("bits")).toArrow()  # at most BITS / 64 rows
    bits = np.zeros(BITS // 64, np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` a bitmap lets through: 1 or 0 of each."""
    place = keys.view(np.uint64) & np.uint64(BITS - 1)
    return bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)


def _holding(found: DataFrame, last: Broadcast[np.ndarray]) -> DataFrame:
    """The (row) of those in ``found`` that have a key of the bitmap ``last`` in their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at = np.flatnonzero(_has(last.value, batch.column(1).flatten().to_numpy()))
            row = np.unique(np.searchsorted(batch.column(1).offsets.to_numpy(), at, side="right") - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row))], ["row"])

    return found.select("row", "prefix").mapInArrow(run, "row long")


def _reordered(rows: DataFrame, shared: Broadcast[np.ndarray], last: Broadcast[np.ndarray], width: int, least: float) -> DataFrame:
    """(row, prefix, added) of each of ``rows``, with the keys of the bitmap ``last`` behind all others; added are those of the prefix that come new into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        popular, own = shared.value, Shingles(width)
        for batch in batches:
            prefix, added = [], []
            for value in batch.column(1):
                s = own(value.as_py())
                n = popular[_bucket(s, len(popular))]
                now = _prefix(s, least, n, _has(last.value, s))
                prefix.append(now.view(np.int64))
                added.append(np.setdiff1d(now, _prefix(s, least, n), assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prefix, pa.list_(pa.int64())), pa.array(added, pa.list_(pa.int64()))], ["row", "prefix", "added"])

    return stage(rows.select("row", "text").mapInArrow(run, "row long, prefix array<long>, added array<long>"), "reordered")


def _sieved(found: DataFrame, shared: DataFrame, but: Broadcast[np.ndarray] | None = None) -> DataFrame:
    """(row, pos, key) of the prefixes in ``found`` for all keys that are ``shared``, and few others: what a bitmap of fixed size lets through. Prefixes with a key of the bitmap ``but`` are left out."""
    sieve = _bitmap(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            keys = batch.column(1).flatten().to_numpy()
            at = np.flatnonzero(_has(sieve.value, keys))
            row = np.searchsorted(ends, at, side="right") - 1
            if but is not None:
                out = np.zeros(batch.num_rows, bool)
                out[np.searchsorted(ends, np.flatnonzero(_has(but.value, keys)), side="right") - 1] = True
                at, row = at[~out[row]], row[~out[row]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((at - ends[row]).astype(np.int32)), pa.array(keys[at])], ["row", "pos", "key"])

    return found.select("row", "prefix").mapInArrow(run, "row long, pos int, key long")


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (row, ...) with the group that ``links`` (a, b) put each into; its own where it has no link."""
    group = components(links).select(F.col("node").alias("row"), F.col("root").alias("group"))
    return rows.join(group, "row", "left").withColumn("group", F.coalesce("group", "row"))


def near_copies(rows: DataFrame, *, width: int = WIDTH, least: float = LEAST, buckets: int = BUCKETS, crowded: int = CROWDED) -> DataFrame:
    """(row, first) for each of ``rows`` (row, name, text): the row of its group of linked texts that has the least name, then the least row.

    Null names come last. Texts without words are equal. ``rows`` are read several
    times and joined by ``row``; best they lie in buckets of it (``shelve``).
    """
    popular = rows.sparkSession.sparkContext.broadcast(_popularity(rows, width, buckets))
    found = _described(rows, popular, width, least)
    order = F.struct(F.col("name").isNull().alias("unnamed"), "name", "row")
    folded = stage(found.groupBy("digest").agg(F.min(order).alias("at")), "folded")
    single = found.join(folded.select(F.col("at.row").alias("row")), "row", "left_semi")
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * least - 1e-9
    # SimHash first: texts of one fingerprint with the least of them, and fingerprints that multi-index hashing links
    facts = stage(single.select("row", "size", "typical", "fp"), "facts")
    least_of = stage(facts.groupBy("fp").agg(F.min("row").alias("row")), "leasts")
    leader = lambda fp, row: least_of.select(F.col("fp").alias(fp), F.col("row").alias(row))
    near = simhash.links(least_of).withColumnsRenamed({"a": "fa", "b": "fb"}).join(leader("fa", "a"), "fa").join(leader("fb", "b"), "fb").select("a", "b")
    same = facts.join(leader("fp", "a"), "fp").where(F.col("a") < F.col("row")).select("a", F.col("row").alias("b"))
    hashed = _verified(stage(near.unionByName(same), "hashed"), rows, width, least)
    # the shingles that several texts have early: only keys travel, then the few rows that have one of them
    keys = found.select("code", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    shared = stage(keys.where("low <> high").select("key"), "shared")
    grouped = stage(_grouped(facts.drop("fp"), hashed), "grouped")
    # those that many have early go to the end of the order; other prefixes stay as they are, as they have none of these
    counted = _sieved(found, shared).join(grouped.select("row", "group"), "row").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
    last = _bitmap(counted.where((F.col("n") >= crowded) & (F.col("low") != F.col("high"))).select("key"))
    moved = stage(_holding(found, last).join(facts, "row", "left_semi"), "moved")
    anew = _reordered(rows.join(moved.hint("shuffle_hash"), "row", "left_semi"), popular, last, width, least)
    early = stage(shared.union(anew.select(F.explode("added").alias("key"))).distinct(), "early")
    filed = _sieved(found, early, but=last).union(_sieved(anew, early)).join(early, "key", "left_semi")
    filed = stage(filed.join(grouped, "row"), "filed")  # of copies, the one that stands for them
    mixed = filed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    met = stage(filed.join(mixed, "key", "left_semi"), "met")
    ahead = lambda x, p, y, q: F.least(x - p, y - q) >= least / (1 + least) * (x + y) - 1e-9
    # each against the typical text that has the shingle
    hub = F.max(F.struct("typical", *[F.col(c).alias(f"hub_{c}") for c in ("row", "size", "pos", "group")]))
    hubs = met.groupBy("key").agg(hub.alias("hub")).select("key", "hub.*").drop("typical")
    possible = (F.col("group") != F.col("hub_group")) & fits(F.col("size"), F.col("hub_size")) & ahead(F.col("size"), F.col("pos"), F.col("hub_size"), F.col("hub_pos"))
    stars = stage(met.join(hubs, "key").where(possible).select(F.col("hub_row").alias("a"), F.col("row").alias("b")).distinct(), "stars")
    links = hashed.unionByName(_verified(stars, rows, width, least))
    # what the stars left apart
    apart = stage(_grouped(met.select("key", "row", "size", "pos"), links), "apart")
    mixed = apart.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    left = apart.join(mixed, "key", "left_semi").select("key", "row", "size", "pos", "group")
    right = left.select("key", *[F.col(c).alias(f"{c}_b") for c in ("row", "size", "pos", "group")])
    both = left.join(right, "key").where((F.col("row") < F.col("row_b")) & (F.col("group") != F.col("group_b")) & fits(F.col("size"), F.col("size_b")) & ahead(F.col("size"), F.col("pos"), F.col("size_b"), F.col("pos_b")))
    pairs = both.select(F.col("row").alias("a"), F.col("row_b").alias("b")).distinct()
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    more = _verified(pairs, rows, width, least)
    roots = stage(components(links.unionByName(more)), "roots")
    rooted = folded.join(roots, F.col("at.row") == F.col("node"), "left").select("digest", "at", F.coalesce("root", "at.row").alias("root"))
    named = rooted.groupBy("root").agg(F.min("at").alias("least")).select("root", F.col("least.row").alias("first"))
    out = stage(found.select("row", "digest").join(rooted.join(named, "root").select("digest", "first"), "digest").select("row", "first"), "firsts")
    discard(found, folded, facts, least_of, shared, moved, anew, early, grouped, filed, met, stars, apart, pairs, roots)
    return out


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least doc_id, of equal ones the first.

    Decisions go by row: repeated rows and rows that share a doc_id are told apart, and
    a row without doc_id stays only where its group has none with one. Null and empty
    texts are copies of each other. Other columns are kept as they are, whatever their
    names; an empty table gives an empty result.
    """
    key = free_name(docs, "_row")
    numbered = shelve(docs.withColumn(key, F.monotonically_increasing_id()), key, "rows")
    rows = numbered.select(F.col(doc_id).alias("name"), F.col(text).alias("text"), F.col(key).alias("row"))
    first = near_copies(rows, width=width, least=least).where("row = first").select(F.col("row").alias(key))
    return numbered.join(first.hint("shuffle_hash"), key, "left_semi").drop(key).select(*docs.columns)
