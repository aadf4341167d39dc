"""Near-duplicates by 64-bit SimHash, linked exactly with multi-index hashing.

Fingerprints that differ in at most three bits agree in at least one 32-bit half up
to one flipped bit. Every half is filed as it is in a table; every fingerprint
looks up the 33 values of the Hamming ball of radius one around each of its halves
and verifies the whole distance of what it meets. Copies are folded to one
fingerprint first, and crowded table entries are dealt out further by bytes of the
other half (of which one must agree), so no key's work lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import discard, release, stage

SEED = 42
#: Shingles hashed at a time.
BLOCK = 100_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned SimHash of a text's word shingles; 0 without words."""
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: only A-Z is lower-cased, only ASCII white space cuts
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))) if len(w) >= width else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return majority(len(shingles), (np.array([digest(s, SEED) for s in shingles[k : k + BLOCK]], np.uint64) for k in range(0, len(shingles), BLOCK)))


def majority(n: int, hashes: Iterable[np.ndarray]) -> int:
    """The bits that over half of ``n`` 64-bit hashes, given in parts, have set."""
    ones = np.zeros(64, np.int64)
    for part in hashes:
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, *, text: str = "text", out: str = "fp", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and each row's fingerprint as a (signed) long."""
    from pyspark.sql import types as T

    fields = [docs.schema[c] for c in keep] + [T.StructField(out, T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            prints = np.array([fingerprint(x.as_py()) for x in batch.column(len(keep))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints.view(np.int64))], [f.name for f in fields])

    return docs.select(*keep, text).mapInArrow(run, T.StructType(fields))


HALVES = (0, 32)
#: A table entry with more fingerprints than this is dealt out by bytes of the other half.
CROWDED = 1000


def _half(fp, shift: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def links(prints: DataFrame, *, fp: str = "fp", crowded: int = CROWDED) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints in ``prints`` that differ in one to three bits.

    A half is a key of 33 bits: which half, then its value.
    """
    tag = lambda shift: F.lit((shift // 32) << 32).cast("long")
    base = prints.select(F.col(fp).alias("fp"))
    tables = F.array(*[F.struct((_half(F.col("fp"), s) + tag(s)).alias("key")) for s in HALVES])
    filed = base.select("fp", F.inline(tables)).select("key", F.col("fp").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])

    def ball(shift: int):
        return F.transform(flips, lambda m: _half(F.col("fp"), shift).bitwiseXOR(m) + tag(shift))

    balls = F.concat(*map(ball, HALVES))
    probes = base.select(F.col("fp").alias("a"), F.explode(balls).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    full = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key")
    full = stage(full, "crowded")
    if full.isEmpty():
        return probes.join(filed.hint("shuffle_hash"), "key").where(near).select("a", "b").distinct()
    # which entries are crowded is known by their keys alone; each has over ``crowded`` fingerprints, so there are few
    light = probes.join(full, "key", "left_anti").join(filed.join(full, "key", "left_anti"), "key").where(near)
    # of the other half's four bytes one agrees, as at most three bits differ
    other = lambda c: F.array(*[F.shiftrightunsigned(F.when(F.col("key") < (1 << 32), F.shiftrightunsigned(c, 32)).otherwise(c), 8 * i).bitwiseAND(F.lit(255).cast("long")) + 256 * i for i in range(4)])
    finer = lambda df, c: df.join(full, "key", "left_semi").select("*", F.explode(other(F.col(c))).alias("byte"))
    dense = finer(probes, "a").join(finer(filed, "b"), ["key", "byte"]).where(near)
    return light.select("a", "b").union(dense.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Alternating star contraction: each round is two small shuffles and is written
    to the shared folder; the number of rounds grows with the logarithm of a
    component's diameter.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stage(small.where("u <> v").distinct(), "edges")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_links, n_same.

    component_id is the least doc_id that links of up to three differing bits
    reach, itself included; n_links counts the other fingerprints linked directly,
    n_same the rows with the same fingerprint. Null and empty texts have
    fingerprint 0 and link like any other. Rows without doc_id belong to their
    component but never name it (null if no row of it has one). Repeated rows each
    get their row; an empty table gives an empty result; other columns are ignored.
    """
    prints = stage(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "prints")
    same = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")), "same")
    pairs = stage(links(same), "links")
    roots = stage(components(pairs), "roots")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = same.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = stage(rooted.join(named, "root").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_same"), "facts")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(facts, "fp").select("doc_id", hexed, "component_id", "n_links", "n_same")
