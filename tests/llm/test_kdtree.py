"""K-d shards against a tree that sorts every node, and on repeated rows and odd ids."""

import collections

import pytest
from pyspark.sql import functions as F

from catalume.llm import kdtree

SF = "/root/testdata/sf0.001"


def brute(rows, shards):
    """Shards by sorting: split at the weighted median along the widest dimension, again and again."""
    span = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in kdtree.DIMENSIONS]
    out, todo = {}, [(rows, 0, shards)]
    while todo:
        own, first, k = todo.pop()
        if k == 1:
            out.update((r["_id"], first) for r in own)
            continue
        ends = [(min(r[d] for r in own), max(r[d] for r in own)) for d in kdtree.DIMENSIONS]
        widths = [(z - a) / s if s else 0.0 for (a, z), s in zip(ends, span, strict=True)]
        best = max(range(4), key=lambda d: (widths[d], -d))
        (low, high), name = ends[best], kdtree.DIMENSIONS[best]

        def key(r, low=low, high=high, name=name):
            place = int((r[name] - low) / (high - low) * ((1 << kdtree.DIM_BITS) - 1)) if high > low else 0
            return (place << kdtree.GROUP_BITS + kdtree.ROW_BITS) + (r["_group"] << kdtree.ROW_BITS) + r["_row"]

        own = sorted(own, key=key)
        left = (k + 1) // 2
        goal = sum(r["size"] for r in own) * left / k
        at, before = 0, 0
        while at < len(own) and before + own[at]["size"] < goal:
            before += own[at]["size"]
            at += 1
        if at < len(own) and before + own[at]["size"] - goal <= goal - before:
            at += 1
        todo += [(own[:at], first, left), (own[at:], first + left, k - left)]
    return out


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_equals_a_tree_that_sorts(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([r.asDict() for r in kdtree.metadata(docs).collect()], shards)
    ids = {r._id: r.doc_id for r in kdtree.metadata(docs).collect()}
    got = {r.doc_id: r.shard for r in kdtree.kd_shards(docs, shards, tolerance=0.0).collect()}
    assert got == {ids[i]: s for i, s in want.items()}


def test_equal_rows_are_cut_apart(spark):
    rows = spark.range(1000).select(F.lit(7).alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = kdtree.kd_shards(rows, 4).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) and abs(len(s) - 250) <= 1 for s in slots.values())


def test_ids_of_other_types_and_a_bound_on_shards(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("a-1", "x", "en", "s"), ("17", "y" * 99, "de", "s")] * 5, "doc_id string, text string, lang string, source string")
    got = kdtree.kd_shards(rows, target_bytes=200).collect()
    assert len(got) == 15 and {r.shard for r in got} == {0, 1, 2}
    with pytest.raises(ValueError, match="max_shards"):
        kdtree.kd_shards(rows, target_bytes=10, max_shards=4)
