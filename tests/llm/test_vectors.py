"""Exact search and hard negatives against plain loops over integers."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalume.llm import hard_negatives, pivot_search
from catalume.llm.vectors import Best

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v string, rank string, score string, planes string"
EXTRA = ("x", None, "x", "x", "x")


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], label, *EXTRA) for i, v, label in rows], SCHEMA)


def whole(v):
    """The operator's whole numbers, of the vector as stored; None if it isn't usable."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))  # missing components are zero


def by_rank(found):
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def top_plain(rows, asked, k):
    own = [(i, whole(v)) for i, v, _ in rows if whole(v) is not None]
    out = []
    for a, (i, v) in enumerate(own):
        if i is not None and asked(i):
            best = by_rank([(product(v, w), j) for b, (j, w) in enumerate(own) if b != a])[:k]
            out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def negatives_plain(rows, asked):
    own = [(i, whole(v), label) for i, v, label in rows if whole(v) is not None and label is not None]
    out = []
    for a, (i, v, label) in enumerate(own):
        if i is None or not asked(i):
            continue
        scored = [(product(v, w), j, other == label) for b, (j, w, other) in enumerate(own) if b != a]
        for p, j, _ in by_rank([x for x in scored if x[2]])[:5]:
            range_ = by_rank([x for x in scored if not x[2] and 30 * p <= 100 * x[0] <= 90 * p])[:10]
            out += [(i, j, rank + 1, n, p, s) for rank, (s, n, _) in enumerate(range_)]
    return sorted(out, key=str)


def some_rows(n, width, seed, spread=1.0, ids=None):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=width) * spread).tolist(), int(rng.integers(4))) for i in (ids if ids is not None else range(n))]
    rows += [(n + k, rows[0][1], 1) for k in range(n // 3)]  # one vector that a quarter of the rows have
    return rows


ODD = [(1000, None, 1), (1010, [], 2), (1020, [1.0], 1), (1030, [None, 1.0], 1), (1040, [float("nan"), 1.0], 1), (1050, [float("inf")], 1), (None, [0.5, 0.5], 1), (0, [0.25, -0.5], 2), (0, [0.25, -0.5], 2), (1060, [0.1, 0.2], None), (-10, [-1.0, -2.0, 3.0], 3)]


@pytest.mark.parametrize(("seed", "width", "spread"), [(1, 3, 1.0), (2, 8, 0.1), (3, 64, 0.2), (4, 13, 3000.0)])
def test_top_k_equals_a_plain_loop(spark, monkeypatch, seed, width, spread):
    monkeypatch.setattr(pivot_search, "SAMPLE", 40)
    rows = some_rows(160, width, seed, spread) + ODD
    got = pivot_search.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=5, pivots=6, block=20)
    assert sorted(map(tuple, got.collect()), key=str) == top_plain(rows, lambda i: i % 10 == 0, 5)


@pytest.mark.parametrize(("seed", "width", "spread"), [(1, 3, 1.0), (2, 8, 0.1), (3, 64, 0.2), (4, 13, 3000.0)])
def test_negatives_equal_a_plain_loop(spark, monkeypatch, seed, width, spread):
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    rows = some_rows(160, width, seed, spread) + ODD
    got = hard_negatives.mine_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, block=9)
    want = negatives_plain(rows, lambda i: i % 10 == 0)
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_few_rows_and_none(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, None, 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [0.0], 0), (100, [0.0], 0), (3, [0.0], 1)]):
        df = table(spark, rows)
        assert sorted(map(tuple, pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str) == top_plain(rows, lambda i: i % 50 == 0, 5)
        assert sorted(map(tuple, hard_negatives.mine_negatives(df, F.col("vec_id") % 100 == 0).collect()), key=str) == negatives_plain(rows, lambda i: i % 100 == 0)


def test_scores_beyond_a_long_raise(spark):
    with pytest.raises(ValueError, match="long"):
        pivot_search.top_k(table(spark, [(0, [1e30, 1.0], 1)]), F.col("vec_id") == 0)


def test_subset_sums_give_full_products():
    rng = np.random.default_rng(5)
    for width, largest in ((1, 1), (8, 100), (19, 5000), (64, 2**20)):
        a, x = (rng.integers(-largest, largest + 1, (n, width)) for n in (5, 300))
        x[0], x[1] = largest, -largest
        planes = hard_negatives.pack_planes(x, hard_negatives.plane_count(largest))
        assert (hard_negatives.look_up(hard_negatives.subset_sums(a, np.int64), planes) == x @ a.T).all()


def test_pivots_spare_most_scores_of_clustered_rows():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 200
    x = np.floor(centres[np.sort(rng.integers(40, size=20_000))] + rng.normal(size=(20_000, 16)) * 4).astype(np.int64)
    pivots = pivot_search.choose_pivots(x[::20], 32)
    d = pivot_search.distances(x, pivots)
    asked = np.arange(0, len(x), 200)
    block = pivot_search.Block(pa.table({"row": asked, "vec_id": asked, "v": x[asked].tolist()}), 16, pivots, x[::20].astype(float), np.arange(0, len(x), 20), 5, True)
    best, counts = Best(len(asked), 5, block.floor), np.zeros(3, np.int64)
    lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))
    for start in range(0, len(x), 5000):
        own = np.arange(start, start + 5000)
        pivot_search.search_batch(block, best, pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), lists(x[own], pa.int64()), lists(d[own], pa.float32())], ["row", "vec_id", "v", "d"]), 16, counts)
    pairs = len(x) * len(asked)
    assert counts[2] < 0.1 * pairs and counts[1] < 0.5 * pairs
    for slot, row in enumerate(block.row.tolist()):
        score = x @ x[row]
        score[row] = -(2**62)
        assert best.kept[slot][1].tolist() == np.lexsort((np.arange(len(x)), -score))[:5].tolist()
