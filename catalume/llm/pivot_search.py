"""Exact search for the highest inner products by pivot-table elimination.

As ``q.x = (|q|**2 + |x|**2 - d(q, x)**2) / 2``, a lower bound of a distance is an upper
bound of a score. The distances of every row to the pivots are computed once and kept in
a table, sorted by nearest pivot. By the triangle inequality the largest difference of a
query's and a row's distances to any pivot is a lower bound of theirs. A task bounds
runs of rows first, by the range of their distances, then rows, and computes scores of
queries that are alike in order of the bounds until no later bound reaches the k-th
score found for its query: nothing beyond can enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import discard, stage
from catalume.llm.vectors import Best, Vectors, best_of_all, in_blocks, matrix, numbers, whole_vectors

#: Rows that pivots are chosen from and that give every query a first threshold.
SAMPLE = 2048
#: Rows of the table at a time, rows bounded by one range, queries that go together, and rows scored before the first look at the next bound.
ROWS, RUN, AT_ONCE, FIRST = 4096, 128, 32, 128
FOUND = "query_row long, query_id long, score long, row long, vec_id long"


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of a sample, each the farthest from those before; fewer if no others are left."""
    if not len(sample):
        return sample
    points = sample.astype(np.float64)
    far = ((points - points.mean(0)) ** 2).sum(1)
    picked = []
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        gap = ((points - points[picked[-1]]) ** 2).sum(1)
        far = gap if len(picked) == 1 else np.minimum(far, gap)
    return sample[picked or [0]]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T))).astype(np.float32)


def pivot_table(vectors: Vectors, pivots: np.ndarray) -> DataFrame:
    """``vectors.rows`` with d, their distances to the pivots, sorted over the whole table by the nearest pivot and the distance to it."""
    width = vectors.width

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column(2), width), pivots)
            near = d.argmin(1)
            offsets = pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32())
            columns = [*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(d.ravel())), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "v", "d", "cell", "near"])

    rows = vectors.rows.select("row", "vec_id", "v").mapInArrow(measure, "row long, vec_id long, v array<long>, d array<float>, cell int, near float")
    return stage(rows.repartitionByRange("cell", "near", "row").sortWithinPartitions("cell", "near", "row").drop("cell", "near"), "pivot-table")


class Block:
    """A block of queries: their vectors, squared lengths, distances to the pivots and first thresholds."""

    def __init__(self, asked: pa.Table, width: int, pivots: np.ndarray, sample: np.ndarray, sample_rows: np.ndarray, k: int, exact: bool):
        nearest = distances(matrix(asked.column("v").combine_chunks(), width), pivots).argmin(1)
        asked = asked.take(np.argsort(nearest, kind="stable")).combine_chunks()  # queries that go together are alike
        self.row = asked.column("row").to_numpy()
        self.ids = asked.column("vec_id").to_numpy()
        self.q = matrix(asked.column("v").combine_chunks(), width).astype(np.float64 if exact else np.int64)
        self.far, self.square = distances(self.q, pivots), (self.q.astype(np.float64) ** 2).sum(1)
        self.floor = np.full(len(self.row), np.iinfo(np.int64).min)
        for c in range(len(self.row) if len(sample) > k else 0):  # the k-th best of the sample's own scores; its rows come up in the search, too
            score = np.delete(sample @ self.q[c], np.flatnonzero(sample_rows == self.row[c]))
            if len(score) >= k:
                self.floor[c] = np.partition(score, len(score) - k)[len(score) - k]


def search_batch(block: Block, best: Best, batch: pa.RecordBatch, width: int, counts: np.ndarray) -> None:
    """Offer to ``best`` every row of a batch of the pivot table that may be among the best of a query. counts: bounds of runs, bounds of rows, scores."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        _search_rows(block, best, part.column(0).to_numpy(), numbers(part.column(1)), matrix(part.column(2), width), matrix(part.column(3), block.far.shape[1]), counts)


def _search_rows(block: Block, best: Best, row: np.ndarray, ids: tuple[np.ndarray, np.ndarray], x: np.ndarray, d: np.ndarray, counts: np.ndarray) -> None:
    vec_id, null = ids
    x = x.astype(block.q.dtype)
    square = (x.astype(np.float64) ** 2).sum(1)
    at = np.arange(0, len(row), RUN)
    low, high, longest = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at), np.maximum.reduceat(square, at)
    spread = float(max(d.max(), block.far.max())) ** 2
    slack = 1 + 1e-6 * (spread + square.max() + block.square.max())  # more than single precision may err
    for first in range(0, len(block.row), AT_ONCE):
        own = slice(first, first + AT_ONCE)
        far, long_ = block.far[own], block.square[own]
        gap = np.zeros((len(at), len(far)), np.float32)
        for p in range(far.shape[1]):
            np.maximum(gap, np.maximum(low[:, p, None] - far[None, :, p], far[None, :, p] - high[:, p, None]), out=gap)
        alive = (longest[:, None] + long_ - gap.astype(np.float64) ** 2) / 2 + slack >= best.floor[own]
        counts[0] += alive.size
        near = np.flatnonzero(np.repeat(alive.any(1), RUN)[: len(row)])
        gap = np.zeros((len(near), len(far)), np.float32)
        for p in range(far.shape[1]):
            np.maximum(gap, np.abs(d[near, p, None] - far[None, :, p]), out=gap)
        counts[1] += gap.size
        bound = (square[near, None] + long_ - gap.astype(np.float64) ** 2) / 2 + slack
        lead = (bound - best.floor[own]).max(1, initial=-1)
        rest, size = np.argsort(-lead)[: int((lead >= 0).sum())], FIRST
        while len(rest):
            now, rest = near[rest[:size]], rest[size:]
            score = (x[now] @ block.q[own].T).astype(np.int64)
            counts[2] += score.size
            wins = (score >= best.floor[own]) & (row[now, None] != block.row[own])
            for c in np.flatnonzero(wins.any(0)).tolist():
                some = now[wins[:, c]]
                best.offer(first + c, score[wins[:, c], c], row[some], vec_id[some], null[some])
            rest, size = rest[(bound[rest] >= best.floor[own]).any(1)], size * 2


def top_k(df: DataFrame, is_query: Column, *, k: int = 5, pivots: int = 32, block: int = 4096, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is a query, the ``k`` other rows of highest inner product of floor(scale * x); ties to the smaller vec_id.

    Exact. Rows are told apart by place, not by id: of rows with one id each is a query
    and a candidate of its own, a repeated row the best match of itself perhaps; a null
    vec_id is never a query unless ``is_query`` says so, and comes last among ties. Rows
    without a usable vector (``whole_vectors``) take no part; other columns aren't read.
    An empty table gives no rows. Pivots come from a sample of at most ``SAMPLE`` rows
    or so; they bear on speed alone.
    """
    vectors = whole_vectors(df, scale=scale, vector=vector, asked=F.coalesce(is_query, F.lit(False)))
    width, exact = vectors.width, vectors.floats_are_exact
    n = max(1, vectors.rows.count())
    some = vectors.rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) <= int(min(1.0, SAMPLE / n) * (1 << 40))).select("row", "v").limit(2 * SAMPLE).toArrow().combine_chunks()
    sample, sample_rows = matrix(some.column("v").combine_chunks(), width) if some.num_rows else np.zeros((0, width), np.int64), some.column("row").to_numpy()
    chosen = choose_pivots(sample, pivots) if len(sample) else np.zeros((1, width), np.int64)
    sample = sample.astype(np.float64 if exact else np.int64)
    table = pivot_table(vectors, chosen)
    spark = df.sparkSession

    def search(asked: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(Block(asked, width, chosen, sample, sample_rows, k, exact))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best = Best(len(queries.row), k, queries.floor)
            for batch in batches:
                search_batch(queries, best, batch, width, np.zeros(3, np.int64))
            slot, columns = best.columns()
            yield pa.RecordBatch.from_arrays([pa.array(queries.row[slot]), pa.array(queries.ids[slot], pa.int64(), from_pandas=True), *columns], ["query_row", "query_id", "score", "row", "vec_id"])

        return table.mapInArrow(run, FOUND)

    found = in_blocks(vectors.rows.where("asked").select("row", "vec_id", "v"), block, search, FOUND, "best")
    discard(table)
    return best_of_all(found, ["query_row"], k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB SQL, every query with every row.
SQL = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= 5"""
