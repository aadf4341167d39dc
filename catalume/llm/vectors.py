"""Whole-number vectors, and searches of stated rows against all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.common import new_path, stage


class Vectors:
    """``rows`` (row, vec_id, v, and the extra columns), a table in the shared folder; ``width``: the longest vector; ``largest``: the largest component in size."""

    def __init__(self, rows: DataFrame, width: int, largest: int):
        self.rows, self.width, self.largest = rows, width, largest
        if width * largest * largest >= 2**63:
            raise ValueError("inner products of these vectors don't fit a long")

    @property
    def floats_are_exact(self) -> bool:
        """Whether inner products in double precision are exact."""
        return 4 * self.width * self.largest * self.largest < 2**53


def whole_vectors(df: DataFrame, *, scale: int = 256, vector: str = "embedding", **extra: Column) -> Vectors:
    """The rows of ``df`` with components floor(scale * x), numbered.

    Vectors that are null or hold null or non-finite components are left out; shorter
    ones end in zeros. Components so large that scores don't fit a long raise.
    """
    fine = F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = df.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *[c.alias(name) for name, c in extra.items()])
    rows = stage(rows, "vectors")
    width, low, high = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    return Vectors(rows, max(1, width or 0), max(abs(low or 0), abs(high or 0)))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, with zeros at the ends of short ones."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of longs, and where it is null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def in_blocks(asked: DataFrame, block: int, search: Callable[[pa.Table], DataFrame], schema: str, name: str) -> DataFrame:
    """What ``search`` finds for the rows ``asked`` (which have a column ``row``), about ``block`` of them at a time, gathered in one table.

    A block is what the driver and every task hold of the rows asked for, however many
    there are; a block's search is one job over all rows, written before the next.
    """
    spark, path = asked.sparkSession, new_path(asked.sparkSession, name)
    n, done = -(-asked.count() // block), False
    for k in range(n):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).toArrow()
        if part.num_rows:
            search(part).write.mode("append").parquet(path)
            done = True
    return spark.read.schema(schema).parquet(path) if done else spark.createDataFrame([], schema)


class Best:
    """The best ``k`` found so far for each of ``n`` slots: by score, then by smaller id, ids that are null last."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        #: What a score must reach to matter.
        self.floor = np.full(n, np.iinfo(np.int64).min) if floor is None else floor.copy()
        self.kept: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3 + (np.empty(0, bool),) for _ in range(n)]

    def offer(self, slot: int, score: np.ndarray, row: np.ndarray, vec_id: np.ndarray, null: np.ndarray) -> None:
        if len(score) > 4 * self.k:  # only the best k and what equals the last of them can enter
            top = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, row, vec_id, null = score[top], row[top], vec_id[top], null[top]
        score, row, vec_id, null = (np.concatenate(x) for x in zip(self.kept[slot], (score, row, vec_id, null), strict=True))
        order = np.lexsort((row, vec_id, null, -score))[: self.k]
        self.kept[slot] = score[order], row[order], vec_id[order], null[order]
        if len(order) == self.k:
            self.floor[slot] = max(self.floor[slot], score[order[-1]])

    def columns(self) -> tuple[np.ndarray, list[pa.Array]]:
        """The slot of each row kept, and score, row and id."""
        slot = np.repeat(np.arange(len(self.kept)), [len(x[0]) for x in self.kept])
        score, row, vec_id, null = (np.concatenate([x[i] for x in self.kept]) if self.kept else np.empty(0) for i in range(4))
        return slot, [pa.array(score, pa.int64()), pa.array(row, pa.int64()), pa.array(vec_id, pa.int64(), mask=null.astype(bool))]


def best_of_all(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` of what tasks kept, with their rank: no more rows than tasks times k meet for each of ``by``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
