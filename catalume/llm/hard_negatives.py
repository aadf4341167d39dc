"""Hard-negative mining with exact scores from subset-sum tables ("Four Russians").

Components of all rows are kept as bit planes: for each bit of the two's complement and
each group of eight dimensions one byte. For an anchor, a group's table holds the sums
of all 256 subsets of its eight components. A row's score is then looked up: plane by
plane from the sign down, double what there is and add each group's entry at the row's
byte. No component of a row is multiplied or unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import discard, stage
from catalume.llm.vectors import Best, Vectors, best_of_all, in_blocks, matrix, numbers, whole_vectors

#: Anchors whose tables are used together, and rows scored together.
AT_ONCE, ROWS = 64, 4096
POSITIVES = "anchor_row long, anchor_id long, score long, row long, vec_id long"
NEGATIVES = "anchor_row long, positive_row long, score long, row long, vec_id long"


def plane_count(largest: int) -> int:
    """Bits of the two's complement that hold whole numbers up to ``largest`` in size."""
    return int(largest).bit_length() + 1


def pack_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups): bytes of bit planes, the lowest plane first; a byte's highest bit is its group's first dimension."""
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % 8)))
    return np.stack([np.packbits(((v >> j) & 1).astype(np.uint8), axis=1) for j in range(planes)], axis=1)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for every byte the sum of the components whose bits are set."""
    a = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8)))
    parts = a.reshape(len(a), -1, 8).transpose(1, 2, 0)
    sums = np.zeros((parts.shape[0], 1, len(a)), kind)
    for i in range(7, -1, -1):  # the first dimension has the highest bit
        sums = np.concatenate([sums, sums + parts[:, i : i + 1].astype(kind)], axis=1)
    return sums


def look_up(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): full inner products of ``pack_planes`` rows with the anchors of ``subset_sums``."""
    out = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    entry = np.empty_like(out)
    last = planes.shape[1] - 1
    for j in range(last, -1, -1):
        out <<= 1
        for g in range(tables.shape[0]):
            np.take(tables[g], planes[:, j, g], axis=0, out=entry, mode="clip")
            if j == last:  # the sign's plane counts negative
                out -= entry
            else:
                out += entry
    return out


def plane_table(vectors: Vectors) -> DataFrame:
    """(row, vec_id, label, planes) of every row, a table in the shared folder."""
    width, planes = vectors.width, plane_count(vectors.largest)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pack_planes(matrix(batch.column(3), width), planes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in packed], pa.binary())], ["row", "vec_id", "label", "planes"])

    return stage(vectors.rows.select("row", "vec_id", "label", "v").mapInArrow(pack, "row long, vec_id long, label long, planes binary"), "planes")


def _pieces(batch: pa.RecordBatch, planes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A few rows at a time: row, id, whether the id is null, label, planes."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        packed = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8)
        yield part.column(0).to_numpy(), *numbers(part.column(1)), part.column(2).to_numpy(), packed.reshape(part.num_rows, planes, -1)


def mine_negatives(df: DataFrame, is_anchor: Column, *, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 4096, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the ``positives`` other rows of its label that score
    highest. For each of them, the ``negatives`` rows of other labels that score highest
    among those between ``low`` and ``high`` percent of the positive's score. Ties go to
    the smaller vec_id. Exact: all rows are scored for every anchor.

    Rows are told apart by place: rows with one id are anchors and candidates of their
    own; a null vec_id comes last among ties. Rows without label or usable vector
    (``whole_vectors``) take no part; other columns aren't read. An empty table, an
    anchor alone with its label and a positive without negatives in range give no rows.
    """
    vectors = whole_vectors(df.where((F.col("label") if label is None else label).isNotNull()), scale=scale, vector=vector, label=(F.col("label") if label is None else label).cast("long"), asked=F.coalesce(is_anchor, F.lit(False)))
    width, planes = vectors.width, plane_count(vectors.largest)
    kind = np.int32 if 2 * width * vectors.largest**2 + 1 < 2**31 else np.int64
    table = plane_table(vectors)
    spark = df.sparkSession
    anchors = vectors.rows.where("asked").select("row", "vec_id", "label", "v")

    def of_same_label(asked: pa.Table) -> DataFrame:
        asked = asked.combine_chunks()
        own = (asked.column("row").to_numpy(), asked.column("vec_id").to_pylist(), asked.column("label").to_numpy(), matrix(asked.column("v").combine_chunks(), width))
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_row, own_id, own_label, v = shared.value
            best = Best(len(own_row), positives)
            members = {int(x): np.flatnonzero(own_label == x) for x in np.unique(own_label)}
            for batch in batches:
                for row, vec_id, null, label, packed in _pieces(batch, planes):
                    order = np.argsort(label, kind="stable")
                    for there in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                        every = members.get(int(label[there[0]])) if len(there) else None
                        for first in range(0, len(every) if every is not None else 0, AT_ONCE):
                            some = every[first : first + AT_ONCE]
                            score = look_up(subset_sums(v[some], kind), packed[there])
                            for c, slot in enumerate(some.tolist()):
                                wins = np.flatnonzero((score[:, c] >= best.floor[slot]) & (row[there] != own_row[slot]))
                                if len(wins):
                                    at = there[wins]
                                    best.offer(slot, score[wins, c].astype(np.int64), row[at], vec_id[at], null[at])
            slot, columns = best.columns()
            yield pa.RecordBatch.from_arrays([pa.array(own_row[slot]), pa.array([own_id[s] for s in slot], pa.int64()), *columns], ["anchor_row", "anchor_id", "score", "row", "vec_id"])

        return table.mapInArrow(run, POSITIVES)

    found = stage(best_of_all(in_blocks(anchors, block, of_same_label, POSITIVES, "positives"), ["anchor_row"], positives), "best-positives")
    pairs = F.array_sort(F.collect_list(F.struct("rank", "row", "score")))  # no more than ``positives``
    wanted = anchors.join(found.groupBy(F.col("anchor_row").alias("row")).agg(pairs.alias("pairs")), "row").select("row", "label", "v", F.col("pairs.row").alias("positive_rows"), F.col("pairs.score").alias("scores"))

    def of_other_labels(asked: pa.Table) -> DataFrame:
        asked = asked.combine_chunks()
        lists = asked.column("scores").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        score = lists.flatten().to_numpy()
        window = (np.array([-(-low * int(s) // 100) for s in score], np.int64), np.array([high * int(s) // 100 for s in score], np.int64))
        own = (asked.column("row").to_numpy(), asked.column("label").to_numpy(), matrix(asked.column("v").combine_chunks(), width), np.repeat(np.arange(len(sizes)), sizes), asked.column("positive_rows").combine_chunks().flatten().to_numpy(), window)
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_row, own_label, v, of, positive, (least, most) = shared.value
            best = Best(len(of), negatives, least)
            starts = np.searchsorted(of, np.arange(len(own_row) + 1))
            blocks = range(0, len(own_row), AT_ONCE)
            tables = [subset_sums(v[first : first + AT_ONCE], kind) for first in blocks] if len(own_row) <= 1024 else None
            for batch in batches:
                for row, vec_id, null, label, packed in _pieces(batch, planes):
                    for number, first in enumerate(blocks):
                        score = look_up(tables[number] if tables else subset_sums(v[first : first + AT_ONCE], kind), packed)
                        for c in range(score.shape[1]):
                            a = first + c
                            slots = range(starts[a], starts[a + 1])
                            column = score[:, c]
                            able = np.flatnonzero((column >= min(best.floor[s] for s in slots)) & (label != own_label[a]))
                            mine = column[able]
                            for s in slots:
                                wins = able[(mine >= best.floor[s]) & (mine <= most[s])]
                                if len(wins):
                                    best.offer(s, column[wins].astype(np.int64), row[wins], vec_id[wins], null[wins])
            slot, columns = best.columns()
            yield pa.RecordBatch.from_arrays([pa.array(own_row[of[slot]]), pa.array(positive[slot]), *columns], ["anchor_row", "positive_row", "score", "row", "vec_id"])

        return table.mapInArrow(run, NEGATIVES)

    chosen = best_of_all(in_blocks(wanted, block, of_other_labels, NEGATIVES, "negatives"), ["anchor_row", "positive_row"], negatives)
    chosen = chosen.select("anchor_row", "positive_row", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("anchor_row", F.col("row").alias("positive_row"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    discard(table)
    return named.join(chosen, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB SQL, every anchor with every row.
SQL = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INT) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.ar = p.ar AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10"""
