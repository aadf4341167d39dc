"""Documents and their lengths in flat token files, found by scanning for separators.

A token file is nothing but fixed-width little-endian ids; each document ends with
an end-of-document id and there is no index. Files are cut into blocks that tasks
read by themselves. Each block is searched with one vectorised comparison. Where a
document crosses blocks, its start is stitched in by a prefix scan over the block
summaries (how many separators came before, and where the last one was), in two
levels, so that a file of any length is never one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalume.llm.bpe import encoder, read_ranks
from catalume.llm.common import free_name, new_path

#: Blocks whose summaries are scanned together.
SPAN = 1024


def write_token_files(docs: DataFrame, path: str, ranks_path: str, pattern: str, *, separator: int, text: str = "text", width: int = 2) -> None:
    """Encode each text and write its ids and ``separator``, ``width`` bytes each.

    A null or empty text is a separator alone; repeated rows are written each time;
    an empty table writes no document. Other columns are ignored.
    Spark's own text writer does the writing, with the separator's bytes as line
    ends, so the files may lie in any store and failed tasks leave nothing behind.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    if len(tokens.value) > 1 << 8 * width or separator >= 1 << 8 * width:
        raise ValueError(f"ids don't fit in {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokens.value, pattern)
        for batch in batches:
            out = [np.array(bpe.encode(x.as_py() or ""), f"<u{width}").tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    end = separator.to_bytes(width, "little").decode("latin-1")
    raw = docs.select(text).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    raw.write.option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def _read(path: str, start: int, size: int) -> bytes:
    """A range of a file: local or shared files directly, others by the store's own driver."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        with open(unquote(url.path), "rb") as f:
            f.seek(start)
            return f.read(size)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(size, start)


def scan_separators(spark: SparkSession, path: str, *, separator: int, width: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document of the flat token files under ``path``.

    Returns file, ordinal (from 0 in the file), first_token (its place in the
    file) and n_tokens, without the separator. Tokens after a file's last
    separator are one more document, without a separator; a file that ends with a
    separator has none. Neighbouring separators enclose an empty document, empty
    files hold none. A file whose length isn't a whole number of ids raises.
    """
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    blocks = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}"))).alias("block"))
    # one task for about as many bytes as Spark gives a task that reads files
    blocks = blocks.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are not a whole number of ids")
                start = block * block_bytes
                ids = np.frombuffer(_read(file, start, min(block_bytes, length - start)), f"<u{width}")
                at = np.flatnonzero(ids == separator) + start // width
                row = [[file], [block], [at], [start // width + len(ids) if start + block_bytes >= length else None]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int64()), pa.array(row[2], pa.list_(pa.int64())), pa.array(row[3], pa.int64())], ["file", "block", "at", "length"])

    found = blocks.mapInArrow(search, "file string, block long, at array<long>, length long")
    found = found.withColumn("span", F.expr(f"block div {SPAN}"))
    # within a span, then over spans: separators before, and the place of the last one
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("n", F.size("at")).withColumn("last", F.element_at(F.when(F.size("at") > 0, F.col("at")), -1))
    local = local.withColumn("n_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("last_before", F.max("last").over(inside))
    spans = local.groupBy("file", "span").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("file", "span", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_spans"), F.max("last").over(over).alias("last_spans"))
    stitched = local.join(carried, ["file", "span"])
    carry = F.coalesce("last_before", "last_spans", F.lit(-1).cast("long"))
    # in the last block the end of the file closes a document that no separator does
    ends = F.when(F.col("length").isNotNull() & (F.coalesce("last", carry) < F.col("length") - 1), F.concat("at", F.array("length"))).otherwise(F.col("at"))
    rows = stitched.select("file", (F.col("n_before") + F.col("n_spans")).alias("base"), carry.alias("carry"), ends.alias("ends"))
    rows = rows.select("file", "base", "carry", "ends", F.posexplode(F.arrays_zip(F.concat(F.array("carry"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("prev"), F.col("ends").alias("end"))).alias("k", "pair"))
    rows = rows.where(F.col("pair.end").isNotNull())
    return rows.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("pair.prev") + 1).alias("first_token"), (F.col("pair.end") - F.col("pair.prev") - 1).alias("n_tokens"))


def count_documents(docs: DataFrame, ranks_path: str, pattern: str, *, separator: int, text: str = "text", width: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """Write ``docs`` as flat token files in the shared folder and scan them: part long, ordinal, first_token, n_tokens.

    One row for each row of ``docs``: null and empty texts have no tokens, repeated
    rows each have theirs, an empty table gives an empty result.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs.select(F.col(text).alias(free_name(docs, "text_"))), path, ranks_path, pattern, separator=separator, text=free_name(docs, "text_"), width=width)
    rows = scan_separators(docs.sparkSession, path, separator=separator, width=width, block_bytes=block_bytes)
    return rows.select(F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("part"), "ordinal", "first_token", "n_tokens")
