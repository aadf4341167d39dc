"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name under ``spark.checkpoint.dir``. Where that is unset, a new folder takes its place, but on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-catalume-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder that all executors share and read it back; this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once nothing reads them any more."""
    for df in staged:
        path, files = _path(df.sparkSession, df.staged_path)
        files.delete(path, True)


def _leaves(files, path, depth: int, below: str = "") -> list[str]:
    """Names of the partition folders ``depth`` levels down."""
    if not depth:
        return [below]
    inside = [x.getPath() for x in files.listStatus(path) if x.isDirectory() and "=" in x.getPath().getName()]
    return [y for x in inside for y in _leaves(files, x, depth - 1, f"{below}/{x.getName()}")]


def publish(df: DataFrame, path: str, partition_cols: list[str], *, partitions_only: bool = False) -> None:
    """Write ``df`` beside ``path`` and put it in its place by renaming, when it is whole.

    If the write fails, what was there stays as it was. With ``partitions_only`` just the
    partitions that ``df`` has rows for are put in place; the others stay.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    (here, files), (fresh, _), (former, _) = _path(spark, path), _path(spark, new), _path(spark, old)
    try:
        (df.write.partitionBy(*partition_cols) if partition_cols else df.write).parquet(new)
        if partitions_only and files.exists(here):
            for leaf in _leaves(files, fresh, len(partition_cols)):
                (target, _), (source, _), (before, _) = _path(spark, path + leaf), _path(spark, new + leaf), _path(spark, old + leaf)
                for parent in (target.getParent(), before.getParent()):
                    files.mkdirs(parent)
                _swap(files, source, target, before)
        else:
            _swap(files, fresh, here, former)
    finally:
        files.delete(fresh, True)
        files.delete(former, True)


def _swap(files, new, path, old) -> None:
    there = files.exists(path)
    if there and not files.rename(path, old):
        raise OSError(f"{path} could not be moved away")
    if not files.rename(new, path):
        if there:
            files.rename(old, path)
        raise OSError(f"{path} could not be put in place")
