"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package.
SPACES = "\t\n\x0b\f\r"


#: What this Python worker keeps from task to task: one thing at most, with the key it was made for.
_held: list = []


def release() -> None:
    """Give back what earlier tasks left in this Python worker, which Spark uses again for other operators."""
    if _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker until another key is asked for or an operator releases it."""
    if not _held or _held[0] != key:
        release()
        _held[:] = [key, make()]
    return _held[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a new one, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-catalume-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor. Unlike a
    checkpoint it is columnar, so that later passes read only what they need.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def shelve(df: DataFrame, key: str, name: str) -> DataFrame:
    """``stage`` as a table bucketed by ``key``: joins on it move the other side only, as often as it is read.

    It has as many buckets as ``spark.sql.shuffle.partitions``. The session's catalog
    names it; its files are in the shared folder.
    """
    spark = df.sparkSession
    path, buckets = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    title = path.rpartition("/")[2].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(title)
    return spark.table(title)


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once nothing reads them any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text):
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
