"""Cutting lineage in a folder that all executors share, and checking sizes before a broadcast.

The folder is spark.checkpoint.dir of the session.  Only on one machine (a local master) may it be unset: a temporary one is
made then; on a cluster that is an error.  Stored tables are deleted when the application ends, or before by ``drop``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if set_.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quipu-"))
        set_ = context._jsc.sc().getCheckpointDir()
    return (context.getConf().get("spark.checkpoint.dir") or set_.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The table computed once and its lineage cut."""
    folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """As ``cut``, for wide rows: written as a compressed table."""
    path = place(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OPEN: set[str] = set()


def place(spark: SparkSession) -> str:
    """Path of a new table, deleted when the application ends."""
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    if not _OPEN:
        atexit.register(lambda: drop(SparkSession.getActiveSession(), list(_OPEN)))
    _OPEN.add(path)
    return path


def drop(spark: SparkSession | None, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        _OPEN.discard(path)
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; the folder's owner clears it
            return


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows; it should be cheap to read."""
    return F.broadcast(df) if bounded(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer parts than there are cores, dealt out evenly; any other as it is.

    A small file is one part however costly its rows are.  Tables of many files have parts enough and aren't moved.
    """
    most = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= most else df.repartition(most)
