"""Streams: windowed counts with late data, and the daily merge and upsert on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quipu.operators import corpus
from quipu.sources.tables import replace_table


def windowed_counts(items: DataFrame, at: str, label: str, window: str = "72 hours", slide: str = "24 hours", late: str = "6 hours") -> DataFrame:
    """``(start, end, label, documents, average_stress)`` in sliding event-time windows; later rows than ``late`` are dropped."""
    rows = items.withWatermark(at, late).groupBy(F.window(at, window, slide).alias("w"), label)
    return rows.agg(F.count("*").alias("documents"), F.avg("stress_score").alias("average_stress")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), label, "documents", "average_stress")


def merge_stream(items: DataFrame, path: str, checkpoint: str, collected_at: str, once: bool = True) -> StreamingQuery:
    """Merge each micro-batch of collected items (with ``seq``) into the corpus at ``path``."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.parquet(path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            before = batch.limit(0)
        replace_table(corpus.merge_corpus(before, batch, collected_at), path)

    writer = items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Keep the latest row of each key at ``path``."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.parquet(path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            before = batch.limit(0)
        replace_table(corpus.upsert(before, batch, key), path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
