"""Streams: counts by event-time windows with late rows, and replay of a change log into a placed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day", by: str = "event_type", at: str = "ts") -> DataFrame:
    """Tumbling counts; rows later than ``late`` behind the newest are left out once their window is final."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = timed.groupBy(F.window(at, every), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return changes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def replayed(base: DataFrame, changes: DataFrame, keys: list[str], order: str = "seq", op: str = "op") -> DataFrame:
    """``base`` after ``changes`` (op: upsert or delete), whatever order they come in and however often."""
    last = latest(changes, keys, order)
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter(F.col(op) != "delete").select(*base.columns))


def replay(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each micro-batch of a change stream to ``apply``; batches that were applied are known by their number."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: apply(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
