"""Structured Streaming: tumbling means of an event stream as panel rows, and mergeable moments over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(bin, event_type, n, total): counts and sums by event time; state is dropped once the watermark passes."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bin"), "event_type", "n", "total")


def add_moments(store: dict, batch: DataFrame, columns: list[str]) -> None:
    """Adds a micro-batch's count, sums and products to a store; for foreachBatch. Sums merge in any order, so a batch that is repeated must be told apart by its number."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = batch.agg(F.count(F.lit(1)), *[F.sum(c) for c in columns], *[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).first()
    for key, value in zip([("n",), *[(c,) for c in columns], *pairs], row):
        store[key] = store.get(key, 0) + (value or 0)
