"""Streams of events and staged sources. Batch and stream share their operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.sources.snapshots import Store, upsert
from loomwright.sources.tables import SCHEMAS


def pending_stream(spark: SparkSession, path: str) -> DataFrame:
    """Staged sources as JSON lines that keep coming in."""
    return spark.readStream.schema(SCHEMAS["pending"]).json(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and the sum of their values by type and window; what comes later than `late` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def commit_stream(stream: DataFrame, store: Store, name: str, key: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch is upserted into a table of the store; a batch that comes twice changes nothing."""

    def commit(batch: DataFrame, _: int) -> None:
        old = store.read(name)
        store.write({name: upsert(old, batch, key) if old is not None else batch.dropDuplicates([key])})

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
