"""Windowed counts over an event stream.

Without a bound on lateness every event counts, and the state holds a row for each window there is. With one, Spark drops events of
windows that are that much behind; ``late_events`` finds these, so that nothing is lost without trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_counts(stream: DataFrame, time: str, width: str, late: str | None = None) -> DataFrame:
    """Events per tumbling window; with ``late``, the state of a window is dropped once it is that much behind."""
    bounded = stream.withWatermark(time, late) if late else stream
    return (
        bounded.groupBy(F.window(time, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("start"), "count")
    )


def late_events(events: DataFrame, counted: DataFrame, time: str, width: str) -> DataFrame:
    """(start, missing): windows whose kept count is below the events there are, for a batch job over the source."""
    actual = events.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
    gap = F.col("n") - F.coalesce("count", F.lit(0))
    return actual.join(counted, "start", "left").select("start", gap.alias("missing")).where("missing > 0")


def keep_counts(counts: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write changed windows of each batch to its own folder; a retried batch overwrites it."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        tagged.write.mode("overwrite").parquet(f"{folder}/b{batch_id:012d}")

    writer = counts.writeStream.outputMode("update").foreachBatch(handle)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The last written count of every window."""
    schema = "start timestamp, count bigint, batch bigint"
    rows = spark.read.schema(schema).parquet(f"{folder}/b*")
    return rows.groupBy("start").agg(F.max_by("count", "batch").alias("count"))
