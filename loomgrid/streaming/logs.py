"""Append-only logs as streams: windowed counts, the latest state of each key, checkpoints by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """JSON lines that are appended as files."""
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, every: str, late: str = "1 hour") -> DataFrame:
    """Counts and totals by type and tumbling window; in a stream, events later than the bound are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("event_type", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each user, the greatest id of equal times."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.*")


def checkpointed(stream: DataFrame, target: str, checkpoint: str):
    """Each batch appended to a Parquet table once: a batch that is run again replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
