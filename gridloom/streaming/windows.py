"""Stepping along time as a stream: tumbling and session windows with late data, and chunk windows with upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum per key and window; rows later than ``late`` are left out, as in any watermarked stream."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", key: str = "user_id") -> DataFrame:
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def distinct_events(events: DataFrame, key: str, late: str = "2 hours", time: str = "ts") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_chunks(stream: DataFrame, path: str, checkpoint: str, step: str, chunk: int):
    """Write each micro-batch under its chunk window of ``step``.  The folder of a batch is named by its id, so a batch that is
    run again after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("chunk", F.floor(F.col(step) / chunk).cast("long"))
        placed.write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
