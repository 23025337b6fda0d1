"""The event log as a stream: the same derivations, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, fmt: str = "parquet", schema: str = EVENT) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def recent_counts(events: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """start, event_type, n over sliding windows of `days`; events without a time are left to `untimed`."""
    timed = events.where("ts is not null").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{days} days", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def untimed(events: DataFrame) -> DataFrame:
    return events.where("ts is null")


def totals(events: DataFrame) -> DataFrame:
    """event_type, n, total: running counters."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def triggered(events: DataFrame, threshold: int) -> DataFrame:
    """user_id, n of those that have reached the threshold."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream gives for all that is there now: each batch replaces the result table in the folder."""
    result = f"{folder}/result"
    q = (
        stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(result)).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(result)
