"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sniff import detect


def payload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that arrive in a folder, with their detected schema."""
    rows = spark.readStream.text(folder).where(F.trim("value") != "").select(F.col("value").alias("payload"))
    return detect(rows)


def window_report(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean values by window and status; events later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "status").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_seconds"))


def distinct_stream(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def to_table(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table; the checkpoint makes each row count once."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
