"""Evidence as a stream: late repeats dropped within the watermark, counts per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, at: str = "ts", late: str | None = None, width: str = "1 day") -> DataFrame:
    """Rows and sum of values per window and type; `late` only where events have no watermark yet."""
    w = (events.withWatermark(at, late) if late else events).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("rows"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "rows", "value")
