"""Session settings for local runs; on a cluster the session comes from the launcher."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(cpus: int | str = "*", partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS | more)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
