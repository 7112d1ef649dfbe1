"""An answer cache as Parquet in hash buckets: an update rewrites the buckets it touches, in whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import upsert

BUCKETS = 64
STAGED, MARK = "_staged", "_commit"


def _fs(spark: SparkSession, path: str):
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _finish(spark: SparkSession, path: str) -> None:
    """Completes an update whose marker was written, and drops one that has none. Each step may be repeated."""
    fs, kind = _fs(spark, path)
    staged, mark = f"{path}/{STAGED}", kind(f"{path}/{MARK}")
    if fs.exists(mark):
        stream = fs.open(mark)
        names = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        for name in names:  # at most BUCKETS of them
            new = kind(f"{staged}/{name}")
            if fs.exists(new):
                fs.delete(kind(f"{path}/{name}"), True)
                fs.rename(new, kind(f"{path}/{name}"))
        fs.delete(mark, False)
    fs.delete(kind(staged), True)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache's rows; None where there is none."""
    fs, kind = _fs(spark, path)
    if not fs.exists(kind(path)):
        return None
    _finish(spark, path)
    return spark.read.parquet(path).drop("bucket") if any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(kind(path))) else None


def update_cache(new: DataFrame, path: str, key: str, at: str, buckets: int = BUCKETS) -> list[int]:
    """Puts new rows into the cache, the latest (by `at`) of each key staying, and returns the buckets that were rewritten.

    Old rows of the touched buckets alone are read. What they become is written beside the cache; then a marker names the buckets, and
    they are moved into place. A failure before the marker leaves the old state, one after it is completed by the next
    reader or writer. One writer at a time."""
    spark = new.sparkSession
    fs, kind = _fs(spark, path)
    old = read_cache(spark, path)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # at most `buckets` numbers
    if not touched:
        return []
    rows = new
    if old is not None:
        there = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        rows = upsert(there, new, key, at)
    else:
        rows = upsert(new.limit(0), new, key, at)
    rows.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/{STAGED}")
    mark = fs.create(kind(f"{path}/{MARK}.part"), True)
    mark.write(json.dumps([f"bucket={b}" for b in touched]).encode())
    mark.close()
    fs.rename(kind(f"{path}/{MARK}.part"), kind(f"{path}/{MARK}"))
    _finish(spark, path)
    return touched
