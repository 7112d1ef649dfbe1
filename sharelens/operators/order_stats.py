"""Ranks, percentiles and medians of groups of any size: a group is spread over tasks by value, none sees all of it.

Rows become counts per group and value (summed before the shuffle). These are dealt by ranges of (group, value); a running sum
within each range and the sums of the ranges before it, one row per group and range, give how many of a group's rows are smaller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import table


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, by keys of which nulls are equal."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (rows with it), before (rows of the group with smaller values), total (rows of the group with a value)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    # written once: the ranges stay what they are if an executor is lost
    ranged = table(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*keys)
    sums = sums.withColumns({"total": F.sum("_n").over(group), "_offset": F.sum("_n").over(group.orderBy("_range")) - F.col("_n")}).drop("_n")
    within = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    out = joined(rows, sums, [*keys, "_range"])
    return out.select(*keys, value, "n", (F.col("_offset") + F.col("_own")).alias("before"), "total")


def percentiles(df: DataFrame, keys: list[str], value: str, name: str = "percentile") -> DataFrame:
    """df and the average percentile rank of its value within its group: ties share the mean of their ranks, over the rows with a
    value. Null for a null value."""
    rank = F.col("before") + 1 + (F.col("n") - 1) / 2
    ranks = value_ranks(df, keys, value).select(*keys, value, (rank / F.col("total")).alias(name))
    return joined(df, ranks, [*keys, value], "left")


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys and the exact median of each group's values: the mean of the two in the middle."""
    ranks = value_ranks(df, keys, value)
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    ends = ranks.where(holds(low) | holds(high)).groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return ends.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def standardised(df: DataFrame, keys: list[str], value: Column, name: str = "z") -> DataFrame:
    """df and the z-score of a value within its group; null for lone or equal values. Means and deviations are sums that
    combine before the shuffle, one row per group."""
    rows = df.withColumn("_x", value)
    stats = rows.groupBy(*keys).agg(F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_std"))
    out = joined(rows, stats, keys)
    return out.withColumn(name, (F.col("_x") - F.col("_mean")) / F.nullif("_std", F.lit(0.0))).drop("_x", "_mean", "_std")
