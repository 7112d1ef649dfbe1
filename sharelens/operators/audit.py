"""Corpus audits, constraint reports, keys and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import ratio


def venue_audit(papers: DataFrame, small: int, first: int, last: int) -> DataFrame:
    out = papers.groupBy("venue").agg(F.count("*").alias("papers"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count_distinct("year").alias("years"), F.count_distinct("paper_id").alias("ids"), F.count_if(F.col("price") > 250000).alias("high"))
    flags = F.concat_ws(";", F.when(F.col("papers") < small, "SMALL"), F.when(F.col("years") < last - first + 1, "GAPS"), F.when(F.col("high") == 0, "NO_HIGH"))
    return out.withColumns({"high_share": ratio("high", "papers"), "flags": flags})


def value_audit(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def level_stats(venue_rows: DataFrame, level: str, value: str) -> DataFrame:
    return venue_rows.groupBy(level).agg(F.count("*").alias("venues"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"))


def duplicate_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs more than once, with the number."""
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(*keys))).where("copies > 1")


def metrics(df: DataFrame, **values) -> DataFrame:
    """One aggregation as metric and value rows."""
    one = df.agg(*[v.cast("long").alias(k) for k, v in values.items()])
    return one.unpivot([], list(values), "metric", "value")


def surrogate_keys(df: DataFrame, order: list[str], name: str = "key", width: int = 7, prefix: str = "P") -> DataFrame:
    """Keys in order: a prefix and the row's number."""
    out = numbered(df, order, "_k")
    return out.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("_k").cast("string"), width, "0"))).drop("_k")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers in order without one task seeing all rows: a range sort, counts per partition, and their running sums.

    The sorted rows are written once, so numbers stay the same if an executor is lost."""
    from ..sources.stages import written

    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per partition
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def text_report(df: DataFrame, template: str, *columns: str, order: tuple[str, ...], most: int = 1000) -> str:
    """Formatted lines of a small summary frame, collected at the edge; an error beyond `most` lines."""
    rows = df.orderBy(*order).select(F.format_string(template, *columns).alias("line")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} lines: write it as a table")
    return "\n".join(r["line"] for r in rows)
