"""Evidence of many sources to one row per paper and country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _joined(field: str):
    """Distinct values of a field in the order of the rows, blanks left out."""
    values = F.filter(F.transform("_rows", lambda r: r[field]), lambda v: ~F.lower(F.trim(v)).isin("", "nan", "none", "<na>"))
    return F.array_join(F.array_distinct(values), "|")


def consolidate(evidence: DataFrame) -> DataFrame:
    """One row per paper and country, from one set of its distinct (priority, source, method), a bounded number."""
    rows = evidence.groupBy("paper_id", "country").agg(F.array_sort(F.collect_set(F.struct("priority", "source", "method"))).alias("_rows"))
    sources = F.array_distinct(F.array_compact(F.transform("_rows", lambda r: r["source"])))
    return rows.select("paper_id", "country", _joined("source").alias("sources"), _joined("method").alias("methods"), F.size(sources).cast("long").alias("n_sources"), F.array_min(F.array_compact(F.transform("_rows", lambda r: r["priority"]))).alias("best_priority"))


def source_counts(consolidated: DataFrame) -> DataFrame:
    rows = consolidated.select("paper_id", F.explode(F.split("sources", r"\|")).alias("source"))
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("paper_id").alias("papers"))
