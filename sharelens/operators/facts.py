"""The paper fact: one row per paper with what all indicators sum. One shuffle on paper_id; no distinct counts later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio


def paper_fact(papers: DataFrame, countries: DataFrame) -> DataFrame:
    """countries: paper_id, country, is_bloc, is_focal, repeats allowed: a paper's distinct ones (a bounded set) come from the same
    aggregation that counts them, so they are shuffled once, by paper."""
    per = countries.groupBy("paper_id").agg(F.collect_set(F.struct("country", "is_bloc", "is_focal")).alias("_set"))
    per = per.select(
        "paper_id",
        F.size("_set").cast("long").alias("n_countries"),
        F.size(F.filter("_set", lambda x: x["is_bloc"])).cast("long").alias("n_bloc"),
        F.exists("_set", lambda x: x["is_focal"]).alias("has_focal"),
        F.array_sort(F.transform("_set", lambda x: x["country"])).alias("countries"),
        F.array_sort(F.transform(F.filter("_set", lambda x: x["is_bloc"]), lambda x: x["country"])).alias("bloc_countries"),
    )
    out = papers.join(per, "paper_id", "left")
    return out.withColumns({
        "resolved": F.col("n_countries").isNotNull(),
        "has_bloc": F.coalesce(F.col("n_bloc") > 0, F.lit(False)),
        "has_focal": F.coalesce("has_focal", F.lit(False)),
    })


SUMS = {"total": F.count, "resolved": "resolved", "bloc": "has_bloc", "focal": "has_focal"}


def sums():
    return [F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), F.count_if("has_bloc").alias("bloc"), F.count_if("has_focal").alias("focal")]


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "unresolved": F.col("total") - F.col("resolved"),
        "coverage": ratio("resolved", "total"),
        "share_world": ratio("focal", "resolved"),
        "share_bloc": ratio("focal", "bloc"),
    })


def basic_metrics(fact: DataFrame, *keys: str) -> DataFrame:
    return with_ratios(fact.groupBy(*keys).agg(*sums()))


def basic_metrics_sets(fact: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """All groupings in one pass; columns outside a grouping are null, `grouping` names it."""
    groups = [[F.col(k) for k in s] for s in sets]
    bits = F.grouping_id(*keys)
    name = None
    for s in sets:
        value = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        label = "+".join(s)
        name = F.when(bits == value, label) if name is None else name.when(bits == value, label)
    return with_ratios(fact.groupingSets(groups, *keys).agg(*sums(), name.alias("grouping")))


def coverage(fact: DataFrame, *keys: str) -> DataFrame:
    out = fact.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved"))
    return out.withColumns({"unresolved": F.col("total") - F.col("resolved"), "coverage": ratio("resolved", "total")})
