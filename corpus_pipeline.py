"""The corpus pipeline: five stages over documents, each on all that the one before has kept.

toxicity -> exact dedup -> n-gram Jaccard join -> mixing to target weights -> BPE encoding and decoding.
Stages take (spark, docs, sf_dir); all but the last return the columns of documents. The dedups keep one row of each
group, told apart by a row key where ids are null or repeated: that of the smallest doc_id, a row without an id only if
no other row of its group has one, and any one of several rows with that id. Other columns may have any name but those that
begin with `_llm_` or are `_rk`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharelens.llm import bpe, common, exact_dedup, jaccard_join, mixing, queries, toxicity

#: Four fifths of the tokens that reach the mix, no document twice.
MIX = mixing.Mix(percent=80, epochs=1)


def _one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of docs per group. grouped takes rows with their keys as doc_id, and gives each key's (row) group."""
    docs = common.numbered(docs)
    groups = grouped(docs.select(F.col("_rk").alias("doc_id"), "text")).join(docs.select(F.col("_rk").alias("row"), "doc_id"), "row")
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    return docs.join(kept.select(F.col("least.row").alias("_rk")), "_rk", "left_semi").drop("_rk")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects at its language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return toxicity.scored(docs, labels, rest).where("NOT _llm_rejected").drop("_llm_score", "_llm_rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of equal texts."""
    return _one_of_each(docs, lambda rows: exact_dedup.dedup(rows).select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of each group of linked documents."""
    return _one_of_each(docs, lambda rows: jaccard_join.join(rows).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents to the target weights."""
    return mixing.select(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests; the ids decode to the text."""
    return bpe.transcode(docs, queries.tokenizer_path(), keep=("lang", "source"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix), ("BPE", encode)]

#: The classifier and set similarity can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before = common.tables()
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs, read = common.materialize(out), docs
        common.discard_since(before - {getattr(read, "_work_path", None)}, docs)


__all__ = ["STAGES", "ORACLE_SQL", "run"]
