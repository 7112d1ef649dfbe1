"""Ranking history: versions per venue, validity, as-of levels, gaps, priorities and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import classes, first_rule, weighted_terms


def resolve_duplicates(raw: DataFrame) -> DataFrame:
    """One level per venue and year, A* before A; conflicts are flagged and their values kept."""
    return raw.groupBy("venue", "core_year").agg(
        F.when(F.bool_or(F.col("level") == "A*"), "A*").otherwise(F.min("level")).alias("level"),
        F.min_by("conference_name", F.struct("source_file", "conference_name")).alias("conference_name"),
        F.array_join(F.array_sort(F.collect_set("source_file")), "|").alias("source_files"),
        F.count("*").alias("n_raw_rows"),
        (F.count_distinct("level") > 1).alias("had_conflict"),
        F.array_join(F.array_sort(F.collect_set("level")), "|").alias("level_raw_values"),
    )


def infer_undifferentiated(raw: DataFrame, year: int, before: int, after: int, policy: str = "infer") -> DataFrame:
    """Levels of a list without levels from the versions before and after: A* if one side is A* and both are listed;
    A with less evidence; not listed on either side: left out ('-'). policy 'all_a' takes A for all."""
    side = lambda y, n: F.when(F.bool_or((F.col("core_year") == y) & (F.col("level") == "A*")), "A*").when(F.bool_or((F.col("core_year") == y) & (F.col("level") == "A")), "A").otherwise("-").alias(n)
    out = raw.groupBy("venue").agg(F.bool_or(F.col("core_year") == year).alias("_listed"), side(before, "level_before"), side(after, "level_after")).where("_listed").drop("_listed")
    b, a = F.col("level_before"), F.col("level_after")
    level = F.when((b == "-") & (a == "-"), "-").when((b != "-") & (a != "-") & ((b == "A*") | (a == "A*")), "A*").otherwise("A")
    return out.withColumn("level_inferred", F.lit("A") if policy == "all_a" else level)


def validity(history: DataFrame, first: int, last: int) -> DataFrame:
    """Years in which each version of the whole list counts: from its year to the one before the next version."""
    years = history.select("core_year").distinct()  # ranking versions: a few rows
    w = Window.orderBy("core_year")
    years = years.withColumn("_next", F.lead("core_year").over(w))
    years = years.select("core_year", F.greatest("core_year", F.lit(first)).alias("year_start"), F.least(F.coalesce(F.col("_next") - 1, F.lit(last)), F.lit(last)).alias("year_end"))
    return history.join(F.broadcast(years), "core_year").where("year_start <= year_end")


def as_of(papers: DataFrame, history: DataFrame, parts: int = 1) -> DataFrame:
    """Adds hist_level, hist_year and fallback: the latest version up to the paper's year, else the first later one
    (fallback), else null (fallback).

    A sort merge: papers and versions are one list by venue and year, along which the last version is carried forward, so
    there is one exchange, no join, and a row per paper however long a history is. `parts` deals each venue's papers over
    so many tasks, each with the venue's versions, where one venue holds much of all papers."""
    salt = F.pmod(F.xxhash64(*papers.columns), F.lit(parts)).cast("int")
    version = F.struct(F.col("core_year").alias("hist_year"), F.col("level").alias("hist_level"))
    rows = papers.select(F.struct("*").alias("_p"), F.col("venue").alias("_v"), F.col("year").alias("_y"), salt.alias("_part"), F.lit(1).alias("_side"))
    versions = history.where("venue IS NOT NULL AND core_year IS NOT NULL").select(F.col("venue").alias("_v"), F.col("core_year").alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(0).alias("_side"), version.alias("_h"))
    both = rows.unionByName(versions, allowMissingColumns=True)
    venue = Window.partitionBy("_v", "_part")
    upto = venue.orderBy("_y", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("_v").isNotNull() & F.col("_y").isNotNull()
    both = both.withColumns({"_last": F.last("_h", ignorenulls=True).over(upto), "_first": F.min("_h").over(venue)}).where("_side = 1")
    found = F.when(known, F.coalesce("_last", "_first"))  # a paper before all versions takes the first one
    out = both.withColumn("_h", found).select("_p.*", "_h.hist_level", "_h.hist_year")
    return out.withColumn("fallback", F.coalesce(F.col("hist_year") > F.col("year"), F.lit(True)))


def scenario_tags(dated: DataFrame) -> DataFrame:
    """paper_id and the corpus scenarios it belongs to; one pass, an array of tags per paper."""
    in_history = F.col("hist_level").isNotNull() & ~F.col("fallback")
    tags = F.array_compact(F.array(F.lit("fixed"), F.when(in_history, "historical_all"), F.when(in_history & (F.col("hist_level") == "A*"), "historical_top"), F.when(in_history & (F.col("hist_level") == F.col("level")), "stable_both")))
    return dated.select("paper_id", F.explode(tags).alias("scenario"))


def gap(history: DataFrame, known: DataFrame) -> DataFrame:
    """Venues of the history that the known ones lack; names are compared trimmed, with case."""
    h = history.withColumn("venue", F.trim("venue"))
    return h.join(known.select(F.trim("venue").alias("venue")).distinct(), "venue", "left_anti")


def venue_rollup(history: DataFrame) -> DataFrame:
    return history.groupBy("venue").agg(
        F.min("core_year").alias("first_year"),
        F.max("core_year").alias("last_year"),
        F.count_distinct("core_year").alias("years_present"),
        F.array_join(F.array_sort(F.collect_set(F.col("core_year").cast("string"))), "|").alias("years_list"),
        F.array_join(F.array_sort(F.collect_set("level")), "|").alias("levels_list"),
        F.count_if(F.col("level") == "A*").alias("top_years"),
        F.count_if(F.col("level") == "A").alias("a_years"),
    )


def required_years(history: DataFrame, first: int, last: int) -> DataFrame:
    v = validity(history, first, last)
    return v.groupBy("venue").agg(F.sum(F.col("year_end") - F.col("year_start") + 1).alias("required_years"), F.min("year_start").alias("first_required"), F.max("year_end").alias("last_required"))


def priority(rollup: DataFrame, required: DataFrame, relevance: DataFrame, terms: dict[str, str], cuts, lowest: str) -> DataFrame:
    """Each venue's history with a score of added terms and its class; the tables are parameters."""
    df = rollup.join(required, "venue", "left").join(relevance, "venue", "left").fillna(0, ["required_years"]).fillna("MEDIUM", ["relevance"])
    return classes(weighted_terms(df, terms, "priority_score"), "priority_score", cuts, lowest, "priority_level")


def tiers(scored: DataFrame, seeds: DataFrame, rules, otherwise: tuple[str, str]) -> DataFrame:
    """tier and reason of each venue by ordered rules over its scores and its curated seed."""
    return first_rule(scored.join(seeds, "venue", "left"), rules, otherwise, ("tier", "reason"))


def override(df: DataFrame, overrides: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Non-empty overrides win."""
    o = overrides.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_o_{c}") for c, v in columns.items()])
    out = df.join(o, df[key] == F.col("_k"), "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.trim(f"_o_{c}"), F.lit("")), F.col(c)) for c in columns}).drop("_k", *[f"_o_{c}" for c in columns])
