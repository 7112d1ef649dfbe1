"""Rankings, wide tables, growth, trends, top lists, fractional counts, collaboration and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import col, ratio
from ..params import WindowSpec
from ..sources.stages import table
from . import order_stats


def rank_min(value: str, *keys: str) -> Column:
    """Competition rank, highest first; null for a null value."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(w))


def country_counts(pc: DataFrame, *keys: str) -> DataFrame:
    """Papers per country; rows of pc are distinct (paper, country), so a plain count will do."""
    return pc.groupBy(*keys, "country").agg(F.count("*").alias("papers"))


def ranked_countries(pc: DataFrame, fact: DataFrame, *keys: str) -> DataFrame:
    """Bloc countries with the bloc's papers, share and rank."""
    counts = country_counts(pc.where("is_bloc"), *keys)
    den = fact.groupBy(*keys).agg(F.count_if("has_bloc").alias("bloc"))
    out = counts.join(den, [*keys]).withColumn("share", ratio("papers", "bloc"))
    return out.withColumn("rank", rank_min("papers", *keys))


def pivot_counts(df: DataFrame, keys: list[str], column: str, values: list[str], total: str = "papers") -> DataFrame:
    """Counts per value as columns, zeros filled."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(column) == v, F.col(total))), F.lit(0)).alias(v.lower().replace("-", "_")) for v in values])


def growth(counts: DataFrame, first: str, last: str) -> DataFrame:
    out = counts.groupBy("country").agg(*[F.coalesce(F.sum(F.when(F.col("win") == w, F.col("papers"))), F.lit(0)).alias(n) for n, w in (("papers_first", first), ("papers_last", last))])
    return out.withColumns({"delta": F.col("papers_last") - F.col("papers_first"), "factor": ratio("papers_last", "papers_first")})


def trends(ranked: DataFrame, windows: WindowSpec, step: float = 1.0) -> DataFrame:
    """Change of the share in percentage points: up, down, mixed (a peak in between) or stable; the earliest peak window."""
    first, last = windows.labels[0], windows.labels[-1]
    pct = 100 * F.col("share")
    at = windows.order()
    out = ranked.groupBy("country").agg(
        F.max(F.when(F.col("win") == first, pct)).alias("first"),
        F.max(F.when(F.col("win") == last, pct)).alias("last"),
        F.max(pct).alias("peak"),
        F.max_by("win", F.struct(pct, -at)).alias("peak_win"),
    )
    out = out.withColumn("delta", F.col("last") - F.col("first"))
    mid = F.col("peak") - F.greatest("first", "last") >= step
    trend = F.when(F.col("delta") >= step, "up").when(F.col("delta") <= -step, "down").when(mid, "mixed").when(F.col("delta").isNotNull(), "stable")
    return out.withColumn("trend", trend)


def monotonicity_drops(metrics: DataFrame, value: str, windows: WindowSpec) -> DataFrame:
    """Windows whose value is below the one before. A few windows: one small partition."""
    w = Window.orderBy(windows.order())
    out = metrics.withColumn("before", F.lag(value).over(w))
    return out.where(F.col(value) < F.col("before"))


def top_by(df: DataFrame, n: int, value: str, *ties: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The n rows with the highest value, ties in order of `ties`, per group or over all."""
    if not within:
        return df.orderBy(F.col(value).desc(), *ties).limit(n)
    w = Window.partitionBy(*within).orderBy(F.col(value).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fractional(pc: DataFrame, *keys: str) -> DataFrame:
    """Complete and fractional counts per bloc country; a paper's weight is 1 / all its countries."""
    weight = 1 / F.count("*").over(Window.partitionBy("paper_id"))
    out = pc.withColumn("_w", weight).where("is_bloc").groupBy(*keys, "country").agg(F.count("*").alias("complete"), F.round(F.sum("_w"), 6).alias("fractional"))
    return out.withColumns({"rank_complete": rank_min("complete", *keys), "rank_fractional": rank_min("fractional", *keys)})


def denominators(pc: DataFrame, groups: DataFrame, windows: DataFrame, focal: str) -> DataFrame:
    """Focal papers over the papers of each country group, zeros included."""
    den = pc.join(groups, "country").select("paper_id", "win", "grp").distinct().groupBy("win", "grp").agg(F.count("*").alias("papers"))
    num = pc.where(F.col("country") == focal).groupBy("win").agg(F.count("*").alias("focal"))
    grid = windows.crossJoin(groups.select("grp").distinct())  # windows x groups: a few rows
    out = grid.join(den, ["win", "grp"], "left").join(num, "win", "left").fillna(0, ["papers", "focal"])
    return out.withColumn("share", ratio("focal", "papers"))


def normalised(pc: DataFrame, attributes: DataFrame, measures: dict[str, int], *keys: str) -> DataFrame:
    """Papers of each country over its measures (people, researchers, spending, ...), each per so many units; a country
    without attributes keeps its row with nulls. attributes: country and the measures, one row a country."""
    counts = pc.groupBy(*keys, "country").agg(F.count("*").alias("papers"))
    out = counts.join(attributes, "country", "left")
    return out.select(*keys, "country", "papers", *[F.try_divide(F.col("papers").cast("double") * per, F.col(m).cast("double")).alias(f"per_{m}") for m, per in measures.items()])


def overlap_inflation(fact: DataFrame, *keys: str) -> DataFrame:
    f = fact.where("has_bloc")
    out = f.groupBy(*keys).agg(F.count("*").alias("articles"), F.sum("n_bloc").alias("sum_counts"), F.avg("n_bloc").alias("mean_multiplicity"), F.median("n_bloc").alias("median_multiplicity"), F.count_if(F.col("n_bloc") > 1).alias("intra"))
    return out.withColumns({"share_intra": ratio("intra", "articles"), "factor": ratio("sum_counts", "articles")})


def multiplicity(fact: DataFrame, *keys: str) -> DataFrame:
    out = fact.where("has_bloc").groupBy(*keys, F.col("n_bloc").alias("multiplicity")).agg(F.count("*").alias("articles"))
    return out.withColumn("share", ratio("articles", F.sum("articles").over(Window.partitionBy(*keys))))


def collaboration(fact: DataFrame, *keys: str) -> DataFrame:
    out = fact.where("has_focal").groupBy(*keys).agg(F.count("*").alias("papers"), F.count_if(F.col("n_countries") == 1).alias("alone"), F.avg("n_countries").alias("mean_countries"), F.median("n_countries").alias("median_countries"))
    return out.withColumn("share_alone", ratio("alone", "papers"))


def partners(fact: DataFrame, focal: str, *keys: str) -> DataFrame:
    rows = fact.where("has_focal").select(*keys, F.explode(F.array_remove("countries", focal)).alias("partner"))
    return rows.groupBy(*keys, "partner").agg(F.count("*").alias("papers"))


def institution_ranking(links: DataFrame) -> DataFrame:
    """Papers per institution and its place: a range sort and the running sums of its parts, no task sees all institutions."""
    from .audit import numbered

    counts = links.groupBy("institution").agg(F.count("*").alias("papers"))
    return numbered(counts, [F.col("papers").desc(), F.col("institution")], "place")


def concentration(links: DataFrame, *keys: str) -> DataFrame:
    counts = links.groupBy(*keys, "institution").agg(F.count("*").alias("papers"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"_total": F.sum("papers").over(w), "_place": F.row_number().over(w.orderBy(F.col("papers").desc(), "institution"))})
    share = F.col("papers") / F.col("_total")
    out = counts.groupBy(*keys).agg(F.count("*").alias("institutions"), F.sum("papers").alias("links"), F.sum(F.when(F.col("_place") <= 5, F.col("papers"))).alias("top5"), F.sum(F.when(F.col("_place") <= 10, F.col("papers"))).alias("top10"), F.round(F.sum(share * share), 9).alias("hhi"))
    return out.withColumns({"share_top5": ratio("top5", "links"), "share_top10": ratio("top10", "links")})


def impact_scores(papers: DataFrame, value: str) -> DataFrame:
    """z-score of log1p(value) and average percentile rank within venue and year. Null z for lone or equal values."""
    group = ["venue", "year"]
    out = order_stats.standardised(papers, group, F.log1p(F.coalesce(col(value), F.lit(0.0))))
    return order_stats.percentiles(out, group, value)


def impact(pc: DataFrame, scores: DataFrame, value: str) -> DataFrame:
    """By bloc country and window; a null percentile counts in the denominator of the top shares."""
    rows = pc.where("is_bloc").select("paper_id", "country").join(scores.select("paper_id", "win", value, "z", "percentile"), "paper_id").drop("paper_id")
    rows = table(rows)  # read for the sums and for the medians
    top = lambda p: F.avg(F.coalesce(F.col("percentile") >= p, F.lit(False)).cast("double"))
    sums = rows.groupBy("country", "win").agg(F.count("*").alias("papers"), F.round(F.avg(value), 4).alias("mean_value"), F.round(F.avg("z"), 6).alias("mean_z"), F.round(top(0.9), 6).alias("top10"), F.round(top(0.99), 6).alias("top1"))
    middle = order_stats.medians(rows.select("country", "win", value), ["country", "win"], value, "_median")
    out = order_stats.joined(sums, middle, ["country", "win"], "left")
    return out.select("country", "win", "papers", "mean_value", F.round("_median", 4).alias("median_value"), "mean_z", "top10", "top1")


def leadership(authors: DataFrame, papers: DataFrame, *keys: str) -> DataFrame:
    """Papers with a focal author, with one in first or last place, and with focal authors only."""
    last = F.max("author_order").over(Window.partitionBy("paper_id"))
    per = authors.withColumn("_n", last).groupBy("paper_id").agg(
        F.bool_or("is_focal").alias("has"),
        F.bool_or(F.col("is_focal") & (F.col("author_order") == 1)).alias("first"),
        F.bool_or(F.col("is_focal") & (F.col("author_order") == F.col("_n"))).alias("last"),
        F.bool_and("is_focal").alias("only"),
        F.max("_n").alias("n"),
    )
    rows = per.where("has").join(papers, "paper_id")
    out = rows.groupBy(*keys).agg(F.count("*").alias("papers"), F.count_if("first").alias("led_first"), F.count_if("last").alias("led_last"), F.count_if(F.col("first") | F.col("last")).alias("led_either"), F.count_if("only").alias("alone"), F.round(F.avg("n"), 6).alias("mean_authors"))
    return out.withColumn("share_first", ratio("led_first", "papers"))
