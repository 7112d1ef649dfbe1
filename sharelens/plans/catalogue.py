"""The query catalogue: name -> function of (spark, sf_dir), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ratios import percent3, ratio
from ..operators import audit, consolidate, facts, gates, history, indicators, matching, robustness
from ..schema import duplicates, mismatches, missing_keys, out_of_range
from ..params import Params
from ..sources.driver import Corpus
from .oracles import SQL

_ALL: dict[str, Callable[[Corpus], DataFrame]] = {}


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    _ALL[f.__name__] = f
    return f


def wide(df: DataFrame) -> DataFrame:
    """Integers as long, so that schemas don't depend on where a number comes from."""
    return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes])


def run(name: str, spark: SparkSession, path: str, params: Params) -> DataFrame:
    """One query with other parameters than the default ones."""
    return wide(_ALL[name](Corpus(spark, path, params)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, path, f=f: wide(f(Corpus(spark, path)))) for n, f in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, s in (SQL | source_queries.SQL).items() if n in _ALL}


def fact(c: Corpus) -> DataFrame:
    return facts.paper_fact(c.papers, c.country_rows)


def bloc(c: Corpus) -> DataFrame:
    return c.nations.where("is_bloc").select("country")


BASIC = ["total", "resolved", "bloc", "focal", "unresolved", "coverage", "share_world", "share_bloc"]


@query
def basic_metrics_window(c):
    return facts.basic_metrics(fact(c), "win")


@query
def basic_metrics_area_window(c):
    return facts.basic_metrics(fact(c), "win", "area")


@query
def basic_metrics_level_window(c):
    return facts.basic_metrics(fact(c), "win", "level")


@query
def basic_metrics_venue(c):
    return facts.basic_metrics(fact(c), "venue")


@query
def basic_metrics_grouping_sets(c):
    sets = [["win"], ["win", "area"], ["win", "level"], ["venue"]]
    return facts.basic_metrics_sets(fact(c), ["win", "area", "level", "venue"], sets)


@query
def basic_metrics_excluded_area(c):
    rows = fact(c) if c.params.include_excluded else fact(c).where(F.col("area") != c.params.excluded_area)
    return facts.basic_metrics(rows, "win")


@query
def paper_counts_by_year(c):
    return c.papers.groupBy("year").agg(F.count("*").alias("papers"))


@query
def paper_counts_venue_year(c):
    return c.papers.groupBy("venue", "year").agg(F.count("*").alias("papers"))


@query
def coverage_by_window(c):
    return facts.coverage(fact(c), "win")


@query
def coverage_by_venue_window(c):
    return facts.coverage(fact(c), "venue", "win")


@query
def coverage_area_venues(c):
    out = fact(c).groupBy("area").agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), F.count_distinct("venue").alias("venues"))
    return out.withColumn("coverage", ratio("resolved", "total"))


@query
def bloc_summary_window(c):
    out = fact(c).where("resolved").groupBy("win").agg(F.count("*").alias("papers"), F.count_if("has_bloc").alias("bloc"), F.count_if("has_focal").alias("focal"), F.max("n_countries").alias("most_countries"))
    return out.withColumns({"bloc_pct": percent3("bloc", "papers"), "focal_pct": percent3("focal", "bloc")})


@query
def country_by_window(c):
    return indicators.country_counts(c.paper_country_full, "win")


@query
def country_rank_bloc_window(c):
    return indicators.ranked_countries(c.paper_country_full, fact(c), "win")


@query
def country_rank_area_window(c):
    return indicators.ranked_countries(c.paper_country_full, fact(c), "win", "area")


@query
def country_rank_level_window(c):
    return indicators.ranked_countries(c.paper_country_full, fact(c), "win", "level")


@query
def focal_bloc_wide(c):
    counts = fact(c).groupBy("area", "win").agg(F.count_if("has_focal").alias("papers"))
    return indicators.pivot_counts(counts, ["area"], "win", c.params.windows.labels)


@query
def primary_comparators_wide(c):
    counts = indicators.country_counts(c.paper_country_full.where("is_bloc"), "win")
    out = indicators.pivot_counts(counts, ["win"], "country", list(c.params.comparators))
    return out.withColumn("ratio_3_8", ratio("nation_3", "nation_8"))


@query
def focal_ratio_by_window(c):
    counts = indicators.country_counts(c.paper_country_full, "win")
    out = indicators.pivot_counts(counts, ["win"], "country", ["NATION_3", "NATION_13"])
    return out.select("win", F.col("nation_3").alias("focal"), F.col("nation_13").alias("other"), ratio("nation_3", "nation_13").alias("ratio"))


@query
def growth_factors(c):
    counts = indicators.country_counts(c.paper_country_full.where("is_bloc"), "win")
    return indicators.growth(counts, c.params.windows.labels[0], c.params.windows.labels[-1])


@query
def trend_classes(c):
    return indicators.trends(indicators.ranked_countries(c.paper_country_full, fact(c), "win"), c.params.windows)


@query
def monotonicity_drops(c):
    return indicators.monotonicity_drops(facts.basic_metrics(fact(c), "win"), "focal", c.params.windows).select("win", "focal", "before")


@query
def top_venues_focal(c):
    rows = fact(c).groupBy("venue", "area", "level").agg(F.count_if("has_focal").alias("focal"))
    return indicators.top_by(rows, 100, "focal", "venue", "area", "level")


@query
def top_venues_focal_by_window(c):
    rows = fact(c).groupBy("win", "venue", "area", "level").agg(F.count_if("has_focal").alias("focal")).where("focal > 0")
    return indicators.top_by(rows, 30, "focal", "venue", "area", "level", within=("win",))


@query
def complete_vs_fractional_window(c):
    return indicators.fractional(c.paper_country_full, "win")


@query
def complete_vs_fractional_area_window(c):
    return indicators.fractional(c.paper_country_full, "win", "area")


@query
def alternative_denominators(c):
    n = c.table("nation")
    tags = F.array_compact(F.array(F.lit("world"), F.when(F.col("n_regionkey") == 3, "bloc"), F.when(F.col("n_regionkey").isin(2, 3), "extended"), F.when(F.col("n_nationkey") % 2 == 1, "comparable")))
    groups = n.select(F.col("n_name").alias("country"), F.explode(tags).alias("grp"))
    return indicators.denominators(c.paper_country_full, groups, c.papers.select("win").distinct(), c.params.focal)


@query
def coverage_threshold_sensitivity(c):
    return robustness.threshold_sensitivity(fact(c), c.params.thresholds, bloc(c))


def resolved_history(c: Corpus) -> DataFrame:
    return history.resolve_duplicates(c.ranking_raw).select("venue", "core_year", "level")


@query
def asof_historical_level(c):
    return history.as_of(c.papers, resolved_history(c), parts=8).select("paper_id", "year", "venue", "level", "hist_level", "hist_year", "fallback")


@query
def historical_scenarios(c):
    return robustness.scenario_shares(fact(c), history.scenario_tags(history.as_of(c.papers, resolved_history(c), parts=8)))


def reclassified(c: Corpus) -> DataFrame:
    """Focal and bloc papers by scenario, window and area; the scenarios' overrides are joined once for all."""
    rows = [("merge", "BUILDING", 0, "MACHINERY"), ("merge", "BUILDING", 1, "MACHINERY"), ("split", "AUTOMOBILE", 0, "VEHICLES")]
    names = ("scenario", "_area", "_mod", "area_alt")
    over = c.spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))
    tags = F.explode(F.array(*map(F.lit, ("base", "merge", "split"))))
    rows = fact(c).withColumns({"scenario": tags, "_mod": F.element_at(F.split("venue", "-"), -1).cast("int") % 2, "_area": F.col("area")})
    out = rows.join(F.broadcast(over), ["scenario", "_area", "_mod"], "left")  # a few literals
    return out.groupBy("scenario", "win", F.coalesce("area_alt", "area").alias("area")).agg(F.count_if("has_bloc").alias("bloc"), F.count_if("has_focal").alias("focal")).withColumn("share", ratio("focal", "bloc"))


@query
def area_reclassification(c):
    return reclassified(c)


@query
def area_reclassification_pivot(c):
    rows = reclassified(c)
    latest = rows.withColumn("_last", F.max("win").over(Window.partitionBy())).where("win = _last")  # aggregated rows
    out = latest.groupBy("area").pivot("scenario", ["base", "merge", "split"]).agg(F.first("share"))
    return out.withColumn("spread", F.greatest("base", "merge", "split") - F.least("base", "merge", "split"))


def _segments(c: Corpus) -> DataFrame:
    return robustness.segments(fact(c), "area", "level")


def _parts(c: Corpus) -> DataFrame:
    labels = c.params.windows.labels
    return robustness.shift_share(_segments(c), labels[0], labels[-1], "area", "level")


@query
def shift_share_segments(c):
    return _segments(c)


@query
def shift_share_contributions(c):
    return _parts(c).select("area", "level", *[F.round(n, 9).alias(n) for n in ("w0", "q0", "w1", "q1", "composition", "performance", "interaction")])


@query
def shift_share_summary(c):
    return robustness.shift_share_summary(_parts(c))


@query
def collaboration_profile(c):
    return indicators.collaboration(fact(c), "win", "area")


@query
def partner_countries(c):
    return indicators.partners(fact(c), c.params.focal, "win")


@query
def institution_ranking(c):
    return indicators.institution_ranking(c.institutions.where("is_focal").select("paper_id", "institution"))


@query
def institution_concentration(c):
    return indicators.concentration(c.institutions.where("is_focal").join(c.papers, "paper_id"), "win")


@query
def impact_percentile(c):
    return indicators.impact_scores(c.papers, "price").select("paper_id", "venue", "year", F.round("z", 6).alias("z"), "percentile")


@query
def impact_by_country_window(c):
    return indicators.impact(c.paper_country, indicators.impact_scores(c.papers, "price"), "price")


@query
def maturity_scenarios(c):
    return robustness.maturity(fact(c), c.paper_country_full, [("full", 1999, 2001), ("without_last", 1999, 2000), ("last", 2001, 2001)], bloc(c))


@query
def rank_bounds(c):
    return robustness.rank_bounds(fact(c), c.paper_country_full, c.params.focal, bloc(c))


@query
def overlap_inflation(c):
    return indicators.overlap_inflation(fact(c), "win")


@query
def multiplicity_distribution(c):
    return indicators.multiplicity(fact(c), "win")


def with_doi(c: Corpus) -> DataFrame:
    """Papers of a price of six digits or more stand for those with a DOI."""
    return fact(c).withColumn("has_doi", F.length(F.round("price").cast("long").cast("string")) > 5)


@query
def missingness_by_cell(c):
    return facts.coverage(with_doi(c), "win", "area", "level", "has_doi")


@query
def missingness_by_venue(c):
    return facts.coverage(fact(c), "venue")


@query
def missingness_logit(c):
    cells = robustness.missingness_cells(with_doi(c).withColumn("has_doi", F.col("has_doi").cast("double")), "win", "area", "level", "has_doi")
    totals = robustness.logit_totals(cells, "share ~ win + area + level + has_doi", weight="n")
    return totals.select("term", F.round("rows").cast("long").alias("papers"), F.round("observed", 3).alias("resolved"), F.round("fitted", 3).alias("fitted"))


@query
def bootstrap_observed(c):
    return robustness.bootstrap_observed(robustness.clusters(fact(c), "win"), "win")


@query
def bootstrap_ci(c):
    out = robustness.bootstrap(robustness.clusters(fact(c), "win"), "win", c.params.replicates, c.params.seed)
    return out.select("win", "clusters", *[F.round(n, 9).alias(n) for n in ("share", "low", "high", "sd")])


@query
def corpus_expansion_detail(c):
    labels = c.params.windows.labels
    return robustness.expansion(fact(c), labels[0], labels[-1])


@query
def corpus_expansion_summary(c):
    return robustness.expansion_summary(corpus_expansion_detail(c))


@query
def leadership_by_window(c):
    return indicators.leadership(c.authors, c.papers, "win")


@query
def leadership_area_window(c):
    return indicators.leadership(c.authors, c.papers, "win", "area")


FIRST, LAST = 1995, 2002


@query
def validity_intervals(c):
    return history.validity(resolved_history(c), FIRST, LAST).select("venue", "core_year", "level", "year_start", "year_end")


@query
def required_years(c):
    return history.required_years(resolved_history(c), FIRST, LAST)


@query
def ranking_duplicates_resolved(c):
    return history.resolve_duplicates(c.ranking_raw)


@query
def undifferentiated_year_inference(c):
    return history.infer_undifferentiated(c.ranking_raw, 1998, 1996, 2000, c.params.policy)


@query
def ranking_counts_pivot(c):
    h = resolved_history(c)
    return h.groupBy("core_year").agg(F.count_if(F.col("level") == "A*").alias("top"), F.count_if(F.col("level") == "A").alias("a"))


@query
def historical_gap(c):
    known = c.papers.where("year = 1995 AND venue NOT LIKE '%4'").select("venue")
    return history.gap(history.venue_rollup(resolved_history(c)), known)


# The terms of a venue's priority, its classes, and the rules of its tier, in order.
PRIORITY_TERMS = {
    "ever at the top level": "if(top_years > 0, 5, 2)",
    "versions": "least(years_present, 6)",
    "versions at the top level": "least(top_years, 4)",
    "recency": "CASE WHEN last_year >= 2000 THEN 3 WHEN last_year >= 1998 THEN 2 WHEN last_year >= 1996 THEN 1 END",
    "early start": "if(first_year <= 1994, 2, 0)",
    "required years": "least(required_years / 5D, 4D)",
    "relevance": "CASE relevance WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 ELSE -2 END",
}
PRIORITY_CUTS = ((15, "HIGH"), (10, "MEDIUM"))
CENTRAL, ADJACENT = "area IN ('BUILDING', 'MACHINERY')", "area IN ('FURNITURE', 'HOUSEHOLD')"
TIER_RULES = (
    ("seed = 3", "TIER3", "seed"),
    ("seed = 1 AND (top_years > 0 OR years_present >= 2 OR required_years >= 8)", "TIER1", "seed"),
    ("seed = 2", "TIER2", "seed"),
    (f"{CENTRAL} AND top_years > 0 AND required_years >= 5", "TIER1", "central, once at the top, long required"),
    (f"{CENTRAL} AND priority_level = 'HIGH' AND priority_score >= 18 AND required_years >= 10", "TIER1", "central, high priority"),
    (f"{CENTRAL} AND priority_level IN ('HIGH', 'MEDIUM')", "TIER2", "central, little evidence"),
    (f"{ADJACENT} AND top_years >= 2 AND required_years >= 10 AND priority_score >= 20", "TIER2", "adjacent, lasting top level"),
    (f"{ADJACENT} AND priority_level = 'HIGH'", "TIER2", "adjacent, high priority"),
    (ADJACENT, "TIER3", "adjacent"),
    ("priority_level = 'LOW'", "TIER3", "low priority"),
)


def scored(c: Corpus) -> DataFrame:
    h = resolved_history(c)
    rel = F.when(F.col("nk") % 5 == 0, "HIGH").when(F.col("nk") % 5 == 4, "LOW").otherwise("MEDIUM")
    relevance = c.venues.select("venue", "area", "nk", rel.alias("relevance"))
    return history.priority(history.venue_rollup(h), history.required_years(h, FIRST, LAST), relevance, PRIORITY_TERMS, PRIORITY_CUTS, "LOW")


@query
def venue_priority(c):
    return scored(c).select("venue", "area", "years_present", "top_years", "required_years", "relevance", "priority_score", "priority_level")


def tiered(c: Corpus) -> DataFrame:
    seed = F.when(F.col("nk") == 22, 3).when(F.col("nk") == 10, 1).when(F.col("nk") == 14, 2)
    return history.tiers(scored(c), c.venues.select("venue", seed.alias("seed")), TIER_RULES, ("TIER2", "mixed evidence"))


@query
def venue_tiers(c):
    return tiered(c).select("venue", "area", "priority_score", "priority_level", "tier")


@query
def tier_summary(c):
    return tiered(c).groupBy("tier").agg(F.count("*").alias("venues"), F.round(F.avg("priority_score"), 6).alias("mean_score"), F.min("priority_score").alias("min_score"), F.max("priority_score").alias("max_score"))


@query
def priority_overrides(c):
    manual = c.venues.select("venue", F.when(F.col("nk") == 3, "LOW").when(F.col("nk") == 4, " ").alias("priority_override"))
    return history.override(scored(c), manual, "venue", {"priority_level": "priority_override"}).select("venue", "priority_level")


@query
def evidence_consolidated(c):
    return consolidate.consolidate(c.evidence)


@query
def evidence_source_counts(c):
    return consolidate.source_counts(consolidate.consolidate(c.evidence))


@query
def cascade_unresolved(c):
    stages = [c.evidence.where(F.col("source") == s) for s in ("A", "N", "R")]
    left = matching.unresolved(c.papers.select("paper_id"), *stages)
    return consolidate.union(*[df.agg(F.lit(i).alias("stage"), F.count("*").alias("papers")) for i, df in enumerate(left)])


@query
def dedupe_best_confidence(c):
    e = c.evidence.select("paper_id", "country", "source", "method", "confidence", "seq")
    return matching.best(e, ["paper_id", "country"], F.col("confidence").desc(), F.col("seq"), F.col("source"), F.col("method"))


def title_sides(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """All documents as papers and as works."""
    return c.titles.withColumnRenamed("doc_id", "paper_id"), c.titles.withColumnRenamed("doc_id", "work_id")


@query
def title_exact_match(c):
    return matching.exact_match(*title_sides(c), ["lang"]).where("paper_id <> work_id")


@query
def title_fuzzy_match(c):
    return matching.fuzzy_match(*title_sides(c), ["lang"], 0.86, other=True)


@query
def secondary_text_flags(c):
    t = F.coalesce("text", F.lit(""))
    return c.table("documents").select("doc_id", text.hits(t, ("the", "license", "www")).alias("tokens"), text.has_any(t, ("license", "copyright")).alias("secondary"), text.has_doi(t).alias("has_text"))


@query
def profile_interval_lookup(c):
    start = F.explode(F.array(*map(F.lit, (1996, 1998, 2000)))).alias("start")
    h = c.venues.select(F.col("nk").alias("author")).distinct().select("author", start).where("(author + start) % 5 <> 1")
    a, s = F.col("author"), F.col("start")
    h = h.withColumns({"end": F.when(s < 2000, s + a % 3), "country": F.when((a + s) % 7 != 0, F.concat(F.lit("C"), ((a + s) % 4).cast("string")))})
    papers = c.papers.select("paper_id", "year", F.element_at(F.split("venue", "-"), -1).cast("int").alias("author"))
    return matching.profile_lookup(papers, h, parts=8)


@query
def doi_normalise(c):
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC"), k)).when(k % 6 == 1, F.concat(F.lit("http://dx.doi.org/10.1000/Abc"), k, F.lit("."))).when(k % 6 == 2, F.concat(F.lit("doi: 10.1000/x"), k)).when(k % 6 == 3, F.concat(F.lit(" 10.1000/Y"), k, F.lit(" "))).when(k % 6 == 4, "")
    out = c.table("part").select("p_partkey", raw.alias("raw"))
    return out.select("*", text.doi(F.col("raw")).alias("doi"), text.doi(F.col("raw"), True).alias("doi_case")).withColumn("has_doi", text.has_doi(F.col("doi")))


@query
def url_host_filter(c):
    h = text.host(F.col("url"))
    return c.table("pages").select("page_id", h.alias("host"), text.host_allowed(h, ("example.com", "example.org")).alias("allowed"), text.short_id(F.col("url")).alias("short_id"))


@query
def html_links(c):
    rows = c.table("pages").select("page_id", "url", F.explode(text.hrefs(F.col("html"))).alias("link"))
    out = rows.groupBy("page_id", "url", "link").agg(F.count("*").alias("times"))
    full = F.col("link").rlike("^[a-zA-Z]+://") | F.col("link").startswith("/")
    return out.select("page_id", "link", "times", F.when(full, text.absolute(F.col("url"), F.col("link"))).alias("target"))


@query
def entity_repair(c):
    return c.table("pages").select("page_id", F.md5(text.entities(F.col("html"), ("quot", "copy", "middot", "amp")).cast("binary")).alias("repaired"), F.length("html").alias("n"))


@query
def venue_audit(c):
    return audit.venue_audit(c.papers, 100, 1995, 2001)


@query
def booktitle_audit(c):
    return audit.value_audit(c.table("part"), "p_brand", "p_type")


@query
def level_stats(c):
    return audit.level_stats(c.papers.groupBy("venue", "level").agg(F.count("*").alias("papers")), "level", "papers")


@query
def duplicate_keys(c):
    return audit.duplicate_rows(c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")


@query
def metric_summary(c):
    return audit.metrics(fact(c), papers=F.count("*"), resolved=F.count_if("resolved"), bloc=F.count_if("has_bloc"), focal=F.count_if("has_focal"), venues=F.count_distinct("venue"))


@query
def constraint_violations(c):
    o, li = c.table("orders"), c.table("lineitem")
    keys = o.select(F.col("o_orderkey").alias("k")), li.select(F.col("l_orderkey").alias("k"))
    n = c.table("nation")
    checks = {
        "orders_pk": duplicates(o, "o_orderkey"),
        "lineitem_pk": duplicates(li, "l_orderkey", "l_linenumber"),
        "orders_without_lines": missing_keys(keys[0], keys[1], ["k"]),
        "lines_without_order": missing_keys(keys[1], keys[0], ["k"]),
        "year_range": out_of_range(o, F.year("o_orderdate"), 1995, 2000),
        "name_overlap": c.table("customer").select(F.col("c_nationkey").alias("k")).intersect(c.table("supplier").select(F.col("s_nationkey").alias("k"))),
        "region_mismatch": mismatches(n, n.select("n_nationkey", (F.col("n_nationkey") % 5).alias("n_regionkey")), ["n_nationkey"], ["n_regionkey"]),
    }
    return consolidate.union(*[df.agg(F.lit(k).alias("check_name"), F.count("*").alias("violations")) for k, df in checks.items()])


@query
def surrogate_keys(c):
    return audit.surrogate_keys(c.table("orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "key")


@query
def status_counts(c):
    return audit.value_audit(c.table("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), "status", "priority")


@query
def subarea_names(c):
    return c.venues.groupBy("area").agg(F.count("*").alias("venues"), F.array_join(F.array_sort(F.collect_set("venue")), ", ").alias("names"))


@query
def stable_intersection(c):
    h = resolved_history(c)
    return h.where("core_year = 1996").select("venue").intersect(h.where("core_year = 2000").select("venue"))


@query
def conclusion_checks(c):
    """Statements recomputed from the tables, one row each: name, value, and whether it holds."""
    m = facts.basic_metrics(fact(c), "win")
    cells = facts.basic_metrics(fact(c), "win", "area")
    drops = indicators.monotonicity_drops(m, "focal", c.params.windows)
    rows = [
        m.agg(F.lit("bloc_within_resolved").alias("name"), F.count_if(F.col("bloc") > F.col("resolved")).alias("value")),
        m.agg(F.lit("resolved_within_total"), F.count_if(F.col("resolved") > F.col("total"))),
        cells.agg(F.lit("small_denominators"), F.count_if(F.col("bloc") < 30)),
        drops.agg(F.lit("focal_drops"), F.count("*")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("holds", F.col("value") == 0)


@query
def main_track_filter(c):
    """Parts as records: brand as venue, type as booktitle."""
    records = c.table("part").select("p_partkey", F.col("p_brand").alias("venue"), F.col("p_type").alias("booktitle"))
    types = records.select("venue", F.col("booktitle").alias("pattern")).distinct()
    accepted = types.where(F.length("pattern") % 2 == 0)
    partial = types.where("venue LIKE '%1'").select("venue", F.substring("pattern", 1, 3).alias("pattern"))
    return matching.main_track(records, accepted, partial, ("tin", "workshop"))


@query
def near_year_title_match(c):
    """Titles again, with a year from the number of characters: works of one year more or less count."""
    years = c.table("documents").select("doc_id", (2000 + F.coalesce("n_chars", F.lit(0)) % 3).cast("int").alias("year"))
    t = c.titles.join(years, "doc_id")
    papers = matching.near_years(t.withColumnRenamed("doc_id", "paper_id"))
    works = t.select(F.col("doc_id").alias("work_id"), "lang", "title", F.col("year").alias("match_year"))
    return matching.exact_match(papers, works, ["lang", "match_year"]).where("paper_id <> work_id").groupBy("paper_id").agg(F.min("work_id").alias("work_id"))


@query
def unicode_title_groups(c):
    """Documents by the first words of their text, equal without case and accents in any script."""
    t = c.table("documents").select("lang", text.first_words(F.coalesce("text", F.lit("")), 3).alias("t"))
    words = F.slice(text.tokens(text.title_unicode(F.col("t"))), 1, 2)
    rows = t.select("lang", F.collate(F.array_join(words, " "), "UNICODE").alias("title"))
    out = rows.groupBy("lang", "title").agg(F.count("*").alias("documents"))
    return out.select("lang", F.collate("title", "UTF8_BINARY").alias("title"), "documents")


@query
def source_fallback(c):
    """Countries of a paper from its best source alone."""
    rows = c.evidence.select("paper_id", "country", (F.col("priority") - 1).alias("priority"))
    return matching.best_priority(rows, "paper_id", "priority", "country")


@query
def positional_zip(c):
    """Line numbers and parts of an order side by side; the arrays are bounded by an order's lines."""
    s = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    a = c.table("lineitem").groupBy("l_orderkey").agg(s.alias("s"))
    a = a.select("l_orderkey", F.col("s.l_linenumber").alias("numbers"), F.col("s.l_partkey").alias("parts"))
    return matching.zipped(a, "numbers", "parts")


@query
def key_prefix_filter(c):
    """URLs as keys: those whose first two segments are accepted."""
    keys = c.table("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("key"))
    accepted = c.table("pages").where("url LIKE 'https:%'").select(F.substring_index(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "/", 2).alias("prefix"))
    return matching.prefix_filter(keys, "key", accepted).select("page_id", "key", "prefix")


@query
def country_flags(c):
    """Codes normalised and flagged against named sets."""
    raw = c.nations.select("country", "is_bloc", "is_focal", F.concat(F.lit(" "), F.lower(F.substring("country", 8, 1)), F.lit("s ")).alias("raw"))
    code = text.country_code(F.translate("raw", "0123456789", "aeudnkgbfi"))
    return raw.select("country", code.alias("code"), code.isin("ES", "DS").alias("in_set"), "is_bloc", "is_focal")


@query
def preflight_summary(c):
    """Rows, distinct keys and coverage before any analysis."""
    return audit.metrics(fact(c), rows=F.count("*"), papers=F.count_distinct("paper_id"), without_window=F.count_if(F.col("win").isNull()), without_venue=F.count_if(F.col("venue").isNull()), unresolved=F.count_if(~F.col("resolved")))


@query
def preflight_gates(c):
    """Errors and warnings before any analysis: keys, references, ranges and empty values of orders and their lines, each table read
    once."""
    year = F.year("o_orderdate")
    orders = gates.Side(
        "orders", c.table("orders"), ("o_orderkey",),
        (gates.Gate("year out of range", ~year.between(1995, 2000)), gates.Gate("no customer", F.col("o_custkey").isNull()), gates.Gate("price above 250000", F.col("o_totalprice") > 250000, gates.WARNING)),
        unique=gates.ERROR, known=gates.WARNING,
    )
    lines = gates.Side("lines", c.table("lineitem"), ("l_orderkey",), (gates.Gate("no quantity", F.col("l_quantity") <= 0), gates.Gate("returned", F.col("l_returnflag") == "R", gates.WARNING)), known=gates.ERROR)
    return gates.check_both(orders, lines)


from . import source_queries  # noqa: E402 - registers the queries of readers and text functions
