"""DuckDB SQL for the catalogue, written independently of the Spark plans."""

from __future__ import annotations

from ..operators.robustness import poisson_cuts

WIN = "CASE WHEN y BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN y BETWEEN 1997 AND 1998 THEN '1997-1998' WHEN y BETWEEN 1999 AND 2000 THEN '1999-2000' WHEN y BETWEEN 2001 AND 2002 THEN '2001-2002' END"
BASE = f"""
pm AS (SELECT o_orderkey AS paper_id, CAST(y AS BIGINT) AS year, {WIN} AS win, c_mktsegment || '-' || c_nationkey AS venue, c_mktsegment AS area,
  CASE WHEN c_nationkey % 3 = 0 THEN 'A*' ELSE 'A' END AS level, o_totalprice AS price, c_nationkey AS nk
  FROM (SELECT *, year(o_orderdate) AS y FROM orders) JOIN customer ON o_custkey = c_custkey),
li AS (SELECT l_orderkey AS paper_id, n_name AS country, n_regionkey = 3 AS is_bloc, n_name = 'NATION_3' AS is_focal, l_returnflag, l_linestatus, l_linenumber, l_discount, s_name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
pc AS (SELECT DISTINCT paper_id, country, is_bloc, is_focal FROM li WHERE l_returnflag = 'R'),
agg AS (SELECT paper_id, count(*) AS n_countries, count(*) FILTER (is_bloc) AS n_bloc, bool_or(is_focal) AS hf FROM pc GROUP BY paper_id),
fact AS (SELECT pm.*, n_countries, n_bloc, n_countries IS NOT NULL AS resolved, coalesce(n_bloc > 0, false) AS has_bloc, coalesce(hf, false) AS has_focal FROM pm LEFT JOIN agg USING (paper_id)),
pcm AS (SELECT pc.*, year, win, venue, area, level FROM pc JOIN pm USING (paper_id)),
bloc AS (SELECT n_name AS country FROM nation WHERE n_regionkey = 3),
ven AS (SELECT DISTINCT c_mktsegment || '-' || c_nationkey AS venue, c_mktsegment AS area, c_nationkey AS nk FROM customer),
raw AS (SELECT venue, y AS core_year, CASE WHEN (nk + y // 2) % 3 = 0 THEN 'A*' ELSE 'A' END AS level, 'file' || y AS source_file, 'Conf ' || venue AS conference_name
  FROM ven, (VALUES (1994), (1996), (1998), (2000)) t(y) WHERE nk % 11 <> 7 AND (nk + y) % 5 <> 0 AND NOT (nk % 4 = 1 AND y < 1998)
  UNION ALL SELECT venue, 1998, 'A*', 'extra1998', 'Conf ' || venue || ' b' FROM ven WHERE nk % 11 <> 7 AND nk % 6 = 0),
hist AS (SELECT venue, core_year, CASE WHEN bool_or(level = 'A*') THEN 'A*' ELSE min(level) END AS level FROM raw GROUP BY ALL)"""


def q(body: str, more: str = "") -> str:
    return f"WITH {BASE}{', ' + more if more else ''}\n{body}"


def div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


SUMS = "count(*) AS total, count(*) FILTER (resolved) AS resolved, count(*) FILTER (has_bloc) AS bloc, count(*) FILTER (has_focal) AS focal"
RATIOS = f"total, resolved, bloc, focal, total - resolved AS unresolved, {div('resolved', 'total')} AS coverage, {div('focal', 'resolved')} AS share_world, {div('focal', 'bloc')} AS share_bloc"


def basic(keys: str) -> str:
    return q(f"SELECT {keys}, {RATIOS} FROM (SELECT {keys}, {SUMS} FROM fact GROUP BY {keys})")


def cover(keys: str) -> str:
    return q(f"SELECT {keys}, total, resolved, total - resolved AS unresolved, {div('resolved', 'total')} AS coverage FROM (SELECT {keys}, {SUMS} FROM fact GROUP BY {keys})")


def ranked(keys: str) -> str:
    on = " AND ".join(f"c.{k.strip()} IS NOT DISTINCT FROM d.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return q(
        f"""SELECT {sel}, c.country, papers, bloc, {div('papers', 'bloc')} AS share, rank() OVER (PARTITION BY {sel} ORDER BY papers DESC) AS rank
FROM (SELECT {keys}, country, count(*) AS papers FROM pcm WHERE is_bloc GROUP BY {keys}, country) c JOIN (SELECT {keys}, count(*) FILTER (has_bloc) AS bloc FROM fact GROUP BY {keys}) d ON {on}"""
    )


RANKW = f"rw AS (SELECT c.win, c.country, papers, bloc, {div('papers', 'bloc')} AS share FROM (SELECT win, country, count(*) AS papers FROM pcm WHERE is_bloc GROUP BY ALL) c JOIN (SELECT win, count(*) FILTER (has_bloc) AS bloc FROM fact GROUP BY win) d USING (win))"
COMP = ["NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23"]


def frac(keys: str) -> str:
    return q(
        f"SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY complete DESC) AS rank_complete, rank() OVER (PARTITION BY {keys} ORDER BY fractional DESC) AS rank_fractional FROM f",
        f"w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY paper_id) AS wt FROM pcm), f AS (SELECT {keys}, country, count(*) AS complete, round(sum(wt), 6) AS fractional FROM w WHERE is_bloc GROUP BY {keys}, country)",
    )


ASOF = """dated AS (SELECT pm.*, coalesce(p.level, l.level) AS hist_level, coalesce(p.core_year, l.core_year) AS hist_year, p.core_year IS NULL AS fallback
  FROM pm LEFT JOIN (SELECT paper_id, max_by(h.level, h.core_year) AS level, max(h.core_year) AS core_year FROM pm JOIN hist h USING (venue) WHERE h.core_year <= year GROUP BY paper_id) p USING (paper_id)
  LEFT JOIN (SELECT paper_id, min_by(h.level, h.core_year) AS level, min(h.core_year) AS core_year FROM pm JOIN hist h USING (venue) WHERE h.core_year > year GROUP BY paper_id) l USING (paper_id))"""
TAGS = """tags AS (SELECT paper_id, 'fixed' AS scenario FROM dated UNION ALL SELECT paper_id, 'historical_all' FROM dated WHERE hist_level IS NOT NULL AND NOT fallback
  UNION ALL SELECT paper_id, 'historical_top' FROM dated WHERE hist_level = 'A*' AND NOT fallback UNION ALL SELECT paper_id, 'stable_both' FROM dated WHERE hist_level = level AND NOT fallback)"""
SEG = f"seg AS (SELECT win, area, level, bloc, focal, {div('focal', 'bloc')} AS q, CAST(bloc AS DOUBLE) / sum(bloc) OVER (PARTITION BY win) AS weight FROM (SELECT win, area, level, count(*) AS bloc, count(*) FILTER (has_focal) AS focal FROM fact WHERE has_bloc GROUP BY win, area, level))"
PARTS = """parts AS (SELECT coalesce(a.area, b.area) AS area, coalesce(a.level, b.level) AS level, coalesce(a.weight, 0) AS w0, coalesce(a.q, 0) AS q0, coalesce(b.weight, 0) AS w1, coalesce(b.q, 0) AS q1
  FROM (SELECT * FROM seg WHERE win = '1995-1996') a FULL JOIN (SELECT * FROM seg WHERE win = '2001-2002') b ON a.area = b.area AND a.level = b.level)"""
AREAS = "sc(scenario, match_area, match_mod, area_alt) AS (VALUES ('merge', 'BUILDING', 0, 'MACHINERY'), ('merge', 'BUILDING', 1, 'MACHINERY'), ('split', 'AUTOMOBILE', 0, 'VEHICLES'))"
RECLASS = f"""{AREAS}, rec AS (SELECT s.scenario, fact.win, coalesce(o.area_alt, fact.area) AS area, count(*) FILTER (has_bloc) AS bloc, count(*) FILTER (has_focal) AS focal
  FROM fact CROSS JOIN (SELECT 'base' AS scenario UNION ALL SELECT DISTINCT scenario FROM sc) s LEFT JOIN sc o ON o.scenario = s.scenario AND o.match_area = fact.area AND o.match_mod = fact.nk % 2 GROUP BY ALL)"""
EXP = """ex AS (SELECT venue, count(*) FILTER (win = '1995-1996' AND has_bloc) AS bloc0, count(*) FILTER (win = '2001-2002' AND has_bloc) AS bloc1, count(*) FILTER (win = '1995-1996' AND has_focal) AS focal0, count(*) FILTER (win = '2001-2002' AND has_focal) AS focal1
  FROM fact WHERE resolved AND win IN ('1995-1996', '2001-2002') GROUP BY venue),
exs AS (SELECT *, CASE WHEN bloc0 = 0 AND bloc1 > 0 THEN 'new' WHEN bloc0 > 0 AND bloc1 = 0 THEN 'gone' ELSE 'both' END AS status, focal1 - focal0 AS delta_focal, bloc1 - bloc0 AS delta_bloc FROM ex)"""
INST = "inst AS (SELECT DISTINCT paper_id, s_name AS institution FROM li WHERE l_returnflag = 'R' AND is_focal)"
IMPACT = f"""lg AS (SELECT *, ln(1 + coalesce(price, 0)) AS lg FROM pm),
imp AS (SELECT *, (lg - avg(lg) OVER g) / nullif(stddev_samp(lg) OVER g, 0) AS z,
  (rank() OVER (PARTITION BY venue, year ORDER BY price) + (count(*) OVER (PARTITION BY venue, year, price) - 1) / 2.0::DOUBLE) / count(price) OVER g AS percentile FROM lg WINDOW g AS (PARTITION BY venue, year))"""
INTERVALS = "iv AS (SELECT core_year, greatest(core_year, 1995) AS year_start, least(coalesce(lead(core_year) OVER (ORDER BY core_year) - 1, 2002), 2002) AS year_end FROM (SELECT DISTINCT core_year FROM hist))"
ROLL = """roll AS (SELECT venue, min(core_year) AS first_year, max(core_year) AS last_year, count(DISTINCT core_year) AS years_present, string_agg(DISTINCT core_year::VARCHAR, '|' ORDER BY core_year::VARCHAR) AS years_list,
  string_agg(DISTINCT level, '|' ORDER BY level) AS levels_list, count(*) FILTER (level = 'A*') AS top_years, count(*) FILTER (level = 'A') AS a_years FROM hist GROUP BY venue)"""
REQ = f"{INTERVALS}, req AS (SELECT venue, CAST(sum(year_end - year_start + 1) AS BIGINT) AS required_years, min(year_start) AS first_required, max(year_end) AS last_required FROM hist JOIN iv USING (core_year) WHERE year_start <= year_end GROUP BY venue)"
PRIO = f"""{ROLL}, {REQ}, pr0 AS (SELECT roll.*, coalesce(required_years, 0) AS required_years, ven.area, ven.nk, CASE WHEN nk % 5 = 0 THEN 'HIGH' WHEN nk % 5 = 4 THEN 'LOW' ELSE 'MEDIUM' END AS relevance
  FROM roll LEFT JOIN req USING (venue) JOIN ven USING (venue)),
pr1 AS (SELECT *, round((CASE WHEN top_years > 0 THEN 5 ELSE 2 END + least(years_present, 6) + least(top_years, 4) + CASE WHEN last_year >= 2000 THEN 3 WHEN last_year >= 1998 THEN 2 WHEN last_year >= 1996 THEN 1 ELSE 0 END
  + CASE WHEN first_year <= 1994 THEN 2 ELSE 0 END + CASE relevance WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 ELSE -2 END)::DOUBLE + least(required_years / 5.0::DOUBLE, 4.0), 2) AS priority_score FROM pr0),
pr AS (SELECT *, CASE WHEN priority_score >= 15 THEN 'HIGH' WHEN priority_score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS priority_level FROM pr1)"""
TIERS = f"""{PRIO}, ti AS (SELECT *, CASE WHEN nk = 22 THEN 3 WHEN nk = 10 THEN 1 WHEN nk = 14 THEN 2 END AS seed FROM pr),
tier AS (SELECT *, CASE WHEN seed = 3 THEN 'TIER3' WHEN seed = 1 AND (top_years > 0 OR years_present >= 2 OR required_years >= 8) THEN 'TIER1' WHEN seed = 2 THEN 'TIER2'
  WHEN area IN ('BUILDING', 'MACHINERY') AND top_years > 0 AND required_years >= 5 THEN 'TIER1' WHEN area IN ('BUILDING', 'MACHINERY') AND priority_level = 'HIGH' AND priority_score >= 18 AND required_years >= 10 THEN 'TIER1'
  WHEN area IN ('BUILDING', 'MACHINERY') AND priority_level IN ('HIGH', 'MEDIUM') THEN 'TIER2'
  WHEN area IN ('FURNITURE', 'HOUSEHOLD') AND top_years >= 2 AND required_years >= 10 AND priority_score >= 20 THEN 'TIER2' WHEN area IN ('FURNITURE', 'HOUSEHOLD') AND priority_level = 'HIGH' THEN 'TIER2'
  WHEN area IN ('FURNITURE', 'HOUSEHOLD') THEN 'TIER3' WHEN priority_level = 'LOW' THEN 'TIER3' ELSE 'TIER2' END AS tier FROM ti)"""
EVID = "ev AS (SELECT DISTINCT paper_id, country, l_returnflag AS source, l_linestatus AS method, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS priority FROM li)"
CONS = f"""{EVID}, cons AS (SELECT paper_id, country, string_agg(source, '|' ORDER BY sp) AS sources, any_value(methods) AS methods, count(*) AS n_sources, min(sp) AS best_priority
  FROM (SELECT paper_id, country, source, min(priority) AS sp FROM ev GROUP BY ALL)
  JOIN (SELECT paper_id, country, string_agg(method, '|' ORDER BY k, method) AS methods FROM (SELECT paper_id, country, method, min(priority || source) AS k FROM ev GROUP BY ALL) GROUP BY ALL) USING (paper_id, country) GROUP BY ALL)"""
TITLE = """ti0 AS (SELECT doc_id, lang, list_filter(string_split(trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS w FROM documents),
titles AS (SELECT doc_id, lang, array_to_string(w[1:12], ' ') AS title FROM ti0),
p AS (SELECT doc_id AS paper_id, lang, title FROM titles), w AS (SELECT doc_id AS work_id, lang, title FROM titles)"""
DOIS = """dois AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'https://doi.org/10.1000/ABC' || p_partkey WHEN 1 THEN 'http://dx.doi.org/10.1000/Abc' || p_partkey || '.' WHEN 2 THEN 'doi: 10.1000/x' || p_partkey WHEN 3 THEN ' 10.1000/Y' || p_partkey || ' ' WHEN 4 THEN '' ELSE NULL END AS raw FROM part)"""


SQL: dict[str, str] = {
    "basic_metrics_window": basic("win"),
    "basic_metrics_area_window": basic("win, area"),
    "basic_metrics_level_window": basic("win, level"),
    "basic_metrics_venue": basic("venue"),
    "basic_metrics_grouping_sets": q(
        f"SELECT win, area, level, venue, grp AS grouping, {RATIOS} FROM (SELECT win, area, level, venue, CASE GROUPING(win, area, level, venue) WHEN 7 THEN 'win' WHEN 3 THEN 'win+area' WHEN 5 THEN 'win+level' WHEN 14 THEN 'venue' END AS grp, {SUMS} FROM fact GROUP BY GROUPING SETS ((win), (win, area), (win, level), (venue)))"
    ),
    "basic_metrics_excluded_area": q(f"SELECT win, {RATIOS} FROM (SELECT win, {SUMS} FROM fact WHERE area <> 'FURNITURE' GROUP BY win)"),
    "paper_counts_by_year": q("SELECT year, count(*) AS papers FROM pm GROUP BY year"),
    "paper_counts_venue_year": q("SELECT venue, year, count(*) AS papers FROM pm GROUP BY ALL"),
    "coverage_by_window": cover("win"),
    "coverage_by_venue_window": cover("venue, win"),
    "coverage_area_venues": q(f"SELECT *, {div('resolved', 'total')} AS coverage FROM (SELECT area, count(*) AS total, count(*) FILTER (resolved) AS resolved, count(DISTINCT venue) AS venues FROM fact GROUP BY area)"),
    "bloc_summary_window": q(f"SELECT *, round(100 * {div('bloc', 'papers')}, 3) AS bloc_pct, round(100 * {div('focal', 'bloc')}, 3) AS focal_pct FROM (SELECT win, count(*) AS papers, count(*) FILTER (has_bloc) AS bloc, count(*) FILTER (has_focal) AS focal, max(n_countries) AS most_countries FROM fact WHERE resolved GROUP BY win)"),
    "country_by_window": q("SELECT win, country, count(*) AS papers FROM pcm GROUP BY ALL"),
    "country_rank_bloc_window": ranked("win"),
    "country_rank_area_window": ranked("win, area"),
    "country_rank_level_window": ranked("win, level"),
    "focal_bloc_wide": q("SELECT area, " + ", ".join(f"count(*) FILTER (win = '{w}' AND has_focal) AS \"{w.replace('-', '_')}\"" for w in ("1995-1996", "1997-1998", "1999-2000", "2001-2002")) + " FROM fact GROUP BY area"),
    "primary_comparators_wide": q("SELECT win, " + ", ".join(f"count(*) FILTER (country = '{c}') AS {c.lower()}" for c in COMP) + f", {div(chr(39).join(['count(*) FILTER (country = ', 'NATION_3', ')']), chr(39).join(['count(*) FILTER (country = ', 'NATION_8', ')']))} AS ratio_3_8 FROM pcm WHERE is_bloc GROUP BY win"),
    "focal_ratio_by_window": q(f"SELECT win, a AS focal, b AS other, {div('a', 'b')} AS ratio FROM (SELECT win, count(*) FILTER (country = 'NATION_3') AS a, count(*) FILTER (country = 'NATION_13') AS b FROM pcm GROUP BY win)"),
    "growth_factors": q(f"SELECT *, papers_last - papers_first AS delta, {div('papers_last', 'papers_first')} AS factor FROM (SELECT country, CAST(coalesce(sum(papers) FILTER (win = '1995-1996'), 0) AS BIGINT) AS papers_first, CAST(coalesce(sum(papers) FILTER (win = '2001-2002'), 0) AS BIGINT) AS papers_last FROM rw GROUP BY country)", RANKW),
    "trend_classes": q(
        """SELECT country, first, last, peak, peak_win, last - first AS delta, CASE WHEN last - first >= 1 THEN 'up' WHEN last - first <= -1 THEN 'down' WHEN peak - greatest(first, last) >= 1 THEN 'mixed' WHEN last - first IS NOT NULL THEN 'stable' END AS trend
FROM (SELECT country, max(100 * share) FILTER (win = '1995-1996') AS first, max(100 * share) FILTER (win = '2001-2002') AS last, max(100 * share) AS peak, arg_max(win, (100 * share, -CAST(substr(win, 1, 4) AS INT))) AS peak_win FROM rw GROUP BY country)""",
        RANKW,
    ),
    "monotonicity_drops": q("SELECT win, focal, before FROM (SELECT win, focal, lag(focal) OVER (ORDER BY win) AS before FROM (SELECT win, count(*) FILTER (has_focal) AS focal FROM fact GROUP BY win)) WHERE focal < before"),
    "top_venues_focal": q("SELECT venue, area, level, focal FROM (SELECT venue, area, level, count(*) FILTER (has_focal) AS focal FROM fact GROUP BY ALL) ORDER BY focal DESC, venue, area, level LIMIT 100"),
    "top_venues_focal_by_window": q("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY focal DESC, venue, area, level) AS rank FROM (SELECT win, venue, area, level, count(*) FILTER (has_focal) AS focal FROM fact GROUP BY ALL) WHERE focal > 0) WHERE rank <= 30"),
    "complete_vs_fractional_window": frac("win"),
    "complete_vs_fractional_area_window": frac("win, area"),
    "alternative_denominators": q(
        f"SELECT wn.win, g.grp, coalesce(d.papers, 0) AS papers, coalesce(n.focal, 0) AS focal, {div('coalesce(n.focal, 0)', 'coalesce(d.papers, 0)')} AS share FROM (SELECT DISTINCT win FROM pm) wn CROSS JOIN (SELECT DISTINCT grp FROM grp) g LEFT JOIN (SELECT win, grp, count(DISTINCT paper_id) AS papers FROM pcm JOIN grp USING (country) GROUP BY ALL) d ON d.win = wn.win AND d.grp = g.grp LEFT JOIN (SELECT win, count(*) AS focal FROM pcm WHERE is_focal GROUP BY win) n ON n.win = wn.win",
        "grp AS (SELECT n_name AS country, 'world' AS grp FROM nation UNION ALL SELECT n_name, 'bloc' FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n_name, 'extended' FROM nation WHERE n_regionkey IN (2, 3) UNION ALL SELECT n_name, 'comparable' FROM nation WHERE n_nationkey % 2 = 1)",
    ),
    "coverage_threshold_sensitivity": q(
        f"""SELECT *, rank() OVER (PARTITION BY threshold, win ORDER BY share DESC) AS rank FROM (SELECT d.threshold, d.win, b.country, d.bloc, coalesce(n.papers, 0) AS papers, {div('coalesce(n.papers, 0)', 'd.bloc')} AS share
FROM (SELECT threshold, fact.win, count(*) FILTER (has_bloc) AS bloc FROM fact JOIN ok ON ok.venue = fact.venue AND ok.win = fact.win GROUP BY ALL) d CROSS JOIN bloc b
LEFT JOIN (SELECT threshold, pcm.win, country, count(*) AS papers FROM pcm JOIN ok ON ok.venue = pcm.venue AND ok.win = pcm.win WHERE is_bloc GROUP BY ALL) n ON n.threshold = d.threshold AND n.win = d.win AND n.country = b.country)""",
        f"th(threshold) AS (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.8), (0.9)), ok AS (SELECT venue, win, threshold FROM (SELECT venue, win, {div('count(*) FILTER (resolved)', 'count(*)')} AS c FROM fact GROUP BY ALL) JOIN th ON c >= threshold)",
    ),
    "asof_historical_level": q("SELECT paper_id, year, venue, level, hist_level, CAST(hist_year AS BIGINT) AS hist_year, fallback FROM dated", ASOF),
    "historical_scenarios": q(f"SELECT *, {div('focal', 'bloc')} AS share FROM (SELECT scenario, win, count(*) AS papers, count(*) FILTER (has_bloc) AS bloc, count(*) FILTER (has_focal) AS focal FROM fact JOIN tags USING (paper_id) GROUP BY ALL)", f"{ASOF}, {TAGS}"),
    "area_reclassification": q(f"SELECT scenario, win, area, bloc, focal, {div('focal', 'bloc')} AS share FROM rec", RECLASS),
    "area_reclassification_pivot": q(
        """SELECT area, base, merge, split, greatest(base, merge, split) - least(base, merge, split) AS spread FROM (SELECT area, max(s) FILTER (scenario = 'base') AS base, max(s) FILTER (scenario = 'merge') AS merge, max(s) FILTER (scenario = 'split') AS split
FROM (SELECT *, CAST(focal AS DOUBLE) / nullif(bloc, 0) AS s FROM rec WHERE win = (SELECT max(win) FROM rec)) GROUP BY area)""",
        RECLASS,
    ),
    "shift_share_segments": q("SELECT * FROM seg", SEG),
    "shift_share_contributions": q("SELECT area, level, round(w0, 9) AS w0, round(q0, 9) AS q0, round(w1, 9) AS w1, round(q1, 9) AS q1, round((w1 - w0) * q0, 9) AS composition, round(w0 * (q1 - q0), 9) AS performance, round((w1 - w0) * (q1 - q0), 9) AS interaction FROM parts", f"{SEG}, {PARTS}"),
    "shift_share_summary": q("SELECT round(sum(w0 * q0), 9) AS share0, round(sum(w1 * q1), 9) AS share1, round(sum((w1 - w0) * q0), 9) AS composition, round(sum(w0 * (q1 - q0)), 9) AS performance, round(sum((w1 - w0) * (q1 - q0)), 9) AS interaction, count(*) AS segments FROM parts", f"{SEG}, {PARTS}"),
    "collaboration_profile": q(f"SELECT *, {div('alone', 'papers')} AS share_alone FROM (SELECT win, area, count(*) AS papers, count(*) FILTER (n_countries = 1) AS alone, avg(n_countries) AS mean_countries, median(n_countries) AS median_countries FROM fact WHERE has_focal GROUP BY ALL)"),
    "partner_countries": q("SELECT win, country AS partner, count(*) AS papers FROM pcm WHERE NOT is_focal AND paper_id IN (SELECT paper_id FROM pc WHERE is_focal) GROUP BY ALL"),
    "institution_ranking": q("SELECT institution, papers, row_number() OVER (ORDER BY papers DESC, institution) AS place FROM (SELECT institution, count(*) AS papers FROM inst GROUP BY institution)", INST),
    "institution_concentration": q(
        f"SELECT *, {div('top5', 'links')} AS share_top5, {div('top10', 'links')} AS share_top10 FROM (SELECT win, count(*) AS institutions, CAST(sum(papers) AS BIGINT) AS links, CAST(sum(papers) FILTER (k <= 5) AS BIGINT) AS top5, CAST(sum(papers) FILTER (k <= 10) AS BIGINT) AS top10, round(sum((papers / t) * (papers / t)), 9) AS hhi FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY papers DESC, institution) AS k, CAST(sum(papers) OVER (PARTITION BY win) AS DOUBLE) AS t FROM (SELECT win, institution, count(*) AS papers FROM inst JOIN pm USING (paper_id) GROUP BY ALL)) GROUP BY win)",
        INST,
    ),
    "impact_percentile": q("SELECT paper_id, venue, year, round(z, 6) AS z, percentile FROM imp", IMPACT),
    "impact_by_country_window": q("SELECT country, imp.win, count(*) AS papers, round(avg(price), 4) AS mean_value, round(median(price), 4) AS median_value, round(avg(z), 6) AS mean_z, round(avg(CASE WHEN percentile >= 0.9 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top10, round(avg(CASE WHEN percentile >= 0.99 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1 FROM pc JOIN imp USING (paper_id) WHERE is_bloc GROUP BY ALL", IMPACT),
    "maturity_scenarios": q(
        f"SELECT *, rank() OVER (PARTITION BY scenario ORDER BY share DESC) AS rank FROM (SELECT d.scenario, b.country, d.bloc, coalesce(n.papers, 0) AS papers, {div('coalesce(n.papers, 0)', 'd.bloc')} AS share FROM (SELECT scenario, count(*) FILTER (has_bloc) AS bloc FROM fact JOIN ms ON year BETWEEN lo AND hi GROUP BY scenario) d CROSS JOIN bloc b LEFT JOIN (SELECT scenario, country, count(*) AS papers FROM pcm JOIN ms ON year BETWEEN lo AND hi WHERE is_bloc GROUP BY ALL) n ON n.scenario = d.scenario AND n.country = b.country)",
        "ms(scenario, lo, hi) AS (VALUES ('full', 1999, 2001), ('without_last', 1999, 2000), ('last', 2001, 2001))",
    ),
    "rank_bounds": q(
        f"""SELECT *, rank() OVER (PARTITION BY scenario, win ORDER BY share DESC) AS rank FROM (SELECT scenario, win, country, value, base, {div('value', 'base')} AS share FROM (SELECT s.scenario, d.win, b.country,
coalesce(n.papers, 0) + CASE WHEN s.scenario = 'optimistic' AND b.country = 'NATION_3' THEN d.unresolved ELSE 0 END AS value, d.bloc + CASE WHEN s.scenario = 'observed' THEN 0 ELSE d.unresolved END AS base
FROM (SELECT win, count(*) FILTER (has_bloc) AS bloc, count(*) FILTER (NOT resolved) AS unresolved FROM fact GROUP BY win) d CROSS JOIN bloc b CROSS JOIN (VALUES ('observed'), ('optimistic'), ('pessimistic')) s(scenario)
LEFT JOIN (SELECT win, country, count(*) AS papers FROM pcm WHERE is_bloc GROUP BY ALL) n ON n.win = d.win AND n.country = b.country))"""
    ),
    "overlap_inflation": q(f"SELECT *, {div('intra', 'articles')} AS share_intra, {div('sum_counts', 'articles')} AS factor FROM (SELECT win, count(*) AS articles, CAST(sum(n_bloc) AS BIGINT) AS sum_counts, avg(n_bloc) AS mean_multiplicity, median(n_bloc) AS median_multiplicity, count(*) FILTER (n_bloc > 1) AS intra FROM fact WHERE has_bloc GROUP BY win)"),
    "multiplicity_distribution": q("SELECT win, n_bloc AS multiplicity, count(*) AS articles, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY win) AS share FROM fact WHERE has_bloc GROUP BY win, n_bloc"),
    "missingness_by_cell": q(f"SELECT *, total - resolved AS unresolved, {div('resolved', 'total')} AS coverage FROM (SELECT win, area, level, length(CAST(price AS BIGINT)::VARCHAR) > 5 AS has_doi, count(*) AS total, count(*) FILTER (resolved) AS resolved FROM fact GROUP BY ALL)"),
    "missingness_by_venue": cover("venue"),
    "bootstrap_observed": q(f"SELECT *, {div('focal', 'bloc')} AS share FROM (SELECT win, count(DISTINCT (venue, year)) AS clusters, count(*) AS articles, count(*) FILTER (has_focal) AS focal, count(*) FILTER (has_bloc) AS bloc FROM fact WHERE resolved GROUP BY win)"),
    "bootstrap_ci": q(
        f"""SELECT win, any_value(clusters) AS clusters, round(max(CASE WHEN r < 0 THEN v END), 9) AS share, round(quantile_cont(v, 0.025) FILTER (r >= 0), 9) AS low, round(quantile_cont(v, 0.975) FILTER (r >= 0), 9) AS high, round(stddev_samp(v) FILTER (r >= 0), 9) AS sd
FROM (SELECT win, r, count(*) AS clusters, {div('sum(focal * t)', 'sum(bloc * t)')} AS v FROM rep GROUP BY win, r) GROUP BY win""",
        f"""cl AS (SELECT win, venue, year, count(*) FILTER (has_focal) AS focal, count(*) FILTER (has_bloc) AS bloc FROM fact WHERE resolved GROUP BY ALL),
cut(c) AS (VALUES {', '.join(f'({c})' for c in poisson_cuts())}),
u AS MATERIALIZED (SELECT *, ('0x' || substr(md5('12345|' || coalesce(win, '') || '|' || venue || '|' || year || '|' || r), 1, 8))::BIGINT AS x FROM cl, range(-1, 500) t(r)),
rep AS (SELECT *, CASE WHEN r < 0 THEN 1 ELSE (SELECT count(*) FROM cut WHERE x >= c) END AS t FROM u)""",
    ),
    "missingness_logit": q(
        "SELECT term, sum(x)::BIGINT AS papers, round(sum(x * r), 3) AS resolved, round(sum(x * r), 3) AS fitted FROM t GROUP BY term",
        """f AS (SELECT win, area, level, resolved::INT::DOUBLE AS r, (length(CAST(price AS BIGINT)::VARCHAR) > 5)::INT::DOUBLE AS has_doi FROM fact WHERE win IS NOT NULL AND area IS NOT NULL),
t AS (SELECT 'intercept' AS term, 1.0::DOUBLE AS x, r FROM f UNION ALL SELECT 'has_doi', has_doi, r FROM f UNION ALL SELECT 'win_' || win, 1, r FROM f WHERE win > (SELECT min(win) FROM f)
  UNION ALL SELECT 'area_' || area, 1, r FROM f WHERE area > (SELECT min(area) FROM f) UNION ALL SELECT 'level_' || level, 1, r FROM f WHERE level > (SELECT min(level) FROM f))""",
    ),
    "corpus_expansion_detail": q("SELECT * FROM exs", EXP),
    "corpus_expansion_summary": q(f"SELECT status, count(*) AS venues, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("bloc0", "bloc1", "focal0", "focal1")) + f", {div('sum(focal0)', 'sum(bloc0)')} AS share0, {div('sum(focal1)', 'sum(bloc1)')} AS share1, (SELECT {div('sum(focal0)', 'sum(bloc0)')} FROM exs) AS overall0, (SELECT {div('sum(focal1)', 'sum(bloc1)')} FROM exs) AS overall1 FROM exs GROUP BY status", EXP),
}


def lead(keys: str) -> str:
    return q(
        f"SELECT {keys}, count(*) AS papers, count(*) FILTER (f) AS led_first, count(*) FILTER (l) AS led_last, count(*) FILTER (f OR l) AS led_either, count(*) FILTER (o) AS alone, round(avg(n), 6) AS mean_authors, {div('count(*) FILTER (f)', 'count(*)')} AS share_first FROM (SELECT paper_id, bool_or(is_focal) AS has, bool_or(is_focal AND k = 1) AS f, bool_or(is_focal AND k = n) AS l, bool_and(is_focal) AS o, max(n) AS n FROM au GROUP BY paper_id) JOIN pm USING (paper_id) WHERE has GROUP BY {keys}",
        "au AS (SELECT *, max(k) OVER (PARTITION BY paper_id) AS n FROM (SELECT DISTINCT paper_id, l_linenumber AS k, country, is_focal FROM li))",
    )


SQL |= {
    "leadership_by_window": lead("win"),
    "leadership_area_window": lead("win, area"),
    "validity_intervals": q("SELECT venue, CAST(core_year AS BIGINT) AS core_year, level, CAST(year_start AS BIGINT) AS year_start, CAST(year_end AS BIGINT) AS year_end FROM hist JOIN iv USING (core_year) WHERE year_start <= year_end", INTERVALS),
    "required_years": q("SELECT venue, required_years, CAST(first_required AS BIGINT) AS first_required, CAST(last_required AS BIGINT) AS last_required FROM req", REQ),
    "ranking_duplicates_resolved": q("SELECT venue, CAST(core_year AS BIGINT) AS core_year, CASE WHEN bool_or(level = 'A*') THEN 'A*' ELSE min(level) END AS level, arg_min(conference_name, source_file) AS conference_name, string_agg(DISTINCT source_file, '|' ORDER BY source_file) AS source_files, count(*) AS n_raw_rows, count(DISTINCT level) > 1 AS had_conflict, string_agg(DISTINCT level, '|' ORDER BY level) AS level_raw_values FROM raw GROUP BY venue, core_year"),
    "undifferentiated_year_inference": q(
        "SELECT venue, b AS level_before, a AS level_after, CASE WHEN b = '-' AND a = '-' THEN '-' WHEN b <> '-' AND a <> '-' AND (b = 'A*' OR a = 'A*') THEN 'A*' ELSE 'A' END AS level_inferred FROM (SELECT venue, bool_or(core_year = 1998) AS listed, CASE WHEN bool_or(core_year = 1996 AND level = 'A*') THEN 'A*' WHEN bool_or(core_year = 1996 AND level = 'A') THEN 'A' ELSE '-' END AS b, CASE WHEN bool_or(core_year = 2000 AND level = 'A*') THEN 'A*' WHEN bool_or(core_year = 2000 AND level = 'A') THEN 'A' ELSE '-' END AS a FROM raw GROUP BY venue) WHERE listed"
    ),
    "ranking_counts_pivot": q("SELECT CAST(core_year AS BIGINT) AS core_year, count(*) FILTER (level = 'A*') AS top, count(*) FILTER (level = 'A') AS a FROM hist GROUP BY core_year"),
    "historical_gap": q("SELECT venue, CAST(first_year AS BIGINT) AS first_year, CAST(last_year AS BIGINT) AS last_year, years_present, years_list, levels_list, top_years, a_years FROM roll WHERE venue NOT IN (SELECT venue FROM pm WHERE year = 1995 AND venue NOT LIKE '%4')", ROLL),
    "venue_priority": q("SELECT venue, area, years_present, top_years, required_years, relevance, priority_score, priority_level FROM pr", PRIO),
    "venue_tiers": q("SELECT venue, area, priority_score, priority_level, tier FROM tier", TIERS),
    "tier_summary": q("SELECT tier, count(*) AS venues, round(avg(priority_score), 6) AS mean_score, min(priority_score) AS min_score, max(priority_score) AS max_score FROM tier GROUP BY tier", TIERS),
    "priority_overrides": q("SELECT venue, CASE WHEN nk = 3 THEN 'LOW' ELSE priority_level END AS priority_level FROM pr", PRIO),
    "evidence_consolidated": q("SELECT paper_id, country, sources, methods, n_sources, CAST(best_priority AS BIGINT) AS best_priority FROM cons", CONS),
    "evidence_source_counts": q("SELECT source, count(*) AS rows, count(DISTINCT paper_id) AS papers FROM ev2 GROUP BY source", "ev2 AS (SELECT DISTINCT paper_id, country, l_returnflag AS source FROM li)"),
    "cascade_unresolved": q(
        "SELECT 0::BIGINT AS stage, count(*) AS papers FROM pm UNION ALL SELECT 1, count(*) FROM pm WHERE paper_id NOT IN (SELECT paper_id FROM li WHERE l_returnflag = 'A') UNION ALL SELECT 2, count(*) FROM pm WHERE paper_id NOT IN (SELECT paper_id FROM li WHERE l_returnflag IN ('A', 'N')) UNION ALL SELECT 3, count(*) FROM pm WHERE paper_id NOT IN (SELECT paper_id FROM li)"
    ),
    "dedupe_best_confidence": q("SELECT paper_id, country, source, method, confidence, CAST(seq AS BIGINT) AS seq FROM (SELECT paper_id, country, l_returnflag AS source, l_linestatus AS method, l_discount AS confidence, l_linenumber AS seq, row_number() OVER (PARTITION BY paper_id, country ORDER BY l_discount DESC, l_linenumber, l_returnflag, l_linestatus) AS k FROM li) WHERE k = 1"),
    "title_exact_match": f"WITH {TITLE} SELECT paper_id, work_id FROM p JOIN (SELECT lang, title, min(work_id) AS work_id FROM w GROUP BY ALL) USING (lang, title) WHERE title <> '' AND paper_id <> work_id",
    "title_fuzzy_match": f"""WITH {TITLE}, ps AS (SELECT DISTINCT lang, title, list_distinct(string_split(title, ' ')) AS t FROM p WHERE title <> ''), ws AS (SELECT lang, title AS wt, min(work_id) AS work_id, list_distinct(string_split(title, ' ')) AS u FROM w WHERE title <> '' GROUP BY lang, title),
s AS (SELECT ps.lang, title, work_id, CAST(len(list_intersect(t, u)) AS DOUBLE) / greatest(len(t), len(u)) AS score FROM ps JOIN ws ON ps.lang = ws.lang AND title <> wt AND least(len(t), len(u)) >= 0.86 * greatest(len(t), len(u)))
SELECT paper_id, work_id, score FROM p JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, title ORDER BY score DESC, work_id) AS k FROM s WHERE score >= 0.86) WHERE k = 1) USING (lang, title)""",
    "secondary_text_flags": """SELECT doc_id, array_to_string(list_filter(['the', 'license', 'www'], lambda x: contains(lower(coalesce(text, '')), x)), ';') AS tokens, regexp_matches(lower(coalesce(text, '')), 'license|copyright') AS secondary, length(coalesce(text, '')) > 3 AS has_text FROM documents""",
    "profile_interval_lookup": q(
        """SELECT paper_id, author, country, CAST(kind AS BIGINT) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, author ORDER BY kind, start DESC, country) AS k
FROM (SELECT pa.paper_id, CAST(pa.author AS BIGINT) AS author, h.country, h.start, CASE WHEN year BETWEEN h.start AND coalesce(h."end", 9999) THEN 0 WHEN h.start <= year THEN 1 ELSE 2 END AS kind FROM (SELECT paper_id, year, nk AS author FROM pm) pa JOIN ph h USING (author) WHERE h.country IS NOT NULL)) WHERE k = 1""",
        """ph AS (SELECT nk AS author, s AS start, CASE WHEN s < 2000 THEN s + nk % 3 END AS "end", CASE WHEN (nk + s) % 7 <> 0 THEN 'C' || ((nk + s) % 4) END AS country FROM (SELECT DISTINCT nk FROM ven), (VALUES (1996), (1998), (2000)) t(s) WHERE (nk + s) % 5 <> 1)""",
    ),
    "doi_normalise": f"""WITH {DOIS}, d AS (SELECT *, trim(regexp_replace(regexp_replace(trim(raw), '^(https?://)?(dx\\.)?doi\\.org/|^doi:\\s*', '', 'i'), '^\\.+|\\.+$', '', 'g')) AS x FROM dois) SELECT p_partkey, raw, nullif(lower(x), '') AS doi, nullif(x, '') AS doi_case, coalesce(length(nullif(lower(x), '')) > 3, false) AS has_doi FROM d""",
    "url_host_filter": r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '(^|\.)example\.(com|org)$') AS allowed, split_part(url, '/', -1) AS short_id FROM pages""",
    "html_links": r"""SELECT page_id, link, count(*) AS times, CASE WHEN regexp_matches(link, '^[a-zA-Z]+://') THEN link WHEN link LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || link ELSE NULL END AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""",
    "entity_repair": "SELECT page_id, md5(replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS repaired, length(html) AS n FROM pages",
    "venue_audit": q(f"SELECT *, {div('high', 'papers')} AS high_share, concat_ws(';', CASE WHEN papers < 100 THEN 'SMALL' END, CASE WHEN years < 7 THEN 'GAPS' END, CASE WHEN high = 0 THEN 'NO_HIGH' END) AS flags FROM (SELECT venue, count(*) AS papers, min(year) AS min_year, max(year) AS max_year, count(DISTINCT year) AS years, count(DISTINCT paper_id) AS ids, count(*) FILTER (price > 250000) AS high FROM pm GROUP BY venue)"),
    "booktitle_audit": "SELECT p_brand, p_type, count(*) AS rows FROM part GROUP BY ALL",
    "level_stats": q("SELECT level, count(*) AS venues, CAST(sum(papers) AS BIGINT) AS sum, min(papers) AS min, median(papers) AS median, max(papers) AS max FROM (SELECT venue, level, count(*) AS papers FROM pm GROUP BY ALL) GROUP BY level"),
    "duplicate_keys": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem) WHERE copies > 1",
    "metric_summary": q("SELECT * FROM (VALUES ('papers', (SELECT count(*) FROM fact)), ('resolved', (SELECT count(*) FROM fact WHERE resolved)), ('bloc', (SELECT count(*) FROM fact WHERE has_bloc)), ('focal', (SELECT count(*) FROM fact WHERE has_focal)), ('venues', (SELECT count(DISTINCT venue) FROM fact))) t(metric, value)"),
    "constraint_violations": """SELECT 'orders_pk' AS check_name, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'lineitem_pk', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'lines_without_order', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'year_range', count(*) FROM orders WHERE year(o_orderdate) NOT BETWEEN 1995 AND 2000 UNION ALL SELECT 'name_overlap', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'region_mismatch', count(*) FROM nation WHERE n_regionkey <> n_nationkey % 5""",
    "surrogate_keys": "SELECT o_orderkey, 'P' || lpad((row_number() OVER (ORDER BY o_orderdate, o_orderkey))::VARCHAR, 7, '0') AS key FROM orders",
    "status_counts": "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS rows FROM orders GROUP BY ALL",
    "subarea_names": q("SELECT area, count(*) AS venues, string_agg(venue, ', ' ORDER BY venue) AS names FROM ven GROUP BY area"),
    "stable_intersection": q("SELECT DISTINCT venue FROM hist WHERE core_year = 1996 INTERSECT SELECT DISTINCT venue FROM hist WHERE core_year = 2000"),
}

SQL |= {
    "conclusion_checks": q(
        f"""SELECT name, value, value = 0 AS holds FROM (SELECT 'bloc_within_resolved' AS name, count(*) FILTER (bloc > resolved) AS value FROM m UNION ALL SELECT 'resolved_within_total', count(*) FILTER (resolved > total) FROM m
UNION ALL SELECT 'small_denominators', count(*) FROM (SELECT win, area, count(*) FILTER (has_bloc) AS b FROM fact GROUP BY ALL) WHERE b < 30 UNION ALL SELECT 'focal_drops', count(*) FROM (SELECT focal, lag(focal) OVER (ORDER BY win) AS l FROM m) WHERE focal < l)""",
        f"m AS (SELECT win, {SUMS} FROM fact GROUP BY win)",
    ),
    "main_track_filter": """SELECT p_partkey, p_brand AS venue, p_type AS booktitle FROM part WHERE NOT contains(lower(p_type), 'tin') AND NOT contains(lower(p_type), 'workshop')
AND (length(p_type) % 2 = 0 OR (p_brand LIKE '%1' AND EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand AND contains(lower(trim(part.p_type)), lower(substr(q.p_type, 1, 3))))))""",
    "near_year_title_match": f"""WITH {TITLE}, y AS (SELECT doc_id, 2000 + coalesce(n_chars, 0) % 3 AS y FROM documents)
SELECT paper_id, min(work_id) AS work_id FROM p JOIN y a ON a.doc_id = paper_id JOIN (SELECT lang, title, y, min(work_id) AS work_id FROM w JOIN y ON doc_id = work_id GROUP BY ALL) b USING (lang, title)
WHERE title <> '' AND abs(a.y - b.y) <= 1 AND paper_id <> work_id GROUP BY paper_id""",
    "source_fallback": q("SELECT paper_id, country, CAST(priority AS BIGINT) AS priority FROM (SELECT DISTINCT paper_id, country, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS priority FROM li) QUALIFY priority = min(priority) OVER (PARTITION BY paper_id)"),
    "positional_zip": 'SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, CAST(l_linenumber AS BIGINT) AS "left", l_partkey AS "right" FROM lineitem',
    "key_prefix_filter": """WITH k AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS key FROM pages), x AS (SELECT *, array_to_string(string_split(key, '/')[1:2], '/') AS prefix FROM k)
SELECT page_id, key, prefix FROM x WHERE prefix IN (SELECT prefix FROM x JOIN pages USING (page_id) WHERE url LIKE 'https:%')""",
    "country_flags": """WITH r AS (SELECT n_name AS country, n_regionkey = 3 AS is_bloc, n_name = 'NATION_3' AS is_focal, upper(trim(translate(' ' || lower(substr(n_name, 8, 1)) || 's ', '0123456789', 'aeudnkgbfi'))) AS c FROM nation),
f AS (SELECT *, CASE WHEN c = 'UK' THEN 'GB' WHEN c = 'EL' THEN 'GR' ELSE c END AS d FROM r)
SELECT country, CASE WHEN regexp_full_match(d, '[A-Z][A-Z]') THEN d END AS code, CASE WHEN regexp_full_match(d, '[A-Z][A-Z]') THEN d IN ('ES', 'DS') END AS in_set, is_bloc, is_focal FROM f""",
    "unicode_title_groups": r"""SELECT lang, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')[1:2], ' ') AS title, count(*) AS documents FROM documents GROUP BY ALL""",
    "preflight_gates": """WITH v AS (
SELECT 1 AS i, 'orders: year out of range' AS "check", 'error' AS severity, (SELECT count(*) FROM orders WHERE year(o_orderdate) NOT BETWEEN 1995 AND 2000) AS violations
UNION ALL SELECT 2, 'orders: no customer', 'error', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
UNION ALL SELECT 3, 'orders: price above 250000', 'warning', (SELECT count(*) FROM orders WHERE o_totalprice > 250000)
UNION ALL SELECT 4, 'orders: repeated keys', 'error', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 5, 'orders: unknown keys', 'warning', (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 6, 'lines: no quantity', 'error', (SELECT count(*) FROM lineitem WHERE l_quantity <= 0)
UNION ALL SELECT 7, 'lines: returned', 'warning', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 8, 'lines: unknown keys', 'error', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))
SELECT "check", severity, violations, CASE WHEN violations = 0 THEN 'ok' ELSE severity END AS status FROM v""",
    "preflight_summary": q("SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM fact)), ('papers', (SELECT count(DISTINCT paper_id) FROM fact)), ('without_window', (SELECT count(*) FROM fact WHERE win IS NULL)), ('without_venue', (SELECT count(*) FROM fact WHERE venue IS NULL)), ('unresolved', (SELECT count(*) FROM fact WHERE NOT resolved))) t(metric, value)"),
}
