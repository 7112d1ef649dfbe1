"""Queries of readers, services and text functions. Their inputs are the driver's tables in the form that a reader expects:
rows rendered as lists, dumps, JSON or HTML (where the reader takes files, written to the shared folder and read back)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import consolidate, gazetteer, indicators, matching
from ..schema import alias_columns, cardinality_differences, require_columns
from ..sources import api, cache, files, sinks
from ..sources.driver import Corpus
from ..sources.stages import Runner, Skip, Stage, scratch
from .catalogue import fact, query

SQL: dict[str, str] = {}


def sql(text_: str):
    """The query's rows in DuckDB SQL."""

    def note(f):
        SQL[f.__name__] = text_
        return query(f)

    return note


def pick(number, *values):
    """One of the values, by the number's remainder."""
    return F.get(F.array(*[v if hasattr(v, "cast") else F.lit(v) for v in values]), (number % len(values)).cast("int"))


def cat(*parts):
    return F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])


def written_text(df: DataFrame, c: Corpus, **options) -> str:
    path = scratch(c.spark)
    df.write.options(**options).text(path)
    return path


def key():
    return F.col("p_partkey")


def supp():
    return F.col("s_suppkey")


PLACES = ("Spain", "Germany", "India", "France", "Italy")
PLACE_SQL = "['Spain', 'Germany', 'India', 'France', 'Italy'][s_nationkey % 5 + 1]"
CODE_SQL = "['ES', 'DE', 'IN', 'FR', 'IT'][s_nationkey % 5 + 1]"


@sql("SELECT CAST(p_partkey AS BIGINT) AS id, p_name || ', conf' AS title, upper(p_type) || p_partkey AS acronym, 'A*' AS rank FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 5 <> 0")
def ranking_scan(c):
    """A headerless ranking list with bad lines and rows without acronym."""
    good = cat(key(), ',"', F.col("p_name"), ', conf",', F.when(key() % 5 == 0, "").otherwise(cat(" ", F.upper("p_type"), key(), " ")), ",CORE,A*,Yes,46,,")
    lines = c.table("part").select(F.when(key() % 13 == 0, cat(key(), ",too,many,cells,are,in,this,line,x,y,z")).otherwise(good).alias("value"))
    return files.read_ranking(c.spark, written_text(lines, c)).select("id", "title", "acronym", "rank")


@sql("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey >= 8 THEN 'Añejo ' ELSE 'Anejo ' END || s_name || repeat(' x', 400) AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def csv_sniffed(c):
    """Encoding, separator and header told from the file; its first accent comes late."""
    path = scratch(c.spark)
    rows = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(supp().alias("id"), cat(F.when(supp() >= 8, "Añejo ").otherwise("Anejo "), F.col("s_name"), F.repeat(F.lit(" x"), F.lit(400))).alias("name"), F.col("n_name").alias("nation"))
    rows.sort("id").write.options(header="true", sep=";", encoding="ISO-8859-1").csv(path)
    return files.read_csv_flex(c.spark, path).select(F.col("id").cast("long").alias("id"), "name", "nation")


@sql("SELECT 'list' AS name, avg((p_partkey IS NOT NULL AND length(p_type) BETWEEN 1 AND 40)::INT) > 0.8 AS headerless FROM part UNION ALL SELECT 'names', false")
def headerless_detection(c):
    lists = c.table("part").select(key().cast("string").alias("a"), "p_name", "p_type", cat("CORE", F.col("p_size") + 2000).alias("d"))
    names = c.table("part").select("p_name", "p_brand", "p_type", "p_brand")
    return c.spark.createDataFrame([("list", files.looks_headerless(lists)), ("names", files.looks_headerless(names.toDF("a", "b", "c", "d")))], "name string, headerless boolean")


@sql("SELECT * FROM (VALUES ('short', 'code'), ('named', 'Venue')) t(name, guess)")
def acronym_column_guess(c):
    p = c.table("part")
    short = p.select(cat(F.col("p_name"), " and more words").alias("title"), cat(F.upper(F.substring("p_type", 1, 4)), key()).alias("code"), F.lower("p_brand").alias("brand"))
    return c.spark.createDataFrame([("short", files.guess_venue_column(short)), ("named", files.guess_venue_column(short.withColumnRenamed("brand", "Venue")))], "name string, guess string")


@sql("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'article' ELSE 'inproceedings' END AS tag, o_orderkey % 13 = 0 AS bad FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'k/' || k AS dblp_key, tag, 'Müller ' || c || '; B & C' AS authors, 'On order' || chr(95) || k || ' & more' AS title,
CAST(CASE WHEN k % 5 <> 0 THEN year(d) END AS BIGINT) AS year, CASE WHEN k % 3 = 0 THEN 'J' ELSE 'Conf' END AS booktitle, '10.1/x' || k AS doi,
CASE WHEN k % 2 = 0 THEN '2001.' || k END AS arxiv_id, 1 + CAST(k % 2 = 0 AS BIGINT) AS n_links, bad FROM o WHERE NOT bad
UNION ALL SELECT NULL, tag, NULL, NULL, NULL, NULL, NULL, NULL, NULL, bad FROM o WHERE bad""")
def dump_records(c):
    """A compressed bibliographic dump with entities, markup in titles, records over several lines, attributes in any order, quotes and
    lines, bad years, other records, and records that are not well formed."""
    k = F.col("o_orderkey")
    tag = F.when(k % 7 == 0, "book").when(k % 3 == 0, "article").otherwise("inproceedings")
    arxiv = F.when(k % 2 == 0, cat("<ee>https://arxiv.org/abs/2001.", k, "v3</ee>")).otherwise("")
    place = F.when(k % 3 == 0, "<journal>J</journal>").otherwise("<booktitle>Conf</booktitle>")
    year = F.when(k % 5 == 0, "bad").otherwise(F.year("o_orderdate").cast("string"))
    attributes = pick(k, cat(' mdate="2020-01-02" key="k/', k, '"'), cat(" key='k/", k, "' mdate='>'"), cat('\nkey="k/', k, '"\n'), cat("\tmdate='x' key = \"k/", k, '" '))
    broken = F.when(k % 13 == 0, "<year>").otherwise("")
    xml = cat("<", tag, attributes, "><author>M&uuml;ller ", F.col("o_custkey"), "</author>\n<author></author><author>B &amp; C</author>\n<title>On <i>order</i>_", k, " &amp; more</title>\n", broken, "<year>", year, "</year>", place, "<ee>https://doi.org/10.1/X", k, "</ee>", arxiv, "</", tag, ">")
    out = files.read_dump(c.spark, written_text(c.table("orders").select(xml.alias("value")), c, compression="gzip"))
    return out.select("dblp_key", "tag", "authors", "title", "year", "booktitle", "doi", "arxiv_id", F.size("links").alias("n_links"), "bad")


def _answers(keys: list[str]) -> dict[str, str]:
    return {k: f'{{"id": "{k}"}}' for k in keys if int(k.rpartition("x")[2]) % 3}


def _fragile(keys: list[str]) -> dict[str, str]:
    """Whole batches fail if one of their keys is odd enough."""
    if len(keys) > 1 and any(int(k.rpartition("x")[2]) % 10 == 0 for k in keys):
        raise ValueError("bad batch")
    return _answers(keys)


FETCHED = "WITH k AS (SELECT DISTINCT p_partkey % 500 AS n FROM part) SELECT '10.1000/x' || n AS key, CASE WHEN n % 3 <> 0 THEN '{\"id\": \"10.1000/x' || n || '\"}' END AS body, CASE WHEN n % 3 <> 0 THEN 'found' ELSE 'absent' END AS status FROM k"


@sql(FETCHED)
def batched_fetch(c):
    """A service asked in batches; keys without an answer stay as negative ones."""
    return api.fetch(c.table("part").select(cat("10.1000/x", key() % 500).alias("doi")), "doi", _answers, batch=7)


@sql(FETCHED)
def profile_fetch(c):
    """Batches that fail are asked for again key by key."""
    return api.fetch(c.table("part").select(cat("10.1000/x", key() % 500).alias("id")), "id", _fragile, batch=50, retries=1, pause=0.0, one_by_one=True)


def _page(ident: str, year: int, cursor: str | None) -> tuple[list[str], str | None]:
    at = int(cursor or 0)
    return [f'{{"id": "{ident}-{year}-{at}"}}'], str(at + 1) if at < int(ident) % 3 else None


@sql("SELECT n_nationkey || '|' || y AS key, n_nationkey || '-' || y || '-' || i AS id FROM nation, range(1995, 1998) t(y), range(0, 3) u(i) WHERE i <= n_nationkey % 3")
def paged_fetch(c):
    """Pages of a source and year followed by their cursors."""
    years = F.explode(F.sequence(F.lit(1995), F.lit(1997)))
    keys = c.table("nation").select("n_nationkey", years.alias("y")).select(cat(F.col("n_nationkey"), "|", F.col("y")).alias("k"))
    got = api.fetch(keys, "k", api.paged(_page), batch=10)
    return got.select("key", F.explode(F.from_json("body", "array<struct<id: string>>")).alias("w")).select("key", "w.id")


@sql("""WITH w AS (SELECT p_brand, min(p_name) AS want FROM part GROUP BY p_brand), s AS (SELECT p_brand AS venue, p_partkey AS source_id, string_split(want, ' ') AS a, string_split(p_name || ' ' || lower(p_type), ' ') AS b, p_partkey % 3 AS t FROM part JOIN w USING (p_brand)),
r AS (SELECT venue, source_id, len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(a)), len(list_distinct(b))) + [0.0, 0.05, -0.02][t + 1] AS score FROM s)
SELECT venue, source_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY round(score, 9) DESC, source_id) AS n FROM r WHERE score >= 0.35) WHERE n = 1""")
def source_resolution(c):
    """Of many candidate sources the one whose title overlaps most, conferences before journals."""
    p = c.table("part")
    want = p.groupBy("p_brand").agg(F.min("p_name").alias("want"))
    candidates = p.join(want, "p_brand").select(F.col("p_brand").alias("venue"), "want", key().alias("source_id"), cat(F.col("p_name"), " ", F.lower("p_type")).alias("title"), pick(key(), "repository", "conference", "journal").alias("type"))
    return matching.best_source(candidates).select("venue", "source_id", F.round("score", 6).alias("score"))


@sql("SELECT '/vol/' || s_suppkey AS href, (1990 + s_suppkey % 25) || ' volume ' || s_suppkey AS label, CAST(1990 + s_suppkey % 25 AS BIGINT) AS year FROM supplier")
def volume_index_links(c):
    html = cat('<p><a class="v" href="/vol/', supp(), '"><b>', 1990 + supp() % 25, "</b> volume ", supp(), '</a> and <a href="/about">about us</a></p>')
    return files.volume_links(c.table("supplier").select(html.alias("html"))).select("href", "label", "year")


@sql(f"SELECT 'T' || s_suppkey || ' & more' AS title, CASE WHEN s_suppkey % 2 = 0 THEN list_aggregate(list_sort(list_distinct(['GB', {CODE_SQL}])), 'string_agg', ',') ELSE {CODE_SQL} END AS countries, 1 + CAST(s_suppkey % 2 = 0 AS BIGINT) AS n_affiliations FROM supplier")
def volume_xml_papers(c):
    """Volumes as XML with name spaces, attributes and front matter."""
    second = F.when(supp() % 2 == 0, "<v:affiliation>gb</v:affiliation>").otherwise("")
    xml = cat('<v:volume xmlns:v="http://x.org/v"><v:paper><v:title>Front Matter</v:title></v:paper><v:paper id="', supp(), '"><v:title>T', supp(), "  &amp; more</v:title><v:affiliation>Lab, ", pick(F.col("s_nationkey"), *PLACES), "</v:affiliation>", second, "</v:paper></v:volume>")
    out = files.volume_titles(c.table("supplier").select(F.regexp_replace(xml, "  ", " ").alias("xml")))
    return out.select("title", F.array_join("countries", ",").alias("countries"), "n_affiliations")


def affiliated(c: Corpus, *parts) -> DataFrame:
    return c.table("supplier").select(cat(*parts).alias("value"))


@sql(f"SELECT '10.1/s' || s_suppkey AS doi, 'Lab, ' || {PLACE_SQL} AS affiliation, {CODE_SQL} AS country FROM supplier UNION ALL SELECT '10.1/s' || s_suppkey, 'Nowhere', NULL FROM supplier WHERE s_suppkey % 2 = 0")
def crossref_affiliation_rows(c):
    more = F.when(supp() % 2 == 0, ', {"affiliation": [{"name": "Nowhere"}]}').otherwise("")
    return files.crossref_affiliations(affiliated(c, '{"DOI": "10.1/S', supp(), '", "author": [{"affiliation": [{"name": "Lab, ', pick(F.col("s_nationkey"), *PLACES), '"}]}', more, "]}"))


@sql(f"SELECT '10.1/w' || s_suppkey AS doi, 1 + i AS author_order, 'I' || i AS institution, {CODE_SQL} AS country FROM supplier, range(0, 3) t(i) WHERE i <= s_suppkey % 3")
def works_json_countries(c):
    """Nested works: authors, their institutions and countries."""
    author = lambda i: cat('{"author": {"id": "a"}, "institutions": [{"display_name": "I', F.lit(i), '", "country_code": "', F.lower(pick(F.col("s_nationkey"), "ES", "DE", "IN", "FR", "IT")), '"}]}')
    authors = F.array_join(F.slice(F.array(*map(author, range(3))), F.lit(1), (supp() % 3 + 1).cast("int")), ", ")
    out = files.work_countries(affiliated(c, '{"id": "w", "doi": "https://doi.org/10.1/W', supp(), '", "authorships": [', authors, "]}"))
    return out.withColumn("author_order", F.col("author_order").cast("long"))


@sql("""WITH n AS (SELECT p_partkey AS k, p_brand, p_name, p_partkey % 2 = 1 AND p_brand NOT LIKE '%2' AS first FROM part), b AS (SELECT p_brand, bool_or(first) AS has FROM n GROUP BY p_brand)
SELECT 'n' || k AS note_id, p_brand AS venue, CASE WHEN first THEN 'Blind_Submission' ELSE 'Submission' END AS invitation, p_name AS title, k % 3 AS n_authors, CASE k % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS accepted
FROM n JOIN b USING (p_brand) WHERE first = has""")
def notes_accepted(c):
    """Notes of both kinds; of each venue only its first kind of invitation."""
    first = (key() % 2 == 1) & ~F.col("p_brand").endswith("2")
    decision, venueid = pick(key(), "Reject", "Accept (Poster)", "", ""), pick(key(), "", "", "conf/X", "")
    ids = F.array_join(F.slice(F.array(*map(F.lit, ('"~a"', '"~b"'))), F.lit(1), (key() % 3).cast("int")), ", ")
    plain = cat('{"id": "n', key(), '", "domain": "', F.col("p_brand"), '", "invitation": "X/-/Blind_Submission", "content": {"title": "', F.col("p_name"), '", "decision": "', decision, '", "venueid": "', venueid, '", "authorids": [', ids, "]}}")
    wrapped = cat('{"id": "n', key(), '", "domain": "', F.col("p_brand"), '", "invitations": ["X/-/Submission", "X/-/Edit"], "content": {"title": {"value": "', F.col("p_name"), '"}, "decision": {"value": "', decision, '"}, "venueid": {"value": "', venueid, '"}, "authorids": {"value": [', ids, "]}}}")
    out = files.read_notes(c.table("part").select(F.when(first, plain).otherwise(wrapped).alias("value")), order=("Blind_Submission", "Submission"))
    return out.select("note_id", "venue", "invitation", "title", F.size("authors").alias("n_authors"), "accepted")


@sql(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS root, regexp_extract(url, '^([a-zA-Z]+://[^?#]*/)', 1) AS here FROM pages),
l AS (SELECT page_id, h, (CASE WHEN length(here) > length(root) THEN here ELSE root || '/' END) || 'files/' || page_id || '.pdf' AS link FROM u UNION ALL SELECT page_id, h, root || '/pdf/' || page_id FROM u)
SELECT page_id, link FROM l WHERE h = 'example.org' OR ends_with(h, '.example.org') OR h = 'example.net' OR ends_with(h, '.example.net')""")
def pdf_link_discovery(c):
    """PDF links of pages, made absolute, on allowed hosts."""
    k = F.col("page_id")
    html = cat('<a href="files/', k, '.pdf">a</a> <a href="/pdf/', k, '">b</a> <a href="http://other.test/x.pdf">c</a> <a href="/about">d</a> <a href="files/', k, '.pdf">again</a>')
    return c.table("pages").select("page_id", F.explode(text.pdf_links(html, F.col("url"), ("example.org", "example.net"))).alias("link"))


@sql("SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END + 10 * p_partkey AS work_id, CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE round(11.0::DOUBLE / 12, 9) END AS score FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def title_search_hits(c):
    """The first five hits of a search by title: within a year and similar enough."""
    words = "one two three four five six seven eight nine ten eleven"
    papers = c.table("part").select(key().alias("paper_id"), cat(words, " t", key()).alias("title"), (1995 + F.col("p_size") % 5).cast("int").alias("year"))
    year = F.col("year")
    near = cat("another", F.substring("title", 4, 1000))
    hit = lambda place, title, y: F.struct(F.lit(place).alias("place"), (10 * F.col("paper_id") + place).alias("work_id"), title.alias("title"), y.cast("int").alias("year"))
    found = F.array(
        hit(1, F.substring_index("title", " ", -9), year), hit(2, F.col("title"), year + 2), hit(3, near, F.when(F.col("paper_id") % 2 == 0, year + 1).otherwise(year + 3)),
        hit(4, F.col("title"), F.when(F.col("paper_id") % 3 == 0, year).otherwise(year - 5)), hit(5, F.lit("none of it"), year), hit(6, F.col("title"), year),
    )
    hits = papers.select("paper_id", F.inline(found))
    return matching.title_search(papers, hits).select("paper_id", "work_id", F.round("score", 9).alias("score"))


@sql("""WITH n AS (SELECT p_partkey AS k, p_partkey % 70 AS citations, 2 AS seen FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 9 <> 0), o AS (SELECT p_partkey AS k, p_partkey % 50 AS citations, 1 AS seen FROM part WHERE p_partkey % 2 = 0)
SELECT '10.1/m' || k AS doi, citations, CAST(seen AS BIGINT) AS seen FROM n UNION ALL SELECT '10.1/m' || k, citations, seen FROM o WHERE k NOT IN (SELECT k FROM n)""")
def metrics_cache(c):
    """Citation metrics of works as JSON put into a bucketed cache: the latest answer of each DOI counts."""
    p = c.table("part")
    old = p.where(key() % 2 == 0).select(cat("10.1/m", key()).alias("doi"), (key() % 50).cast("long").alias("citations"), F.lit(1).alias("seen"))
    body = cat('{"doi": "https://doi.org/10.1/M', key(), '", "cited_by_count": ', key() % 70, ', "publication_year": 2001, "type": "article", "is_retracted": ', (key() % 9 == 0), "}")
    new = files.citation_metrics(p.where(key() % 3 == 0).select(body.alias("value"))).select("doi", "citations", F.lit(2).alias("seen"))
    path = f"{scratch(c.spark)}/cache"
    for rows in (old, new):
        cache.update_cache(rows, path, "doi", "seen", buckets=16)
    return cache.read_cache(c.spark, path)


@sql("SELECT p_partkey AS k, p_name AS v, CASE WHEN p_brand LIKE '%1' THEN 7 END::BIGINT AS extra FROM part WHERE p_brand NOT LIKE '%2'")
def matching_files(c):
    """Of a file for every brand those that have the needed columns: footers are read by tasks, files of one schema in one scan."""
    base, p = scratch(c.spark), c.table("part")
    kind = F.when(F.col("p_brand").endswith("1"), "a").when(F.col("p_brand").endswith("2"), "b").otherwise("c")
    rows = p.select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("v"), kind.alias("kind"), F.col("p_brand").alias("brand"))
    rows.where("kind = 'a'").select("k", "v", "brand", F.lit(7).cast("long").alias("extra")).write.partitionBy("brand").parquet(f"{base}/a")
    rows.where("kind = 'b'").select("k", "brand").write.partitionBy("brand").parquet(f"{base}/b")
    rows.where("kind = 'c'").select("k", "v", "brand").write.partitionBy("brand").parquet(f"{base}/c")
    found = files.parquet_files(c.spark, base)
    return files.read_matching(c.spark, found, {"k", "v"}).select("k", "v", "extra")


@sql("SELECT * FROM (VALUES ('tables', 'OK'), ('optional_source', 'SKIPPED'), ('after', 'SKIPPED'), ('broken', 'OPTIONAL_FAILED'), ('last', 'OK'), ('tables again', 'CACHED')) t(name, status)")
def stage_run(c):
    """Stages with a manifest: one needs an absent source, one fails and may, and a second run reads what is there."""
    out = scratch(c.spark)

    def absent(frames):
        raise Skip("no such source")

    def broken(frames):
        raise ValueError("no such column")

    first = Stage("tables", lambda f: c.table("region"))
    stages = [first, Stage("optional_source", absent), Stage("after", lambda f: f["optional_source"], ("optional_source",)), Stage("broken", broken, optional=True), Stage("last", lambda f: f["tables"].select("r_name"), ("tables",))]
    again = F.concat("name", F.lit(" again")).alias("name")
    return Runner(c.spark, out, stages).run().select("name", "status").union(Runner(c.spark, out, [first]).run().select(again, "status"))


@sql("SELECT 'base' AS scenario, 1.0::DOUBLE AS weight UNION ALL SELECT r_name, CAST(r_regionkey AS DOUBLE) FROM region")
def default_scenarios(c):
    """A scenario file that is absent takes its default; one that is there is read."""
    default = c.spark.createDataFrame([("base", 1.0)], "scenario string, weight double")
    path = scratch(c.spark)
    c.table("region").select(F.col("r_name").alias("scenario"), F.col("r_regionkey").cast("double").alias("weight")).write.parquet(f"{path}/there")
    return consolidate.union(files.optional(c.spark, f"{path}/absent", default), files.optional(c.spark, f"{path}/there", default))


@sql("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def csv_roundtrip(c):
    """A table to the CSV sink and back."""
    paths = sinks.write_tables({"nation": c.table("nation").select("n_nationkey", "n_name")}, scratch(c.spark), "csv", single=True)
    return c.spark.read.option("header", True).schema("n_nationkey long, n_name string").csv(paths["nation"])


YEARS = "CASE WHEN y <= 1996 THEN '1995-1996' WHEN y <= 1998 THEN '1997-1998' WHEN y <= 2000 THEN '1999-2000' ELSE '2001-2002' END"


@sql(f"SELECT {YEARS} AS win, count(*) AS papers FROM (SELECT year(o_orderdate) AS y FROM orders) WHERE y BETWEEN 1995 AND 2002 GROUP BY ALL")
def strict_windows(c):
    """Windows that raise on a year outside of all."""
    rows = c.papers.where("year BETWEEN 1995 AND 2002").select(c.params.windows.of(F.col("year"), strict=True).alias("win"))
    return rows.groupBy("win").agg(F.count("*").alias("papers"))


@sql("SELECT p_partkey, CASE WHEN p_brand <> 'Brand#13' THEN NULL WHEN contains(lower(p_name), 'widget') THEN 'WIDE' WHEN contains(lower(p_name), 'cold') OR contains(lower(p_name), 'red') THEN 'COLOR' ELSE 'MAIN' END AS venue FROM part")
def stream_routing(c):
    """A stream that several venues share, routed by words of the title."""
    return c.table("part").select("p_partkey", text.route(F.col("p_brand"), F.col("p_name"), "Brand#13", {"WIDE": ("widget",), "COLOR": ("cold", "red")}, "MAIN").alias("venue"))


@sql("SELECT p_brand AS venue, count(*) AS rows, count(*) FILTER (p_partkey % 2 = 0) AS linked FROM part GROUP BY p_brand")
def standard_columns(c):
    """Other names of a column brought to one, required columns checked, absent link columns as empty ones."""
    rows = require_columns(alias_columns(c.table("part").withColumnRenamed("p_brand", "congress"), {"venue": ("congress", "conference")}), "venue", "p_partkey")
    rows = matching.with_columns_or_empty(rows.withColumn("ee", F.when(key() % 2 == 0, "http://x").otherwise("")), "ee", "url")
    linked = F.count_if((F.col("ee") != "") | (F.col("url") != ""))
    return rows.groupBy("venue").agg(F.count("*").alias("rows"), linked.alias("linked"))


@sql("SELECT coalesce(p_type, t) AS p_type, coalesce(rows, 0) AS rows, coalesce(wanted, 0)::BIGINT AS wanted FROM (SELECT p_type, count(*) AS rows FROM part GROUP BY p_type) FULL JOIN (VALUES ('ECONOMY', 2), ('NONE', 5)) w(t, wanted) ON p_type = t WHERE coalesce(rows, 0) <> coalesce(wanted, 0)")
def cardinality_check(c):
    """Values that are there more or less often than they should be."""
    expected = c.spark.createDataFrame([("ECONOMY", 2), ("NONE", 5)], "p_type string, wanted long")
    return cardinality_differences(c.table("part"), "p_type", expected)


@sql("SELECT p_partkey, list_aggregate(list_filter(string_split(lower(p_name || ' with data from the ' || p_type), ' '), lambda t: length(t) >= 4 AND t NOT IN ('with', 'from', 'that', 'this', 'using', 'based')), 'string_agg', ' ') AS useful FROM part")
def useful_title_tokens(c):
    norm = text.title_ascii(cat(F.col("p_name"), " with data, from the ", F.col("p_type")))
    return c.table("part").select("p_partkey", F.array_join(text.useful_tokens(norm), " ").alias("useful"))


def phrases(c: Corpus) -> DataFrame:
    """A dictionary of word n-grams: one to four words from every place of the benchmark's texts, their item's nation as code."""
    w = text.tokens(text.title_ascii(F.col("text")))
    rows = c.table("benchmark").select("item_id", w.alias("w")).select("item_id", F.posexplode(F.transform("w", lambda _, i: F.slice("w", i + 1, i % 4 + 1))).alias("i", "p"))
    return rows.where(F.size("p") == F.col("i") % 4 + 1).select(F.array_join("p", " ").alias("phrase"), cat("N", F.col("item_id") % 25).alias("code"), (F.col("i") % 3).alias("rank"))


WORDS_SQL = "list_filter(string_split(trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
PHRASES_SQL = f"""b AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(len(w))) AS i FROM b),
dict AS MATERIALIZED (SELECT phrase, arg_min(code, (rank, code)) AS code, min(rank) AS rank, len(string_split(phrase, ' ')) AS n FROM (
  SELECT array_to_string(w[i + 1 : i + i % 4 + 1], ' ') AS phrase, 'N' || item_id % 25 AS code, i % 3 AS rank FROM bi WHERE i + i % 4 + 1 <= len(w)) GROUP BY phrase)"""
MENTIONS_SQL = f"""dw AS MATERIALIZED (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents WHERE text IS NOT NULL),
di AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM dw),
grams AS (SELECT doc_id, pos, n, array_to_string(w[pos + 1 : pos + n], ' ') AS phrase FROM di, range(1, 5) t(n) WHERE pos + n <= len(w)),
hit AS MATERIALIZED (SELECT doc_id, pos, n, phrase, code, rank FROM grams JOIN dict USING (phrase, n)),
men AS MATERIALIZED (SELECT * FROM (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit) WHERE before IS NULL OR before < pos + n)"""


@sql(f"WITH {PHRASES_SQL}, {MENTIONS_SQL} SELECT doc_id, code, count(*) AS mentions, count(DISTINCT phrase) AS phrases, min(pos) AS first, max(n) AS longest FROM men GROUP BY doc_id, code")
def country_mentions(c):
    """All countries of a text and how often their phrases stand in it: longest matches of a dictionary in whole documents."""
    found = gazetteer.mentions(c.table("documents").select(F.col("doc_id").alias("id"), "text"), phrases(c))
    return found.groupBy(F.col("id").alias("doc_id"), "code").agg(F.count("*").alias("mentions"), F.count_distinct("phrase").alias("phrases"), F.min("pos").alias("first"), F.max("n").alias("longest"))


@sql(f"""WITH {PHRASES_SQL}, {MENTIONS_SQL},
dp AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS place FROM (SELECT doc_id, string_split(text, ',') AS p FROM documents)),
cand AS (SELECT doc_id, 0 AS kind, 0 AS rank, -place AS place, code FROM (SELECT doc_id, place, array_to_string({WORDS_SQL.format("part")}, ' ') AS phrase FROM dp) JOIN dict USING (phrase)
  UNION ALL SELECT doc_id, 1, 0, 0, upper(trim(text)) FROM documents WHERE regexp_matches(upper(trim(text)), '^[A-Z]{{2}}$')
  UNION ALL SELECT doc_id, 2, rank, pos, code FROM men WHERE length(phrase) > 4)
SELECT doc_id, code, ['part', 'code', 'mention'][kind + 1] AS how FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, rank, place, code) AS k FROM cand) WHERE k = 1""")
def country_inference_text(c):
    """One country for each document, as of an affiliation: a part between commas, a literal code, or a phrase."""
    return gazetteer.infer(c.table("documents").select(F.col("doc_id").alias("id"), "text"), phrases(c)).withColumnRenamed("id", "doc_id")


@sql("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages),
own AS (SELECT host AS suffix, 'N' || length(host) % 25 AS code FROM h WHERE host <> '' AND length(host) % 3 = 0 UNION SELECT substr(host, length(host) - length(string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1]) + 1), string_split(host, '.')[-2] FROM h WHERE host LIKE '%.%.%'),
s AS (SELECT suffix, min(code) AS code FROM own GROUP BY suffix),
l AS (SELECT page_id, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h WHERE host <> ''),
m AS (SELECT page_id, suffix, code, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC) AS k FROM (SELECT page_id, array_to_string(string_split(host, '.')[-i:], '.') AS suffix FROM l) JOIN s USING (suffix))
SELECT page_id, code, suffix FROM m WHERE k = 1""")
def domain_countries(c):
    """Countries from the longest suffix of a page's host that a table of suffixes has: hosts of some lengths, and second-level domains."""
    hosts = c.table("pages").select(F.col("page_id").alias("id"), text.host(F.col("url")).alias("host"))
    h = hosts.where("host <> ''")
    own = h.where(F.length("host") % 3 == 0).select(F.col("host").alias("suffix"), cat("N", F.length("host") % 25).alias("code"))
    seconds = h.where("host LIKE '%.%.%'").select(F.substring_index("host", ".", -2).alias("suffix"), F.substring_index(F.substring_index("host", ".", -2), ".", 1).alias("code"))
    return gazetteer.from_host(hosts, own.union(seconds)).withColumnRenamed("id", "page_id")


@sql("SELECT p_partkey, [p_name || ' x', NULL, NULL, p_brand][p_partkey % 4 + 1] AS venue FROM part")
def venue_clean(c):
    return c.table("part").select("p_partkey", text.squeeze(pick(key(), cat("  ", F.col("p_name"), " \t x "), "nan", "", F.col("p_brand"))).alias("venue"))


@sql("SELECT doc_id, len(list_filter(w, lambda x: upper(trim(x)) = 'A')) AS a, len(list_filter(w, lambda x: upper(trim(x)) IN ('A*', 'A-STAR', 'ASTAR', 'A+'))) AS top FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents)")
def level_normalise(c):
    """How many words of each document name a level."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    count = lambda value: F.size(F.filter(words, lambda x: text.level(x).eqNullSafe(value)))
    return c.table("documents").select("doc_id", count("A").alias("a"), count("A*").alias("top"))


@sql("SELECT p_partkey, 'https://b/' || p_partkey AS link, 1::BIGINT AS place FROM part UNION ALL SELECT p_partkey, 'http://a', 0 FROM part")
def link_split(c):
    """Links of a list with mixed separators."""
    rows = c.table("part").select("p_partkey", F.posexplode(text.links(cat("http://a; ftp://no |https://b/", key(), " x"))).alias("place", "link"))
    return rows.withColumn("place", F.col("place").cast("int"))


@sql("SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: lower(trim(x)) IN ('true', '1', 'yes', 'y', 'si', 'sí'))) AS yes FROM documents")
def truth_values(c):
    """How many words of each document say yes."""
    return c.table("documents").select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), text.truth)).alias("yes"))


@sql("SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS b FROM part")
def content_values(c):
    """Fields of a JSON object, plain or wrapped."""
    doc = F.when(key() % 2 == 0, cat('{"a": {"value": "', F.col("p_name"), '"}, "b": "', F.col("p_brand"), '"}')).otherwise(cat('{"a": "', F.col("p_name"), '"}'))
    rows = c.table("part").select("p_partkey", text.parsed(doc).alias("doc"))
    return rows.select("p_partkey", text.content(F.col("doc"), "a").alias("a"), text.content(F.col("doc"), "b").alias("b"))


@sql("SELECT 'papers' || lpad(format('{:,}', count(*)), 12, ' ') || printf('%9.2f', 100.0 * count(*) FILTER (y = 1996) / count(*)) AS line FROM (SELECT year(o_orderdate) AS y FROM orders)")
def report_lines(c):
    """A formatted line of a report."""
    one = c.papers.agg(F.count("*").alias("n"), (F.count_if(F.col("year") == 1996) * 100.0 / F.count("*")).alias("x"))
    return one.select(F.format_string("papers%,12d%9.2f", "n", "x").alias("line"))


NORMALISED = """, a AS (SELECT n_name AS country, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS people, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS researchers,
  (SELECT round(sum(c_acctbal), 2) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS spending FROM nation WHERE n_nationkey % 6 <> 5)"""


@sql("""WITH pc AS (SELECT DISTINCT l_orderkey AS paper_id, n_name AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R')""" + NORMALISED + """
SELECT country, count(*) AS papers, round(1000.0::DOUBLE * count(*) / nullif(any_value(people), 0), 6) AS per_people, round(1.0::DOUBLE * count(*) / nullif(any_value(researchers), 0), 6) AS per_researchers, round(1000000.0::DOUBLE * count(*) / nullif(any_value(spending), 0), 6) AS per_spending
FROM pc LEFT JOIN a USING (country) GROUP BY country""")
def normalised_indicators(c):
    """Papers of each country by its people, researchers and spending; countries without attributes keep their row."""
    cu, su = c.table("customer"), c.table("supplier")
    people = cu.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"), F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 2).alias("spending"))
    researchers = su.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("researchers"))
    attributes = c.table("nation").where("n_nationkey % 6 <> 5").join(people, "n_nationkey", "left").join(researchers, "n_nationkey", "left").select(F.col("n_name").alias("country"), "people", "researchers", "spending")
    out = indicators.normalised(c.paper_country, attributes, {"people": 1000, "researchers": 1, "spending": 1_000_000})
    return out.select("country", "papers", *[F.round(f"per_{m}", 6).alias(f"per_{m}") for m in ("people", "researchers", "spending")])


@sql("SELECT page_id, md5(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')) AS repaired, length(html) - length(replace(html, '&', '')) AS marks FROM pages")
def html_entities(c):
    """Named entities of whole pages by the HTML 5 table; unknown ones stay, and what comes out of one is not read again."""
    html = F.col("html")
    return c.table("pages").select("page_id", F.md5(text.entities(html).cast("binary")).alias("repaired"), (F.length(html) - F.length(F.replace(html, F.lit("&"), F.lit("")))).alias("marks"))


@sql("SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents")
def accents_folded(c):
    """Whole documents without accents: composed letters, combining marks and letters of other Latin blocks."""
    return c.table("documents").select("doc_id", F.md5(text.title_ascii(F.col("text")).cast("binary")).alias("folded"))


@sql("SELECT win, max(total) AS most, count(*) AS venues FROM (SELECT " + YEARS + " AS win, c_mktsegment || '-' || c_nationkey AS venue, count(*) AS total FROM (SELECT *, year(o_orderdate) AS y FROM orders) JOIN customer ON o_custkey = c_custkey WHERE y BETWEEN 1995 AND 2002 GROUP BY ALL) GROUP BY win")
def largest_venues(c):
    """Numbers of the fact by venue, as the preflight checks them."""
    rows = fact(c).where("win IS NOT NULL").groupBy("win", "venue").agg(F.count("*").alias("total"))
    return rows.groupBy("win").agg(F.max("total").alias("most"), F.count("*").alias("venues"))


__all__ = ["SQL"]
