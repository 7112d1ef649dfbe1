"""File sources: ranking lists, bibliographic dumps, works as JSON, PDFs, and a cache table."""

from __future__ import annotations

import codecs
import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import RANKING_RAW, ContractError
from .stages import written


def read_ranking(spark: SparkSession, path: str, rank: str | None = None) -> DataFrame:
    """A headerless list with fixed columns: bad lines dropped, strings trimmed, rows without acronym dropped; with `rank`
    every row must have it and acronyms must be unique."""
    # a line is bad by all of its cells, not only by those that a query needs
    df = spark.read.schema(RANKING_RAW).options(mode="DROPMALFORMED", columnPruning="false").csv(path)
    df = df.withColumns({f.name: F.trim(f.name) for f in RANKING_RAW if f.name != "id"}).where("acronym <> ''")
    if rank is not None:
        r = df.agg(F.count_if(F.coalesce(F.col("rank") != rank, F.lit(True))), F.count("*"), F.count_distinct("acronym")).first()
        if r[0] or r[1] != r[2]:
            raise ContractError(f"{path}: {r[0]} rows of another rank, {r[1] - r[2]} repeated acronyms")
    return df


def sniff(head: bytes) -> dict[str, str]:
    """Options of a CSV from its first bytes: the first encoding, separator and header mode with 3 columns or more."""
    for encoding in ("utf-16", "utf-8", "iso-8859-1") if head[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8", "iso-8859-1"):
        try:
            text = codecs.getincrementaldecoder(encoding)().decode(head)
        except UnicodeDecodeError:
            continue
        for sep in (",", ";", "\t", "|"):
            rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r][:20]
            if len(rows) > 1 and min(len(r) for r in rows[:-1] or rows) >= 3:
                numbers = sum(r[0].strip().isdigit() for r in rows)
                return {"encoding": encoding, "sep": sep, "header": str(not rows[0][0].strip().isdigit() or numbers < len(rows) // 2).lower()}
    raise ContractError("not a CSV with three columns")


def head(spark: SparkSession, path: str, length: int) -> bytes:
    """The first bytes of a file, or of the first file of a folder, in any store that Spark knows; no more is read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getLen() and not s.getPath().getName().startswith(("_", ".")))
        if not names:
            raise ContractError(f"{path} has no files")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, names[0])
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def read_csv_flex(spark: SparkSession, path: str, bytes_read: int = 4096) -> DataFrame:
    """A CSV whose separator and header are told from its head, and its encoding from all of it: one pass counts lines that are
    not UTF-8, and a file with such lines is read as the next encoding."""
    first = head(spark, path, bytes_read)
    found = sniff(first[: first.rfind(b"\n") + 1] or first)
    if found["encoding"] == "utf-8" and spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count():
        found["encoding"] = "iso-8859-1"
    return spark.read.options(**found).csv(path)


def looks_headerless(df: DataFrame) -> bool:
    """Numbers first, short acronyms third, ranking names fourth, each in more than 80 % of the rows."""
    c = [F.col(f"`{n}`") for n in df.columns[:4]]
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    r = df.agg(share(c[0].try_cast("double").isNotNull()), share(F.length(c[2]).between(1, 40)), share(F.upper(c[3]).rlike("CORE|ERA"))).first()
    return all((x or 0) > 0.8 for x in r)


def guess_venue_column(df: DataFrame) -> str:
    """A column that is called so, else the one most like acronyms: upper-case words, few spaces, short."""
    for n in df.columns:
        if n.strip().lower() in ("acronym", "venue", "congress", "sigla"):
            return n
    aggs = []
    for n in df.columns:
        x = F.col(f"`{n}`").cast("string")
        share = lambda cond: F.coalesce(F.avg(F.coalesce(cond, F.lit(False)).cast("double")), F.lit(0.0))
        like = share(x.rlike(r"^[A-Z][A-Za-z0-9&/+\-]{1,14}$"))
        aggs.append((like - share(F.contains(x, F.lit(" "))) - F.greatest(F.lit(0.0), F.coalesce(F.median(F.length(x)), F.lit(0)) - 12) / 50).alias(n))
    r = df.agg(*aggs).first()
    return max(df.columns, key=lambda n: (r[n], -df.columns.index(n)))


RECORD = "_key string, author array<string>, title string, year string, booktitle string, journal string, ee array<string>, url string, _bad string"

#: Bytes up to which a record is held; a longer one, or one without an end, is a bad record.
LONGEST = 16 << 20


#: How an end of a part leaves a record: it goes on, ends, or is broken (another one begins, or it is too long).
ON, ENDS, BROKEN = 0, 1, 2


class _Part:
    """One part of a file, piece by piece. Rows are file, block, kind, state and xml: kind is 'record' or 'bad' for an element that
    begins here, 'tail' for one that does not end here, and 'head' for what stands before the first begin or end of one."""

    def __init__(self, file: str, block: int, begin, end, longest: int):
        self.file, self.block, self.begin, self.end, self.longest = file, block, begin, end, longest
        self.held, self.size, self.tag, self.out = [], 0, None, []
        self.head = block > 0

    def emit(self, kind: str, state: int = ON) -> None:
        if self.size > self.longest:
            kind, state, self.held = ("bad" if kind == "record" else kind), BROKEN, self.held[:1]
        self.out.append((self.file, self.block, kind, state, b"".join(self.held)))
        self.held, self.size, self.tag, self.head = [], 0, None, False

    def add(self, piece: bytes) -> None:
        if self.size <= self.longest:
            self.held.append(piece + b">")
        self.size += len(piece) + 1

    def take(self, piece: bytes) -> None:
        at = piece.rfind(b"<")
        m = self.begin.match(piece, at) if at >= 0 else None
        if m:
            if self.head:
                self.emit("head", BROKEN)
            elif self.tag:
                self.emit("bad")
            self.tag = m[1]
            self.add(piece[at:])
            if piece.endswith(b"/"):  # an empty element
                self.emit("record")
        elif self.tag or self.head:
            self.add(piece)
            m = self.end.match(piece, at) if at >= 0 else None
            if m and (self.head or m[1] == self.tag):
                self.emit("head" if self.head else "record", ENDS)

    def close(self) -> None:
        if self.head or self.tag:
            self.emit("head" if self.head else "tail")


def _records(tags: tuple[str, ...], charset: str, longest: int):
    """Pieces between '>' in the order of a file's part -> the rows of its elements."""
    import re

    names = "|".join(map(re.escape, tags)).encode()
    begin, end = re.compile(rb"<(" + names + rb")(?=[\s/]|$)"), re.compile(rb"</(" + names + rb")\s*$")

    def run(batches):
        import pyarrow as pa

        def rows(parts):
            found = list(zip(*(r for p in parts for r in p.out))) or [()] * 5
            for p in parts:
                p.out = []
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([*map(pa.array, found[:4], kinds), pa.array([x.decode(charset, "replace") for x in found[4]], pa.string())], ["file", "block", "kind", "state", "xml"])

        part = None
        for batch in batches:
            parts = [part] if part else []
            for file, block, piece in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("piece").to_pylist()):
                if part is None or (file, block) != (part.file, part.block):
                    if part:
                        part.close()
                    part = _Part(file, block, begin, end, longest)
                    parts.append(part)
                part.take(piece)
            yield rows(parts)
        if part:
            part.close()
            yield rows([part])

    return run


def read_elements(spark: SparkSession, path: str, tags: tuple[str, ...], charset: str = "utf-8", longest: int = LONGEST) -> DataFrame:
    """xml and bad: every element of the given names in files of any size, plain (split among tasks) or compressed.

    The text source gives the pieces between '>' in order, so neither lines nor the form of attributes matter. A record that
    two or more parts share is put together from its tail and the heads that follow, two rows a part. Elements without an end,
    or longer than `longest` bytes, come back as bad rows."""
    pieces = spark.read.option("lineSep", ">").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    pieces = pieces.select(F.col("value").cast("binary").alias("piece"), F.col("file_path").alias("file"), F.col("file_block_start").alias("block"))
    rows = written(pieces.mapInArrow(_records(tags, charset, longest), "file string, block long, kind string, state int, xml string"))
    cut = rows.where("kind IN ('head', 'tail')").withColumn("at", F.struct("block", F.col("kind") == "tail"))  # a part's head comes before its tail
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("record", F.count_if(F.col("kind") == "tail").over(before)).where("record > 0")
    own = Window.partitionBy("file", "record").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("over", F.coalesce(F.max("state").over(own) > ON, F.lit(False))).where("NOT over")
    whole = cut.groupBy("file", "record").agg(F.max("state").alias("state"), F.sum(F.octet_length("xml")).alias("n"), F.array_sort(F.collect_list(F.struct("at", "xml"))).alias("p"))
    bad = (F.col("state") != ENDS) | (F.col("n") > longest)
    whole = whole.select(F.array_join(F.transform("p", lambda x: x["xml"]), "").alias("xml"), bad.alias("bad"))
    return rows.where("kind IN ('record', 'bad')").select("xml", (F.col("kind") == "bad").alias("bad")).unionByName(whole)


def read_dump(spark: SparkSession, path: str, charset: str = "ISO-8859-1", tags: tuple[str, ...] = ("inproceedings", "article")) -> DataFrame:
    """Records of a bibliographic XML dump: key, tag, authors, title, year, booktitle, links; and bad, records that could not be
    parsed (their other columns are null).

    Entities of HTML are repaired before parsing, since the XML parser knows only its own five; markup within titles is removed."""
    return parse_records(read_elements(spark, path, tags, charset))


def parse_records(rows: DataFrame) -> DataFrame:
    """rows: xml, one element each, and bad."""
    clean = T.xml_safe(F.regexp_replace("xml", r"</?(?:i|b|sub|sup|tt|ref)(?:\s[^>]*)?>", ""))
    r = F.from_xml(clean, F.lit(RECORD), {"rowTag": "r", "attributePrefix": "_", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.select("bad", F.regexp_extract("xml", r"^<([^\s/>]+)", 1).alias("tag"), r.alias("r"))
    rows = rows.withColumn("bad", F.col("bad") | F.col("r._bad").isNotNull())
    f = lambda n: F.when(~F.col("bad"), F.col(f"r.{n}"))
    authors = F.array_join(F.filter(f("author"), lambda x: x != ""), "; ")
    return rows.select(
        f("_key").alias("dblp_key"), "tag", authors.alias("authors"), F.trim(f("title")).alias("title"), f("year").try_cast("int").alias("year"),
        F.coalesce(F.nullif(f("booktitle"), F.lit("")), f("journal")).alias("booktitle"), T.doi(T.first_doi(f("ee"))).alias("doi"), T.first_arxiv(f("ee")).alias("arxiv_id"), f("ee").alias("links"), "bad",
    )


WORK = "id string, doi string, authorships array<struct<author: struct<id: string, display_name: string>, institutions: array<struct<id: string, display_name: string, country_code: string>>>>"


def work_countries(works: DataFrame, column: str = "value") -> DataFrame:
    """Rows of nested works: doi, author_order, institution, country."""
    w = works.select(F.from_json(column, WORK).alias("w")).where("w.doi IS NOT NULL")
    a = w.select(T.doi(F.col("w.doi")).alias("doi"), F.posexplode("w.authorships").alias("pos", "a"))
    i = a.select("doi", (F.col("pos") + 1).alias("author_order"), F.explode("a.institutions").alias("i"))
    return i.select("doi", "author_order", F.col("i.display_name").alias("institution"), T.country_code(F.col("i.country_code")).alias("country"))


def crossref_affiliations(items: DataFrame, column: str = "value") -> DataFrame:
    """doi and affiliation names; DOIs are matched without case."""
    from ..functions import countries

    x = items.select(F.from_json(column, "DOI string, author array<struct<affiliation: array<struct<name: string>>>>").alias("x"))
    rows = x.select(F.lower("x.DOI").alias("doi"), F.explode("x.author").alias("a")).select("doi", F.explode("a.affiliation.name").alias("affiliation"))
    return rows.withColumn("country", countries.infer(F.col("affiliation")))


def volume_titles(volumes: DataFrame, column: str = "xml") -> DataFrame:
    """Titles, countries and number of affiliations of a volume's XML; front matter is left out. Name spaces don't count: their
    prefixes go before the XML is parsed; attributes may stand anywhere."""
    body = T.xml_safe(F.regexp_replace(F.regexp_replace(column, r"(</?)[A-Za-z0-9_.-]+:", "$1"), r"\sxmlns(?::\w+)?=\"[^\"]*\"", ""))
    volume = F.from_xml(body, F.lit("paper array<struct<title: string, affiliation: array<string>>>"), {"rowTag": "v"})
    papers = volumes.select(F.explode(volume.getField("paper")).alias("p"))
    rows = papers.select(F.trim("p.title").alias("title"), F.coalesce("p.affiliation", F.array().cast("array<string>")).alias("aff"))
    front = T.has_any(F.col("title"), ("front matter", "preface", "table of contents", "frontmatter"))
    from ..functions import countries

    return rows.where(~front).select("title", F.array_sort(F.array_distinct(F.array_compact(F.transform("aff", lambda a: countries.infer(a))))).alias("countries"), F.size("aff").alias("n_affiliations"))


def volume_links(pages: DataFrame, column: str = "html") -> DataFrame:
    """Links of an index page to volumes, with the year in their label."""
    rows = pages.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?si)(<a\s[^>]*href\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a>)"), F.lit(1))).alias("a"))
    rows = rows.select(F.get(T.hrefs(F.col("a")), F.lit(0)).alias("href"), F.regexp_replace("a", "<[^>]*>", "").alias("label"))
    return rows.withColumn("year", F.regexp_extract("label", "((?:19|20)[0-9]{2})", 1).try_cast("int")).where("href <> '' AND year IS NOT NULL")


def read_pdf_text(spark: SparkSession, path: str, pages: int = 2, least: int = 100) -> DataFrame:
    """path and text of the first pages; null below `least` characters. Needs pypdf on the executors."""

    def run(batches):
        import pandas as pd
        from pypdf import PdfReader

        for pdf in batches:
            out = []
            for body in pdf["content"]:
                text = "\n".join((p.extract_text() or "") for p in PdfReader(io.BytesIO(body)).pages[:pages])
                out.append(text if len(text) >= least else None)
            yield pd.DataFrame({"path": pdf["path"], "text": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def parquet_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the Parquet files below a folder, listed by Spark's binary source without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return sorted(r["path"] for r in found.select("path").collect())


def _footers(batches):
    """Paths -> schema of each file as JSON; null where the file can't be read here."""
    import pyarrow as pa
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            try:
                fs, at = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
                meta = pq.read_metadata(at, filesystem=fs).metadata or {}
                schema = meta.get(b"org.apache.spark.sql.parquet.row.metadata")
                out.append(schema.decode() if schema else json.dumps(None))
            except (OSError, pa.ArrowException):
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], ["path", "schema"])


def read_matching(spark: SparkSession, paths: list[str], required: set[str]) -> DataFrame | None:
    """The union of the Parquet files that have the required columns; None if none has.

    Tasks read the footers, and files of one schema are one scan, so many small files cost neither a driver's look at each nor a
    plan's branch. Files whose footer names no schema of Spark, or lie where tasks can't open them, are looked at here."""
    from pyspark.sql.types import StructType

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 50, 1000)))
    by: dict[str | None, list[str]] = {}
    for r in rows.mapInArrow(_footers, "path string, schema string").collect():  # a row per path, which came from here
        by.setdefault(r["schema"], []).append(r["path"])
    frames = []
    for schema, own in sorted(by.items(), key=lambda x: str(x[0])):
        if schema in (None, "null"):
            frames += [df for p in sorted(own) if required <= set((df := spark.read.parquet(p)).columns)]
            continue
        kind = StructType.fromJson(json.loads(schema))
        if required <= set(kind.names):
            frames.append(spark.read.schema(kind).parquet(*sorted(own)))
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def read_notes(notes: DataFrame, column: str = "value", order: tuple[str, ...] = ()) -> DataFrame:
    """Submission notes as JSON of either kind (content values plain or wrapped): note_id, venue, invitation, title, authors,
    accepted. `order` lists kinds of invitations (their last segment): of a venue only the first kind that it has counts."""
    from ..operators.matching import first_source

    # a generator: the filter below is not pushed through it, so each note is parsed once
    docs = notes.select(F.explode(F.array(T.parsed(F.col(column)))).alias("v"))
    v, c = F.col("v"), lambda k, kind="string": T.content(F.col("v"), k, "$.content", kind)
    get = lambda path: F.try_variant_get(v, path, "string")
    invitation = F.coalesce(get("$.invitation"), get("$.invitations[0]"))
    authors = F.coalesce(c("authorids", "array<string>"), F.array().cast("array<string>"))
    rows = docs.select(
        get("$.id").alias("note_id"), get("$.domain").alias("venue"), F.substring_index(invitation, "/", -1).alias("invitation"),
        c("title").alias("title"), authors.alias("authors"), T.accepted(c("decision"), F.coalesce(c("venueid"), F.lit(""))).alias("accepted"),
    ).where("note_id IS NOT NULL")
    if not order:
        return rows
    return first_source(*[rows.where(F.col("invitation") == kind) for kind in order], key="venue").drop("priority")


METRICS = "doi string, cited_by_count long, publication_year int, type string, is_retracted boolean"


def citation_metrics(works: DataFrame, column: str = "value") -> DataFrame:
    """doi, citations, year, type of works as JSON; retracted ones are left out."""
    w = works.select(F.from_json(column, METRICS).alias("w")).where("w.doi IS NOT NULL AND NOT coalesce(w.is_retracted, false)")
    return w.select(T.doi(F.col("w.doi")).alias("doi"), F.coalesce("w.cited_by_count", F.lit(0)).alias("citations"), F.col("w.publication_year").alias("year"), F.col("w.type").alias("type"))


def upsert(cache: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Cache rows with the latest per key; negative answers are rows too."""
    both = cache.unionByName(new, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.col(at)).alias("r")).select(key, "r.*")


def optional(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame | None:
    """The Parquet table at path, else the default."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else default
