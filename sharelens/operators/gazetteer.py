"""Country inference from a dictionary table: names, aliases, institutions and domains are rows, texts meet them in hash joins.

A dictionary has phrase and code, and a rank that orders phrases (lowest first). Phrases and texts are compared as words without
accents and case. No name is compiled into a plan, so a dictionary of any size has the same plan; the planner
broadcasts or shuffles it by its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.countries import ALIASES, HINTS, NAMES, SUFFIXES

#: Languages whose country names the default dictionary has.
LANGUAGES = ("en", "es", "fr", "de", "it", "pt", "nl", "ca", "pl", "sv", "da", "fi", "cs", "hu", "ro", "hr", "tr")


def world(spark: SparkSession, languages: tuple[str, ...] = LANGUAGES, institutions=HINTS) -> DataFrame:
    """phrase, code, rank: every country's name in each language as the JVM's locale data has them, the names and aliases of
    `countries` (which come first), and parts of institutions' names (last)."""
    locale = spark._jvm.java.util.Locale
    rows = [(n, c, 0) for n, c in (*NAMES, *ALIASES)]
    for i, language in enumerate(languages):
        speak = locale.forLanguageTag(language)
        for code in locale.getISOCountries():
            rows.append((locale.forLanguageTag(f"und-{code}").getDisplayCountry(speak), str(code), 1 + i))
    rows += [(n, c, 1 + len(languages)) for n, c in institutions]
    return spark.createDataFrame(rows, "phrase string, code string, rank int")


def domains(spark: SparkSession, more=SUFFIXES) -> DataFrame:
    """suffix, code: the top-level domain of every country, and suffixes that differ from their country's code."""
    codes = [str(c) for c in spark._jvm.java.util.Locale.getISOCountries()]
    return spark.createDataFrame([*more, *((c.lower(), c) for c in codes if c.lower() not in dict(more))], "suffix string, code string")


def words(column) -> F.Column:
    return T.tokens(T.title_ascii(column))


def entries(dictionary: DataFrame) -> DataFrame:
    """phrase (words joined by spaces), n (words), first word, code, rank: one row per phrase, that of the lowest rank and code."""
    rank = F.col("rank") if "rank" in dictionary.columns else F.lit(0).alias("rank")
    rows = dictionary.select(F.array_join(words(F.col("phrase")), " ").alias("phrase"), "code", rank).where("phrase <> '' AND code IS NOT NULL")
    rows = rows.groupBy("phrase").agg(F.min(F.struct("rank", "code")).alias("x"))
    return rows.select("phrase", F.size(F.split("phrase", " ")).alias("n"), F.substring_index("phrase", " ", 1).alias("first"), "x.code", "x.rank")


def mentions(texts: DataFrame, dictionary: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """key, pos, n, phrase, code, rank: the longest phrases of the dictionary in each text, by word (pos from 0). A phrase within a
    longer one found there does not count; `key` names one text.

    Words that begin a phrase are told by a join with the first words, which also says what lengths to try; the word
    n-grams of these lengths are looked up by an equi-join. So what is joined is the places where a phrase may begin, not every text by
    every phrase."""
    d = entries(dictionary)
    most = d.agg(F.max("n")).first()[0] or 1
    lengths = d.groupBy("first").agg(F.collect_set("n").alias("ns"))  # at most `most` values
    # each place carries the few words that a phrase may need, not its whole text
    ws = texts.select(F.col(key), words(F.col(column)).alias("w"))
    places = ws.select(key, F.posexplode(F.transform("w", lambda _, i: F.slice(F.col("w"), i + 1, most))).alias("pos", "ws"))
    tried = places.join(lengths, F.get("ws", F.lit(0)) == F.col("first")).select(key, "pos", "ws", F.explode("ns").alias("n"))
    tried = tried.where(F.size("ws") >= F.col("n")).select(key, "pos", F.array_join(F.slice("ws", F.lit(1), F.col("n")), " ").alias("phrase"))
    found = tried.join(d.drop("first"), "phrase")
    # what ends where an earlier or longer one has ended lies within it
    before = Window.partitionBy(key).orderBy("pos", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_end", F.max(F.col("pos") + F.col("n")).over(before))
    return found.where(F.col("_end").isNull() | (F.col("_end") < F.col("pos") + F.col("n"))).select(key, "pos", "n", "phrase", "code", "rank")


def normalise(names: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Adds `code`: the whole value is a phrase of the dictionary, else a literal two-letter code."""
    d = entries(dictionary).select(F.col("phrase").alias("_p"), F.col("code").alias("_code"))
    out = names.withColumn("_n", F.array_join(words(F.col(column)), " ")).join(d, F.col("_n") == F.col("_p"), "left")
    return out.withColumn("code", F.coalesce("_code", T.country_code(F.col(column)))).drop("_n", "_p", "_code")


def infer(texts: DataFrame, dictionary: DataFrame, key: str = "id", column: str = "text", least: int = 4) -> DataFrame:
    """key, code, how of the texts that tell a country: the last part between commas that is a phrase ('part'), else a literal code
    ('code'), else the phrase of the lowest rank, then place, longer than `least` characters ('mention')."""
    d = entries(dictionary).select("phrase", "code")
    parts = texts.select(key, F.posexplode(F.split(column, ",")).alias("at", "part")).select(key, "at", F.array_join(words(F.col("part")), " ").alias("phrase"))
    parts = parts.where("phrase <> ''").join(d, "phrase").select(key, F.lit(0).alias("kind"), F.lit(0).alias("rank"), (-F.col("at")).alias("at"), "code")
    literal = T.country_code(F.col(column))
    codes = texts.select(key, F.lit(1).alias("kind"), F.lit(0).alias("rank"), F.lit(0).alias("at"), literal.alias("code")).where("code IS NOT NULL")
    inside = mentions(texts, dictionary, key, column).where(F.length("phrase") > least).select(key, F.lit(2).alias("kind"), "rank", F.col("pos").alias("at"), "code")
    best = parts.unionByName(codes).unionByName(inside).groupBy(key).agg(F.min(F.struct("kind", "rank", "at", "code")).alias("x"))
    return best.select(key, "x.code", F.element_at(F.array(F.lit("part"), F.lit("code"), F.lit("mention")), F.col("x.kind") + 1).alias("how"))


def from_host(hosts: DataFrame, suffixes: DataFrame, key: str = "id", column: str = "host") -> DataFrame:
    """key, code, suffix: the longest suffix (whole labels) of a host that is in suffixes (suffix, code)."""
    labels = F.split(F.lower(column), r"\.")
    rows = hosts.where(F.coalesce(F.col(column), F.lit("")) != "").select(key, F.explode(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("suffix"))
    s = suffixes.groupBy(F.lower(F.ltrim(F.col("suffix"), F.lit("."))).alias("suffix")).agg(F.min("code").alias("code"))
    rows = rows.join(s, "suffix")
    return rows.groupBy(key).agg(F.max(F.struct(F.length("suffix").alias("n"), "suffix", "code")).alias("x")).select(key, "x.code", "x.suffix")
