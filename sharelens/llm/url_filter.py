"""URL filters: pattern rules indexed by their rarest literal token, DataFrame functions only.

Each rule has a regular expression and the literal tokens ([a-z0-9]+ in lower case) without which it can't match. Token
counts over all URLs choose each rule's rarest token; the index maps it to the rule. A URL's distinct tokens are
looked up in the index, and only the rules found there run their regular expression on it.

Two kinds of rules: host rules (host, path, verdict) fit a host and its subdomains where the path starts with the
rule's, the longest wins; pattern rules judge the whole URL where no host rule fits: an allowing pattern wins over
blocking ones, and without either the URL is allowed. The index is broadcast only up to BROADCAST_RULES rules.

Defined cases: a null URL or one without "://" has empty host and path (pattern rules still see the URL); an empty host
fits no host rule; null or repeated page_ids and repeated rows each come back; an empty table gives no rows; other
columns are ignored; long URLs are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rules (under 1 kB each) up to which the index is broadcast; more are joined by token.
BROADCAST_RULES = 20_000

HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: (regular expression on the URL, tokens that it needs, verdict)
PATTERN_RULES = (
    (r"[?&]utm_source=[a-z]+", ("utm", "source"), "block"),
    (r"^https?://blog\.[^/]*\.example\.com/", ("blog", "example", "com"), "block"),
    (r"[?&]page=[0-9]+&ref=", ("page", "ref"), "block"),
    (r"/en/[0-9]+\.html$", ("en", "html"), "allow"),
    (r"^https://www\.", ("https", "www"), "allow"),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_rows(host_rules: Sequence[tuple], pattern_rules: Sequence[tuple]) -> list[tuple]:
    """(rule, text it judges, regular expression, tokens, verdict, rank); host rules judge host, line feed, path."""
    rows = []
    for host, path, verdict in host_rules:
        pattern = rf"(?s)^(?:.*\.)?{re.escape(host)}\n{re.escape(path)}"
        rows.append((host + path, True, pattern, [t for t in re.split("[^a-z0-9]+", host) if t], verdict, len(host + path)))
    for pattern, tokens, verdict in pattern_rules:
        rows.append((None, False, pattern, list(tokens), verdict, 1 if verdict == "allow" else 0))
    return rows


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def judge(pages: DataFrame, host_rules: Sequence[tuple] = HOST_RULES, pattern_rules: Sequence[tuple] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    spark = pages.sparkSession
    rows = rule_rows(host_rules, pattern_rules)
    names = ("id", "rule", "is_host", "pattern", "tokens", "verdict", "rank")
    literal = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v).cast("string") if v is None else F.lit(v)
    rules = spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(*[literal(v).alias(n) for n, v in zip(names, (i, *r))]) for i, r in enumerate(rows)])))
    few = len(rows) <= BROADCAST_RULES
    held = F.broadcast if few else (lambda df: df)
    # numbered and written once: a page has one number in every branch, whichever executors read it again
    pages = materialize(pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).withColumn("row", F.monotonically_increasing_id()))

    wanted = rules.select("id", F.explode("tokens").alias("token"))
    seen = pages.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(held(wanted.select("token").distinct()), "token").groupBy("token").count()
    rarest = wanted.join(seen, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token"))
    index = rules.drop("tokens").join(rarest, "id")

    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    fetched = pages.withColumn("token", F.explode(tokens_of(F.col("url")))).join(held(index), "token")
    # one row per page and rule that fits; the best one per page by (host rule, rank)
    fits = fetched.where(F.expr(r"rlike(CASE WHEN is_host THEN concat(host, '\n', path) ELSE url END, pattern)"))
    best = F.max(F.when(F.col("id").isNotNull(), F.struct("is_host", "rank", "rule", "verdict")))
    fits = fits.select("row", "page_id", "host", "path", "id", "is_host", "rank", "rule", "verdict")
    all_rows = pages.select("row", "page_id", "host", "path", *[F.lit(None).cast(t).alias(n) for n, t in (("id", "int"), ("is_host", "boolean"), ("rank", "int"), ("rule", "string"), ("verdict", "string"))])
    out = all_rows.unionByName(fits).groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
