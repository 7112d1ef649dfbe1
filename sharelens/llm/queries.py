"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, code_compression, divergence, exact_dedup, fingerprints, jaccard_join, license_scan, mixing, pii, substring_dedup, suffix_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark, sf_dir):
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file's place on the driver; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir):
    return bpe.transcode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_pii(spark, sf_dir):
    return pii.scan(_table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.assign(_table(spark, sf_dir, "documents"), mixing.Mix())


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op11_code_compression(spark, sf_dir):
    return code_compression.compress(_table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, row_number() OVER () AS k,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, f, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT k, max_by(h || f, length(h || f)) AS rule, max_by(v, length(h || f)) AS v
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY k)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN m.v
            WHEN regexp_matches(url, '/en/[0-9]+\.html$') OR regexp_matches(url, '^https://www\.') THEN 'allow'
            WHEN regexp_matches(url, '[?&]utm_source=[a-z]+') OR regexp_matches(url, '^https?://blog\.[^/]*\.example\.com/')
                 OR regexp_matches(url, '[?&]page=[0-9]+&ref=') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (k)"""


def queries():
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_bpe": op2_bpe,
        "op3_mixing": op3_mixing,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_pii": op6_pii,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_url_filter": op9_url_filter,
        "op10_toxicity": op10_toxicity,
        "op11_code_compression": op11_code_compression,
        "op12_license_scan": op12_license_scan,
        "op13_divergence": op13_divergence,
    }


def oracle_sql():
    return {"op3_mixing": mixing.sql(mixing.Mix()), "op5_exact_dedup": OP5_SQL, "op9_url_filter": OP9_SQL, "op11_code_compression": code_compression.sql(), "op12_license_scan": license_scan.sql(), "op13_divergence": divergence.sql()}
