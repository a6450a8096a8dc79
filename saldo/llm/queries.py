"""The registered queries of this subpackage, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saldo.llm import (
    fingerprints,
    html_rendering,
    jaccard_join,
    language_id,
    lexical_search,
    license_scan,
    packing,
    pii,
    quality_rules,
    resampling,
    sampled_pieces,
    token_files,
    url_filters,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL is given only where DuckDB can express the whole result.
ORACLE: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identified(table(spark, folder, "documents"))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.joined(table(spark, folder, "documents"))


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"))


@query
def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judged(table(spark, folder, "pages"))


@query
def op7_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sampled_pieces.sampled(table(spark, folder, "documents"))


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query
def op8_html_rendering(spark: SparkSession, folder: str) -> DataFrame:
    return html_rendering.extract(table(spark, folder, "pages"))


@query
def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.digests(table(spark, folder, "documents"))


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op11_resampling"] = resampling.ORACLE
ORACLE["op13_lexical_search"] = lexical_search.ORACLE


@query
def text_edited(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the fingerprints that SQL can follow: lengths, and digests of the edited texts."""
    return op1_fingerprints(spark, folder).select("doc_id", "n_chars", "edited_sha256")


@query
def page_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the URL filters that SQL can follow: hosts, paths and the rules that fit."""
    return op6_url_filters(spark, folder).select("page_id", "host", "path", "rule")


ORACLE["text_edited"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
    SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after
    FROM texts
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
    sha256(left(text, length(text) - length(text) // 3) || left(after, length(text) // 3)) AS edited_sha256
FROM following
"""

ORACLE["page_rules"] = """
WITH parts AS (
    SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM parts
),
rules(host, path) AS (
    VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')
),
fits AS (
    SELECT page_id, r.host || r.path AS rule FROM split s JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, rule FROM split LEFT JOIN (
    SELECT page_id, arg_max(rule, length(rule)) AS rule FROM fits GROUP BY page_id) USING (page_id)
"""
