"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, ngram_join, packing, quality, secret_scan, sst, token_counts, url_filter
from ._shared import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.token_table(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), size=2048, end_id=1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"), x["edits"].cast("string"))), ","))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.fit(table(spark, sf_dir, "documents")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ngram_join.Params(shingle=3, num=90, den=100)).drop("class_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_url_filter, op3_token_counts, op4_sorted_string_table, op5_packing, op6_decontamination, op7_license_scan, op8_language_id, op9_ngram_join, op10_quality_rules)
}

def _secret_sql() -> str:
    """Places from the text split by each rule, as the operator takes them."""
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS n "
            f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g, string_split_regex(text, '{pattern}') AS p FROM t), unnest(range(1, len(m) + 1)) u(i) WHERE length(g[i]) >= {r.group_chars}"
        )
    span, base = "kind || ':' || s || ':' || (s + n)", len(secret_scan.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({' UNION ALL '.join(parts)}) SELECT doc_id, {counts}, "
        f"sha256(coalesce(string_agg({span}, ',' ORDER BY s, k) FILTER (WHERE k < {base}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY s, k), '') AS spans FROM t LEFT JOIN found USING (doc_id) GROUP BY doc_id"
    )


# The pages hold no canonical or refresh links, so no verdict is carried; with links the operator is tested on fixtures.
_URL_SQL = (
    "WITH r(rule_host, rule_path, verdict) AS (VALUES "
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    + r"""), u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, verdict) AS k FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, NULL::VARCHAR AS alias_of FROM h LEFT JOIN f ON f.page_id = h.page_id AND k = 1"""
)

# Exact containment; the operator finds its candidates by MinHash and verifies the same measure.
_CONTAINED_SQL = r"""WITH words AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f\x{2010}-\x{2027}\x{ab}\x{bb}\x{a0}]+'), lambda x: x <> '') AS w FROM words WHERE text IS NOT NULL),
b AS (SELECT id AS item_id, w, least(5, len(w)) AS k FROM w WHERE side = 'b' AND len(w) > 0),
it AS (SELECT row_number() OVER () AS r, item_id, k, list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM b),
g AS (SELECT r, item_id, k, len(s) AS n, unnest(s) AS g FROM it),
d AS (SELECT DISTINCT id AS doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (SELECT DISTINCT k FROM b) WHERE side = 'd' AND len(w) >= k)
SELECT doc_id, item_id, floor(log2(n))::INT + 1 AS size_partition, count(*)::BIGINT AS n_shared, n::BIGINT AS n_item, count(*)::DOUBLE / n AS containment FROM g JOIN d USING (k, g) GROUP BY doc_id, r, item_id, n HAVING count(*) >= 0.8 * n - 1e-9"""

# All pairs that share a shingle are counted, and reach follows the links.
_JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0d]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - least(3, len(w)) + 2), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id FROM s"""

ORACLE_SQL: dict[str, str] = {"op1_secret_scan": _secret_sql(), "op2_url_filter": _URL_SQL, "op6_decontamination": _CONTAINED_SQL, "op9_ngram_join": _JACCARD_SQL}
