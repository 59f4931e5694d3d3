"""Queries over documents, pages and relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract, pages, relational
from ..operators.vectors import hash_sample
from .registry import query, table, texts

SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
ALNUM = r"length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
N_WORDS = "(CASE WHEN " + SQUEEZED.format("text") + " = '' THEN 0 ELSE len(string_split(" + SQUEEZED.format("text") + ", ' ')) END)"
VALID = (
    f"(length(trim(text)) >= 100 AND {N_WORDS} >= 20 AND (length(text) - length(replace(text, '<', ''))) <= (length(text) - length(replace(text, ' ', ''))) / 10.0 AND {ALNUM.format('text')} >= 0.7 * length(text))"
)
CLEAN = (
    r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), "
    r"'<[^<>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"
).replace('\\"', '"')


@query("SELECT doc_id, source, n_chars FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 100 AND source IN ('src1', 'src2', 'src3')")
def scan_filter_content(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(relational.has_content("text") & F.col("source").isin("src1", "src2", "src3"))
    return d.select("doc_id", "source", "n_chars")


@query("""SELECT c_custkey, c_name, count(l_orderkey) AS n_lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY c_custkey, c_name ORDER BY c_custkey DESC LIMIT 200 OFFSET 10""")
def join_group_count(spark: SparkSession, sf: str) -> DataFrame:
    c, o, l = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "lineitem")
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left").join(l.select("l_orderkey"), o["o_orderkey"] == l["l_orderkey"], "left")
    return j.groupBy("c_custkey", "c_name").agg(F.count("l_orderkey").alias("n_lines")).orderBy(F.desc("c_custkey")).offset(10).limit(200)


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def join_preagg_count(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents d WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.source = 'src0' AND md5(s.text) = md5(d.text))")
def anti_seen(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return relational.unseen(d.where("source <> 'src0'"), d.where("source = 'src0'"), F.col("key"), F.col("key")).select("doc_id")


@query("SELECT conv_id, count(*) AS n, string_agg(DISTINCT role, ', ' ORDER BY role) AS \"values\" FROM conversations GROUP BY conv_id ORDER BY n DESC, conv_id LIMIT 10")
def string_agg_types(spark: SparkSession, sf: str) -> DataFrame:
    return relational.distinct_list(table(spark, sf, "conversations"), "conv_id", "role", 10)


@query(f"SELECT doc_id, {N_WORDS} AS n_words, {VALID} AS is_valid FROM documents")
def valid_documents(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", tx.word_count("text").cast("bigint").alias("n_words"), tx.is_valid_document("text").alias("is_valid"))


@query(f"SELECT 'doc_' || doc_id AS id, 'document' AS node_type, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS label, {N_WORDS} AS num_tokens FROM documents")
def num_tokens_projection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.lit("document").alias("node_type"), tx.truncated("text", 50).alias("label"), tx.word_count("text").cast("bigint").alias("num_tokens"))


@query(f"""SELECT count(*) AS n_documents, count(*) FILTER (WHERE {VALID}) AS n_valid, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) = 0) AS n_empty,
count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_labelled, sum(length(text))::BIGINT AS total_chars, round(avg(length(text)), 6) AS avg_chars FROM documents""")
def preprocess_stats(spark: SparkSession, sf: str) -> DataFrame:
    return relational.preprocess_stats(texts(spark, sf), table(spark, sf, "labels"))


@query(f"""SELECT count(*) AS n, round(avg({VALID}::INT), 6) AS valid_ratio, round(avg(length(text)), 6) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars,
avg({VALID}::INT) < 0.9 AS low_coverage, avg({VALID}::INT) < 0.5 AS very_low_coverage FROM documents""")
def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return relational.validation_summary(texts(spark, sf))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM pages), d AS (SELECT DISTINCT page_id, link FROM l),
g AS (SELECT page_id, bool_or(contains(link, '/th')) AS any_good FROM d GROUP BY page_id)
SELECT d.page_id, link FROM d JOIN g USING (page_id) WHERE NOT any_good OR contains(link, '/th')""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.links(table(spark, sf, "pages"), ("/th",)).select("page_id", F.explode("links").alias("link"))


@query(f"SELECT page_id, {CLEAN} AS text FROM pages")
def html_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "pages").select("page_id", tx.clean_html("html").alias("text"))


@query(r"""SELECT page_id, coalesce(nullif(substr(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 1, 200), ''), nullif(substr(trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)), 1, 200), '')) AS title,
nullif(regexp_extract(html, '(?i)<html[^>]*\blang\s*=\s*["'']([A-Za-z-]+)["'']', 1), '') AS lang, try_strptime(nullif(regexp_extract(html, '\b(\d{2}/\d{2}/\d{4})\b', 1), ''), '%d/%m/%Y')::DATE AS published,
coalesce(nullif(regexp_extract(html, '\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}'), ''), 'processo_' || page_id) AS number, md5(url) AS url_hash FROM pages""")
def html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return pages.metadata(table(spark, sf, "pages"))


PARAGRAPHS = r"""SELECT doc_id, i::INT AS ordem, substr(p[i], 1, 3000) AS content FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 100)[1:10] AS p FROM documents), unnest(range(1, len(p) + 1)) t(i)"""


@query(PARAGRAPHS)
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    return pages.paragraphs(texts(spark, sf))


def _field_sql(name: str) -> str:
    ways = "".join(f" WHEN regexp_matches(text, '(?i){p}') THEN substr(regexp_replace(regexp_extract(text, '(?i){p}', {g}), '^\\s+|\\s+\\z', '', 'g'), 1, 200)" for p, g in pages.FIELD_PATTERNS[name])
    return f"CASE{ways} END AS {name}"


@query(f"SELECT doc_id, {', '.join(map(_field_sql, pages.FIELD_PATTERNS))}, CASE WHEN contains(lower(text), 'empréstimo consignado') THEN 'Empréstimo Consignado' WHEN contains(lower(text), 'consignado') THEN 'Consignado' END AS assunto_principal FROM documents")
def process_fields(spark: SparkSession, sf: str) -> DataFrame:
    return pages.process_fields(texts(spark, sf))


# The whole pattern of a section: sentences up to an empty one.
_SECTION_SQL = ", ".join(f"{{'tipo': '{t}', 'content': regexp_replace(regexp_extract(text, '(?is){h}([^\\.]+(?:\\.[^\\.]+)*)', 1), '^\\s+|\\s+\\z', '', 'g')}}" for t, h in pages.SECTION_HEADS)


@query(f"""WITH s AS (SELECT doc_id, list_filter([{_SECTION_SQL}], lambda x: length(x.content) > 50) AS found, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+\\z', '', 'g')), lambda x: length(x) > 100)[1:10] AS large FROM documents)
SELECT doc_id, i::INT AS ordem, CASE WHEN len(found) > 0 THEN found[i].tipo ELSE 'paragrafo_' || i END AS tipo, substr(CASE WHEN len(found) > 0 THEN found[i].content ELSE large[i] END, 1, 3000) AS content FROM s, unnest(range(1, CASE WHEN len(found) > 0 THEN len(found) ELSE len(large) END + 1)) t(i)""")
def content_sections(spark: SparkSession, sf: str) -> DataFrame:
    return pages.content_sections(texts(spark, sf))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[-10:], '|') AS contexts FROM documents")
def last_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", F.array_join(pages.last_contexts(F.split("text", "\n", -1)), "|").alias("contexts"))


@query(r"""SELECT page_id, CASE WHEN md5(url) IN (SELECT md5(url) FROM pages WHERE page_id % 7 = 0) THEN 'already_processed' WHEN 'processo_' || page_id IN (SELECT 'processo_' || page_id FROM pages WHERE page_id % 5 = 0) THEN 'already_exists'
WHEN length(trim(coalesce(html, ''))) <= 100 THEN 'error' ELSE 'success' END AS status FROM pages""")
def scrape_status(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    stored = p.where("page_id % 5 = 0").select(F.concat(F.lit("processo_"), F.col("page_id").cast("string")).alias("number"))
    return pages.scrape_status(p, p.where("page_id % 7 = 0"), stored)


ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS nfc, translate(text, '{ACCENTED}', '{PLAIN}') AS folded FROM documents")
def normalize_unicode(spark: SparkSession, sf: str) -> DataFrame:
    nfc = tx.normalize_unicode("NFC", "space")
    return texts(spark, sf).select("doc_id", nfc("text").alias("nfc"), tx.fold_accents("text").alias("folded"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS t FROM documents)
SELECT doc_id, trim(CASE WHEN length(t) > 1536 THEN substr(t, 1, 1536) || '...' ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS prepared FROM t""")
def vector_prep(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", tx.vector_prep("text").alias("prepared"))


WINDOW_TEXT = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {WINDOW_TEXT} AS normal FROM documents")
def window_text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", tx.window_text("text").alias("normal"))


@query("SELECT doc_id, CASE WHEN length(text) >= 1000 THEN text END AS text FROM documents")
def min_length_null(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.clean_text_or_null("text", 1000).alias("text"))


@query(f"""SELECT doc_id, ordem, length(content) BETWEEN 200 AND 2000 AND len(string_split({SQUEEZED.format('content')}, ' ')) >= 10 AND {ALNUM.format('content')} >= 0.6 * length(content) AND regexp_matches(content, '(?i)(the|und|que|les)') AS is_valid FROM ({PARAGRAPHS})""")
def section_predicate(spark: SparkSession, sf: str) -> DataFrame:
    p = pages.paragraphs(texts(spark, sf))
    ok = F.length("content").between(200, 2000) & (tx.word_count("content") >= 10) & (tx.alnum_count("content") >= 0.6 * F.length("content")) & F.col("content").rlike("(?i)(the|und|que|les)")
    return p.select("doc_id", "ordem", ok.alias("is_valid"))


@query("""SELECT 'documents' AS source_table, count(DISTINCT source) AS n_distinct, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents
UNION ALL SELECT 'conversations', count(DISTINCT role), string_agg(DISTINCT role, ',' ORDER BY role) FROM conversations""")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    def of(name: str, c: str) -> DataFrame:
        return table(spark, sf, name).agg(F.count_distinct(c).alias("n_distinct"), F.array_join(F.array_sort(F.collect_set(c)), ",").alias("names")).select(F.lit(name).alias("source_table"), "n_distinct", "names")

    return of("documents", "source").unionByName(of("conversations", "role"))


_TERMS = r"SELECT DISTINCT lower(unnest(string_split(p_type, ' '))) AS term FROM part"
_BENCH = r"SELECT DISTINCT unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS term FROM benchmark"


@query(f"""WITH a AS ({_TERMS}), b AS ({_BENCH}) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_ops_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("term")).distinct()
    b = table(spark, sf, "benchmark").select(F.explode(tx.word_array(tx.window_text("text"))).alias("term")).distinct()
    rows = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", b.exceptAll(a.intersect(b)))]
    out = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n") for name, d in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 5")
def sample_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(25)


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || '42') LIMIT 50")
def sample_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return hash_sample(table(spark, sf, "documents").select("doc_id", "source"), F.col("doc_id"), 50)


@query("""SELECT conv_id, turn, CASE lower(trim(role)) WHEN 'decisao' THEN 'decisao' WHEN 'voto' THEN 'voto' ELSE 'outros' END AS section_type, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS group_code FROM conversations""")
def map_section_type(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.graph import group_code

    kind = F.when(F.col("role") == "user", "document").when(F.col("role") == "assistant", "section").otherwise("other")
    return table(spark, sf, "conversations").select("conv_id", "turn", extract.section_type(F.col("role")).alias("section_type"), group_code(kind).alias("group_code"))


@query(r"""WITH c AS (SELECT doc_id, text, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[_\-=*]{3,}$')), chr(10)) AS clean FROM documents)
SELECT doc_id, clean, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...' WHEN length(text) > 200 THEN text END AS generic FROM c""")
def section_split_generic(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", tx.clean_section("text").alias("clean"), extract.generic_section(F.col("text")).alias("generic"))


def _text_rules():
    from ..sources.dictionaries import SectionRule

    return (SectionRule("decisao", (r"(?:^|\n)\s*[A-Z]\w+ing\b",), 9, 100, 2000), SectionRule("voto", (r"(?:^|\n)\s*The\b",), 7, 50, 1000))


@query()
def section_extract(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_sections(texts(spark, sf), rules=_text_rules()).select("doc_id", "section_id", "section_type", "ordem", "start", "length")


def entity_rules():
    from ..sources.dictionaries import EntityRule

    return (
        EntityRule("pessoa", (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",), (), ("mail", "the")),
        EntityRule("orgao", (r"https?://[^\s)\"']+",), (), ("see", "by")),
        EntityRule("lei", (r"(?:Licensed under|Released under) ([A-Z][\w .-]{2,40})",), ((r"\.$", ""),), ("license",)),
    )


@query()
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_entities(texts(spark, sf), entity_rules())


@query()
def judges_laws_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = extract.extract_entities(texts(spark, sf), entity_rules())
    return extract.names_over(e, "lei", 0.7).withColumn("kind", F.lit("lei")).unionByName(extract.names_over(e, "pessoa", 0.8).withColumn("kind", F.lit("pessoa")))


EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"


@query(rf"""WITH e AS (SELECT 'email' AS entity_type, lower(unnest(regexp_extract_all(text, '{EMAIL}'))) AS name, doc_id FROM documents UNION ALL SELECT 'license', lower(unnest(regexp_extract_all(text, 'Licensed under [A-Za-z -]+'))), doc_id FROM documents)
SELECT entity_type, name, count(*) AS frequency, min(doc_id) AS first_doc FROM e GROUP BY entity_type, name HAVING count(*) >= 2""")
def entity_simple(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf)
    kinds = (("email", EMAIL), ("license", "Licensed under [A-Za-z -]+"))

    def matches(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), lambda x: F.struct(F.lit(kind).alias("entity_type"), F.lower(x).alias("name")))

    found = F.flatten(F.array(*(matches(*k) for k in kinds)))
    e = d.select("doc_id", F.explode(found).alias("e")).select("e.entity_type", "e.name", "doc_id")
    return e.groupBy("entity_type", "name").agg(F.count("*").alias("frequency"), F.min("doc_id").alias("first_doc")).where("frequency >= 2")


@query()
def contexts_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return extract.snippets(table(spark, sf, "documents"), "license", per_doc=2, at_most=20)


@query("SELECT md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) AS hit, count(*) AS n FROM documents GROUP BY 1")
def cache_miss_split(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    return relational.cache_split(d, d.where("doc_id % 3 = 0"), F.col("key"), F.col("key")).groupBy("hit").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, round(score_len, 6) AS score_len, round(score_id, 6) AS score_id, round(score_len + score_id, 6) AS total, n_keys FROM (SELECT doc_id, ln(1 + n_chars) AS score_len, log2(2 + doc_id) AS score_id, CASE WHEN lang = 'en' THEN 2 ELSE 3 END AS n_keys FROM documents)""")
def map_array_helpers(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("len"), F.log(1 + F.col("n_chars")), F.lit("id"), F.log2(2 + F.col("doc_id")))
    keys = F.array_union(F.array(F.lit("len"), F.lit("id")), F.array(F.when(F.col("lang") == "en", "id").otherwise(F.col("lang"))))
    d = table(spark, sf, "documents").select("doc_id", m.alias("m"), keys.alias("k"))
    return d.select("doc_id", F.round(F.element_at("m", "len"), 6).alias("score_len"), F.round(F.element_at("m", "id"), 6).alias("score_id"), F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("k").alias("n_keys"))


@query("""SELECT nat, CASE WHEN length(n_name) > 5 THEN substr(n_name, 1, 5) || '...' ELSE n_name END AS label, ('0x' || substr(h, 1, 2))::INT AS r, ('0x' || substr(h, 3, 2))::INT AS g, ('0x' || substr(h, 5, 2))::INT AS b FROM (SELECT n_nationkey AS nat, n_name, md5(n_name) AS h FROM nation)""")
def label_truncate_rgb(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nat"), tx.truncated("n_name", 5).alias("label"), tx.hex_to_rgb(F.concat(F.lit("#"), F.substring(F.md5("n_name"), 1, 6))).alias("c"))
    return n.select("nat", "label", "c.r", "c.g", "c.b")
