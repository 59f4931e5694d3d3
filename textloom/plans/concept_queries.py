"""Queries over concepts and their co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import concepts as cp
from ..operators import cooccurrence as co
from ..operators import vectors as vc
from ..sources.dictionaries import STOP_WORDS, Category
from .registry import query, table, texts
from .text_queries import WINDOW_TEXT

# Terms that the synthetic texts hold, single words and phrases.
TERMS = ("thing", "tion", "thand", "ing", "haing", "rean", "thble", "of the", "in the", "que la", "erung", "keit")
CATEGORY_RULES = (Category("articles", ("the", "la"), ("der",), 1.0), Category("endings", ("ing", "tion"), ("keit",), 1.0))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOPS = _list(STOP_WORDS)
WORDS = f"words AS (SELECT doc_id, w, CASE WHEN array_to_string(w, ' ') = '' THEN 0 ELSE len(w) END AS n FROM (SELECT doc_id, string_split({WINDOW_TEXT}, ' ') AS w FROM documents))"
TERM_ROWS = f"terms AS (SELECT unnest({_list(TERMS)}) AS term)"
OCC = f"""{WORDS}, {TERM_ROWS}, spots AS (SELECT doc_id, n, i - 1 AS pos, w[i] AS t1, CASE WHEN i < n THEN w[i] || ' ' || w[i + 1] END AS t2 FROM words, unnest(range(1, n + 1)) u(i)),
occ AS (SELECT doc_id, n, pos, 1 AS size, term FROM spots JOIN terms ON t1 = term UNION ALL SELECT doc_id, n, pos, 2, term FROM spots JOIN terms ON t2 = term)"""
GRAMS = f"""{WORDS}, grams AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS gram FROM words, unnest(range(2, 5)) s(k), unnest(range(1, n + 1)) u(i) WHERE i + k - 1 <= n)"""
FAST = f"length(gram) BETWEEN 6 AND 60 AND length(regexp_replace(gram, '[^0-9]', '', 'g')) <= 4 AND len(list_filter(string_split(gram, ' '), lambda x: NOT list_contains({STOPS}, x))) > 0"
STRICT = f"""length(gram) BETWEEN 5 AND 50 AND length(regexp_replace(gram, '[^0-9]', '', 'g')) <= 0.3 * length(gram) AND len(list_filter(string_split(gram, ' '), lambda x: NOT list_contains({STOPS}, x))) > 0
AND NOT regexp_matches(gram, '^[0-9]') AND NOT regexp_matches(gram, '^[^ ] | [^ ]$') AND len(list_distinct(string_split(gram, ' '))) = len(string_split(gram, ' '))"""
COUNTS = "counts AS (SELECT gram, count(*) AS total, count(DISTINCT doc_id) AS df FROM grams WHERE {0} GROUP BY gram)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", "text")


def terms(spark: SparkSession) -> DataFrame:
    return cp.dictionary(spark, TERMS)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {GRAMS}, {COUNTS.format(FAST)} SELECT * FROM counts ORDER BY total DESC, gram LIMIT 100")
def ngram_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return cp.top_candidates(docs(spark, sf), 100)


@query(f"WITH {GRAMS}, {COUNTS.format(STRICT)} SELECT * FROM counts ORDER BY total DESC, gram LIMIT 100")
def ngram_candidates_strict(spark: SparkSession, sf: str) -> DataFrame:
    return cp.top_candidates(docs(spark, sf), 100, strict=True)


CONFIDENCE = """greatest(0.0, least(1.0, 0.5::DOUBLE + CASE WHEN tfidf > 0.2 THEN 0.2 WHEN tfidf > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN df / n_docs > 0.1 THEN 0.2 WHEN df / n_docs > 0.05 THEN 0.1 ELSE 0 END
+ CASE WHEN regexp_matches(gram, '(?i)direito|lei|código|processo|recurso|sentença|contrato|dano|juros|banco') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(gram, '(?i)^(?:caso|forma|parte|vez|dia|ano|valor|meio)(?: |$)') THEN 0.2 ELSE 0 END))"""
SCORED = f"""totals AS (SELECT sum(n)::DOUBLE AS all_words, count(*)::DOUBLE AS n_docs FROM words), top AS (SELECT * FROM counts ORDER BY total DESC, gram LIMIT 500),
scored AS (SELECT gram, total, df, n_docs, total / all_words * ln(n_docs / df) AS tfidf FROM top, totals), judged AS (SELECT *, {CONFIDENCE} AS confidence FROM scored)"""


@query(f"WITH {GRAMS}, {COUNTS.format(FAST)}, {SCORED} SELECT gram, total, df, round(tfidf, 6) AS tfidf, round(confidence, 6) AS confidence FROM judged WHERE df >= 2 AND tfidf >= 0.0005 AND confidence >= 0.5 ORDER BY round(tfidf, 12) DESC, gram LIMIT 75")
def candidate_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return cp.discover(d, cp.top_candidates(d, 500), min_tfidf=0.0005, min_confidence=0.5).select("gram", "total", "df", *r6("tfidf", "confidence"))


@query(f"""WITH {OCC}, per AS (SELECT term, doc_id, count(*) / first(n)::DOUBLE AS tf FROM occ GROUP BY term, doc_id), run AS (SELECT *, count(*) OVER (PARTITION BY term ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS df FROM per)
SELECT term, count(*) AS df, round(avg(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS tfidf FROM run GROUP BY term""")
def candidate_tfidf_running(spark: SparkSession, sf: str) -> DataFrame:
    return cp.running_tfidf(docs(spark, sf), terms(spark)).select("term", "df", *r6("tfidf"))


@query(f"WITH {OCC} SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM occ GROUP BY term")
def concept_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return cp.frequency(cp.occurrences(docs(spark, sf), terms(spark)))


@query(f"""WITH {OCC}, per AS (SELECT term, doc_id, count(*) / first(n)::DOUBLE AS share FROM occ GROUP BY term, doc_id)
SELECT term, count(*) AS df, round(avg(share) * ln((SELECT count(*) FROM documents)::DOUBLE / count(*)), 6) AS tfidf FROM per GROUP BY term""")
def concept_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return cp.predefined_tfidf(cp.occurrences(d, terms(spark)), d.count()).select("term", "df", *r6("tfidf"))


@query(r"""WITH p AS (SELECT p_type AS termo, p_partkey AS pos, (p_size % 10) / 10.0::DOUBLE AS confidence, (p_partkey % 17) / 10.0::DOUBLE AS tfidf FROM part), n AS (SELECT *, trim(regexp_replace(lower(termo), '\s+', ' ', 'g')) AS term FROM p)
SELECT term, pos, round(0.6 * confidence + 0.4 * least(tfidf, 1.0), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, pos) AS r FROM n) WHERE r = 1""")
def concept_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_type").alias("termo"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 10 / 10.0).alias("confidence"), (F.col("p_partkey") % 17 / 10.0).alias("tfidf"))
    return cp.rank(p).select("term", "pos", *r6("score"))


CATEGORY = "CASE WHEN lower({0}) IN ('der') OR contains(lower({0}), 'the') OR contains(lower({0}), 'la') THEN 'articles' WHEN lower({0}) IN ('keit') OR contains(lower({0}), 'ing') OR contains(lower({0}), 'tion') THEN 'endings' ELSE 'Outros' END"


@query(f"WITH {TERM_ROWS} SELECT term, {CATEGORY.format('term')} AS category FROM terms")
def concept_category(spark: SparkSession, sf: str) -> DataFrame:
    return terms(spark).select("term", cp.category_of(F.col("term"), CATEGORY_RULES).alias("category"))


@query(f"""WITH {OCC}, f AS (SELECT term, count(*) AS total FROM occ GROUP BY term), c AS (SELECT *, {CATEGORY.format('term')} AS category FROM f)
SELECT category, count(*) AS n_concepts, sum(total)::BIGINT AS total, round(avg(total), 6) AS mean_total, first(term ORDER BY total DESC, term) AS top_term FROM c GROUP BY category""")
def concept_coverage(spark: SparkSession, sf: str) -> DataFrame:
    f = cp.frequency(cp.occurrences(docs(spark, sf), terms(spark)))
    return cp.coverage(f.withColumn("category", cp.category_of(F.col("term"), CATEGORY_RULES)))


@query(f"""WITH {WORDS} SELECT term, count(*) AS n_docs FROM (SELECT unnest(['thing', 'ingen', 'thal']) AS term) t, documents d
WHERE regexp_matches(text, CASE term WHEN 'thal' THEN '(?i)(^|[^\\p{{L}}\\p{{N}}_])tha(?:l|is)([^\\p{{L}}\\p{{N}}_]|$)' ELSE '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || term || 's?([^\\p{{L}}\\p{{N}}_]|$)' END) GROUP BY term""".replace("\\\\", "\\"))
def concept_regex_plural(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    out = [d.where(F.col("text").rlike(cp_pattern(t))).agg(F.count("*").alias("n_docs")).select(F.lit(t).alias("term"), "n_docs") for t in ("thing", "ingen", "thal")]
    return out[0].unionByName(out[1]).unionByName(out[2]).where("n_docs > 0")


def cp_pattern(term: str) -> str:
    return tx.concept_pattern(term)


FULL = f"""{OCC}, {GRAMS.split(WORDS + ', ')[1]}, {COUNTS.format(FAST)}, {SCORED}, per AS (SELECT term, doc_id, count(*) AS tf, count(*) / first(n)::DOUBLE AS share FROM occ GROUP BY term, doc_id),
known AS (SELECT term AS gram, sum(tf)::BIGINT AS total, count(*) AS df, avg(share) * ln((SELECT n_docs FROM totals) / count(*)) AS tfidf, (SELECT n_docs FROM totals) AS n_docs FROM per GROUP BY term),
found AS (SELECT gram, total, df, tfidf, confidence, false AS predefinido FROM (SELECT * FROM judged WHERE df >= 2 AND tfidf >= 0.0005 AND confidence >= 0.5 ORDER BY round(tfidf, 12) DESC, gram LIMIT 75) WHERE gram NOT IN (SELECT term FROM terms)),
both_kinds AS (SELECT gram, total, df, tfidf, {CONFIDENCE} AS confidence, true AS predefinido FROM known UNION ALL SELECT * FROM found)"""
FULL_ROWS = f"SELECT gram AS termo, gram AS termo_original, {CATEGORY.format('gram')} AS categoria, total AS frequencia, df AS frequencia_documentos, round(tfidf, 6) AS score_tfidf, round(confidence, 6) AS confianca, predefinido FROM both_kinds"


def _concepts(spark: SparkSession, sf: str, discovered: bool) -> DataFrame:
    t = cp.concept_table(docs(spark, sf), terms(spark), discovered=discovered, categories=CATEGORY_RULES, **({"min_tfidf": 0.0005, "min_confidence": 0.5} if discovered else {}))
    return t.select("termo", "termo_original", "categoria", "frequencia", "frequencia_documentos", *r6("score_tfidf", "confianca"), "predefinido")


@query(f"WITH {FULL} {FULL_ROWS}")
def concepts_full(spark: SparkSession, sf: str) -> DataFrame:
    return _concepts(spark, sf, True)


@query(f"WITH {FULL} {FULL_ROWS} WHERE predefinido")
def concept_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return _concepts(spark, sf, False)


WINDOWS = f"""{OCC}, spread AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, pos + size - 10), least(pos, n - 10) + 1)) AS start FROM occ WHERE n >= 10),
wins AS (SELECT doc_id, start, list_sort(list(term)) AS terms FROM spread GROUP BY doc_id, start HAVING count(*) >= 2)"""
PAIRS = f"""{WINDOWS}, kept AS (SELECT s.* FROM spread s JOIN wins USING (doc_id, start)), total AS (SELECT count(*)::DOUBLE AS t FROM wins), single AS (SELECT term, count(*) AS freq FROM kept GROUP BY term),
joint AS (SELECT a.term AS c1, b.term AS c2, count(*) AS joint FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.start = b.start AND a.term < b.term GROUP BY 1, 2),
raw AS (SELECT c1, c2, joint, a.freq AS f1, b.freq AS f2, t, log2((joint / t) / ((a.freq / t) * (b.freq / t))) AS pmi, -log2(joint / t) AS h, joint / least(a.freq, b.freq) AS ratio FROM joint JOIN single a ON a.term = c1 JOIN single b ON b.term = c2, total WHERE joint >= 2 AND a.freq >= 3 AND b.freq >= 3),
pairs AS (SELECT c1, c2, joint, f1, f2, t::BIGINT AS total, pmi, CASE WHEN joint < t THEN greatest(-1.0, least(1.0, pmi / h)) END AS npmi, least(1.0, (0.5 + CASE WHEN joint >= 5 THEN 0.3 WHEN joint >= 3 THEN 0.2 ELSE 0 END + CASE WHEN ratio > 0.5 THEN 0.2 WHEN ratio > 0.3 THEN 0.1 ELSE 0 END) * CASE WHEN joint = 1 THEN 0.7 ELSE 1 END)::DOUBLE AS confidence FROM raw)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return co.pmi_pairs(docs(spark, sf), terms(spark))


@query(f"WITH {WINDOWS} SELECT doc_id, count(*) AS n_windows FROM wins GROUP BY doc_id")
def cooc_windows(spark: SparkSession, sf: str) -> DataFrame:
    return co.window_terms(docs(spark, sf), terms(spark)).groupBy("doc_id").agg(F.count("*").alias("n_windows"))


@query(f"WITH {PAIRS} SELECT c1, c2, joint, f1, f2, total, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(confidence, 6) AS confidence, round(pmi * confidence, 6) AS weighted FROM pairs")
def pmi_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("c1", "c2", "joint", "f1", "f2", "total", *r6("pmi", "npmi", "confidence", "weighted"))


@query(f"WITH {PAIRS} SELECT c1, c2, joint, round(pmi, 6) AS pmi FROM pairs WHERE pmi >= 0.05 ORDER BY round(pmi, 6) DESC, c1, c2 LIMIT 10")
def pmi_top(spark: SparkSession, sf: str) -> DataFrame:
    return co.strongest(pairs(spark, sf), 10, 0.05).select("c1", "c2", "joint", *r6("pmi"))


@query(f"WITH {PAIRS} SELECT CASE WHEN c1 = 'thing' THEN c2 ELSE c1 END AS term, round(pmi, 6) AS pmi, round(pmi * confidence, 6) AS weighted FROM pairs WHERE c1 = 'thing' OR c2 = 'thing' ORDER BY weighted DESC, term LIMIT 5")
def pmi_target(spark: SparkSession, sf: str) -> DataFrame:
    return co.associations(pairs(spark, sf), "thing").select("term", *r6("pmi", "weighted"))


@query(f"WITH {PAIRS} SELECT round(avg(w), 6) AS mean_pmi, round(max(w), 6) AS max_pmi, count(*) AS n_pairs, round(2 * count(*) / {float(len(TERMS)) ** 2}, 6) AS density FROM (SELECT pmi * confidence AS w FROM pairs) WHERE w > 0")
def pmi_network(spark: SparkSession, sf: str) -> DataFrame:
    return co.network(pairs(spark, sf), len(TERMS))


@query(f"WITH {PAIRS}, wanted AS (SELECT a.term AS a, b.term AS b FROM terms a, terms b WHERE a.term <> b.term) SELECT a, b, round(coalesce(pmi * confidence, 0), 6) AS score FROM wanted LEFT JOIN pairs ON c1 = least(a, b) AND c2 = greatest(a, b)")
def pmi_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = sorted(TERMS)
    wanted = spark.createDataFrame([(a, b) for a in t for b in t if a != b], "a string, b string")
    return co.pair_scores(wanted, pairs(spark, sf)).select("a", "b", *r6("score"))


@query(f"WITH {PAIRS} SELECT c1 AS row, c2 AS col, round(pmi * confidence, 6) AS score FROM pairs UNION ALL SELECT c2, c1, round(pmi * confidence, 6) FROM pairs")
def pmi_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return co.matrix(pairs(spark, sf)).select("row", "col", *r6("score"))


@query(f"""WITH {WINDOWS}, hit AS (SELECT doc_id, start FROM wins WHERE list_contains(terms, 'of the') AND list_contains(terms, 'thing') ORDER BY doc_id, start LIMIT 5)
SELECT doc_id, start, array_to_string(w[start + 1:start + 10], ' ') AS context FROM hit JOIN words USING (doc_id)""")
def cooc_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return co.contexts(docs(spark, sf), terms(spark), "of the", "thing")


_SUBSTRINGS = ("erung", "haing", "thand", "thble")


@query(f"""WITH {WORDS}, win AS (SELECT array_to_string(w[i:i + 9], ' ') AS win FROM words, unnest(range(1, greatest(n, 1) + 1)) u(i)), t AS (SELECT unnest({_list(_SUBSTRINGS)}) AS term)
SELECT a.term AS c1, b.term AS c2, count(*) FILTER (WHERE contains(win, a.term) AND contains(win, b.term)) AS joint FROM t a JOIN t b ON a.term < b.term, win GROUP BY 1, 2""")
def joint_substring_counts(spark: SparkSession, sf: str) -> DataFrame:
    return co.joint_substring_counts(docs(spark, sf), list(_SUBSTRINGS))


@query(f"""WITH {OCC}, tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents WHERE trim(text) <> ''),
x AS (SELECT doc_id, term, tf, df, ln((1.0 + n)::DOUBLE / (1.0 + df)) + 1.0 AS idf FROM tf JOIN df USING (term), n), y AS (SELECT *, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY doc_id)) AS weight FROM x)
SELECT doc_id, term, tf, df, round(idf, 6) AS idf, round(weight, 6) AS weight FROM y WHERE weight >= 0.1""")
def relevance_edges(spark: SparkSession, sf: str) -> DataFrame:
    return vc.relevance(docs(spark, sf), terms(spark)).select("doc_id", "term", "tf", "df", *r6("idf", "weight"))


@query()
def tfidf_svd_embed(spark: SparkSession, sf: str) -> DataFrame:
    v = vc.tfidf_svd(docs(spark, sf))
    return v.select("doc_id", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_length"))
