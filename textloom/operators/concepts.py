"""Concepts: dictionary matches, discovery of candidates, scores, categories, reports.

Texts are read as word sequences of `window_text`; a term of k words matches k
consecutive words, so matching is an equi-join of n-grams with the dictionary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.dictionaries import CATEGORIES, STOP_WORDS, all_concepts
from . import grams

# A dictionary up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 200_000


def dictionary(spark: SparkSession, terms=None, extra: tuple[str, ...] = ()) -> DataFrame:
    """term, words (its number), from given terms or the default ones, with extra terms added."""
    terms = list(dict.fromkeys([*(terms if terms is not None else all_concepts()), *extra]))
    d = spark.createDataFrame([(t,) for t in terms], "termo string")
    return d.select("termo", tx.window_text("termo").alias("term")).where("term <> ''").dropDuplicates(["term"]).withColumn("words", F.size(F.split("term", " ")))


def small(d: DataFrame, n: int) -> DataFrame:
    return F.broadcast(d) if n <= BROADCAST_TERMS else d


def words(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, w (its words), n."""
    w = tx.word_array(tx.window_text("text"))
    return docs.select("doc_id", w.alias("w")).withColumn("n", F.size("w"))


def normal(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words as words() reads them, joined by single spaces."""
    return docs.select("doc_id", tx.window_text("text").alias("text"))


def ngrams(d: DataFrame, low: int, high: int) -> DataFrame:
    """words() -> doc_id, n, pos (from 0), size, gram: all n-grams of low to high words."""
    empty = F.array().cast("array<struct<pos:int,size:int,gram:string>>")

    def of_size(k: int) -> Column:
        places = F.sequence(F.lit(0), F.col("n") - k)
        return F.when(F.col("n") >= k, F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("size"), F.concat_ws(" ", *(F.get("w", i + j) for j in range(k))).alias("gram")))).otherwise(empty)

    every = F.concat(*(of_size(k) for k in range(low, high + 1)))
    return d.select("doc_id", "n", F.explode(every).alias("g")).select("doc_id", "n", "g.pos", "g.size", "g.gram")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, n (words of the text), pos, size, term: every place of every term."""
    stats = terms.agg(F.count("*"), F.max("words"), F.min("words")).first()
    if not stats[0]:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, pos int, size int, term string")
    t = terms.select("term")
    if stats[0] <= BROADCAST_TERMS:
        listed = [r["term"] for r in t.collect()]
        if len(set(listed)) == len(listed) and None not in listed:
            return grams.occurrences(normal(docs), listed)
    return ngrams(words(docs), stats[2], stats[1]).withColumnRenamed("gram", "term").join(small(t, stats[0]), "term").select("doc_id", "n", "pos", "size", "term")


def frequency(occ: DataFrame) -> DataFrame:
    """term, total and document frequency."""
    per = occ.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def predefined_tfidf(occ: DataFrame, n_docs: int) -> DataFrame:
    """term, df, score: mean of matches per word over matching documents, times ln(N / df)."""
    per = occ.groupBy("term", "doc_id").agg((F.count("*") / F.first("n")).alias("share"))
    return per.groupBy("term").agg(F.count("*").alias("df"), (F.avg("share") * F.log(F.lit(float(n_docs)) / F.count("*"))).alias("tfidf"))


def all_stops(c: Column, stop=STOP_WORDS) -> Column:
    """Whether a space-joined phrase has stop words only; one regex that most phrases leave at their first word."""
    one = "(?:" + "|".join(re.escape(x) for x in stop) + ")"
    return c.rlike(f"^{one}(?: {one})*$") if stop else F.lit(False)


def candidate(c: Column | str, stop=STOP_WORDS, low: int = 6, high: int = 60, max_digits: int = 4) -> Column:
    """The predicate of discovery: low to high characters, 2 to 4 words, few digits, not all stop words."""
    c = tx.col(c)
    return F.length(c).between(low, high) & tx.count_of(c, " ").between(1, 3) & (tx.digit_count(c) <= max_digits) & ~all_stops(c, stop)


def strict_candidate(c: Column | str, stop=STOP_WORDS) -> Column:
    """5 to 50 characters, 2 to 4 words, at most 30 % digits, not all stop words, no leading digit, one-letter or repeated word."""
    c = tx.col(c)
    w = F.split(c, " ")
    plain = ~c.rlike(r"^[0-9]") & ~c.rlike(r"^[^ ] | [^ ]$") & (F.size(F.array_distinct(w)) == F.size(w))
    return F.length(c).between(5, 50) & F.size(w).between(2, 4) & (tx.digit_count(c) <= 0.3 * F.length(c)) & ~all_stops(c, stop) & plain


def candidate_counts(docs: DataFrame, low: int = 2, high: int = 4, strict: bool = False, stop=STOP_WORDS) -> DataFrame:
    """gram, total, df over all texts."""
    g = ngrams(words(docs), low, high).where(strict_candidate("gram", stop) if strict else candidate("gram", stop))
    per = g.groupBy("gram", "doc_id").agg(F.count("*").alias("tf"))
    return per.groupBy("gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def top_candidates(docs: DataFrame, top: int, strict: bool = False, stop=STOP_WORDS) -> DataFrame:
    """The rows of candidate_counts() of greatest total (ties by gram), in that order."""
    fits = strict_candidate("gram", stop) if strict else candidate("gram", stop)
    counts = grams.frequent(normal(docs), top, 4, fits)
    counts = candidate_counts(docs, strict=strict, stop=stop) if counts is None else counts.where(fits)
    return counts.orderBy(F.desc("total"), "gram").limit(top)


# Words that raise or lower a concept's confidence.
LEGAL_WORDS = r"(?i)direito|lei|código|processo|recurso|sentença|contrato|dano|juros|banco"
GENERIC_WORDS = r"(?i)^(?:caso|forma|parte|vez|dia|ano|valor|meio)(?: |$)"


def concept_confidence(term: Column, tfidf: Column, df: Column, n_docs: Column) -> Column:
    ratio = df / n_docs
    score = (
        F.lit(0.5)
        + F.when(tfidf > 0.2, 0.2).when(tfidf > 0.1, 0.1).otherwise(0.0)
        + F.when(ratio > 0.1, 0.2).when(ratio > 0.05, 0.1).otherwise(0.0)
        + F.when(term.rlike(LEGAL_WORDS), 0.1).otherwise(0.0)
        - F.when(term.rlike(GENERIC_WORDS), 0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def discover(docs: DataFrame, counts: DataFrame, min_df: int = 2, min_tfidf: float = 0.12, min_confidence: float = 0.6, at_most: int = 75, max_candidates: int = 500) -> DataFrame:
    """Top candidates by frequency, scored tf * ln(N / df) with tf = total / all words, kept over the thresholds."""
    totals = words(docs).agg(F.sum("n").alias("all_words"), F.count("*").alias("n_docs")).first()
    all_words, n_docs = float(totals["all_words"] or 1), float(totals["n_docs"] or 1)
    top = counts.orderBy(F.desc("total"), "gram").limit(max_candidates)
    tfidf = F.col("total") / all_words * F.log(F.lit(n_docs) / F.col("df"))
    scored = top.withColumn("tfidf", tfidf).withColumn("confidence", concept_confidence(F.col("gram"), F.col("tfidf"), F.col("df"), F.lit(n_docs)))
    return scored.where((F.col("df") >= min_df) & (F.col("tfidf") >= min_tfidf) & (F.col("confidence") >= min_confidence)).orderBy(F.desc("tfidf"), "gram").limit(at_most)


def running_tfidf(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The variant whose document frequency runs along the documents: mean over matching documents of tf * ln(N / df so far)."""
    n_docs = docs.count()
    per = occurrences(docs, terms).groupBy("term", "doc_id").agg((F.count("*") / F.first("n")).alias("tf"))
    w = Window.partitionBy("term").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.withColumn("df", F.count("*").over(w))
    return run.groupBy("term").agg(F.count("*").alias("df"), F.avg(F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("tfidf"))


def rank(concepts: DataFrame) -> DataFrame:
    """concepts(termo, confidence, tfidf, pos): one row per normalised term (a later one only if strictly more confident), by 0.6 * confidence + 0.4 * min(tfidf, 1)."""
    w = Window.partitionBy("term").orderBy(F.desc("confidence"), "pos")
    d = concepts.withColumn("term", tx.normalize_concept("termo")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return d.withColumn("score", 0.6 * F.col("confidence") + 0.4 * F.least(F.col("tfidf"), F.lit(1.0))).orderBy(F.desc("score"), "term")


def category_of(term: Column, categories=CATEGORIES, default: str = "Outros") -> Column:
    """The first category with the term as member (lower case) or a keyword inside it."""
    t = F.lower(term)
    out = None
    for c in categories:
        hit = t.isin(*(x.lower() for x in c.concepts))
        for k in c.keywords:
            hit = hit | F.contains(t, F.lit(k))
        out = F.when(hit, c.name) if out is None else out.when(hit, c.name)
    return out.otherwise(default)


def coverage(concepts: DataFrame) -> DataFrame:
    """concepts(term, category, total) -> per category: count, sum, mean and the most frequent term."""
    return concepts.groupBy("category").agg(
        F.count("*").alias("n_concepts"), F.sum("total").alias("total"), F.round(F.avg("total"), 6).alias("mean_total"),
        F.min_by("term", F.struct(-F.col("total"), F.col("term"))).alias("top_term"),
    )


def concept_table(docs: DataFrame, terms: DataFrame, max_candidates: int = 500, discovered: bool = True, categories=CATEGORIES, **thresholds) -> DataFrame:
    """termo, termo_original, categoria, frequencia, frequencia_documentos, score_tfidf, confianca, predefinido: dictionary terms, then discovered ones."""
    n_docs = docs.count()
    occ = occurrences(docs, terms)
    f = frequency(occ).join(predefined_tfidf(occ, n_docs).select("term", "tfidf"), "term").join(terms.select("term", "termo"), "term")
    known = f.select(
        tx.normalize_concept("termo").alias("termo"), F.col("termo").alias("termo_original"), category_of(F.col("termo"), categories).alias("categoria"), F.col("total").alias("frequencia"), F.col("df").alias("frequencia_documentos"),
        F.col("tfidf").alias("score_tfidf"), concept_confidence(F.col("termo"), F.col("tfidf"), F.col("df"), F.lit(float(max(1, n_docs)))).alias("confianca"), F.lit(True).alias("predefinido"),
    )
    if not discovered:
        return known
    new = discover(docs, top_candidates(docs, max_candidates), max_candidates=max_candidates, **thresholds).join(terms.select(F.col("term").alias("gram")), "gram", "left_anti")
    found = new.select(
        tx.normalize_concept("gram").alias("termo"), F.col("gram").alias("termo_original"), category_of(F.col("gram"), categories).alias("categoria"), F.col("total").alias("frequencia"), F.col("df").alias("frequencia_documentos"),
        F.col("tfidf").alias("score_tfidf"), F.col("confidence").alias("confianca"), F.lit(False).alias("predefinido"),
    )
    both = known.unionByName(found)
    w = Window.partitionBy("termo").orderBy(F.desc("confianca"), F.desc("predefinido"), "termo_original")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
