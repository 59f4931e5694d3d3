"""Term co-occurrence in sliding word windows: PMI, NPMI, confidence, networks.

A window is `size` consecutive words; a text of n words has max(0, n - size + 1).
Instead of building windows, each place of a term is expanded to the windows that hold it
whole; texts without terms cost nothing after the dictionary join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .concepts import occurrences, words


def window_terms(docs: DataFrame, terms: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, start, terms: the sorted distinct terms of each window that holds two or more."""
    occ = occurrences(docs, terms).where(F.col("n") >= size)
    first, last = F.greatest(F.lit(0), F.col("pos") + F.col("size") - size), F.least(F.col("pos"), F.col("n") - size)
    spread = occ.where(first <= last).select("doc_id", "term", F.explode(F.sequence(first, last)).alias("start"))
    return spread.groupBy("doc_id", "start").agg(F.array_sort(F.collect_set("term")).alias("terms")).where(F.size("terms") >= 2)


def window_counts(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows per term, and per pair c1 < c2."""
    single = windows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    n = F.size("terms")
    pairs = F.flatten(F.transform(F.slice("terms", 1, n - 1), lambda a, i: F.transform(F.slice("terms", i + 2, n), lambda b: F.struct(a.alias("c1"), b.alias("c2")))))
    joint = windows.select(F.explode(pairs).alias("p")).groupBy("p.c1", "p.c2").agg(F.count("*").alias("joint"))
    return single, joint


def pmi_confidence(joint: Column, f1: Column, f2: Column) -> Column:
    ratio = joint / F.least(f1, f2)
    c = F.lit(0.5) + F.when(joint >= 5, 0.3).when(joint >= 3, 0.2).otherwise(0.0) + F.when(ratio > 0.5, 0.2).when(ratio > 0.3, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(joint == 1, c * 0.7).otherwise(c))


def pmi_pairs(docs: DataFrame, terms: DataFrame, size: int = 10, min_joint: int = 2, min_freq: int = 3, all_windows: bool = False) -> DataFrame:
    """c1, c2, joint, f1, f2, total, pmi, npmi (null where every window holds the pair), confidence, weighted.

    The population is the windows with two or more terms; all_windows=True counts every window of every text.
    """
    windows = window_terms(docs, terms, size).persist()
    single, joint = window_counts(windows)
    if all_windows:
        total = words(docs).agg(F.sum(F.greatest(F.lit(0), F.col("n") - size + 1))).first()[0] or 0
    else:
        total = windows.count()
    total = float(total)
    a, b = single.select(F.col("term").alias("c1"), F.col("freq").alias("f1")), single.select(F.col("term").alias("c2"), F.col("freq").alias("f2"))
    j = joint.where(F.col("joint") >= min_joint).join(F.broadcast(a), "c1").join(F.broadcast(b), "c2").where((F.col("f1") >= min_freq) & (F.col("f2") >= min_freq))
    p = F.col("joint") / total
    pmi = F.log2(p / ((F.col("f1") / total) * (F.col("f2") / total)))
    j = j.withColumn("total", F.lit(total).cast("bigint")).withColumn("pmi", pmi)
    # greatest() and least() skip nulls, so the undefined case is set apart
    npmi = F.when(p < 1, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pmi") / -F.log2(p))))
    j = j.withColumn("npmi", npmi).withColumn("confidence", pmi_confidence(F.col("joint"), F.col("f1"), F.col("f2")))
    return j.withColumn("weighted", F.col("pmi") * F.col("confidence")).select("c1", "c2", "joint", "f1", "f2", "total", "pmi", "npmi", "confidence", "weighted")


def strongest(pairs: DataFrame, top: int = 10, min_pmi: float = 0.5) -> DataFrame:
    return pairs.where(F.col("pmi") >= min_pmi).orderBy(F.desc(F.round("pmi", 6)), "c1", "c2").limit(top)


def associations(pairs: DataFrame, target: str, top: int = 5) -> DataFrame:
    """The terms most associated with one term."""
    other = F.when(F.col("c1") == target, F.col("c2")).otherwise(F.col("c1"))
    return pairs.where((F.col("c1") == target) | (F.col("c2") == target)).select(other.alias("term"), "pmi", "weighted").orderBy(F.desc(F.round("weighted", 6)), "term").limit(top)


def pair_scores(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """wanted(a, b) -> its weighted PMI, in either order; 0 where it has none."""
    w = wanted.select("a", "b", F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2"))
    return w.join(pairs.select("c1", "c2", "weighted"), ["c1", "c2"], "left").select("a", "b", F.coalesce("weighted", F.lit(0.0)).alias("score"))


def matrix(pairs: DataFrame) -> DataFrame:
    """Long form of the symmetric matrix: row, col, score."""
    return pairs.select(F.col("c1").alias("row"), F.col("c2").alias("col"), F.col("weighted").alias("score")).unionByName(pairs.select(F.col("c2").alias("row"), F.col("c1").alias("col"), F.col("weighted").alias("score")))


def network(pairs: DataFrame, n_terms: int) -> DataFrame:
    """Mean and maximum of positive entries, number of positive pairs, density over n^2 cells."""
    pos = pairs.where("weighted > 0")
    return pos.agg(F.round(F.avg("weighted"), 6).alias("mean_pmi"), F.round(F.max("weighted"), 6).alias("max_pmi"), F.count("*").alias("n_pairs"), F.round(2 * F.count("*") / F.lit(float(n_terms) ** 2), 6).alias("density"))


def contexts(docs: DataFrame, terms: DataFrame, c1: str, c2: str, size: int = 10, top: int = 5) -> DataFrame:
    """The first windows, in document order, that hold both terms."""
    w = window_terms(docs, terms, size).where(F.array_contains("terms", c1) & F.array_contains("terms", c2)).orderBy("doc_id", "start").limit(top)
    return w.join(words(docs), "doc_id").select("doc_id", "start", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("context")).orderBy("doc_id", "start")


def joint_substring_counts(docs: DataFrame, terms: list[str], size: int = 10) -> DataFrame:
    """Frequencies by substring: per pair, the windows (short ones at the text's end included) whose words hold both strings, and each string's occurrences."""
    d = words(docs)
    win = d.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("win"))
    pairs = [(a, b) for i, a in enumerate(sorted(terms)) for b in sorted(terms)[i + 1 :]]
    holds = {t: F.contains("win", F.lit(t)) for t in terms}
    joint = win.agg(*(F.count_if(holds[a] & holds[b]).alias(f"j{i}") for i, (a, b) in enumerate(pairs)))
    return joint.select(F.explode(F.array(*(F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"j{i}").alias("joint")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.c1", "p.c2", "p.joint")
