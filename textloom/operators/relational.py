"""Loads, filters, joins and summaries over relational inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def has_content(c: str = "html_completo", min_chars: int = 100) -> Column:
    return F.col(c).isNotNull() & (F.length(F.trim(F.col(c))) > min_chars)


def load_processes(processes: DataFrame, metadata: DataFrame, content: DataFrame, statuses=("processado", "pendente"), limit: int | None = None, offset: int = 0, include_empty: bool = False, fan_out: bool = False) -> DataFrame:
    """Processes with their metadata and num_secoes, newest first.

    Section counts are aggregated before the join, so several metadata rows don't
    multiply them; fan_out=True counts over the joined rows instead.
    """
    p = processes.where(F.col("status_processamento").isin(*statuses))
    if not include_empty:
        p = p.where(has_content())
    p = p.drop("tentativas")
    m = metadata.drop("id", "created_at").withColumnRenamed("processo_id", "id")
    own = [c for c in p.columns]
    more = [c for c in m.columns if c != "id"]
    if fan_out:
        c = content.select(F.col("processo_id").alias("id"), F.col("id").alias("_content_id"))
        out = p.join(m, "id", "left").join(c, "id", "left").groupBy(*own, *more).agg(F.count("_content_id").alias("num_secoes"))
    else:
        c = content.groupBy(F.col("processo_id").alias("id")).agg(F.count("*").alias("num_secoes"))
        out = p.join(m, "id", "left").distinct().join(c, "id", "left").withColumn("num_secoes", F.coalesce("num_secoes", F.lit(0)).cast("bigint"))
    out = out.orderBy(F.col("created_at").desc(), "id")
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def load_sections(content: DataFrame, ids: DataFrame) -> DataFrame:
    """Sections of the given process ids (column id), by process and place."""
    keys = ids.select(F.col("id").alias("processo_id")).distinct()
    return content.join(keys, "processo_id", "left_semi").orderBy("processo_id", "ordem")


def sample_documents(documents: DataFrame, n: int = 10, newest_first: str | None = None) -> DataFrame:
    order = [F.col(newest_first).desc(), F.col("doc_id")] if newest_first else [F.col("doc_id")]
    return documents.orderBy(*order).limit(n)


def unseen(rows: DataFrame, seen: DataFrame, key: Column, seen_key: Column) -> DataFrame:
    """Rows whose key is not among the seen ones."""
    return rows.withColumn("_key", key).join(seen.select(seen_key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def cache_split(rows: DataFrame, cache: DataFrame, key: Column, cache_key: Column) -> DataFrame:
    """Rows with `hit`: whether the cache holds their key. One join; the cache's keys are made distinct first."""
    keys = cache.select(cache_key.alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return rows.withColumn("_key", key).join(keys, "_key", "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_key", "_hit")


def distinct_list(df: DataFrame, by: str, value: str, top: int) -> DataFrame:
    """Per group: number of rows and the sorted distinct values; the top groups by count."""
    return (
        df.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(value)), ", ").alias("values"))
        .orderBy(F.desc("n"), by).limit(top)
    )


def preprocess_stats(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: totals, valid, empty, labelled, total and mean length."""
    d = documents.join(labelled.select("doc_id").distinct().withColumn("_l", F.lit(1)), "doc_id", "left")
    return d.agg(
        F.count("*").alias("n_documents"),
        F.count_if(tx.is_valid_document("text")).alias("n_valid"),
        F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("n_empty"),
        F.count("_l").alias("n_labelled"),
        F.sum(F.length("text")).alias("total_chars"),
        F.round(F.avg(F.length("text")), 6).alias("avg_chars"),
    )


def validation_summary(documents: DataFrame) -> DataFrame:
    ratio = F.avg(tx.is_valid_document("text").cast("double"))
    return documents.agg(
        F.count("*").alias("n"), F.round(ratio, 6).alias("valid_ratio"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"),
        F.min(F.length("text")).alias("min_chars"), F.max(F.length("text")).alias("max_chars"),
        (ratio < 0.9).alias("low_coverage"), (ratio < 0.5).alias("very_low_coverage"),
    )
