"""Token counts through a digest cache.

Content is normalised (null becomes empty) and named by its SHA-256; the cache
holds (content_digest, tokenizer_digest, n_tokens). A run joins its distinct
digests to the cache, encodes each distinct miss once, appends the new counts to
the cache and joins the counts back to every document.

Edge cases. Null and empty text: 0 bytes, 0 tokens. Copies share one encoding,
also within a run; a hot digest is pre-aggregated before the shuffle and only its
id rows (never its texts) meet the joined counts. An empty table gives an empty
result and appends nothing. A failed run leaves at most counts that are right.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, as_texts, fresh_path, map_arrow, written
from ._tokenize import file_digest, sentence_pieces

# Copies from which a digest's count is broadcast (counted; about 60 bytes each) instead of shuffled to.
HOT_COPIES = 64

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, model_path: str, cache_path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token_cache")
    version = file_digest(model_path)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    cache = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest")
    distinct = d.groupBy("content_digest").agg(F.first("text").alias("text"))
    misses = distinct.join(cache, "content_digest", "left_anti")

    def encode(batches):
        counter = sentence_pieces(model_path)
        for b in batches:
            counts = [counter.count(t) for t in as_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    map_arrow(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # two runs may append the same miss; both counts are equal
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    ids = d.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "content_digest")
    # a digest of many documents is one row, sent to every task; all others meet in the shuffle. A left join: no document can go missing.
    hot = ids.groupBy("content_digest").agg(F.count("*").alias("copies")).where(F.col("copies") >= HOT_COPIES)
    hot = written(hot.join(counts, "content_digest").select("content_digest", F.col("n_tokens").alias("hot_tokens")), "hot_digests")
    n_hot = hot.count()
    if 0 < n_hot <= BROADCAST_ROWS // 4:
        ids = ids.join(F.broadcast(hot), "content_digest", "left")
        # known rows get a key of their own, so that no task gets them all
        key = F.when(F.col("hot_tokens").isNull(), F.col("content_digest")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id"))))
        ids = ids.withColumn("content_digest", key)
    else:
        ids = ids.withColumn("hot_tokens", F.lit(None).cast("bigint"))
    return ids.join(counts, "content_digest", "left").withColumn("n_tokens", F.coalesce("hot_tokens", "n_tokens")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
