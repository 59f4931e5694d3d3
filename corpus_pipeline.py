"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet into the folder that driver and executors share and gives the next
stage what it reads back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, ngram_join, packing, quality, secret_scan
from textloom.llm._shared import table, written
from textloom.llm.queries import tokenizer

# Chunks that a worker keeps in sequence_packing: the executor's heap is still as large as the stages before have left it.
PACKING_CACHE = 60_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and go. Rows are judged one by one, so repeated rows share a
    fate; a null language is judged by the base rules alone. An empty table stays empty.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 over five-word shingles, the one of the least doc_id stays.

    A document without words is linked with nothing and stays. Where ids repeat or are null, one row of each group stays,
    a named one before an unnamed one. An empty table stays empty.
    """
    return ngram_join.one_of_each(docs, ngram_join.Params(shingle=5, num=80, den=100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty documents contain nothing and stay; null and empty items match nothing. Repeated rows share a fate.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark, and n_chars follows.

    Null and empty texts stay as they are, repeated rows too; overlapping secrets become one mark.
    """
    return secret_scan.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), size=2048, end_id=1, cache_entries=PACKING_CACHE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sequence_packing", sequence_packing),
]

# Shingle joins, divergences and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
