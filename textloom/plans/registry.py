"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, dealt over all cores if its files have fewer splits than there are cores (a split is a row group at least).

    A corpus of that few splits is small, so the exchange is too; larger ones are read as they are.
    """
    d = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores) if d._jdf.queryExecution().toRdd().getNumPartitions() < cores else d
