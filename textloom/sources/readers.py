"""Where tables come from: Parquet, JDBC, caches."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .. import schemas

TABLES = {"processos": schemas.PROCESSES, "processos_metadados": schemas.METADATA, "processos_conteudo": schemas.CONTENT, "scraping_log": schemas.SCRAPING_LOG}


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    r = spark.read
    return (r.schema(TABLES[name]) if name in TABLES else r).parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, name: str, options: dict[str, str] | None = None, key: str = "id", partitions: int = 16) -> DataFrame:
    """A table by JDBC, read in ranges of its key. Connection options come from the call or from spark.textloom.jdbc.*; none is built in."""
    conf = {k: v for k in ("url", "user", "password", "driver") if (v := spark.conf.get(f"spark.textloom.jdbc.{k}", None))} | (options or {})
    r = spark.read.format("jdbc").options(**conf).option("dbtable", name)
    if {"lowerBound", "upperBound"} <= conf.keys():
        r = r.option("partitionColumn", key).option("numPartitions", partitions)
    return r.load()


def cached(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet cache, empty if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def catalog(spark: SparkSession) -> DataFrame:
    """Tables and views that the session knows, and the engine's version."""
    return spark.createDataFrame([(t.name, t.tableType, spark.version) for t in spark.catalog.listTables()], "name string, kind string, version string")


def settings_from_env(prefix: str = "TEXTLOOM_") -> dict[str, str]:
    """Settings given in the environment, for GraphConfig(**...) after conversion."""
    return {k.removeprefix(prefix).lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
