"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset (local tests), a folder of our own; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="textloom-shared-"))
    return _OWN[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of `written` tables, once nothing more reads them."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder; for small tables in loops."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    done = df.checkpoint()
    # as a plain table of rows: constraints that a checkpoint carries on multiply over the rounds of a loop
    session = df.sparkSession
    execution = done._jdf.queryExecution()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(execution.toRdd(), execution.analyzed().schema(), False), session)
