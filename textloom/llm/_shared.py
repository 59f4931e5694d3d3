"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed, discard, fresh_path, shared_dir, written
from ..operators.components import connected_components

_PACKAGE_ROOT = Path(__file__).resolve().parents[2]

# Rows up to which a one-column id table may be broadcast (8 to 40 bytes a row).
BROADCAST_ROWS = 1_000_000

# Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, unless their path has it already."""
    root = str(_PACKAGE_ROOT)
    if root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((_PACKAGE_ROOT / "textloom").rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE_ROOT))
    sc.addPyFile(str(archive))
    sc._textloom_shipped = True


# Caches of Python workers, by name; each is emptied when a worker goes on to another operator.
WORKER_CACHES: dict[str, dict] = {}
_running: list[str] = [""]


def _begin(operator: str) -> None:
    """Workers outlive their tasks: what another operator has cached goes, and freed memory returns to the system."""
    if _running[0] == operator:
        return
    _running[0] = operator
    for cache in WORKER_CACHES.values():
        cache.clear()
    release()


def release() -> None:
    """Garbage goes, and freed memory of this process returns to the system."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_BYTES, so that long texts don't add up in a worker; a setting of the session's own stays."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    operator = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches):
        _begin(operator)
        try:
            yield from fn(batches)
        finally:  # an idle worker counts too
            _trim()

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null becomes empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if x is None else x for x in column.to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def restrict(df: DataFrame, keys: DataFrame, on: str, rows: int | None = None) -> DataFrame:
    """Rows of df whose key is in `keys` (distinct). The key table is broadcast only
    if its counted rows fit BROADCAST_ROWS; beyond that both sides are shuffled."""
    n = keys.count() if rows is None else rows
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, on, "left_semi")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; a file scan's is the size of its files."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 58 else 0  # a plan of unknown size is given as the greatest long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["BROADCAST_ROWS", "as_bytes", "as_texts", "checkpointed", "connected_components", "discard", "fresh_path", "input_bytes", "map_arrow", "restrict", "shared_dir", "ship_package", "table", "written"]
