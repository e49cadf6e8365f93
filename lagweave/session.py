"""What every operator with Python functions needs from a session: this package on the executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once an application (Spark's own file server carries it)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    archive = Path(tempfile.mkdtemp(prefix="lagweave-src-")) / "lagweave_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


#: Bounds of one Arrow batch to or from a Python worker; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def _release() -> None:
    """Give memory that a task no longer needs back to the system: a worker outlives its tasks and their stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its own business
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with this package on the executors, batches bounded in rows and in bytes, and tidy workers.

    Spark's default of 10,000 rows a batch and no bound in bytes makes a task's memory grow with the length of its texts. Settings
    of the session's own stay as they are.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > 1 << 30:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(tidy, schema)
