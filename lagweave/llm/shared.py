"""Shared plumbing of the corpus operators: the shared folder and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (tests) a temporary folder takes its place; on a
    cluster no machine sees another one's temporary folder, so there that is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="lagweave-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/lagweave-{os.getpid()}-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends here.

    Lost executors cost only the tasks that run at the time; the written table outlives them.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read any more; other DataFrames are left alone."""
    for df in tables:
        ref, path = _written.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
