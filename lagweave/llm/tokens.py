"""Token counts through a digest cache.

A count depends on nothing but the text and the tokenizer file, so it is stored under their two digests.
Documents are joined to the stored counts by digest, only digests without a count are encoded (each once,
however many copies there are), and the new counts are appended to the cache, a Parquet table.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); repeated rows each get the count; an
empty table gives an empty result; a very long text is encoded whole; columns besides ``doc_id`` and ``text``
are ignored, whatever their names. Normalising the content for its digest changes nothing but null to empty, since any other
change could change the count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import bpe
from lagweave.llm.shared import fresh_dir, text_or_empty
from lagweave.session import map_arrow

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def version_dir(cache: str, version: str) -> str:
    """Counts of one tokenizer version lie in a folder of their own, so those of others are never read."""
    return f"{cache.rstrip('/')}/tokenizer={version}"


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row a digest even if two jobs appended the same one."""
    try:
        stored = spark.read.schema(CACHE).parquet(version_dir(cache, version))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(misses: DataFrame, path: str) -> DataFrame:
    """``digest, text`` to ``digest, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = bpe.encoder(path, ids=False).counts_of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return map_arrow(misses.select("digest", "text"), run, "digest binary, n_tokens bigint")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row. ``cache`` is a folder that outlives the call; None: a new one."""
    spark = docs.sparkSession
    cache = cache or fresh_dir(spark, "token_cache")
    version = tokenizer_digest(path)
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # copies meet within each task first, so a text with many copies is sent once a task
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")
    encode_counts(misses, path).write.mode("append").parquet(version_dir(cache, version))
    # a digest with very many copies makes this join skewed; its rows are a few bytes and AQE splits them
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return counted.join(read_cache(spark, cache, version).hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens")
