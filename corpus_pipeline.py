"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage works on all rows that its predecessor kept, and each stage's result is written as Parquet and read again,
so a lost executor costs the running stage's tasks only. Toxicity, quality and near-duplicate stages drop documents,
decontamination drops those that hold a benchmark passage, and packing returns one row per piece.

Defined cases, for every stage: a null or empty text is not toxic, fails the quality rules, and so reaches no later stage; very long texts
are handled whole; repeated rows are judged alike, and near-duplicate removal keeps one of them; of a group's documents that with the
least doc_id stays; an empty table passes through all stages as an empty one; columns besides ``doc_id`` and ``text``, whatever their names,
are carried up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagweave.llm import decontaminate, minhash, packing, quality, toxicity
from lagweave.llm.queries import table, tokenizer_path
from lagweave.llm.shared import discard, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", without_low_quality),
    ("minhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: A trained machine, random signatures and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
