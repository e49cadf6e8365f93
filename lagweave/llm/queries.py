"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import ctw, decontaminate, html, licenses, minhash, packing, quality, sharding, tokens, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cold cache: every distinct text is encoded in this call."""
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.withColumn("over_limit", counted["n_tokens"] > 512)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).drop("reason")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.train_and_score(table(spark, sf_dir, "documents"))


SHARDS = sharding.even_tree(8)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS, sharding.grown(SHARDS))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_toxicity, op3_token_counts, op4_quality_rules, op5_lm_scores, op6_sharding, op7_decontamination, op8_packing, op9_license_scan, op10_html_text)
}

SQL: dict[str, str] = {
    "op4_quality_rules": quality.ORACLE_SQL, "op6_sharding": sharding.oracle_sql(SHARDS, sharding.grown(SHARDS)),
    "op7_decontamination": decontaminate.ORACLE_SQL, "op9_license_scan": licenses.oracle_sql(),
}
