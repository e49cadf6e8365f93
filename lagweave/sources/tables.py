"""The tables that the queries read, and the series and coefficient sets made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators.panel import SeriesSpec

MONTHLY = SeriesSpec(("g",), "m", ("y",))
DAILY = SeriesSpec(("g",), "m", ("y",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals by status: ``g, m, y``. Sums of decimals are exact in any order."""
    money = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("g"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(money.alias("y"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of event values by type: ``g, m, y``."""
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("g"), F.date_format("ts", "yyyy-MM-dd").alias("m")).agg(total.alias("y"))


def coefficients(spark: SparkSession, sf_dir: str, p: int, scale: float = 1.0) -> DataFrame:
    """``vec_id, a``: the first ``p`` numbers of each embedding as autoregressive coefficients."""
    a = F.transform(F.slice("embedding", 1, p).cast("array<double>"), lambda x: x * F.lit(scale))
    return table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"))


def matrix(flat: Column, k: int, blocks: int = 1, first: int = 0) -> Column:
    """``blocks`` k x k matrices from consecutive numbers of an array, row by row."""
    return F.array(*[F.array(*[F.array(*[F.get(flat, F.lit(first + (b * k + i) * k + j)) for j in range(k)]) for i in range(k)]) for b in range(blocks)])
