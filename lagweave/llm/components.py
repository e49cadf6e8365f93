"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a distributed aggregate and join whose result is written to the shared folder, so no lineage grows
and no component is gathered anywhere. Links shrink to stars around the smallest member of each component.

Defined cases: links of a node to itself and rows with a null end are ignored; repeated links count once; a link may name its ends in either
order; without links the result is empty; columns besides ``a`` and ``b`` are ignored. The smallest member is the one of the least value,
so there are no ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.where(F.col("b") > F.col("a")).join(least, "a")
    return out.select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("m").alias("a"), "b")
    return out.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, class`` for every node of ``links(a, b)``; the class is the component's smallest node."""
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "links")
    before = _signature(links)
    for _ in range(most_rounds):
        if not before[0]:
            break
        shorter = materialize(_small_star(_large_star(links)), "links")
        discard(links)
        links, now = shorter, _signature(shorter)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("class")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("class")).distinct())
