"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each level every child draws ``-ln(u) / weight`` from a
hash of the row's key and the child's name, and the smallest draw wins, so a child gets rows in proportion
to its weight. A child's draw depends on nothing but key, name and weight: if a weight changes, rows move
only into or out of the subtree whose weight changed. A new shard joins as a subtree of its own (a region
with one rack), so it takes rows only into itself and no row moves between the others.

All of it is DataFrame expressions: a draw is 52 bits of an MD5 digest, which any SQL engine can repeat.

Defined cases: a null text has no bytes; a null key is the empty string; equal keys go to one shard; equal draws (a matter of 2**-52) go to the
child that is named first; a very long text is measured whole, and only its size and checksum travel; repeated rows get slots of their own;
an empty table gives an empty result; columns besides the key and ``text``, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard are ranked within this many hashed pieces, so that no task ranks a whole shard.
SLOT_PIECES = 4096
#: A row that is repeated more often than this is dealt out in pieces of so many slots.
REPEATS = 4096


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> list[Shard]:
    """``shards`` equal shards dealt over regions and racks."""
    return [Shard(f"r{i * regions // shards}", f"k{i * regions * racks // shards % racks}", i) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    n = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(f"r+{n}", "k0", n, weight)]


def draw(key: Column, name: str, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary"))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(unit) / F.lit(float(weight))


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The number of the shard that ``key`` (a string column) descends to."""

    def choose(children: list[tuple[str, float, Column]]) -> Column:
        if len(children) == 1:
            return children[0][2]
        draws = [draw(key, name, weight) for name, weight, _ in children]
        least = F.least(*draws)
        out = F.when(draws[0] == least, children[0][2])
        for d, (_, _, below) in zip(draws[1:-1], children[1:-1], strict=True):
            out = out.when(d == least, below)
        return out.otherwise(children[-1][2])

    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        if s.weight <= 0:
            raise ValueError("a shard's weight must be above 0")
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    weigh = lambda racks: sum(s.weight for shards in racks.values() for s in shards)
    return choose([
        (region, weigh(racks), choose([
            (f"{region}/{rack}", sum(s.weight for s in shards), choose([(f"{region}/{rack}/{s.number}", s.weight, F.lit(s.number)) for s in shards]))
            for rack, shards in racks.items()
        ]))
        for region, racks in regions.items()
    ])


def assign(docs: DataFrame, tree: list[Shard], larger: list[Shard] | None = None, key: str = "doc_id", pieces: int = SLOT_PIECES) -> DataFrame:
    """Shard, gapless slot and the shard in the larger tree, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    # equal rows are one row with a count until slots are dealt, so copies of a row cannot pile up in a task
    rows = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("n"))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = rows.withColumn("shard", shard_of(name, tree))
    rows = rows.withColumn("grown_shard", shard_of(name, larger) if larger else F.lit(None).cast("int"))
    rows = rows.withColumn("piece", F.conv(F.substring(F.md5(F.concat(name, F.lit("|"), F.col("size").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % pieces)
    within = W.partitionBy("shard", "piece").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    ranked = rows.withColumn("upto", F.sum("n").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)))
    totals = rows.groupBy("shard", "piece").agg(F.sum("n").alias("in_piece"))
    # at most shards x pieces rows, whatever the input
    starts = totals.withColumn("before", F.sum("in_piece").over(W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("in_piece"))
    starts = starts.select("shard", "piece", "before")
    dealt = ranked.join(F.broadcast(starts), ["shard", "piece"])
    first = F.col("before") + F.col("upto") - F.col("n")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long")))
    dealt = dealt.withColumn("first", first).withColumn("chunk", chunk)
    step = F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + REPEATS, F.col("n")) - 1))
    return dealt.withColumn("step", step).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("step")).alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def _choice_sql(name: str, tree: list[Shard]) -> str:
    """The same descent as SQL text over a string expression ``name``."""
    draw_sql = lambda child, weight: f"(-ln((('0x' || substr(md5({name} || '|{child}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {float(weight)})"

    def choose(children: list[tuple[str, float, str]]) -> str:
        if len(children) == 1:
            return children[0][2]
        draws = [draw_sql(c, w) for c, w, _ in children]
        least = f"least({', '.join(draws)})"
        return "CASE " + " ".join(f"WHEN {d} = {least} THEN {below}" for d, (_, _, below) in zip(draws[:-1], children[:-1], strict=True)) + f" ELSE {children[-1][2]} END"

    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    return choose([
        (region, sum(s.weight for x in racks.values() for s in x), choose([
            (f"{region}/{rack}", sum(s.weight for s in shards), choose([(f"{region}/{rack}/{s.number}", s.weight, str(s.number)) for s in shards]))
            for rack, shards in racks.items()
        ]))
        for region, racks in regions.items()
    ])


def oracle_sql(tree: list[Shard], larger: list[Shard], key: str = "doc_id", pieces: int = SLOT_PIECES) -> str:
    """The same rows. The checksum is built byte by byte from its table of 256 remainders."""
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders),
b AS (SELECT {key}, coalesce({key}::VARCHAR, '') AS k, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
d AS (SELECT {key}, k, size, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, remainders[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, t),
s AS (SELECT *, {_choice_sql("k", tree)} AS shard, {_choice_sql("k", larger)} AS grown_shard,
             ('0x' || substr(md5(k || '|' || size), 1, 8))::BIGINT % {pieces} AS piece FROM d)
SELECT {key}, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
       (row_number() OVER (PARTITION BY shard ORDER BY piece, {key} NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot
FROM s
"""
