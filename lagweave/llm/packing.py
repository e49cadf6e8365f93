"""Packing token sequences by a configuration linear program.

Pieces of at most ``capacity`` tokens are counted by length. A configuration is a multiset of lengths that fits one sequence;
the linear program asks for the fewest configurations that cover the histogram. Multiplicative weights solve it, with
knapsack dynamic programming as the pricing step, until the value is within ``GAP`` of the dual bound. The fractional
solution is rounded to whole sequences; what rounding leaves over (a few hundredths of the pieces) is filled by subset sums around the
largest length left. Program and rounding see the histogram only (``capacity`` numbers), so their cost does not grow with the
input; pieces then find their places by their rank within their length, in parallel.

Defined cases: a null text is the empty text, one end token; a text of more than ``capacity`` tokens, however long, is cut into
pieces of which the first may be shorter; repeated rows are packed one by one; pieces of equal length take places in the order of
their numbers, so ties are broken the same way on each run over the same files; an empty table gives an empty result; columns besides
``doc_id`` and ``text``, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import bpe
from lagweave.llm.shared import materialize, text_or_empty
from lagweave.session import map_arrow

CAPACITY = 1024
END = 2
#: Rows of one length ranked in one task.
RANKED = 1024
#: Bounds of the linear program: rounds, and the gap between its value and the dual bound at which they end.
ROUNDS, GAP = 2000, 0.003
#: Of a round: how much weights shrink by a full cover, what part of a length's demand it covers at most, how near to the best price counts.
RATE, STEP, NEAR = 2.0, 0.02, 0.02

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def price_knapsacks(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For each room the highest total price of lengths that fit it, and the length taken last (0: the room's last token stays free)."""
    best = np.zeros(capacity + 1)
    taken = [0] * (capacity + 1)
    reverse = prices[::-1].copy()
    n = len(prices)
    for c in range(1, capacity + 1):
        value = best[:c] + reverse[n - 1 - c : n - 1]  # best[c - l] + prices[l] for l = c..1
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], taken[c] = value[k], c - k
        else:
            best[c] = best[c - 1]
    return best, taken


@dataclass
class Program:
    """A fractional cover of the demand. ``value`` of it and ``bound`` of any, by linear-programming duality, in sequences."""

    configurations: dict[Pattern, float]
    value: float
    bound: float
    rounds: int

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def solve(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> Program:
    """Multiplicative weights on the configuration program of ``demand`` (pieces by length, all below ``capacity``).

    A length's price is its share of a sequence times a weight that shrinks exponentially with how often its demand has been covered.
    Each round one knapsack table prices all configurations, and hence those that are best among those with a given length;
    lengths whose best is within ``NEAR`` of the best of all add theirs, no length giving more than ``STEP`` of its demand
    in a round. Prices divided by the best configuration's are a dual solution. The sum of all rounds, scaled so that every length is covered
    once, is a primal one. Rounds end when the two meet within ``gap``, after ``rounds`` at the latest.
    """
    there = np.flatnonzero(demand)
    if not len(there):
        return Program({}, 0.0, 0.0, 0)
    d = demand.astype(float)
    share = np.zeros(len(d))
    share[there] = there / capacity
    covered = np.zeros(len(d))
    x: dict[Pattern, float] = {}
    total = bound = 0.0
    done = 0
    while done < rounds:
        done += 1
        prices = share * np.exp(-RATE * (covered - covered[there].min()))
        best, taken = price_knapsacks(prices, capacity)
        bound = max(bound, float(d @ prices) / best[capacity])
        room = STEP * d
        anchors = there[prices[there] + best[capacity - there] >= (1 - NEAR) * best[capacity]]
        for n in anchors[np.argsort(covered[anchors], kind="stable")].tolist():
            if room[n] <= 1e-9:
                continue
            found, c = {n: 1}, capacity - n
            while c > 0:
                m = taken[c]
                if m:
                    found[m] = found.get(m, 0) + 1
                    c -= m
                else:
                    c -= 1
            amount = min(room[m] / k for m, k in found.items())
            if amount <= 1e-9:
                continue
            key = tuple(sorted(found.items(), reverse=True))
            x[key] = x.get(key, 0.0) + amount
            total += amount
            for m, k in found.items():
                room[m] -= k * amount
                covered[m] += k * amount / d[m]
        least = covered[there].min()
        if least > 0 and total / least <= (1 + gap) * bound:
            break
    least = covered[there].min()
    # a length that no round has reached would need more of them: its pieces then are left to the rounding
    scale = least if least > 0 else max(1.0, done * STEP)
    return Program({p: a / scale for p, a in x.items()}, total / scale, bound, done)


def fill(room: int, counts: dict[int, int]) -> Counter:
    """A multiset within ``counts`` of the largest total of at most ``room``."""
    reach, states, parts = 1, [], []
    mask = (1 << (room + 1)) - 1
    for n in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        times, k = min(counts[n], room // n), 1
        while times > 0:
            k = min(k, times)
            states.append(reach)
            parts.append((n, k))
            reach = (reach | reach << (n * k)) & mask
            times -= k
            k *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, Counter()
    for before, (n, k) in zip(reversed(states), reversed(parts), strict=True):
        if not before >> total & 1:
            out[n] += k
            total -= n * k
    return out


def rounded(program: Program, demand: dict[int, int], capacity: int, slack: int, carried: bool) -> tuple[Counter, int]:
    """Whole numbers of configurations that hold ``demand`` exactly, and how many pieces the program's own ones hold.

    The program's configurations with at most ``slack`` free tokens come first, the most used ones first, as often as it says: with
    the fractions carried on to the next one, or rounded up. None is used more often than pieces are left. What then is left
    is filled around its largest lengths.
    """
    left, out, placed, carry = dict(demand), Counter(), 0, 0.0
    chosen = [(p, a) for p, a in program.configurations.items() if capacity - slack <= sum(n * k for n, k in p)]
    for p, a in sorted(chosen, key=lambda x: (-x[1], x[0])):
        wanted = a + carry
        times = min(int(wanted + 1e-9) if carried else math.ceil(a - 1e-9), *(left.get(n, 0) // k for n, k in p))
        if carried:
            carry = min(max(wanted - times, 0.0), 1.0)
        if times > 0:
            out[p] += times
            for n, k in p:
                left[n] -= k * times
                placed += k * times
    left = {n: k for n, k in left.items() if k > 0}
    while left:  # each turn uses up at least one length
        n = max(left)
        left[n] -= 1
        found = fill(capacity - n, left)
        left[n] += 1
        found[n] += 1
        times = min(left[m] // k for m, k in found.items())
        out[tuple(sorted(found.items(), reverse=True))] += times
        for m, k in found.items():
            left[m] -= k * times
            if not left[m]:
                del left[m]
    return out, placed


@dataclass
class Packing:
    """Configurations and how often to use each, the program they come from, and the share of pieces that its configurations hold."""

    configurations: list[tuple[Pattern, int]]
    program: Program
    share: float


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Packing:
    """A packing that holds the histogram exactly; full pieces are sequences of their own."""
    demand = {n: k for n, k in histogram.items() if k > 0}
    out: Counter = Counter()
    if full := demand.pop(capacity, 0):
        out[((capacity, 1),)] += full
    d = np.zeros(capacity + 1)
    for n, k in demand.items():
        d[n] = k
    program = solve(d, capacity, rounds)
    tried = [rounded(program, demand, capacity, slack, carried) for slack, carried in ((2, True), (4, False), (0, True))]
    pieces = sum(demand.values())
    # the fewest sequences, of roundings that leave at most a tenth of the pieces to the filling if there are any
    found, placed = min(tried, key=lambda x: (x[1] < 0.9 * pieces, sum(x[0].values())))
    return Packing(sorted((out + found).items(), reverse=True), program, placed / pieces if pieces else 1.0)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece, with a number that is unique in the table."""
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key)] + [T.StructField(c, T.LongType()) for c in ("uid", "piece", "start", "length", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            rows, pieces, starts, lengths, crcs = [], [], [], [], []
            for row, ids in enumerate(bpe.encoder(path).ids_of(b.column("text"))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                raw, n = memoryview(ids.tobytes()), len(ids)
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, stop in enumerate(ends):
                    at = max(0, stop - capacity) if k else 0
                    rows.append(row)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(stop - at)
                    crcs.append(zlib.crc32(raw[4 * at : 4 * stop]))
            n = len(rows)
            columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(np.arange(uid, uid + n), pa.int64())]
            columns += [pa.array(x, pa.int64()) for x in (pieces, starts, lengths, crcs)]
            uid += n
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(docs.select("doc_id", text_or_empty("text").alias("text")), run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: its sequence and its place there."""
    spark = docs.sparkSession
    pieces = materialize(cut(docs, path, capacity, end), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots, first, used = [], 0, Counter()
    for pattern, times in configurations(histogram, capacity).configurations:
        at = 0
        for n, k in pattern:
            slots.append((n, used[n], used[n] + k * times, k, first, at))
            used[n] += k * times
            at += n * k
        first += times
    # of each length: salts for ranking, and a grain of ranks so that about one slot falls on each
    kinds = Counter(s[0] for s in slots)
    grains = {n: -(-k // kinds[n]) for n, k in histogram.items()}
    lengths = spark.createDataFrame([(n, -(-k // RANKED), grains[n]) for n, k in histogram.items()], "length long, salts long, grain long")
    # one row for each length of each configuration and grain: bounded by histogram and rounds, not by the input
    cells = [(n, b, *rest) for n, *rest in slots for b in range(rest[0] // grains[n], (rest[1] - 1) // grains[n] + 1)]
    names = ("length", "block", "lo", "hi", "times", "first", "at")
    table = spark.createDataFrame(pa.table({c: pa.array([x[i] for x in cells], pa.int64()) for i, c in enumerate(names)}))
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("uid")) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    ranked = ranked.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).withColumn("block", F.floor(F.col("rank") / F.col("grain")))
    placed = ranked.join(F.broadcast(table), ["length", "block"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    sequence = F.col("first") + F.floor(nth / F.col("times"))
    offset = F.col("at") + F.col("length") * (nth % F.col("times"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
