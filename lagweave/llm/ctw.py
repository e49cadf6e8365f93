"""Language-model scores by context-tree weighting over bytes, beside a unigram word model.

A byte is eight binary decisions, the decision being known by the bits before it (255 nodes). For each decision the last 0 to
``DEPTH`` bytes are its possible contexts. At every context a Krichevsky-Trofimov estimate predicts the bit, and the
weighting of all context trees, ``Pw = 1/2 Pe + 1/2 prod Pw(children)``, makes a mixture of the estimates of all depths:
``p_d = w_d KT_d + (1 - w_d) p_(d+1)`` with ``w_d = 1/2 Pe / Pw``. Texts are lower-cased (A-Z) bytes, begin after zero bytes and end
with a zero byte, which is coded too, so a score is a whole text's probability.

All texts are counted at the full depth, and all contexts are in the trees. What goes to every executor is bounded whatever the input: the
decisions at contexts of at most two bytes, the log probabilities of the most frequent (context, byte), at most ``SENT``, and the counts of
the most frequent words, at most ``HEAD``. The other bytes of each document are joined to log probabilities of the same trees, its rare
words to their counts. ``KEPT``, if set, makes smaller trees: of the contexts of three bytes and more the most frequent stay, and what was
seen in the others is one more child of their parent, "any other byte", with an estimate of its own. The query leaves it unset.

Counting is one pass that emits each task's distinct (context, byte) and word counts; sums meet by key. The trees' weights are computed
bottom-up, in groups by the last three bytes of the context, where all deeper contexts of a group are together; a byte's log probability
needs its group and the contexts of at most two bytes.

Words are told apart by a 64-bit hash. Defined cases: a null text is the empty text (one end token); repeated rows get a row each; an empty table gives an empty result; no training rows at all leave every estimate
at one half; texts are scored whole, very long ones in one row's pieces; columns besides ``doc_id`` and ``text``, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import words as wd
from lagweave.llm.shared import bucket_of, discard, materialize
from lagweave.session import map_arrow

DEPTH = 5
#: Groups of contexts are those with this many last bytes in common; with ``KEPT``, contexts from this depth on can be pooled.
POOLED = 3
#: None: every context is in the trees. A number: at most so many bytes seen in the contexts that stay at each depth from ``POOLED`` on.
KEPT: int | None = None
#: Bytes in context whose log probabilities go to every executor (16 bytes each); with ``KEPT``, so many.
SENT = 1_000_000
#: Words in the table that goes to every executor (16 bytes each).
HEAD = 500_000
#: Distinct bytes in context in one of the groups in which the lower levels of the trees are weighted, on average.
GROUP = 20_000
WORD, GRAM = 0, 1
_END = wd.mix(np.array([0x5BD1E995], np.uint64))  # the end token's hash


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every coded byte with its context, as one number: context bytes, the oldest highest, then the byte. And the rows' bounds."""
    n, rows = len(data), len(offsets) - 1
    wide = np.zeros(n + rows * (DEPTH + 1), np.uint8)  # before each row DEPTH zeros, after it one
    first = offsets[:-1] + np.arange(rows) * (DEPTH + 1) + DEPTH
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(rows), lengths)
    wide[np.arange(n) + (row + 1) * DEPTH + row] = wd.LOWER[data]
    coded = np.ones(len(wide), bool)
    for k in range(DEPTH):
        coded[first - 1 - k] = False
    at = np.flatnonzero(coded)
    out = np.zeros(len(at), np.int64)
    for k in range(DEPTH, -1, -1):
        out = (out << 8) | wide[at - k]
    return out, offsets + np.arange(rows + 1)


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, unique = pd.factorize(keys)
    return unique, np.bincount(codes, minlength=len(unique))


class Tally:
    """Counts by key, merged whenever the pieces outgrow the whole."""

    def __init__(self) -> None:
        self.keys, self.counts, self.parts, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > max(1_000_000, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.parts]])
        counts = np.concatenate([self.counts, *[c for _, c in self.parts]])
        codes, self.keys = pd.factorize(keys)
        self.counts = np.bincount(codes, counts, minlength=len(self.keys)).astype(np.int64)
        self.parts, self.size = [], 0


def count(docs: DataFrame) -> DataFrame:
    """``kind, key, n`` over all texts: words (and ends), and bytes in context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (Tally(), Tally())
        for b in batches:
            for data, offsets in wd.blocks(b.column("text"), 1 << 20):
                words = wd.segment(data, offsets, wd.NOT_BLANK)
                tallies[WORD].add(*(x.view(np.int64) if x.dtype == np.uint64 else x for x in tally(words.hash)))
                tallies[WORD].add(_END.view(np.int64), np.array([len(offsets) - 1]))
                keys, n = tally(grams(data, offsets)[0])
                tallies[GRAM].add(keys, n)
        for kind, t in enumerate(tallies):
            t.merge()
            for i in range(0, len(t.keys), 100_000):
                keys = t.keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys), pa.array(t.counts[i : i + 100_000])], ["kind", "key", "n"])

    return map_arrow(docs.select("text"), run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    codes, unique = pd.factorize(keys)
    return (unique, *(np.bincount(codes, v, minlength=len(unique)) for v in values))


def octave(n: np.ndarray) -> np.ndarray:
    """The eighth of an octave that a count falls in: thresholds are set on these."""
    return np.floor(np.log2(n) * 8 + 1e-9).astype(np.int64)


@dataclass
class Level:
    """Decisions at contexts of one depth: (context << 8 | node), counts, the weight of the own estimate and its probability of a one,
    the estimate for what no kept child has seen, and log Pw."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weight: np.ndarray
    one: np.ndarray
    other: np.ndarray
    pw: np.ndarray


def weighted(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Level:
    """``known``: zeros, ones and log Pw of the kept children together; None at the deepest level."""
    own, one = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1.0)
    if known is None:
        return Level(keys, zeros, ones, np.ones(len(keys)), one, one, own)
    a, b = zeros - known[0], ones - known[1]
    below = known[2] + np.where(a + b > 0, log_kt(a, b), 0.0)
    weight = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
    return Level(keys, zeros, ones, weight, one, (b + 0.5) / (a + b + 1.0), np.logaddexp(own, below) - np.log(2))


def nodes_of(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decisions of the contexts, sorted: (context << 8 | node), zeros, ones."""
    context, symbol = gram >> 8, gram & 255
    keys, zeros, ones = [], [], []
    for k in range(8):
        keys.append(context << 8 | 1 << k | symbol >> (8 - k))
        bit = symbol >> (7 - k) & 1
        ones.append(np.where(bit == 1, n, 0))
        zeros.append(np.where(bit == 0, n, 0))
    out = _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
    order = np.argsort(out[0])
    return tuple(x[order] for x in out)


def parent(keys: np.ndarray, depth: int) -> np.ndarray:
    """The keys one level up: the oldest context byte goes."""
    return (keys >> 8 & ((1 << 8 * (depth - 1)) - 1)) << 8 | keys & 255


#: Decisions of one depth. ``kept``: the context is in the trees, not pooled.
_NODES = "key long, kept boolean, weight double, one double, other double, zeros double, ones double, pw double"


def _node_table(level: Level, kept: np.ndarray) -> pa.Table:
    doubles = {c: pa.array(getattr(level, c), pa.float64()) for c in ("weight", "one", "other", "zeros", "ones", "pw")}
    return pa.table({"key": pa.array(level.keys, pa.int64()), "kept": pa.array(kept, pa.bool_()), **doubles})


def _shorter(grams: np.ndarray, depth: int) -> np.ndarray:
    """(context, byte) with the context's last ``depth`` bytes."""
    return grams & ((1 << 8 * (depth + 1)) - 1)


def group_levels(grams: np.ndarray, n: np.ndarray, least: dict[int, int]) -> tuple[dict[int, Level], np.ndarray]:
    """The levels from ``POOLED`` down of the contexts in a group, and which decisions of the first one are at kept contexts.
    ``least``: the octave from which a depth's contexts are kept."""
    seen = {DEPTH: (grams, n.astype(float))}
    for depth in range(DEPTH - 1, POOLED - 1, -1):
        seen[depth] = _summed(_shorter(seen[depth + 1][0], depth), seen[depth + 1][1])
    levels: dict[int, Level] = {}
    for depth in range(DEPTH, POOLED - 1, -1):
        keys, count = seen[depth]
        codes, _ = pd.factorize(keys >> 8)
        frequent = (octave(np.bincount(codes, count)) >= least[depth])[codes]
        # the level above asks for all decisions of the least pooled depth, kept or not
        chosen = frequent if depth > POOLED else np.ones(len(keys), bool)
        nodes, zeros, ones = nodes_of(keys[chosen], count[chosen])
        if depth == DEPTH:
            levels[depth] = weighted(nodes, zeros, ones, None)
            continue
        known, below = [np.zeros(len(nodes)) for _ in range(3)], levels[depth + 1]
        if len(below.keys):
            up, *sums = _summed(parent(below.keys, depth + 1), below.zeros, below.ones, below.pw)
            at = np.searchsorted(nodes, up)
            for k, x in zip(known, sums, strict=True):
                k[at] = x
        levels[depth] = weighted(nodes, zeros, ones, tuple(known))
    return levels, np.isin(levels[POOLED].keys >> 8, np.unique(keys[frequent] >> 8))


def lower_mixture(gram: np.ndarray, levels: dict[int, Level], kept: np.ndarray) -> np.ndarray:
    """For each gram and each of its 8 decisions the probability of a one from depth ``POOLED`` down; NaN where that context is not kept."""
    tables = {d: (x.keys, x.weight, x.one, x.other) for d, x in levels.items()}
    tables[POOLED] = tuple(x[kept] for x in tables[POOLED])
    out = np.empty((len(gram), 8))
    for k in range(8):
        out[:, k] = mixture(gram >> 8, _node(gram, k), tables, range(POOLED, DEPTH + 1), np.full(len(gram), np.nan))
    return out


def _group(key: str, groups: int):
    shared = F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * POOLED) - 1))
    return F.pmod(F.xxhash64(shared), F.lit(groups)).alias("g")


def deep_levels(counts: DataFrame, groups: int, least: dict[int, int], sent: int) -> DataFrame:
    """Decisions at depth ``POOLED``; and with ``lower``, their ``lower_mixture``, the grams whose count is in octave ``sent`` or above."""
    def run(group: pa.Table) -> pa.Table:
        gram, n = group.column("key").to_numpy(), group.column("n").to_numpy()
        levels, kept = group_levels(gram, n, least)
        frequent = gram[octave(n) >= sent]
        lower = pa.ListArray.from_arrays(pa.array(np.arange(len(frequent) + 1) * 8, pa.int32()), pa.array(lower_mixture(frequent, levels, kept).ravel()))
        nodes = _node_table(levels[POOLED], kept)
        empty = {f.name: pa.nulls(len(frequent), f.type) for f in nodes.schema if f.name != "key"}
        return pa.concat_tables([
            nodes.append_column("lower", pa.nulls(len(nodes), lower.type)),
            pa.table({"key": pa.array(frequent, pa.int64()), **empty, "lower": lower}),
        ])

    return counts.select("key", "n", _group("key", groups)).groupBy("g").applyInArrow(lambda t: run(t), _NODES + ", lower array<double>")


def upper_level(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of a level from those below: sums first, so a group is at most 255 rows a context."""
    keys = (F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))) * 256 + F.col("key").bitwiseAND(F.lit(255))
    of_kept = [F.sum(F.when(F.col("kept"), F.col(c)).otherwise(0.0)).alias(f"kept_{c}") for c in ("zeros", "ones", "pw")]
    summed = nodes.groupBy(keys.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), *of_kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, zeros, ones, *known = (b.column(c).to_numpy() for c in ("key", "zeros", "ones", "kept_zeros", "kept_ones", "kept_pw"))
            yield from _node_table(weighted(k, zeros, ones, tuple(known)), np.ones(len(k), bool)).to_batches()

    return map_arrow(summed, run, _NODES)


def _eighth(n: str):
    return F.floor(F.log2(n) * 8 + F.lit(1e-9))


def _least(sizes: list[tuple[int, int]], most: int) -> int:
    """The least octave so that from there on there are at most ``most``; ``sizes``: octaves and how many are in each."""
    total, least = 0, 1 << 20
    for o, n in sorted(sizes, reverse=True):
        if total + n > most:
            break
        total, least = total + n, o
    return least


def _sizes(counts: DataFrame, size) -> list[tuple[int, int]]:
    return [(r[0], r[1]) for r in counts.groupBy(_eighth("n").alias("o")).agg(size).collect()]  # at most some 500 rows


def thresholds(grams: DataFrame, kept: int | None) -> dict[int, int]:
    """For each depth from ``POOLED`` on the least octave of counts of the contexts in the trees. All are if ``kept`` is None; else at most ``kept``
    bytes are seen in them, and the octave is no lower than that of the depth before, so that a kept context's parent is kept."""
    if kept is None:
        return dict.fromkeys(range(POOLED, DEPTH + 1), 0)
    out: dict[int, int] = {}
    for depth in range(POOLED, DEPTH + 1):
        context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))
        byte = F.col("key").bitwiseAND(F.lit(255))
        contexts = grams.groupBy(context.alias("c"), byte.alias("b")).agg(F.sum("n").alias("n")).groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("bytes"))
        out[depth] = max([_least(_sizes(contexts, F.sum("bytes")), kept), *out.values()])
    return out


@dataclass
class Bytes:
    """What goes out of the byte model: for each depth sorted decisions with weights, estimates and those for the rest, of which there are none
    from ``POOLED`` on (they are made anew from the counts, in groups); and the most frequent grams, sorted, with their log10 probabilities."""

    levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    seen: dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass
class Model:
    bytes: Broadcast
    #: All (context, byte) and their counts, the number of groups for them, and the octaves from which contexts are in the trees.
    grams: DataFrame
    groups: int
    least: dict[int, int]
    #: Sorted hashes and counts of the frequent words.
    head: Broadcast
    #: All words and their counts.
    words: DataFrame
    #: Tokens, and distinct ones, in training.
    total: int
    distinct: int


def _sorted(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """The columns, ordered by the first."""
    first, *others = (c.to_numpy() for c in rows.columns)
    order = np.argsort(first)
    return first[order], *(x[order] for x in others)


def fit(docs: DataFrame) -> Model:
    """Count ``docs`` and weigh the trees."""
    context = docs.sparkSession.sparkContext
    counts = materialize(count(docs), "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the frequent ones: all whose count is in the highest eighths of octaves that fit
    head = context.broadcast(_sorted(words.where(_eighth("n") >= _least(_sizes(words, F.count("*")), HEAD)).toArrow()))
    grams = counts.where(F.col("kind") == GRAM).select("key", "n")
    sizes = _sizes(grams, F.count("*"))
    groups, least = 32 + sum(n for _, n in sizes) // GROUP, thresholds(grams, KEPT)
    nodes = materialize(deep_levels(grams, groups, least, _least(sizes, SENT if KEPT is None else KEPT)), "nodes")
    # bounded: 255 decisions for each of the 65,793 contexts of at most two bytes
    none = np.zeros(0)
    levels: dict[int, tuple[np.ndarray, ...]] = {d: (none.astype(np.int64), none, none, none) for d in range(POOLED, DEPTH + 1)}
    below = nodes.where(F.col("lower").isNull())
    for depth in range(POOLED - 1, -1, -1):
        below = materialize(upper_level(below, depth), "nodes")
        levels[depth] = _sorted(below.select("key", "weight", "one", "other").toArrow())
    tables = context.broadcast(levels)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, lower = b.column("key").to_numpy(), b.column("lower").flatten().to_numpy().reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(log_probabilities(gram, lower, tables.value))], ["key", "log"])

    seen = _sorted(map_arrow(nodes.where(F.col("lower").isNotNull()).select("key", "lower"), price, "key long, log double").toArrow())
    tables.unpersist()
    discard(nodes)
    return Model(context.broadcast(Bytes(levels, {DEPTH: seen})), grams, groups, least, head, words, int(sums[0]), int(sums[1]))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether each is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _node(gram: np.ndarray, k: int) -> np.ndarray:
    """The decision on bit ``k`` of the grams' bytes."""
    return 1 << k | (gram & 255) >> (8 - k)


def mixture(context: np.ndarray, node: np.ndarray, levels: dict[int, tuple[np.ndarray, ...]], depths: range, rest: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
    """The probability of a one by the estimates of some successive depths. ``below``: that of the next depth, where it has the context (else NaN);
    ``rest``: that where not even the first depth has it."""
    # from above: weights of the estimates so far and what is left of the mixture; a context that is not there has no children either
    p, left, inside, rest = np.zeros(len(node)), np.ones(len(node)), np.ones(len(node), bool), rest.copy()
    for depth in depths:
        keys, weight, one, other = levels[depth]
        at, found = _find(keys, (context & ((1 << 8 * depth) - 1)) << 8 | node)
        inside &= found
        now = at[inside]
        p[inside] += left[inside] * weight[now] * one[now]
        left[inside] *= 1 - weight[now]
        rest[inside] = other[now]
    return p + left * (rest if below is None else np.where(np.isnan(below), rest, below))


def log_probabilities(gram: np.ndarray, lower: np.ndarray, levels: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 of the model's probability of each gram's byte in its context; ``lower``: its ``lower_mixture``."""
    total = np.zeros(len(gram))
    for k in range(8):
        p = mixture(gram >> 8, _node(gram, k), levels, range(POOLED), np.full(len(gram), 0.5), lower[:, k])
        total += np.log10(np.where(gram >> (7 - k) & 1 == 1, p, 1 - p))
    return total


def prices(wanted: DataFrame, model: Model) -> DataFrame:
    """``key, log``: log10 of the probability of any grams, distinct ones in ``key``; grams that training has not seen too."""
    sent, least = model.bytes, model.least
    low = (1 << 8 * POOLED) - 1

    def run(counts: pa.Table, wanted: pa.Table) -> pa.Table:
        gram, keys, n = wanted.column("key").to_numpy(), counts.column("key").to_numpy(), counts.column("n").to_numpy()
        mine = np.isin(keys >> 8 & low, np.unique(gram >> 8 & low))
        levels, kept = group_levels(keys[mine], n[mine], least)
        return pa.table({"key": pa.array(gram, pa.int64()), "log": pa.array(log_probabilities(gram, lower_mixture(gram, levels, kept), sent.value.levels))})

    dealt = (x.select(*x.columns, _group("key", model.groups)).groupBy("g") for x in (model.grams, wanted.select("key")))
    return next(dealt).cogroup(next(dealt)).applyInArrow(lambda a, b: run(a, b), "key long, log double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: ``n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    key = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("uid", T.LongType()), key, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("rare", T.ArrayType(T.LongType()))])
    gram_type = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    schema.add("grams", T.ArrayType(gram_type))
    sent, head, scale = model.bytes, model.head, float(model.total + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        frequent, prices_of = sent.value.seen[DEPTH]
        keys, counts = head.value
        logs = np.log10((counts + 1) / scale)
        for b in batches:
            done = 0
            for data, offsets in wd.blocks(b.column("text"), 2 << 20):
                n = len(offsets) - 1
                gram, bounds = grams(data, offsets)
                codes, unique = pd.factorize(gram)
                at, known = _find(frequent, unique)
                value = np.zeros(len(unique))
                value[known] = prices_of[at[known]]
                byte_score = wd.per_row(value[codes], bounds)
                # the others, each once a row
                rare = np.flatnonzero(~known[codes])
                row = np.searchsorted(bounds, rare, "right") - 1
                pairs, times = np.unique(row * len(unique) + codes[rare], return_counts=True)
                others = pa.StructArray.from_arrays([pa.array(unique[pairs % len(unique)]), pa.array(times.astype(np.int64))], ["key", "n"])
                others = pa.ListArray.from_arrays(np.searchsorted(pairs, np.arange(n + 1) * len(unique)).astype(np.int32), others)
                words = wd.segment(data, offsets, wd.NOT_BLANK)
                # words, then an end a row, in row order
                hashes = np.insert(words.hash.view(np.int64), words.bounds[1:], _END.view(np.int64)[0])
                ends = words.bounds + np.arange(n + 1)
                codes, unique = pd.factorize(hashes)
                at, known = _find(keys, unique)
                value = np.zeros(len(unique))
                value[known] = logs[at[known]]
                is_known = known[codes]
                rare = np.flatnonzero(~is_known)
                rare_bounds = np.searchsorted(rare, ends)
                columns = [pa.array(np.arange(uid, uid + n)), b.column("doc_id").slice(done, n), pa.array(np.diff(ends)), pa.array(wd.per_row(is_known.astype(np.int64), ends))]
                columns += [pa.array(wd.per_row(value[codes], ends)), pa.array(byte_score), pa.array(np.diff(offsets))]
                columns.append(pa.ListArray.from_arrays(pa.array(rare_bounds.astype(np.int32)), pa.array(hashes[rare])))
                columns.append(others)
                uid, done = uid + n, done + n
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    parts = materialize(map_arrow(docs.select("doc_id", "text"), run, schema), "scored")
    rare = parts.select("uid", F.explode("rare").alias("key"))
    found = rare.join(model.words, "key", "left").groupBy("uid").agg(F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(scale))).alias("rest"))
    grams_of = parts.select("uid", F.inline("grams"))
    priced = materialize(prices(grams_of.select("key").distinct(), model), "prices")
    bytes_of = grams_of.join(priced, "key").groupBy("uid").agg(F.sum(F.col("n") * F.col("log")).alias("others"))
    out = parts.drop("rare", "grams").join(found, "uid", "left").join(bytes_of, "uid", "left").withColumn("score", F.col("score") + F.coalesce("others", F.lit(0.0)))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def held_out(modulus: int = 7, remainder: int = 2):
    return bucket_of(F.col("doc_id"), modulus) == remainder


def train_and_score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Learn from the rows that are not held out; score all."""
    model = fit(docs.where(~held_out(modulus, remainder)))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(modulus, remainder).alias("held_out"), *scored.columns[1:])
