"""Near-duplicates by BagMinHash.

A document is a multiset of five-word shingles. Each shingle of weight w owns the discretised weight levels 1..w. Levels are
grouped into bands [0, 1), [1, 2), [2, 4), [4, 8), ..; a band has one Poisson process over time, each of whose points
falls on one of its levels and one signature component. A document takes the points on levels it owns, and a component's
value is its earliest point. Documents with equal weights see equal points, so two components agree with the probability
of the weighted Jaccard similarity. A point later than every component's earliest is never drawn, which keeps the cost near
one draw a shingle.

Signatures are banded for candidates. In every bucket the member that shares most buckets with others leads, and others are
held against it, by the exact overlap of multisets; members of other classes than a bucket's largest are then held against all
that no chain of links joins to them yet, in blocks. So a large group of copies costs a comparison a member, and no link between classes is lost.

Words are lower-cased runs of letters, digits and non-ASCII characters. Shingles are told apart by 64-bit hashes, in signatures and in
the overlap.

Defined cases: a document without words (null and empty included) is a class of its own; one of fewer than five words is one
shingle; documents of equal words are one class; repeated rows are in one class; an empty table gives an empty result; very
long texts are taken whole; columns besides ``doc_id`` and ``text`` are carried by ``dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import words as wd
from lagweave.llm.components import components
from lagweave.llm.shared import discard, materialize
from lagweave.session import map_arrow

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Members of a bucket that meet as many others in one task.
BLOCK = 256

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def shingles_of(words: wd.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of every distinct shingle; rows in order."""
    at, hashes = wd.windows(words, k)
    rows = words.row[at]
    lengths = np.diff(words.bounds)
    few = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(few):
        extra_rows, extra = [], []
        for n in range(1, k):
            mine = few[lengths[few] == n]
            if len(mine):
                total = np.zeros(len(mine), _U)
                for j in range(n):
                    total = wd.mix(total + words.hash[words.bounds[mine] + j] + _U(n))
                extra_rows.append(mine)
                extra.append(total)
        rows, hashes = np.concatenate([rows, *extra_rows]), np.concatenate([hashes, *extra])
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    codes, _ = pd.factorize(wd.mix(hashes + (rows.astype(_U) + _U(1)) * _GOLDEN))
    if not len(codes):
        return rows, hashes, np.zeros(0, np.int64)
    weights = np.bincount(codes)
    first = np.empty(len(weights), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return rows[first], hashes[first], weights


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, m: int = COMPONENTS) -> np.ndarray:
    """An (n_rows, m) array of 64-bit values: 32 bits of time above 32 bits that name the point. Rows without shingles are all ones."""
    out = np.full((n_rows, m), np.iinfo(np.uint64).max, _U)
    total = np.bincount(rows, weights, minlength=n_rows)
    # the processes: a band of width 2**(j-1) for each power of two up to the weight, of which w - 2**(j-1) levels are owned
    element, start, width, owned = [np.arange(len(rows))], [np.zeros(len(rows), _U)], [np.ones(len(rows))], [np.ones(len(rows))]
    low = 1
    while len(above := np.flatnonzero(weights > low)):
        element.append(above)
        start.append(np.full(len(above), low, _U))
        width.append(np.full(len(above), float(low)))
        owned.append(np.minimum(weights[above] - low, low).astype(float))
        low *= 2
    element, start, width, owned = (np.concatenate(x) for x in (element, start, width, owned))
    # the first two bands have one width, so a process is told by where its band starts
    seed = wd.mix(hashes[element] ^ wd.mix((start + _U(1)) * _GOLDEN))
    row = rows[element]
    horizon = (np.log(m) + 3) / np.maximum(total, 1)
    left = total > 0
    while left.any():
        active = np.flatnonzero(left[row])
        time, draw = np.zeros(len(active)), 0
        while len(active):
            draw += 1
            bits = wd.mix(seed[active] + np.array([draw], _U) * _GOLDEN)
            uniform = ((bits >> _U(12)).astype(float) + 0.5) * 2.0**-52
            time = time - np.log(uniform) / (m * width[active])
            soon = time < horizon[row[active]]
            active, time, bits = active[soon], time[soon], bits[soon]
            more = wd.mix(bits ^ _GOLDEN)
            level = ((more >> _U(40)).astype(float) * 2.0**-24) * width[active]
            mine = level < owned[active]
            component = (((more & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)).astype(np.int64)
            value = (time.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (wd.mix(more) & _U(0xFFFFFFFF))
            np.minimum.at(out.reshape(-1), row[active][mine] * m + component[mine], value[mine])
        # a row with an empty component, or one later than the horizon would allow, looks further
        left = left & (out == np.iinfo(np.uint64).max).any(axis=1)
        horizon = np.where(left, horizon * 2, horizon)
    return out


def band_keys(names: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each row of point names."""
    total = np.broadcast_to(wd.mix((np.arange(bands, dtype=_U) + _U(1)) * _GOLDEN), (len(names), bands)).copy()
    parts = names.reshape(len(names), bands, rows)
    for j in range(rows):
        total = wd.mix(total + parts[:, :, j])
    return total


def content_digest(words: wd.Words) -> np.ndarray:
    """128 bits for each row's sequence of words."""
    n = np.diff(words.bounds)
    place = wd.mix((np.arange(len(words.hash)) - np.repeat(words.bounds[:-1], n)).astype(_U) * _GOLDEN + _U(1))
    out = np.zeros((len(n), 2), _U)
    for c, salt in enumerate((_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))):
        values = np.concatenate(([_U(0)], np.cumsum(wd.mix((words.hash ^ salt) + place))))
        out[:, c] = wd.mix(values[words.bounds[1:]] - values[words.bounds[:-1]] + n.astype(_U) * _GOLDEN)
    return out


def fixed_binary(array: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as binary values."""
    size = array.shape[1] * array.itemsize
    offsets = pa.py_buffer((np.arange(len(array) + 1) * size).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(array), [None, offsets, pa.py_buffer(np.ascontiguousarray(array).tobytes())])


def sketch(docs: DataFrame) -> DataFrame:
    """Per document with words: ``doc_id, node`` (its words' digest), ``sig`` (16 bits a component) and ``bands``."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for data, offsets in wd.blocks(b.column("text"), 1 << 20):
                words = wd.segment(data, offsets)
                n = len(offsets) - 1
                there = np.flatnonzero(np.diff(words.bounds) > 0)
                names = (signatures(*shingles_of(words), n)[there]) & _U(0xFFFFFFFF)
                keys = band_keys(names).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array((np.arange(len(there) + 1) * BANDS).astype(np.int32)), pa.array(keys.reshape(-1)))
                ids = b.column("doc_id").slice(done, n).take(pa.array(there))
                done += n
                yield pa.RecordBatch.from_arrays([ids, fixed_binary(content_digest(words)[there]), fixed_binary((names & _U(0xFFFF)).astype("<u2")), bands], schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def multisets(texts: DataFrame) -> DataFrame:
    """``node, text`` to ``node, shingles`` (sorted hashes), for rows whose words are the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for data, offsets in wd.blocks(b.column("text"), 1 << 20):
                words = wd.segment(data, offsets)
                n = len(offsets) - 1
                wanted = b.column("node").slice(done, n).to_pylist()
                done += n
                digests = content_digest(words)
                rows, hashes, weights = shingles_of(words)
                rows, hashes = np.repeat(rows, weights), np.repeat(hashes, weights)
                bounds = np.searchsorted(rows, np.arange(n + 1))
                got = [(w, np.sort(hashes[bounds[r] : bounds[r + 1]]).astype("<u8").tobytes()) for r, w in enumerate(wanted) if w == digests[r].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], ["node", "shingles"])

    return map_arrow(texts.select("node", "text"), run, "node binary, shingles binary")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(a) and not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    new = np.concatenate(([True], both[1:] != both[:-1]))
    values, total = both[new], np.diff(np.append(np.flatnonzero(new), len(both)))
    of_a = np.searchsorted(a, values, "right") - np.searchsorted(a, values, "left")
    common = int(np.minimum(of_a, total - of_a).sum())
    return common / (len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs ``(a, b)`` whose multisets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            good = [4 * least * max(len(p), len(q)) <= 4 * min(len(p), len(q)) and overlap(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")) >= least - 1e-12 for p, q in zip(x, y, strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # the side that can repeat without bound (a leader) joins last, where AQE splits its partition
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a binary, b binary")


def rest_of_buckets(members: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links between classes: ``members(bucket, node, class, sig, shingles)`` of buckets with several classes.

    The largest class of a bucket needs no look at its own pairs, so its members meet those of the other classes only, and these meet
    all. Both are cut into blocks that meet pairwise, each meeting a task's work of bounded size: with n members in the largest class and m in
    the others, members are sent some (2n + m) m / BLOCK times in all, which is in proportion to n where few have strayed. A pair
    is looked at in the first band that it shares only, and by its multisets at once, so that no pair leaves the task but links, and of
    these only such as join two classes (at most one fewer than there are members). Signatures only order the pairs, likely links first.
    """
    kinds = members.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "class"))
    kinds = kinds.groupBy("bucket").agg(largest["class"].alias("main"), largest["n"].alias("most"), F.sum("n").alias("n"))
    met = members.join(kinds, "bucket").withColumn("stray", F.col("class") != F.col("main"))
    mains, strays = (F.ceil(n / BLOCK).cast("int") for n in (F.col("most"), F.col("n") - F.col("most")))
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    # blocks of the largest class are -1, -2, .., those of the others 0, 1, ..
    met = met.withColumn("block", F.when(F.col("stray"), place(strays)).otherwise(-1 - place(mains)))
    met = met.withColumn("other", F.explode(F.sequence(F.when(F.col("stray"), -mains).otherwise(F.lit(0)), strays - 1)))
    met = met.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "class", "sig", "shingles")

    def run(_: tuple, group: pa.Table) -> pa.Table:
        n = group.num_rows
        node = group.column("node").to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        band = group.column("bucket")[0].as_py()["band"]
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(n, COMPONENTS)
        kind = np.unique(np.array(group.column("class").to_pylist(), object), return_inverse=True)[1]
        block = group.column("block").to_numpy()
        a, b = [], []
        for i in np.flatnonzero(block == lo).tolist():
            others = np.flatnonzero((kind != kind[i]) & ((block == hi) if lo != hi else (np.arange(n) > i)))
            others = others[least * np.maximum(sizes[others], sizes[i]) <= np.minimum(sizes[others], sizes[i]) + 1e-9]
            if not len(others):
                continue
            same = sig[others] == sig[i]
            agree = same.mean(axis=1)
            whole = same.reshape(len(others), BANDS, ROWS).all(axis=2)
            told = np.flatnonzero(whole.any(axis=1) & (whole.argmax(axis=1) == band))
            for j in others[told[np.argsort(-agree[told], kind="stable")]].tolist():
                if kind[j] != kind[i] and overlap(sets[i], sets[j]) >= least - 1e-12:
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
                    kind[kind == kind[j]] = kind[i]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return met.groupBy("bucket", "lo", "hi").applyInArrow(run, "a binary, b binary")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of documents with words, and ``node, class`` of the nodes that have a link."""
    sketches = materialize(sketch(docs), "sketches")
    slots = sketches.select("node", F.posexplode("bands").alias("band", "key"))
    # copies of a text fall together within each task before anything is sent
    slots = slots.groupBy("key", "band", "node").agg(F.lit(1).alias("one")).select(F.struct("band", "key").alias("bucket"), "node")
    slots = materialize(slots, "slots")
    sizes = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(slots.join(sizes, "bucket"), "buckets")
    shared = buckets.groupBy("node").agg(F.sum("n").alias("shared"))
    leaders = buckets.join(shared, "node").groupBy("bucket").agg(F.max(F.struct("shared", "node")).getField("node").alias("b"))
    pairs = buckets.join(leaders, "bucket").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    # one document for each node that meets another
    wanted = buckets.select("node").distinct()
    chosen = sketches.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("__id"))
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")))
    sets = materialize(multisets(texts).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    links = materialize(verified(pairs, sets), "links")
    found = materialize(components(links), "classes")
    # what the leaders have not joined
    named = buckets.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("bucket")
    signed = sketches.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig")).join(sets, "node")
    late = materialize(rest_of_buckets(named.join(mixed, "bucket").join(signed, "node").drop("n")).distinct(), "late_links")
    whole = materialize(components(links.unionByName(late)), "classes")
    discard(slots, buckets, sets, links, found, late)
    return sketches, whole


def _first_of_nodes(sketches: DataFrame, found: DataFrame) -> DataFrame:
    """``node, doc_id, class``: one row per node with its smallest doc_id. Copies fall together within each task first."""
    least = sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    return least.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` for every row; a class is named by its smallest doc_id."""
    sketches, found = classes(docs)
    nodes = _first_of_nodes(sketches, found)
    names = nodes.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = nodes.join(names, "class").select("node", "class_id")
    # the only join with all rows: a text with very many copies makes it skewed, and AQE splits such partitions
    with_words = sketches.select("doc_id", "node").join(named.hint("merge"), "node").select("doc_id", "class_id")
    return with_words.unionByName(_without_words(docs))


def _without_words(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(~text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).select("doc_id", F.col("doc_id").alias("class_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document for each class: that of the smallest doc_id (documents without words all stay)."""
    sketches, found = classes(docs)
    nodes = _first_of_nodes(sketches, found)
    kept = nodes.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.node").alias("__node"))
    return _rows_of(docs, kept)


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows without words, and one row for each kept (id, words)."""
    schema = docs.schema
    text = F.coalesce(F.col("text"), F.lit(""))
    has_words = text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    row = F.struct(*[docs[c] for c in docs.columns])
    packed = docs.select(docs["doc_id"].alias("__id"), text.alias("__text"), has_words.alias("__words"), row.alias("__row"))
    bare = packed.where(~F.col("__words")).select("__row.*")
    met = packed.where("__words").join(kept.withColumnRenamed("__id", "__kept"), F.col("__id").eqNullSafe(F.col("__kept")))

    at = met.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            done, nodes = 0, b.column("__node").to_pylist()
            for data, offsets in wd.blocks(b.column("__text")):
                digests = content_digest(wd.segment(data, offsets))
                good += [digests[r].tobytes() == nodes[done + r] for r in range(len(offsets) - 1)]
                done += len(offsets) - 1
            yield b.filter(pa.array(good, pa.bool_()))

    exact = map_arrow(met, run, at)
    # repeated rows: one stays for each (id, words)
    once = exact.groupBy("__kept", "__node").agg(F.first("__row").alias("__row")).select("__row.*")
    return bare.unionByName(once) if len(set(schema.names)) == len(schema.names) else bare.union(once)
