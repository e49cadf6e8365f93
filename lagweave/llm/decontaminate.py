"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles. A window is contained in a document only if all its shingles are, so
one of them, its rarest, is the prefix that a join needs: shingles are ordered by how often they occur in all
documents, documents are searched for prefixes only, positional and length bounds place the whole window around
a prefix, and each placed window is verified word by word, byte by byte. Equal windows of several items are one window.

Documents never move: a counting pass ranks the benchmark's shingles, a second pass searches. The benchmark goes to the executors in
one table of at most ``GROUP_WORDS`` words (100 bytes a word); a larger one takes more pairs of passes, one after the other, each with
a table of its own that is taken back before the next, and documents' findings meet by row at the end.

Defined cases: a null text has no words; an item without words never occurs; an item of fewer words than a window is one window; a null item_id is
the empty string; equal items each count; of a window's shingles that are equally rare the first is the prefix; repeated rows each get a row;
an empty benchmark leaves every document clean; an empty table gives an empty result; a very long text is searched whole; columns besides
``doc_id``, ``item_id`` and ``text``, whatever their names, are ignored by ``scan`` and carried by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import words as wd
from lagweave.llm.shared import materialize
from lagweave.session import map_arrow, ship

WINDOW = 10
SHINGLE = 5
#: Words of the items that go out at once.
GROUP_WORDS = 1_000_000


@dataclass
class Block:
    """Items' words, and their distinct windows as (first word, length) with the items that have them."""

    ids: list[str]
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    window_first: np.ndarray
    window_length: np.ndarray
    #: Of window w: items ``item[bounds[w]:bounds[w + 1]]``.
    item: np.ndarray
    bounds: np.ndarray
    #: For each shingle size: all shingles' hashes, sorted.
    shingles: dict[int, np.ndarray]
    #: For each shingle size: prefixes' hashes, sorted, and for each the window and the shingle's offset in it.
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def shingle_hashes(words: wd.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    return wd.windows(words, k)


def build_block(ids: list[str], texts: list[str | None], window: int = WINDOW, shingle: int = SHINGLE) -> Block:
    data, offsets = wd.texts_buffer(texts)
    words = wd.segment(data, offsets)
    items, firsts, lengths, keys = [], [], [], []
    for i, k in enumerate(np.diff(words.bounds).tolist()):
        w = min(k, window)
        for at in range(int(words.bounds[i]), int(words.bounds[i]) + k - w + 1 if k else 0):
            items.append(i)
            firsts.append(at)
            lengths.append(w)
            # windows are equal if their words are, to the byte
            keys.append(b" ".join(wd.LOWER[data[a:b]].tobytes() for a, b in zip(words.start[at : at + w].tolist(), words.end[at : at + w].tolist(), strict=True)))
    number: dict[bytes, int] = {}
    code = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
    pairs = np.unique(np.stack((code, np.array(items, np.int64))), axis=1) if keys else np.zeros((2, 0), np.int64)
    bounds = np.searchsorted(pairs[0], np.arange(len(number) + 1))
    leads = np.unique(code, return_index=True)[1] if keys else np.zeros(0, np.int64)
    first, length = np.array(firsts, np.int64)[leads], np.array(lengths, np.int64)[leads]
    shingles = {}
    for k in sorted({min(int(w), shingle) for w in np.unique(length)}):
        of = np.minimum(length, shingle) == k
        _, hashes = wd.windows(wd.Words(words.start, words.end, np.zeros(len(words.start), np.int64), words.hash, words.bounds), k)
        spread = length[of] - k + 1
        places = np.repeat(first[of] - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
        shingles[k] = np.unique(hashes[places])
    return Block(ids, data, words.start, words.end, words.hash, first, length, pairs[1], bounds, shingles, {})


def choose_prefixes(block: Block, counts: dict[int, np.ndarray], shingle: int = SHINGLE) -> None:
    """Each window's rarest shingle; ties go to the first."""
    words = wd.Words(block.start, block.end, np.zeros(len(block.start), np.int64), block.hash, np.zeros(0, np.int64))
    for k, known in block.shingles.items():
        chosen = np.flatnonzero(np.minimum(block.window_length, shingle) == k)
        _, hashes = wd.windows(words, k)  # rows do not matter: windows lie within their item
        first, length = block.window_first[chosen], block.window_length[chosen]
        best, offset = np.full(len(chosen), np.iinfo(np.int64).max), np.zeros(len(chosen), np.int64)
        for o in range(int(length.max(initial=0)) - k + 1):
            fits = o + k <= length
            at = np.minimum(first + o, len(hashes) - 1)
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            seen = np.where(fits, counts[k][place], np.iinfo(np.int64).max)
            better = seen < best
            best, offset = np.where(better, seen, best), np.where(better, o, offset)
        prefix = hashes[first + offset]
        order = np.argsort(prefix, kind="stable")
        block.prefixes[k] = (prefix[order], chosen[order], offset[order])


class Filter:
    """Exact membership in a sorted array, after a bit table that turns most strangers away."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.bits = np.uint64(64 - max(16, min(24, int(len(self.hashes)).bit_length() + 6)))
        self.table = np.zeros(1 << int(np.uint64(64) - self.bits), bool)
        self.table[self.hashes >> self.bits] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the members among ``hashes``."""
        maybe = np.flatnonzero(self.table[hashes >> self.bits])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


def item_groups(items: DataFrame, group_words: int = GROUP_WORDS) -> Iterator[tuple[list[str], list[str | None]]]:
    """Items in groups, read one partition after the other; the driver holds one group."""
    ids: list[str] = []
    texts: list[str | None] = []
    n = 0
    for row in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ids.append(row[0] or "")
        texts.append(row[1])
        # a word takes a byte and what parts it from the next one
        n += len((row[1] or "").encode()) // 2 + 1
        if n >= group_words:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def count_shingles(docs: DataFrame, block: Broadcast) -> list[tuple[int, int, int]]:
    """(size, place in the block's shingles, occurrences in all documents); bounded by the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value.shingles
        filters = {k: Filter(h) for k, h in known.items()}
        totals = {k: np.zeros(len(h), np.int64) for k, h in known.items()}
        for b in batches:
            for data, offsets in wd.blocks(b.column("text")):
                words = wd.segment(data, offsets)
                for k, f in filters.items():
                    _, hashes = wd.windows(words, k)
                    found = hashes[f.find(hashes)]
                    totals[k] += np.bincount(np.searchsorted(known[k], found), minlength=len(known[k]))
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["k", "at", "n"])

    partial = map_arrow(docs.select("text"), run, "k int, at long, n long")
    return [(r[0], r[1], r[2]) for r in partial.groupBy("k", "at").agg(F.sum("n")).collect()]


def prepare(docs: DataFrame, ids: list[str], texts: list[str | None]) -> Broadcast:
    """A group of items with its prefixes, on all executors."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    block = build_block(ids, texts)
    counts = {k: np.zeros(len(h), np.int64) for k, h in block.shingles.items()}
    sent = context.broadcast(block)
    for k, at, n in count_shingles(docs, sent):
        counts[k][at] = n
    sent.unpersist()
    choose_prefixes(block, counts)
    return context.broadcast(block)


def occurrences(words: wd.Words, data: np.ndarray, block: Block, filters: dict[int, Filter]) -> tuple[np.ndarray, np.ndarray]:
    """First word (of the documents) and window of every occurrence."""
    firsts, found = [], []
    for k, (prefix, window, offset) in block.prefixes.items():
        at, hashes = wd.windows(words, k)
        hit = filters[k].find(hashes)
        lo, hi = np.searchsorted(prefix, hashes[hit], "left"), np.searchsorted(prefix, hashes[hit], "right")
        n = hi - lo
        pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = np.repeat(at[hit], n)
        first, w = place - offset[pick], window[pick]
        row = words.row[place]
        length = block.window_length[w]
        inside = (first >= words.bounds[row]) & (first + length <= words.bounds[row + 1])  # position and length
        first, w, length = first[inside], w[inside], length[inside]
        for size in np.unique(length).tolist():
            mine = length == size
            a, b = first[mine], w[mine]
            same = np.ones(len(a), bool)
            for j in range(size):
                same &= words.hash[a + j] == block.hash[block.window_first[b] + j]
            a, b = a[same], b[same]
            good = _same_bytes(words, data, a, block, block.window_first[b], size)
            firsts.append(a[good])
            found.append(b[good])
    empty = np.zeros(0, np.int64)
    return np.concatenate(firsts or [empty]), np.concatenate(found or [empty])


def _same_bytes(words: wd.Words, data: np.ndarray, a: np.ndarray, block: Block, b: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words from a on are those from b on, byte by byte after lower-casing."""
    good = np.ones(len(a), bool)
    for j in range(size):
        n = words.end[a + j] - words.start[a + j]
        good &= n == block.end[b + j] - block.start[b + j]
        left, right = np.flatnonzero(good), n[good]
        if not len(left):
            break
        x = wd.LOWER[wd.bytes_of(data, words.start[a[left] + j], words.end[a[left] + j])]
        y = wd.LOWER[wd.bytes_of(block.data, block.start[b[left] + j], block.end[b[left] + j])]
        wrong = np.repeat(left, right)[x != y]
        good[wrong] = False
    return good


def search(column: pa.Array, block: Block, filters: dict[int, Filter]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each row: words, runs of words hit as (first, last but one), items found."""
    for data, offsets in wd.blocks(column):
        words = wd.segment(data, offsets)
        first, window = occurrences(words, data, block, filters)
        cover = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + block.window_length[window], -1)
        hit = np.cumsum(cover[:-1]) > 0
        # a run ends where hits end or the row does
        begins = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (words.row[1:] != words.row[:-1])))) if len(hit) else first
        ends = np.flatnonzero(hit & np.concatenate((~hit[1:] | (words.row[1:] != words.row[:-1]), [True]))) + 1 if len(hit) else first
        runs: dict[int, list[tuple[int, int]]] = {}
        for r, a, b in zip(words.row[begins].tolist(), begins.tolist(), ends.tolist(), strict=True):
            runs.setdefault(r, []).append((a - int(words.bounds[r]), b - int(words.bounds[r])))
        items: dict[int, set[int]] = {}
        pairs = np.unique(np.stack((words.row[first], window)), axis=1) if len(first) else np.zeros((2, 0), np.int64)
        for r, w in pairs.T.tolist():
            items.setdefault(r, set()).update(block.item[block.bounds[w] : block.bounds[w + 1]].tolist())
        for r, n in enumerate(np.diff(words.bounds).tolist()):
            yield n, runs.get(r, []), [block.ids[i] for i in items.get(r, ())]


def _filters(block: Block) -> dict[int, Filter]:
    return {k: Filter(p[0]) for k, p in block.prefixes.items()}


def _found(docs: DataFrame, block: Broadcast) -> DataFrame:
    """``__uid``, the runs of words hit and the items found, of the documents with a hit."""
    schema = T.StructType([T.StructField("__uid", T.LongType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = _filters(block.value)
        for b in batches:
            got = [(r, runs, items) for r, (_, runs, items) in enumerate(search(b.column("text"), block.value, filters)) if runs]
            columns = [b.column("__uid").take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.list_(pa.int64()))), pa.array([g[2] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(docs.select("__uid", "text"), run, schema)


def _count_words(docs: DataFrame) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], T.StructField("__uid", T.LongType()), T.StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.diff(wd.segment(*x).bounds) for x in wd.blocks(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__uid"), pa.array(np.concatenate(n) if n else [], pa.int64())], schema.names)

    return map_arrow(docs.select("doc_id", "__uid", "text"), run, schema)


def _results(ids: pa.Array, found: list[tuple[int, list[tuple[int, int]], list[str]]], names: list[str]) -> pa.RecordBatch:
    """The result rows of (words, runs of words hit, items)."""
    hits = []
    for _, runs, _ in found:
        total, upto = 0, 0
        for a, b in sorted(runs):
            total, upto = total + max(0, b - max(a, upto)), max(upto, b)
        hits.append(total)
    items = [sorted(set(f[2])) for f in found]
    digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
    columns = [pa.array(x, pa.int64()) for x in ([f[0] for f in found], hits, [len(i) for i in items])]
    return pa.RecordBatch.from_arrays([ids, *columns, pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], names)


def scan(docs: DataFrame, items: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Per document: ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    docs = docs.select("doc_id", "text")
    groups = item_groups(items.select("item_id", "text"), group_words)
    first, second = next(groups, ([], [])), next(groups, None)
    if second is None:
        block = prepare(docs, *first)

        def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = _filters(block.value)
            for b in batches:
                yield _results(b.column("doc_id"), list(search(b.column("text"), block.value, filters)), schema.names)

        return map_arrow(docs, search_all, schema)
    # several groups: rows get a number, and each group leaves its findings in the rows that it hits
    rows = materialize(docs.withColumn("__uid", F.monotonically_increasing_id()), "numbered")
    parts = []
    for k, (ids, texts) in enumerate(chain([first, second], groups)):
        block = prepare(rows, ids, texts)
        parts.append(materialize(_found(rows, block), f"group_{k}"))
        block.unpersist()
    hits = reduce(DataFrame.unionByName, parts).groupBy("__uid").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    met = _count_words(rows).join(hits, "__uid", "left").select("doc_id", "n_words", "runs", "items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n_words", "runs", "items")), strict=True)
            yield _results(b.column("doc_id"), [(n, runs or [], items or []) for n, runs, items in rows], schema.names)

    return map_arrow(met, merge, schema)


def clean(docs: DataFrame, items: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """The rows of ``docs`` without any occurrence, with all their columns. Each group of items works on what those before it left."""
    at = docs.columns.index("text")

    def without(left: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = _filters(block.value)
            for b in batches:
                yield b.filter(pa.array([not runs for _, runs, _ in search(b.column(at), block.value, filters)], pa.bool_()))

        return map_arrow(left, run, left.schema)

    for k, (ids, texts) in enumerate(item_groups(items.select("item_id", "text"), group_words)):
        if k:
            docs = materialize(docs, f"clean_{k}")
        docs = without(docs, prepare(docs.select("text"), ids, texts))
    return docs


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[a:a + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS a FROM s)),
dw AS (SELECT r, k, a, array_to_string(ws[a:a + k - 1], ' ') AS g
       FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
m AS (SELECT r, a, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + k)) AS p FROM m) GROUP BY r),
f AS (SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""
