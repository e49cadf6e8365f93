"""Vectorised words over Arrow string columns.

A batch of texts is one UTF-8 buffer with row offsets.  ``segment`` finds the words of all rows at once
with NumPy and gives each a 64-bit hash, so that no Python object is made per word.  Buffers are worked
through in bounded pieces, so one very long text needs no more working memory than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
#: A block of rows is cut at about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

_BYTES = np.arange(256)
#: Letters, digits and every byte of a non-ASCII character: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: ``[^\x20\x09-\x0D]``.
NOT_BLANK = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: A-Z to a-z.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``n + 1`` row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[at : at + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(offsets)
        missing = np.asarray(column.is_null())
        if lengths[missing].any():  # Arrow allows bytes under a null
            return text_buffer(column.fill_null(""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pa.array([t or "" for t in texts], pa.large_string()))


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes."""
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    """Words in text order. ``row`` is the row each belongs to; ``bounds[i]:bounds[i + 1]`` are row i's."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; spans must be in order and must not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    lengths = end - start
    cumulative = np.concatenate(([0], np.cumsum(lengths)))
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(cumulative, cumulative[i] + PIECE_BYTES, "right")) - 1)
        if j == i + 1 and lengths[i] > PIECE_BYTES:
            out[i] = _hash_long(fold[data[start[i] : end[i]]])
            i = j
            continue
        n, size = lengths[i:j], int(cumulative[j] - cumulative[i])
        if size:
            first = cumulative[i:j] - cumulative[i]
            within = np.arange(size) - np.repeat(first, n)
            values = _BYTE_VALUES[fold[data[within + np.repeat(start[i:j], n)]]]
            longest = int(n.max())
            powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
            values *= powers[within]
            sums = np.add.reduceat(values, np.minimum(first, size - 1))
            sums[n == 0] = 0
        else:
            sums = np.zeros(j - i, np.uint64)
        out[i:j] = mix(sums + n.astype(np.uint64) * _MULTIPLIER)
        i = j
    return out


def _hash_long(data: np.ndarray) -> np.uint64:
    total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    powers = _powers(PIECE_BYTES)
    for k in range(0, len(data), PIECE_BYTES):
        piece = _BYTE_VALUES[data[k : k + PIECE_BYTES]]
        total += scale * np.sum(piece * powers[: len(piece)], dtype=np.uint64)
        scale = scale * powers[-1:] * _MULTIPLIER
    return mix(total + np.array([len(data)], np.uint64) * _MULTIPLIER)[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; no run crosses a row's bounds."""
    starts, ends = [], []
    is_folded = is_word[fold]
    for lo in range(0, len(data), PIECE_BYTES):
        hi = min(len(data), lo + PIECE_BYTES)
        inside = np.zeros(hi - lo + 2, bool)
        inside[1:-1] = is_folded[data[lo:hi]]
        inside[0] = lo > 0 and is_folded[data[lo - 1]]
        inside[-1] = hi < len(data) and is_folded[data[hi]]
        cut = np.zeros(hi - lo + 1, bool)  # cut[i]: a row begins at lo + i
        inner = offsets[(offsets >= lo) & (offsets <= hi)] - lo
        cut[inner] = True
        begins = inside[1:-1] & (~inside[:-2] | cut[:-1])
        finishes = inside[1:-1] & (~inside[2:] | cut[1:])
        starts.append(np.flatnonzero(begins) + lo)
        ends.append(np.flatnonzero(finishes) + lo + 1)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def segment(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ALNUM, fold: np.ndarray = LOWER) -> Words:
    """All words of all rows, hashed after folding."""
    start, end = spans(data, offsets, is_word, fold)
    bounds = np.searchsorted(start, offsets, "left")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(start, end, row, hash_spans(data, start, end, fold), bounds)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``k`` words that lies in one row."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[: n - k + 1] == words.row[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = (total + words.hash[at + j]) * _MULTIPLIER
        total ^= total >> np.uint64(29)
    return at, mix(total + np.uint64(k))


def bytes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    n = end - start
    before = np.cumsum(n) - n
    return data[np.repeat(start - before, n) + np.arange(int(n.sum()))]


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows that ``bounds`` delimits."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
