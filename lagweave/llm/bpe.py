"""Byte-level BPE over Arrow columns, each distinct chunk encoded once.

Pre-tokenisation never crosses certain places in a text, which bytes alone show: a run of blanks gives its
last blank to the word behind it if that blank is a space, and is cut before that blank. The chunks between
these places are encoded one by one with the same result as the whole text, so a chunk that returns (most
do) is looked up instead. Texts with other Unicode blanks or with a special token's string go to the library
whole. Chunks are looked up by a 64-bit hash.

``tokenizers`` defines the results. For chunks whose bytes are at most 0xC9 (characters up to U+027F) the same vocabulary and merges run in
``tiktoken``, which is faster on short strings; tests hold the two against each other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from lagweave.llm import words as wd

_BLANK = ~wd.NOT_BLANK
_ODD_BLANKS = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: The pre-tokenisation pattern of byte-level BPE with ``use_regex``.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered per worker (20 bytes each, and 4 for each id where ids are kept); beyond that the memory starts anew (a matter of speed only).
REMEMBERED = 1_000_000
#: Chunks handed to the library at once; its encodings take some kB each.
LEARNED = 8192

_loaded: dict[tuple[str, bool], Encoder] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast_twin(spec: dict):
    """tiktoken's encoder for the same vocabulary, or None if its ids are not in merge order."""
    try:
        import tiktoken
    except ImportError:
        return None
    pre, model, alphabet = spec.get("pre_tokenizer") or {}, spec["model"], _byte_alphabet()
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids) or len(ids) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("twin", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``ids``: keep the ids of known chunks; without, only their numbers (counting needs no more)."""

    def __init__(self, path: str, ids: bool = True) -> None:
        self.ids = ids
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        special = [re.escape(t["content"].encode()) for t in spec.get("added_tokens", [])]
        self.odd = re.compile(b"|".join([_ODD_BLANKS, *special]))
        self.chunked = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer")
        self.twin = _fast_twin(spec)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.counts, self.firsts = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode_text(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self._forget()
        got: list[list[int] | range] = []
        for k in range(0, len(start), LEARNED):
            raw = [data[a:b].tobytes() for a, b in zip(start[k : k + LEARNED].tolist(), end[k : k + LEARNED].tolist(), strict=True)]
            picked = [i for i, x in enumerate(raw) if self.twin is None or max(x) > 0xC9]
            encoded = self.whole.encode_batch([raw[i].decode() for i in picked], add_special_tokens=False) if picked else []
            whole = {i: e.ids for i, e in zip(picked, encoded, strict=True)}
            ids = [whole[i] if i in whole else self.twin.encode_ordinary(x.decode()) for i, x in enumerate(raw)]
            got += ids if self.ids else [range(len(x)) for x in ids]
        counts = np.fromiter(map(len, got), np.int32, len(got))
        firsts = np.zeros(len(counts), np.int64)
        if self.ids:
            firsts += len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate((self.pool, np.fromiter((t for g in got for t in g), np.uint32, int(counts.sum()))))
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.counts, self.firsts = (np.insert(known, at, new[order]) for known, new in ((self.hashes, hashes), (self.counts, counts), (self.firsts, firsts)))

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = _BLANK[data]
        first = np.zeros(len(data), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        before = np.empty(len(data), bool)
        before[0], before[1:] = False, blank[:-1]
        last = np.ones(len(data), bool)
        last[:-1] = first[1:]
        after_word = np.zeros(len(data), bool)  # a word byte follows in the same row
        after_word[:-1] = ~blank[1:]
        after_word &= ~last
        not_space = np.zeros(len(data), bool)
        not_space[1:] = data[:-1] != 32
        begins = first | (blank & ~before) | (blank & after_word) | (~blank & before & not_space)
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], len(data))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]:
        """For a block of rows: the first chunk of each row, each chunk's place in the list of known chunks, and rows encoded whole."""
        whole: dict[int, list[int]] = {}
        if not self.chunked:
            rows = range(len(offsets) - 1)
        else:
            rows = sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.odd.finditer(data.tobytes())})
        for r in rows:
            whole[r] = self.encode_text(data[offsets[r] : offsets[r + 1]].tobytes().decode())
        if len(data) == 0:
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), whole
        start, end = self._chunks(data, offsets)
        bounds = np.searchsorted(start, offsets, "left")
        if whole:
            keep = np.ones(len(start), bool)
            for r in whole:
                keep[bounds[r] : bounds[r + 1]] = False
            start, end = start[keep], end[keep]
            lengths = np.diff(bounds)
            lengths[list(whole)] = 0
            bounds = np.concatenate(([0], np.cumsum(lengths)))
        codes, unique = pd.factorize(wd.hash_spans(data, start, end))
        at = np.searchsorted(self.hashes, unique)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == unique[known]
        if not known.all():
            where = np.empty(len(unique), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]  # the first chunk with each code
            before = len(self.hashes)
            new = where[~known]
            if before + len(new) > REMEMBERED:
                new = where
            if before and len(new) == len(where):
                self._forget()
            self._learn(data, unique if len(new) == len(where) else unique[~known], start[new], end[new])
            at = np.searchsorted(self.hashes, unique)
        return bounds, codes, at, whole

    def counts_of(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each row of a string column."""
        out = []
        for data, offsets in wd.blocks(column):
            bounds, codes, at, whole = self.encode_block(data, offsets)
            cumulative = np.concatenate(([0], np.cumsum(self.counts[at][codes]))) if len(codes) else np.zeros(1, np.int64)
            n = cumulative[bounds[1:]] - cumulative[bounds[:-1]]
            for r, ids in whole.items():
                n[r] = len(ids)
            out.append(n.astype(np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def ids_of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row of a string column, in order."""
        for data, offsets in wd.blocks(column):
            bounds, codes, at, whole = self.encode_block(data, offsets)
            counts, firsts = self.counts[at], self.firsts[at]
            for r in range(len(offsets) - 1):
                if r in whole:
                    yield np.array(whole[r], np.uint32)
                    continue
                mine = codes[bounds[r] : bounds[r + 1]]
                n = counts[mine]
                before = np.cumsum(n) - n
                yield self.pool[np.repeat(firsts[mine] - before, n) + np.arange(int(n.sum()))]


def encoder(path: str, ids: bool = True) -> Encoder:
    """One encoder per worker process, file and use."""
    if (path, ids) not in _loaded:
        _loaded[path, ids] = Encoder(path, ids)
    return _loaded[path, ids]
