"""License scans: an exact set-similarity join of text blocks with license templates, beside fixed phrases.

A template is a notice by which a license is applied, or a license's whole text. Its blocks in a document are all runs of consecutive words that
are as long as the template at the threshold lets them be, ``len(T) / THRESHOLD`` words; template and block are sets of words, and a template
is found where at least ``THRESHOLD`` of its words stand in one block. Words scattered over a line or paragraph thus are no license.

Words are ordered by how often they occur in all documents. Of a template's words the rarest ``|T| - ceil(THRESHOLD |T|) + 1`` are its
prefix: a block that meets the threshold must hold one of them, so only blocks that reach a prefix word (position) and hold enough of
the template's words, repeats included (length), are counted in full. A block that meets the threshold can be begun at its first template
word, so these blocks are all that need a look, and none that meets the threshold is missed.

Documents never move; templates are parameters and so of bounded size.

Defined cases: a null text has no words, labels or places (empty label strings, null first and last word, score 0); words equally frequent
are ordered by their hashes; repeated rows each get a row; an empty table gives an empty result; very long texts are scanned whole; columns
besides ``doc_id`` and ``text``, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import words as wd
from lagweave.llm.decontaminate import Filter
from lagweave.session import map_arrow

THRESHOLD = 0.9

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by which public licenses are applied and texts of short ones, by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License",),
    "apache-2.0": (
        "the Apache License, Version 2.0", "the Apache-2.0 license",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "under the BSD License", "BSD 3-Clause License", "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "cc-by-nc": ("licensed under CC BY-NC 4.0", "licensed under CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": ("CC0 1.0 Universal", "dedicated to the public domain under CC0"),
    "gpl-2.0": ("GNU General Public License, version 2",),
    "gpl-3.0": (
        "GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "isc": ("under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "lgpl": ("GNU Lesser General Public License",),
    "mit": (
        "under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": ("the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def reach_of(words: int, threshold: float) -> int:
    """Words in a block of a template of so many words."""
    return int(words / threshold + 1e-9)


class Templates:
    """Templates as word sets; ``order`` them once the words' frequencies are known."""

    def __init__(self, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> None:
        self.labels = [label for label, texts in templates.items() for _ in texts]
        words = wd.segment(*wd.texts_buffer([t for texts in templates.values() for t in texts]))
        self.vocabulary = np.unique(words.hash)
        self.sets = [np.unique(np.searchsorted(self.vocabulary, words.hash[a:b])) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        if any(len(s) == 0 for s in self.sets):
            raise ValueError("a template needs a word")
        self.reach = [reach_of(int(n), threshold) for n in np.diff(words.bounds)]
        self.needed = np.array([int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets])
        spoken = wd.segment(*wd.texts_buffer(list(phrases)))
        self.phrases = [(label, spoken.hash[a:b]) for label, a, b in zip(phrases.values(), spoken.bounds[:-1], spoken.bounds[1:], strict=True)]

    def order(self, counts: np.ndarray) -> Templates:
        """``counts``: each vocabulary word's occurrences."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(counts))
        prefixes = []
        #: place[word, template]: the word's place in the template's order, or beyond its end
        self.place = np.full((len(self.vocabulary), len(self.sets)), 1 << 14, np.int16)
        for t, s in enumerate(self.sets):
            ordered = s[np.argsort(rank[s])]
            self.place[ordered, t] = np.arange(len(ordered))
            prefixes.append(ordered[: len(s) - self.needed[t] + 1])
        self.sizes = np.array([len(s) for s in self.sets])
        self.prefix_hashes = self.vocabulary[np.unique(np.concatenate(prefixes))] if prefixes else np.zeros(0, np.uint64)
        return self


def count_words(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each vocabulary word in all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Filter(vocabulary), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for data, offsets in wd.blocks(b.column("text")):
                hashes = wd.segment(data, offsets).hash
                total += np.bincount(np.searchsorted(vocabulary, hashes[known.find(hashes)]), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in map_arrow(docs.select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def matches(words: wd.Words, templates: Templates, known: Filter, prefixes: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each template: the rows with a block that meets the threshold, and the largest share of the template in one."""
    near = prefixes.find(words.hash)
    if not len(near):
        return
    at = known.find(words.hash)
    token = np.searchsorted(templates.vocabulary, words.hash[at])
    reached = np.searchsorted(templates.vocabulary, words.hash[near])
    for t, (size, needed, reach) in enumerate(zip(templates.sizes.tolist(), templates.needed.tolist(), templates.reach, strict=True)):
        anchors = near[templates.place[reached, t] <= size - needed]
        if not len(anchors):
            continue
        member = templates.place[token, t] < size
        place, code = at[member], token[member]
        stop = np.minimum(place + reach, words.bounds[words.row[place] + 1])
        # blocks that begin with a template word and reach a prefix word, with words enough
        ahead = anchors[np.minimum(np.searchsorted(anchors, place), len(anchors) - 1)]
        upto = np.searchsorted(place, stop)
        begins = np.flatnonzero((ahead >= place) & (ahead < stop) & (upto - np.arange(len(place)) >= needed))
        # a template word counts in a block where it has not stood before in it
        order = np.lexsort((place, code))
        before = np.full(len(place), -1)
        same = code[order][1:] == code[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        for k in range(0, len(begins), 4096):
            first = begins[k : k + 4096]
            n = upto[first] - first
            inside = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            new = before[inside] < np.repeat(first, n)
            common = np.add.reduceat(new.astype(np.int64), np.cumsum(n) - n)
            good = common >= needed
            if good.any():
                yield t, words.row[place[first[good]]], common[good] / size


def scan_column(column: pa.Array, templates: Templates, known: Filter, prefixes: Filter) -> Iterator[tuple]:
    for data, offsets in wd.blocks(column, 1 << 20):
        words = wd.segment(data, offsets)
        n = len(offsets) - 1
        places, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
        base: dict[int, set[str]] = {}
        for label, phrase in templates.phrases:
            k = len(phrase)
            at = np.flatnonzero(words.hash[: max(len(words.hash) - k + 1, 0)] == phrase[0])
            for j in range(1, k):
                at = at[words.hash[at + j] == phrase[j]]
            at = at[words.row[at] == words.row[at + k - 1]] if len(at) else at
            rows = words.row[at]
            within = at - words.bounds[rows]
            np.add.at(places, rows, 1)
            np.minimum.at(first, rows, within)
            np.maximum.at(last, rows, within)
            for r in np.unique(rows).tolist():
                base.setdefault(r, set()).add(label)
        labels = {r: set(x) for r, x in base.items()}
        score = np.zeros(n)
        score[places > 0] = 1.0
        for t, rows, share in matches(words, templates, known, prefixes):
            np.maximum.at(score, rows, share)
            for r in np.unique(rows).tolist():
                labels.setdefault(r, set()).add(templates.labels[t])
        lengths = np.diff(words.bounds)
        for r in range(n):
            there = places[r] > 0
            yield int(lengths[r]), int(places[r]), int(first[r]) if there else None, int(last[r]) if there else None, ",".join(sorted(base.get(r, ()))), ",".join(sorted(labels.get(r, ()))), float(score[r])


def scan(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """Per document: ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    templates = templates or Templates()
    templates.order(count_words(docs, templates.vocabulary))
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in kinds.items())])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, prefixes = Filter(templates.vocabulary), Filter(templates.prefix_hashes)
        for b in batches:
            got = list(scan_column(b.column("text"), templates, known, prefixes))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate(arrow))], schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _words_of(text: str) -> list[str]:
    out, word = [], ""
    for c in text + " ":
        c = c.lower() if c.isascii() else c
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def oracle_sql(templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by counting the distinct template words of every block."""
    split = [(i, label, _words_of(t)) for i, (label, t) in enumerate((label, t) for label, texts in templates.items() for t in texts)]
    rows = ", ".join(f"({i}, '{label}', {sorted(set(ws))!r}, {reach_of(len(ws), threshold)})" for i, label, ws in split)
    return rf"""
WITH t(id, label, ts, reach) AS (VALUES {rows}),
v AS (SELECT id, label, len(ts) AS size, reach, unnest(ts) AS word FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM d),
i AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS k FROM w),
o AS (SELECT r, id, label, size, k, count(DISTINCT word) OVER (PARTITION BY r, id ORDER BY k RANGE BETWEEN CURRENT ROW AND reach - 1 FOLLOWING) AS n FROM i JOIN v ON v.word = i.ws[k]),
f AS (SELECT r, list(DISTINCT label) AS ls, max(n / size::DOUBLE) AS share FROM o WHERE n >= ceil({threshold} * size - 1e-9) GROUP BY r),
p AS (SELECT r, k - 1 AS k, CASE WHEN ws[k] = 'cc' AND ws[k + 1] = 'by' THEN 'cc-by' WHEN ws[k] = 'general' AND ws[k + 1] = 'public' AND ws[k + 2] = 'license' THEN 'gpl'
             WHEN ws[k] = 'all' AND ws[k + 1] = 'rights' AND ws[k + 2] = 'reserved' THEN 'reserved' END AS label FROM i),
g AS (SELECT r, count(*) AS n, min(k) AS lo, max(k) AS hi, list(DISTINCT label) AS ls FROM p WHERE label IS NOT NULL GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_base, g.lo::BIGINT AS first_word, g.hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(g.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(g.ls, []) || coalesce(f.ls, []))), ','), '') AS labels,
       CASE WHEN g.n > 0 THEN 1.0 ELSE coalesce(f.share, 0) END::DOUBLE AS score
FROM w LEFT JOIN f USING (r) LEFT JOIN g USING (r)
"""
