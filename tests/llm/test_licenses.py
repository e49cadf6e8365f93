import math
import random
import re

import pytest

from lagweave.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    text = text or ""
    w = words(text)
    places = [(i, label) for phrase, label in li.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    labels, score = set(base), 1.0 if places else 0.0
    for label, texts in li.TEMPLATES.items():
        for notice in texts:
            want, reach = set(words(notice)), li.reach_of(len(words(notice)), li.THRESHOLD)
            n = max((len(want & set(w[i : i + reach])) for i in range(len(w))), default=0)
            if n >= math.ceil(li.THRESHOLD * len(want) - 1e-9):
                labels.add(label)
                score = max(score, n / len(want))
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), pytest.approx(score)


MIT = li.TEMPLATES["mit"][1]
TEXTS = [
    None, "", "...", "Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\ny", "All RIGHTS, reserved all rights reserved", "cc\nby", "all rights\n\nreserved",
    "This work is licensed under the GNU General Public License, version 3.", MIT, MIT.replace("charge", "cost"), "\n".join(MIT[i : i + 60] for i in range(0, len(MIT), 60)),
    "\n\n".join(MIT.split(", ")), MIT.replace("software", "thing").replace("copy", "kopie").replace("person", "one").replace("permit", "let").replace("sell", "give"), "mit der license\n\nthe", "das mit the license " + "wort " * 20000,
    "I read the book at mit and got a license to fish", "I live under the roof of MIT and its License", "license MIT the under",
    "x " + MIT[:200] + " y " * 30 + MIT[200:], ("the of to and in software permission notice " * 300) + MIT, "word " * 100 + MIT.replace("restriction", "limit").replace("merge, ", "") + " word" * 100,
    "licensed under the Apache License,\n \t\nVersion 2.0", "a\n\nb\n\n\nthe ISC\nLicense",
]


def test_matches_all_pairs(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")], "doc_id long, text string, labels string").repartition(3)
    got = li.scan(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r)[1:] == brute(TEXTS[r["doc_id"]]), r
    assert {r["doc_id"]: r["labels"] for r in got}[TEXTS.index("I read the book at mit and got a license to fish")] == ""
    assert li.scan(df.limit(0)).count() == 0


def test_random_texts(spark):
    rng = random.Random(4)
    pool = [x for texts in li.TEMPLATES.values() for t in texts for x in words(t)] + ["other", "words"] * 20
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            notice = words(rng.choice(rng.choice(list(li.TEMPLATES.values()))))
            parts += rng.choices(pool, k=rng.randint(0, 12)) + [x for x in notice if rng.random() > rng.choice([0, 0.05, 0.12])]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in li.scan(df).collect():
        assert tuple(r)[1:] == brute(texts[r["doc_id"]]), r
