import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from lagweave.llm import ctw

TEXTS = ["The cat sat", "the cat sat on the mat", None, "", "  ", "Mat mat\tmat", "é日 the", "zz top zz", "the " * 300, "the cat"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["</end>"]


class Tree:
    """Context-tree weighting in plain recursion. Contexts that are not ``kept`` are one child together."""

    def __init__(self, texts, kept=lambda s, total: True):
        self.total = Counter(context[ctw.DEPTH - d :] for t in texts for context, _ in self.coded(t) for d in range(ctw.DEPTH + 1))
        self.kept = lambda s: len(s) < ctw.POOLED or kept(s, self.total[s])
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, symbol in self.coded(t):
                for k in range(8):
                    node, bit = 1 << k | symbol >> (8 - k), symbol >> (7 - k) & 1
                    for d in range(ctw.DEPTH + 1):
                        s = context[ctw.DEPTH - d :]
                        self.n[s, node][bit] += 1
                        if d and self.kept(s):
                            self.children[s[1:], node].add(s)
        self.pw = cache(self._pw)

    @staticmethod
    def coded(t):
        b = b"\0" * ctw.DEPTH + lower(t).encode() + b"\0"
        return [(b[i - ctw.DEPTH : i], b[i]) for i in range(ctw.DEPTH, len(b))]

    def pe(self, s, node):
        return self.kt(*self.n.get((s, node), (0, 0)))

    def rest(self, s, node):
        """Counts of what no kept child has seen."""
        return [x - sum(self.n[c, node][k] for c in self.children.get((s, node), ())) for k, x in enumerate(self.n.get((s, node), (0, 0)))]

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def _pw(self, s, node):
        if len(s) == ctw.DEPTH:
            return self.pe(s, node)
        below = sum(self.pw(c, node) for c in self.children.get((s, node), ())) + self.kt(*self.rest(s, node))
        hi, lo = max(self.pe(s, node), below), min(self.pe(s, node), below)
        return math.log(0.5) + hi + math.log1p(math.exp(lo - hi))

    def predict(self, context, node, d=0):
        s = context[ctw.DEPTH - d :]
        a, b = self.n.get((s, node), (0, 0))
        if a + b == 0:
            return 0.5
        kt = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return kt
        w = math.exp(math.log(0.5) + self.pe(s, node) - self.pw(s, node))
        if context[ctw.DEPTH - d - 1 :] in self.children.get((s, node), ()):
            return w * kt + (1 - w) * self.predict(context, node, d + 1)
        a, b = self.rest(s, node)
        return w * kt + (1 - w) * (b + 0.5) / (a + b + 1)

    def log10(self, t):
        total = 0.0
        for context, symbol in self.coded(t):
            for k in range(8):
                p = self.predict(context, 1 << k | symbol >> (8 - k))
                total += math.log10(p if symbol >> (7 - k) & 1 else 1 - p)
        return total


@pytest.mark.parametrize(("head", "kept"), [(1_000_000, 1_000_000), (3, 30), (3, 0)])
def test_matches_plain_recursion(spark, monkeypatch, head, kept):
    monkeypatch.setattr(ctw, "HEAD", head)
    monkeypatch.setattr(ctw, "KEPT", kept)
    least, plain = {}, ctw.thresholds
    monkeypatch.setattr(ctw, "thresholds", lambda *x: least.update(plain(*x)) or least)
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = {r["doc_id"]: r for r in ctw.train_and_score(df).collect()}
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [t for i, t in rows if i not in out]
    c = Counter(w for t in train for w in tokens(t))
    n, tree = sum(c.values()), Tree(train, lambda s, total: math.floor(math.log2(total) * 8 + 1e-9) >= least[len(s)])
    assert len(got) == len(rows)
    if kept == 30:  # some are kept and some are pooled
        deep = [s for s in tree.total if len(s) == ctw.POOLED]
        assert 0 < sum(map(tree.kept, deep)) < len(deep)
    for i, t in rows:
        r, w = got[i], tokens(t)
        assert r["held_out"] == (i in out)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w))
        assert r["score"] == pytest.approx(tree.log10(t), rel=1e-4)


def test_the_model_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ctw, "KEPT", 200)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = ctw.fit(df)
    sent = model.bytes.value
    assert all(len(sent.seen[d][0]) <= 200 and len(sent.levels[d][0]) <= 8 * 200 for d in sent.seen)
    assert list(ctw.score(df, model).columns)[0] == "doc_id" and list(ctw.train_and_score(df).columns)[:2] == ["doc_id", "held_out"]


def test_very_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, "ab " * 600_000, 1, "x"), (1, "ab", 2, "y"), (0, None, 3, "z")], "doc_id long, text string, n_tokens int, key string")
    got = ctw.train_and_score(df).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2, 600_001] and all(r["score"] <= 0 for r in got)


def test_empty_table(spark):
    assert ctw.train_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sent", [0, 40, 1_000_000])
def test_all_contexts_are_in_the_trees_whatever_goes_out(spark, monkeypatch, sent):
    monkeypatch.setattr(ctw, "SENT", sent)
    monkeypatch.setattr(ctw, "GROUP", 50)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    train = [t for i, t in enumerate(TEXTS) if i % 2]
    model = ctw.fit(df.where("doc_id % 2 = 1"))
    tree = Tree(train)
    out, seen = len(model.bytes.value.seen[ctw.DEPTH][0]), len({c for t in train for c in Tree.coded(t)})
    assert out <= sent and (out > 0) == (sent > 0) and (out == seen) == (sent > seen)
    for r in ctw.score(df, model).collect():
        assert r["score"] == pytest.approx(tree.log10(TEXTS[r["doc_id"]]), rel=1e-9)


def test_more_contexts_than_were_ever_kept(spark, monkeypatch):
    import random

    letters = random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=450_000)
    rows = [(i, "".join(letters[i % 450 * 1000 : (i % 450 + 1) * 1000])) for i in range(900)]  # twice each, so that deep contexts tell
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["score"] for r in ctw.train_and_score(df).collect()}
    monkeypatch.setattr(ctw, "KEPT", 10**9)
    whole = {r["doc_id"]: r["score"] for r in ctw.train_and_score(df).collect()}
    assert len(got) == len(rows) and got == pytest.approx(whole, rel=1e-6)
