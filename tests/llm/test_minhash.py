import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lagweave.llm import minhash as mh
from lagweave.llm import words as wd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs):
    """Classes by all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    pairs = {(a, b) for rows in where.values() for a in rows for b in rows if a < b}
    for a, b in pairs:
        inter, union = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
        if inter >= 0.8 * union:
            parent[top(b)] = top(a)
    least = {}
    for i, (d, _) in enumerate(docs):
        t = top(i)
        least[t] = min(least.get(t, d), d)
    return sorted((d, least[top(i)]) for i, (d, _) in enumerate(docs))


def near(rng, words, change):
    return " ".join(w if rng.random() > change else f"new{rng.random()}" for w in words)


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = [(1, None), (2, ""), (3, " .,"), (4, "one two"), (5, "One, TWO!"), (6, "two one")]
    for g in range(6):
        base = rng.choices(vocabulary, k=rng.choice([20, 80, 300]))
        docs += [(100 * (g + 1) + k, near(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.1]))) for k in range(14)]
    docs += [(1000, "again and " * 4000), (1001, "again and " * 4001), (1002, "again and again and again and")]
    docs += [docs[10], docs[10], (2000, docs[10][1])]
    return docs


def test_estimate_is_unbiased():
    rng = random.Random(1)
    for shared in (0.3, 0.6, 0.9):
        got, true = [], []
        for _ in range(30):
            keys = [rng.getrandbits(63) for _ in range(60)]
            a = {k: rng.choice([1, 1, 1, 2, 3, 7, 20]) for k in keys}
            b = {k if rng.random() < shared else rng.getrandbits(63): max(1, w + rng.choice([0, 0, 1, -1])) for k, w in a.items()}
            rows = np.repeat([0, 1], [len(a), len(b)])
            h = np.array([*a, *b], np.uint64)
            s = mh.signatures(rows, h, np.array([*a.values(), *b.values()]), 2) & np.uint64(0xFFFFFFFF)
            got.append((s[0] == s[1]).mean())
            true.append(sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}))
        assert abs(np.mean(got) - np.mean(true)) < 0.03


def test_estimate_is_unbiased_for_weights_one_and_two():
    # 80 common shingles of weight 2 and 20 single ones on each side: 160 / 200
    rng = random.Random(2)
    got = []
    for _ in range(30):
        common, one, two = ([rng.getrandbits(63) for _ in range(n)] for n in (80, 20, 20))
        h = np.array([*common, *one, *common, *two], np.uint64)
        s = mh.signatures(np.repeat([0, 1], 100), h, np.array(([2] * 80 + [1] * 20) * 2), 2) & np.uint64(0xFFFFFFFF)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 0.8) < 0.03


def test_overlap():
    a, b = np.array([1, 1, 2, 5], np.uint64), np.array([1, 2, 2, 5], np.uint64)
    assert mh.overlap(a, b) == pytest.approx(3 / 5)
    assert mh.overlap(a[:0], b[:0]) == 0


@pytest.mark.parametrize("block", [512, 3])
def test_classes_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(mh, "BLOCK", block)
    docs = fixture()
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, node int").repartition(3)
    got = sorted(tuple(r) for r in mh.near_duplicates(df).collect())
    assert got == brute(docs)


def test_rest_of_buckets_verifies_pairs_whose_signatures_disagree(spark):
    # one band of 24 in common, multisets at 0.9
    one = np.arange(mh.COMPONENTS, dtype="<u2")
    two = np.where(np.arange(mh.COMPONENTS) < mh.ROWS, one, one + 1000).astype("<u2")
    sets = np.arange(19, dtype="<u8"), np.arange(1, 19, dtype="<u8")
    rows = [((0, 7), bytes([k]), bytes([k]), bytearray(sig.tobytes()), bytearray(s.tobytes())) for k, (sig, s) in enumerate(zip((one, two), sets, strict=True))]
    members = spark.createDataFrame(rows, "bucket struct<band: int, key: long>, node binary, class binary, sig binary, shingles binary")
    assert [(bytes(r["a"]), bytes(r["b"])) for r in mh.rest_of_buckets(members).collect()] == [(bytes([0]), bytes([1]))]


@pytest.mark.parametrize("block", [2, 256])
def test_rest_of_buckets_meets_all_classes(spark, monkeypatch, block):
    # one bucket; a large class, a pair of classes joined by one link between members that lead nothing, and a stranger
    monkeypatch.setattr(mh, "BLOCK", block)
    rng = np.random.default_rng(0)
    sig = np.zeros(mh.COMPONENTS, "<u2").tobytes()
    base = [np.sort(rng.integers(0, 2**63, 40, np.uint64)) for _ in range(4)]
    members = [(b"L", base[0]) for _ in range(9)] + [(b"M", base[1]), (b"M", base[2]), (b"N", np.sort(np.concatenate((base[2][:38], base[3][:2]))))] + [(b"S", base[3])]
    rows = [((0, 7), bytes([k]), bytearray(c), bytearray(sig), bytearray(x.astype("<u8").tobytes())) for k, (c, x) in enumerate(members)]
    frame = spark.createDataFrame(rows, "bucket struct<band: int, key: long>, node binary, class binary, sig binary, shingles binary")
    assert [(bytes(r["a"]), bytes(r["b"])) for r in mh.rest_of_buckets(frame).distinct().collect()] == [(bytes([10]), bytes([11]))]


def test_dedup_keeps_one_row_of_each_class(spark):
    docs = fixture()
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, node int")
    got = mh.dedup(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, c in brute(docs)})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mh.near_duplicates(df).count() == 0 and mh.dedup(df).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in mh.near_duplicates(df).collect()) == brute(docs)


def test_long_word_hashes_do_not_depend_on_their_neighbours():
    long = "x" * (wd.PIECE_BYTES + 7)
    one, two = wd.segment(*wd.texts_buffer([long])), wd.segment(*wd.texts_buffer(["a b", f"c {long} d"]))
    assert one.hash[0] == two.hash[3]
