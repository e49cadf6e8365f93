import hashlib
import re

import numpy as np

from lagweave.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            size = min(len(v), 10)
            grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for p in range(len(w) - size + 1 if size else 0):
                if tuple(w[p : p + size]) in grams:
                    hit |= set(range(p, p + size))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def fixture():
    long = " ".join(f"Wörd{i}" for i in range(30))
    items = [(1, long), (2, "short item Here"), (3, None), (4, "..."), (5, long), (10, "a b a b a b a b a b a b a"), (6, "solo")]
    docs = [
        (1, f"x {long} y"), (2, "Wörd3-wörd4, wörd5 WÖRD6"), (3, None), (4, ""), (5, "SHORT, item\n\nhere! and short item hereby"),
        (6, " ".join(long.split()[5:15])), (7, " ".join(long.split()[5:14])), (8, "b a b a b a b a b a b c" * 3), (9, "solo " * 5000), (9, "solo"), (11, "wörd1 " * 20),
    ]
    return docs, items


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_matches_brute_force_in_one_and_in_many_groups(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], DOCS).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(dc.scan(d, i)) == want
    assert rows(dc.scan(d, i, group_words=5)) == want


def test_clean_keeps_whole_rows(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], DOCS)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = dc.clean(d, i)
    assert got.columns == d.columns
    assert sorted(r["doc_id"] for r in dc.clean(d, i, group_words=5).collect()) == sorted(r["doc_id"] for r in got.collect())
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])


def test_groups_are_bounded_and_equal_windows_are_one():
    shared = " ".join(f"s{i}" for i in range(10))
    block = dc.build_block(["a", "b", "c"], [f"{shared} one", f"two {shared}", "no"])
    assert len(block.window_first) == 4 and sorted(np.diff(block.bounds).tolist()) == [1, 1, 1, 2]

    class Rows:
        def select(self, *_):
            return self

        def toLocalIterator(self):  # noqa: N802
            return iter([(str(k), "word " * 50) for k in range(20)])

    groups = list(dc.item_groups(Rows(), 300))
    assert [i for ids, _ in groups for i in ids] == [str(k) for k in range(20)]
    assert all(sum(len(t.split()) for t in texts) <= 300 + 50 for _, texts in groups)


def test_empty_tables(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], DOCS)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert rows(dc.scan(d.limit(0), i)) == []
    assert rows(dc.scan(d, i.limit(0))) == brute(docs, [])


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    d, i = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    want = brute([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in i.select("item_id", "text").collect()])
    assert rows(dc.scan(d, i)) == want
    assert any(r[5] for r in want)
