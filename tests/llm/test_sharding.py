import zlib
from collections import Counter, defaultdict

import pytest

from lagweave.llm import sharding as sh


def texts(n=4000):
    return [(i, None if i % 97 == 0 else "t" * (i % 13) + "é") for i in range(n)] + [(5, "same")] * 50 + [(None, "x")] * 3


def test_law_and_slots(spark):
    tree = sh.even_tree(8)
    rows = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    got = sh.assign(df, tree, sh.grown(tree), pieces=16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, of = defaultdict(list), {}
    for r in got:
        assert r["law"] == "key" and of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(of.values())
    assert all(abs(n - 500) < 110 for n in sizes.values())
    moved = sum(r["grown_shard"] == 8 for r in got) / len(got)
    assert abs(moved - 1 / 9) < 0.03


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    tree = sh.even_tree(8)
    heavier = [sh.Shard(s.region, s.rack, s.number, 3.0 if s.number == 0 else 1.0) for s in tree]
    df = spark.createDataFrame([(i, "x") for i in range(3000)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["shard"] for r in sh.assign(df, t).collect()} for t in (tree, heavier))
    region = {s.number: s.region for s in tree}
    assert all(region[b[i]] == region[0] for i in a if a[i] != b[i])
    share = sum(s == 0 for s in b.values()) / len(b)
    assert abs(share - 0.3) < 0.04
    with pytest.raises(ValueError, match="weight"):
        sh.assign(df, [sh.Shard("a", "b", 0, 0.0)])


def test_a_very_often_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(sh, "REPEATS", 7)
    df = spark.createDataFrame([(1, "x")] * 50 + [(2, "y")], "doc_id long, text string")
    got = sh.assign(df, [sh.Shard("a", "b", 0)]).collect()
    assert sorted(r["slot"] for r in got) == list(range(51)) and all(r["grown_shard"] is None for r in got)


def test_empty_table(spark):
    assert sh.assign(spark.createDataFrame([], "doc_id long, text string"), sh.even_tree(8)).count() == 0


def test_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = [(1, None), (1, ""), (None, "é日😀"), (None, "é日😀"), (7, "long " * 200_000), (7, "long " * 200_000), (8, "\x00\x7f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree = sh.even_tree(8)
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.sql(sh.oracle_sql(tree, sh.grown(tree)))
    got = sh.assign(df, tree, sh.grown(tree)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
