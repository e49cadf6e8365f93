"""The pipeline's stages against plain checks on the smallest tables."""

from collections import Counter

import corpus_pipeline
from lagweave.llm import toxicity
from lagweave.llm.queries import tokenizer_path
from tests.llm import test_decontaminate, test_minhash, test_quality

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        after = stage(spark, now, SF)
        assert after.columns == docs.columns
        kept = sorted(r["doc_id"] for r in after.collect())
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.5]
        elif name == "quality_rules":
            want = [d for d, t in before if test_quality.brute(t)[6]]
        elif name == "minhash_near_dedup":
            want = {c for _, c in test_minhash.brute(before)}
        else:
            want = [r[0] for r in test_decontaminate.brute(before, items) if not r[5]]
        assert kept == sorted(want), name
        now = spark.createDataFrame(after.collect(), docs.schema)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, t in now.select("doc_id", "text").collect():
        want[d] = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    packed = corpus_pipeline.run(spark, SF).collect()
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want


def odd_rows():
    prose = [" ".join(f"word{k}x{i} other{k}y{i}" for i in range(60)) for k in range(6)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(prose)]
    rows += [(0, prose[0], "en", "s", 0)] * 3  # repeated rows
    rows += [(90, prose[0], None, None, None), (91, prose[1] + " w", "en", "s", 0)]  # copies, exact and near
    rows += [(None, None, None, None, None), (70, None, "en", "s", 0), (71, "", "en", "s", 0), (None, prose[2], "en", "s", 0)]
    rows += [(80, " ".join(f"long{i} word{i % 7919}" for i in range(150_000)), "en", "s", 0)]  # very long
    rows += [(81, prose[3][:300] + " " + "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 " + prose[4][:300], "en", "s", 0)]  # a benchmark passage
    return rows


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    folder = str(tmp_path)
    # columns that the operators use themselves
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(odd_rows(), schema)
    extra = docs.selectExpr("*", "'k' AS kept", "1 AS node", "2 AS __text", "3 AS length", "4 AS score", "5 AS __uid")
    extra.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == columns
        now = spark.createDataFrame(now.collect(), extra.schema)
    kept = Counter(r["doc_id"] for r in now.collect())
    # documents 0, 90 and their repeats are one group, 1 and 91 another; 81 holds the passage; null and empty texts fail the rules
    assert kept[0] == 1 and kept[90] == 0 and kept[1] == 1 and kept[91] == 0 and kept[81] == 0
    assert kept[70] == kept[71] == 0 and kept[80] == 1 and all(kept[k] == 1 for k in (3, 4, 5))
    assert kept[2] + kept[None] == 1  # equal texts, one of them under a null id
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept) - {k for k, n in kept.items() if not n}


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
