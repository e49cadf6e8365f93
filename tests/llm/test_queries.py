"""Every corpus query on the smallest tables: its columns, and its SQL where there is some."""

import duckdb
import pytest

from lagweave.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id class_id", "op2": "doc_id held_out score predicted", "op3": "doc_id n_bytes n_tokens over_limit",
    "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6": "doc_id size text_crc32 law shard slot grown_shard",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated", "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "doc_id n_words n_base first_word last_word base_labels labels score", "op10": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(got.columns)
    n = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op10') else 'documents'}.parquet").count()
    assert got.count() >= n if name.startswith("op8") else got.count() == n


@pytest.mark.parametrize("name", queries.SQL)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    columns = want.columns
    rows = sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want.fetchall())))
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got))) == rows
