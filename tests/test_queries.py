import os

import duckdb
import pytest

from brindle.functions import text as T
from brindle.plans import queries as Q

SOME = ["pretok_cl100k", "pretok_tekken", "piece_spans", "encode_docs", "encode_conversations", "count_tokens", "token_budget_cube", "token_counts", "offsets_char", "csr_offsets", "encode_with_special", "guard_rejects", "decode_rows", "binary_roundtrip", "flat_roundtrip", "shorter_prefixes", "nfc_docs", "encode_nfc", "stream_encode", "windowed_token_counts", "sql_functions", "pair_lookup", "encoding_files", "tokenizer_json", "tekken_json", "import_refusals", "import_verify", "merge_table", "encode_boundaries", "stream_detokenize", "single_token_bytes", "encode_pages_counts", "token_byte_values"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    got = duck.execute(Q.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in got.description], got.fetchall())


@pytest.mark.parametrize("name", ["stream_encode", "stream_detokenize"])
def test_streams_read_tables_of_several_files(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    run = Q.queries()[name]
    got, one = (sorted(map(tuple, run(spark, str(d)).collect())) for d in (tmp_path, sf_dir))
    assert got == one and got


def test_every_sql_has_a_query():
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_scans_read_only_what_they_need(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = docs.select("doc_id", T.count_tokens("text", Q.encoding()))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert {"lang", "source", "documents", "tokens"} <= set(e.entry(spark).columns)
    assert set(e.oracle_sql()) <= set(e.queries())
