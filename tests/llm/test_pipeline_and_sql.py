import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_documents import brute_removed
from test_near_copies import brute_roots

import corpus_pipeline
from brindle.llm import oracle, queries, sentencepiece_sampling

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    (_, toxic), (_, near), (_, repeats), (_, mix), (_, encode) = corpus_pipeline.STAGES
    clean = toxic(spark, docs, sf_dir).cache()
    assert clean.columns == COLUMNS and 0.8 * len(given) < clean.count() <= len(given)
    rows = {r.doc_id: r.text for r in clean.collect()}
    root = brute_roots(rows.items())
    ids = sorted(root)
    single = near(spark, clean, sf_dir).cache()
    kept = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == COLUMNS and set(kept) == {i for i in ids if root[i] == i}
    left = repeats(spark, single, sf_dir).cache()
    removed = brute_removed(kept.items())
    assert left.columns == COLUMNS
    # a cut may split a character, whose other bytes go too
    for r in left.collect():
        n, gone, _, _ = removed[r.doc_id]
        assert n - gone - 6 * removed[r.doc_id][2] <= len((r.text or "").encode()) <= n - gone
    mixed = mix(spark, left, sf_dir).cache()
    assert mixed.columns == COLUMNS and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = encode(spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count() and all(r.lossless for r in out)
    for df in (clean, single, left, mixed):
        df.unpersist()


def test_the_pipeline_takes_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated ids and rows, a long text, and an empty table, from end to end."""
    rows = [(i, f"clean words number {i} and some more of them to read {i * 7}", "en", "a" if i % 3 else None, 10) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "b", 0), (None, "no id here at all, but five words", "en", "b", 1), (3, rows[3][1], "en", "a", 10), (3, rows[3][1], "en", "a", 10), (52, "long " * 20_000, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(40)] + [(None, 1, 1), (50, None, None)], "doc_id long, quality int, toxic int")
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.lossless for r in out) and (name == "full" or not out)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    want = con.execute(oracle.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_eleven_queries():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert os.path.exists(sentencepiece_sampling.MODEL_PATH)
