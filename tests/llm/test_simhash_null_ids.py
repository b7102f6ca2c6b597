from brindle.llm import simhash


def test_fingerprints_of_null_ids_link(spark, monkeypatch):
    """0, 3, 15 are a chain at radius 2, whose middle only a null id has."""
    fps = {"a": 0, "b": 3, "c": 15, "d": -1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: docs.replace({k: str(v) for k, v in fps.items()}, subset="text").selectExpr("id", "cast(text as long) AS fp"))
    docs = spark.createDataFrame([(7, "a"), (None, "b"), (9, "c"), (None, "d")], "doc_id long, text string")
    got = {r.fp: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert got == {0: 7, 3: 7, 15: 7, -1: None}
