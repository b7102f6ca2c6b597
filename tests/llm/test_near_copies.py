import numpy as np
import pytest
from helpers import components

import corpus_pipeline
from brindle.llm import near_copies, simhash


def brute_sets(rows):
    out = {}
    for i, t in rows:
        words = (t or "").lower().encode().split()
        k = min(5, len(words))
        out[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else set()
    return out


def brute_roots(rows):
    sets = brute_sets(rows)
    ids = sorted(sets)
    near = lambda x, y: x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)) > 0
    return components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(sets[a], sets[b])])


def made_rows():
    """Texts with one to four changed words (J of about 0.6 to 0.95), chains of them, a passage that many share, short texts."""
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(1 << 40))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rng.integers(60, 200))]
        for _ in range(6):
            rows.append(" ".join(base))
            base = list(base)
            for at in rng.integers(0, len(base), rng.integers(1, 5)):
                base[at] = word()
    rows += [" ".join([word() for _ in range(k)] + passage + [word() for _ in range(40 - k)]) for k in range(40)]
    rows += [" ".join(passage[:55] + [word() for _ in range(3)]) for _ in range(30)]
    rows += [" ".join(word() for _ in range(6)) for _ in range(60)] + ["", " ", "one", "ONE", "one two"]
    return list(enumerate(rows))


@pytest.mark.parametrize("cap", [8, 2048])
def test_components_equal_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(near_copies, "CELL_CAP", cap)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_components(docs).collect()}
    assert got == brute_roots(rows)


def test_near_copies_at_080_to_088_go(spark):
    """200 pairs of which the fingerprint rule (7 of 64 bits) links only some."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 104)]
        changed = list(base)
        changed[50:51] = ["x"] if i % 2 else ["x", "y", "z"]
        changed[20] = "u"  # J is 90/110 or so
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed))]
    sets = brute_sets(rows)
    assert all(0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.88 for i in range(0, 400, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == list(range(0, 400, 2))


def test_unrelated_texts_with_near_fingerprints_stay(spark):
    """Six-word texts have two shingles, so fingerprints are often near by chance."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 6)) for _ in range(3000)]
    fps = np.array([simhash.fingerprint(t.encode(), 5) for t in texts], dtype=np.uint64)
    i, j = next((i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 7) + i + 1)
    docs = spark.createDataFrame([(1, texts[i]), (2, texts[j])], "doc_id long, text string")
    assert corpus_pipeline.one_of_each(spark, docs, "").count() == 2


def test_near_copies_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (3, "a b c d e f"), (None, "q"), (5, None), (6, ""), (6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), repr(r.component_id)) for r in near_copies.near_copy_components(docs).collect())
    assert got == sorted([("None", "3"), ("None", "3"), ("3", "3"), ("None", "None"), ("5", "5"), ("6", "5"), ("6", "6")])
    assert near_copies.near_copy_components(docs.limit(0)).collect() == []


def test_the_stage_keeps_the_first_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = brute_roots([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in root if root[i] == i}


def test_pairs_of_a_large_group_follow_its_rows(spark, monkeypatch):
    """300 near copies of one text, most of which are near it and not each other: once joined, few of them are compared."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 301):
        text = list(base)
        for at in rng.choice(150, rng.integers(1, 4), replace=False):
            text[at] = f"x{rng.integers(1 << 40)}"
        rows.append((k, " ".join(text)))
    made, write = [], near_copies.materialize

    def counted(df, label, **options):
        out = write(df, label, **options)
        made.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_components(docs).collect()}
    assert got == brute_roots(rows) and max(made) <= 4 * len(rows), made
