import math

import numpy as np
import pytest
from helpers import components, with_extras
from pyspark.sql import functions as F

from brindle.llm import embed_dedup, topk

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            good[k] = x / np.linalg.norm(x)
    return [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        middle = rng.normal(size=24)
        rows += [(middle + rng.normal(size=24) * 0.16 * (k % 4)).tolist() for k in range(6)]
    rows += [rows[0]] * 5 + [(np.array(rows[1]) * 3).tolist()]
    return [(i, v) for i, v in enumerate(rows)]


def test_links_and_components_equal_brute_force(spark, clustered):
    df = spark.createDataFrame([(i, v, 0) for i, v in clustered], SCHEMA)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(with_extras(df)).collect()}
    links = brute_links(clustered)
    root = components([i for i, _ in clustered], links)
    for i, _ in clustered:
        assert got[i].n_links == sum(i in p for p in links)
        assert got[i].component_id == root[i] and got[i].kept == (root[i] == i)


def test_hot_buckets_are_cut_into_cells(spark, clustered, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_CAP", 2)
    df = spark.createDataFrame([(i, v, 0) for i, v in clustered], SCHEMA)
    got = {r.vec_id: r.component_id for r in embed_dedup.near_vectors(df).collect()}
    assert got == components(got, brute_links(clustered))


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    got = sorted(embed_dedup.near_vectors(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [*((i, 0, i, True) for i in range(1, 7)), (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 0, 9, True), (None, 3, 7, False)]
    assert embed_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_top(rows, k=20):
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q is not None and q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard", [16384, 30])
def test_top_k_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAF", 4)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, size=6).astype(float).tolist()) for i in range(150)]  # many ties
    rows += [(200, [NAN] * 6), (220, None), (240, [None] * 6), (260, []), (300, [1.0] * 6), (301, [-1.5] * 6)]
    df = with_extras(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    vectors = topk.quantised(df)
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 20 = 0")).collect())
    assert got == brute_top(rows)


def test_top_k_with_few_or_no_rows(spark):
    few = topk.quantised(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA))
    assert [tuple(r) for r in topk.top_k(few, few.where("id % 20 = 0")).collect()] == [(0, 1, 1, 64 * 128)]
    none = topk.quantised(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(none, none).collect() == []


def test_repeated_ids_are_separate_queries_and_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [-1.0, 0.0]), (1, [2.0, 0.0]), (2, [-2.0, 0.0]), (None, [2.0, 0.0]), (0, [1.0, 0.0]), (3, [5.0]), (20, [1.0])]
    vectors = topk.quantised(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    got = sorted((tuple(r) for r in topk.top_k(vectors, F.col("id") % 20 == 0, k=3).collect()), key=repr)
    one = [(0, 1, 1, 8192), (0, 2, None, 8192), (0, 3, 0, 4096)]
    other = [(0, 1, 2, 8192), (0, 2, 0, -4096), (0, 3, 0, -4096)]
    assert got == sorted(one + one + other + [(20, 1, 3, 64 * 320)], key=repr)


def test_subtrees_are_left_out():
    """Clustered vectors: most of the tree is never looked at, and a floor that is known leaves out more."""
    rng = np.random.default_rng(3)
    x = np.floor(np.repeat(rng.normal(size=(40, 16)) * 100, 100, axis=0) + rng.normal(size=(4000, 16)))
    ids, q = np.arange(4000), x[::40]
    work, tree = topk.Work(), topk.BallTree(x)
    best, who = topk.search(x, ids, ids, q, ids[::40], 5, np.full(100, -np.inf), tree, work)
    leaves = sum(c == 0 for c in tree.child)
    assert work.scored < 0.2 * leaves * len(q) and work.pruned > 0
    s = q @ x.T
    s[np.arange(100), ids[::40]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]
    assert (who == want).all() and (best == np.take_along_axis(s, want, 1)).all()
    again = topk.Work()
    topk.search(x, ids, ids, q, ids[::40], 5, best[:, -1], tree, again)
    assert again.scored < work.scored


def test_scores_beyond_double_precision():
    x = np.array([[2.0**40 + k, 1.0] for k in range(200)])
    ids = np.arange(200)
    _, who = topk.search(x, ids, ids, x[:3], ids[:3], 2, np.full(3, -np.inf))
    assert who.tolist() == [[199, 198]] * 3
    best, who = topk.search(x * 2.0**20, ids, ids, x[:1] * 2.0**20, ids[:1], 1, np.full(1, -np.inf))
    assert who.tolist() == [[199]] and best[0, 0] == (2**40 * (2**40 + 199) + 1) << 40
