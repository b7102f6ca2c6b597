"""What the near-copy join brings to its pairs: texts and buckets that are asked for, and no others."""

import numpy as np
import pyarrow as pa
from test_near_copies import brute_roots, made_rows

from brindle.llm import near_copies


def test_wide_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(12)
    for n in (1, 300, 700, 5000, 30_000):
        for share in (0.0, 0.5, 0.8, 0.9, 1.0):
            base = rng.integers(0, 1 << 63, n).astype(np.uint64)
            more = rng.integers(0, 1 << 63, int(n * rng.uniform(0, 1.2))).astype(np.uint64)
            x, y = np.unique(base), np.unique(np.concatenate([base[: int(n * share)], more]))
            real = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
            got = near_copies.wide_difference(near_copies.wide_sketch(x), near_copies.wide_sketch(y))
            assert got <= real and (share < 1 or len(more) or got == 0)
            if n == 5000 and share == 0.5:
                assert 9 * got > len(x) + len(y)  # far from similar: the pair's texts stay where they are


def test_only_texts_that_are_asked_for_leave_their_place():
    nodes = np.array([7, -5, 9, -5, 1 << 40], dtype=np.int64)
    bitmap = np.zeros(near_copies.ASKED_BITS // 32, dtype=np.uint32)
    for node in (-5, 9):
        at = node & (near_copies.ASKED_BITS - 1)
        bitmap[at >> 5] |= np.uint32(1 << (at & 31))
    batch = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([b"a", b"b", b"c", b"b", b"d"])], names=["node", "text"])
    got = [(r["node"], r["z"][:8]) for b in near_copies._packed(bitmap)(iter([batch, batch.slice(0, 1)])) for r in b.to_pylist()]
    assert got == [(-5, (1).to_bytes(8, "little")), (9, (1).to_bytes(8, "little"))]


def test_the_bitmap_holds_the_nodes_of_all_pairs(spark):
    rng = np.random.default_rng(13)
    pairs = rng.integers(-(1 << 63), 1 << 63, (200, 2))
    bitmap = near_copies._bitmap(spark.createDataFrame(pairs.tolist(), "a long, b long"))
    at = pairs.ravel() & (near_copies.ASKED_BITS - 1)
    assert (bitmap[at >> 5] >> (at & 31).astype(np.uint32) & 1).all() and np.bitwise_count(bitmap).sum() == len(np.unique(at))
    assert not near_copies._bitmap(spark.createDataFrame([], "a long, b long")).any()


def test_the_sample_does_not_pass_one_task(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 500)
    docs = spark.range(5000).selectExpr("cast(id as string) text").repartition(7)
    sample = near_copies._sample(docs)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "SinglePartition" not in plan and 350 < sample.count() < 650


def test_buckets_of_the_same_nodes_are_looked_at_once(spark):
    rows = [(s, node, 10, 1, True) for s, nodes in {1: (1, 2, 3), 2: (1, 2, 3), 3: (1, 2, 4), 4: (1, 2), 5: (1, 2, 3, 4)}.items() for node in nodes]
    got = near_copies._different(spark.createDataFrame(rows, "s long, node long, n int, hub long, met boolean")).collect()
    assert sorted({r.s for r in got}) == [1, 3, 5] and len(got) == 10


def test_near_misses_of_long_texts_stay_where_they_are(spark, monkeypatch):
    """Texts of 3000 words that share three fifths with a neighbour pass the narrow sketches; their texts are not brought together."""
    rng = np.random.default_rng(14)
    word = lambda: "w" + str(rng.integers(1 << 40))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(3000)]
        for _ in range(12):
            text = list(base)
            at = int(rng.integers(0, 2400))
            text[at : at + 450] = [word() for _ in range(450)]
            rows.append(" ".join(text))
    rows = list(enumerate(rows + [t for _, t in made_rows()]))
    made, write = {}, near_copies.materialize

    def counted(df, label, **options):
        out = write(df, label, **options)
        made.setdefault(label, []).append(out.count() if label in ("pairs", "passes", "links") else 0)
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_components(docs).collect()}
    assert got == brute_roots(rows)
    assert len(made["passes"]) == len(made["links"]) == 4 and sum(made["passes"][2:]) < sum(made["pairs"][2:]) / 2, made
