import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from helpers import EDGE_ROWS, SCHEMA, WORD, components, lower, with_extras
from pyspark.sql import functions as F

from brindle.llm import mixing, pitman_yor, queries, sentencepiece_sampling, simhash, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    yield df
    df.unpersist()  # other tests look at plans of the same table


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    return with_extras(spark.createDataFrame(EDGE_ROWS, SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return with_extras(spark.createDataFrame([], SCHEMA))


def by_id(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


# -- SimHash ----------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(fps, radius):
    ids = sorted(fps)
    return components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= radius])


def test_simhash_equals_brute_force(spark, sf_dir, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = brute_groups(fps, 2)
    got = queries.op7_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", root[i]) for i, f in fps.items()}
    assert len(set(root.values())) < len(root)


@pytest.mark.parametrize("radius, segments, key", [(2, 5, 2), (7, 8, 2), (3, 4, 1), (0, 1, 1)])
def test_pigeonring_loses_no_link(spark, radius, segments, key, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_CAP", 8)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, size=6, dtype=np.uint64)
    fps = {}
    for i in range(120):
        f = int(base[i % 6])
        for b in rng.choice(64, size=rng.integers(0, radius + 3), replace=False):
            f ^= 1 << int(b)
        fps[i] = f
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, rep long").groupBy("fp").agg(F.min("rep").alias("rep"))
    cells = simhash.bucket_cells(simhash.bucket_rows(reps, radius, segments, key), ["slot", "key"], "fp", simhash.CELL_CAP)
    links = cells.repartition(4, "slot", "key", "cx", "cy").mapInArrow(simhash.chain_links(radius, segments), "a long, b long").collect()
    first = {}
    for i, f in fps.items():
        first.setdefault(f, i)
    some = {i: fps[i] for i in first.values()}
    assert components(some, [(r.a, r.b) for r in links]) == brute_groups(some, radius)


def test_simhash_of_odd_rows(edge, empty):
    got = by_id(simhash.simhash_components(edge).collect())
    assert [(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 3, 4, 5)] == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 3)]
    assert got[-1].doc_id is None and len(got) == len(EDGE_ROWS) and [r.fp for r in got if r.doc_id == 3] == [0]
    assert simhash.simhash_components(empty).collect() == []
    kept = simhash.keep_one(edge, simhash.simhash_components(edge))
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    with pytest.raises(ValueError):
        simhash.simhash_components(edge, radius=5, segments=5)


# -- suffix arrays ----------------------------------------------------------------------------


def brute_removed(rows, length=50):
    first = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i in sorted(raw):
        for p in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][p : p + length], i)
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute_removed(texts.items())
    assert sum(r[1] for r in got.values()) > 0


def test_repeats_with_overlaps_runs_and_shared_passages(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdef"), size=rng.integers(1, 6)))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(20)) + passage[i % 7 : len(passage) - i % 5] + " ".join(word() for _ in range(5))) for i in range(30)]
    rows += [(100, "z" * 300), (101, "z" * 49), (102, "z" * 50 + "y" + "z" * 60), (103, "ä" * 40), (104, "x" + "ä" * 40), (105, passage[:49]), (106, passage[:50])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_removed(rows)


def test_longest_previous_factors_equal_brute_force():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, size=120).astype(np.uint8)
    order = suffix_dedup.suffix_array(data)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_repeats_of_odd_rows(edge, empty):
    got = by_id(suffix_dedup.repeat_report(edge).collect())
    same = [r.n_removed for r in got if r.doc_id in (1, 2)]
    assert same == [0, 53, 53] and len(got) == len(EDGE_ROWS) and [r.n_bytes for r in got if r.doc_id in (3, 4)] == [0, 0]
    assert suffix_dedup.repeat_report(empty).collect() == []
    left = suffix_dedup.remove_repeats(edge)
    assert left.columns == edge.columns and left.count() == len(EDGE_ROWS) and suffix_dedup.remove_repeats(empty).collect() == []


# -- mixing -----------------------------------------------------------------------------------


def test_the_mix_is_near_its_targets(spark, sf_dir):
    got = queries.op3_mix_sources(spark, sf_dir).collect()
    again = queries.op3_mix_sources(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert all(0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in got)
    total = sum(r.size for r in got)
    assert sum({r.doc_id: r.taken for r in got}.values()) <= total


def test_targets_by_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("c", 1000)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a and its weight 1 would get 3010/7, but stops at 30; the rest is shared 2:3:1
    assert got == {"a": 30.0, "b": pytest.approx(2980 / 3), "c": pytest.approx(1490), None: pytest.approx(2980 / 6)}


def test_mix_of_odd_rows(edge, empty):
    got = by_id(mixing.mix_sources(edge).withColumnRenamed("id", "doc_id").collect())
    assert len(got) == len(EDGE_ROWS) and {r.size for r in got if r.doc_id in (3, 4, 5)} == {0} and {r.taken for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix_sources(empty).collect() == []
    rows = mixing.mixed_rows(edge)
    assert rows.columns == edge.columns and mixing.mixed_rows(empty).collect() == []


# -- SentencePiece ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces(spark):
    return sentencepiece_sampling.load_pieces(spark)


def test_sampled_ids_decode_to_the_texts(spark, docs, texts, pieces):
    encoded = sentencepiece_sampling.encode_documents(docs, pieces)
    once = {r.doc_id: r.ids for r in encoded.select("doc_id", "ids").collect()}
    assert once == {r.doc_id: r.ids for r in sentencepiece_sampling.encode_documents(docs.repartition(7), pieces).select("doc_id", "ids").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sampling.MODEL_PATH)
    for i, t in texts.items():
        assert sentencepiece_sampling.decode(once[i], pieces) == t
    plain = [i for i, t in texts.items() if t and not t.startswith(" ") and "  " not in t][:30]
    assert all(library.decode(once[i]).replace("▁", " ") == texts[i] for i in plain)
    other = {r.doc_id: r.ids for r in sentencepiece_sampling.encode_documents(docs, pieces, seed=9).select("doc_id", "ids").collect()}
    best = {r.doc_id: r.ids for r in sentencepiece_sampling.encode_documents(docs, pieces, seed=None).select("doc_id", "ids").collect()}
    assert once != other and once != best and sum(map(len, best.values())) < sum(map(len, once.values()))


def test_forward_filtering_sums_all_segmentations(pieces):
    chunk, alpha = " hello", 0.5
    lattice = sentencepiece_sampling.build_lattice(chunk, pieces, alpha)
    marked = chunk.replace(" ", "▁")
    n = len(marked)
    total = [1.0] + [0.0] * n
    for e in range(1, n + 1):
        for b in range(e):
            if marked[b:e] in pieces.normal:
                total[e] += total[b] * (pieces.normal[marked[b:e]] + sentencepiece_sampling.RANK_OFFSET) ** -alpha
    assert lattice.log_total == pytest.approx(math.log(total[n]))


def test_round_trip_of_odd_rows(edge, empty, pieces):
    got = by_id(sentencepiece_sampling.round_trip(edge.select("doc_id", "text"), pieces).collect())
    assert len(got) == len(EDGE_ROWS) and all(r.lossless for r in got if r.doc_id != 3)
    assert len({r.ids_sha256 for r in got if r.doc_id == 2}) == 1
    assert sentencepiece_sampling.round_trip(empty, pieces).collect() == [] and sentencepiece_sampling.round_trip(edge, pieces).count() == len(EDGE_ROWS)


# -- toxicity ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    d = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")  # enough held-out labels to measure by
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels.where(toxicity.fold(F.col("doc_id")) != 0))


def test_toxicity_on_held_out_labels(labelled):
    docs, labels, model = labelled
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).collect()
    toxic, clean = [r.score for r in scored if r.toxic == 1], [r.score for r in scored if r.toxic == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    right = np.mean([(r.score >= 0.5) == r.toxic for r in scored])
    assert auc > 0.9 and right > 0.9, (auc, right)


def test_the_kernel_tolerates_gaps():
    k = toxicity.kernel
    assert k(b"idiot", b"i.d.i.o.t") > 0 and k(b"idiot", b"idxiot") > 3 * k(b"idiot", b"banana")


def test_toxicity_of_odd_rows(labelled, edge, empty, spark):
    model = labelled[2]
    got = by_id(toxicity.score_documents(edge, model, name="toxic_score").collect())
    assert len(got) == len(EDGE_ROWS) and all(0 <= r.toxic_score <= 1 for r in got) and len({r.toxic_score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score_documents(empty, model, name="toxic_score").collect() == []
    kept = toxicity.drop_toxic(edge, model)
    assert kept.columns == edge.columns and kept.where("doc_id = 1").first()._text == "y" and toxicity.drop_toxic(empty, model).collect() == []
    nothing = toxicity.fit(edge, spark.createDataFrame([(1, 1), (None, 0), (99, 0), (3, None)], "doc_id long, toxic int"))
    assert nothing.score(np.frombuffer(b"ab", np.uint8), np.array([0, 2])).tolist() == [1.0]
    assert toxicity.fit(edge, spark.createDataFrame([], "doc_id long, toxic int")).score(np.frombuffer(b"", np.uint8), np.array([0, 0])).tolist() == [0.0]


# -- Pitman-Yor -------------------------------------------------------------------------------


def test_pitman_yor_counts_and_gain(spark, sf_dir, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: WORD.findall(lower(t)) + [None] for i, t in texts.items()}
    counts = Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op6_pitman_yor(spark, sf_dir).collect()}
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-5, abs=1e-3)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    scored = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in scored) > sum(r.base_score for r in scored)


def test_pitman_yor_of_odd_rows(edge, empty, spark):
    got = by_id(pitman_yor.score_documents(edge, pitman_yor.fold(F.col("doc_id")) == 2).collect())
    assert len(got) == len(EDGE_ROWS) and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1} and all(math.isfinite(r.score) for r in got)
    assert pitman_yor.score_documents(empty, F.lit(False)).collect() == []
    alone = pitman_yor.score_documents(edge, F.lit(True)).collect()
    assert {(r.train_tokens, r.base_score, r.n_known) for r in alone} == {(0, 0.0, 0)}


def test_rows_that_repeat_an_id_take_what_the_mix_says(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e f", "x"), (2, "g h i j", "y"), (None, "k l", "x"), (None, "k l", "x"), (3, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget in (None, 20, 40):
        taken = mixing.mix_sources(docs, budget=budget).groupBy("id", "size").agg(F.sum("copies").alias("n")).where("n > 0").collect()
        got = mixing.mixed_rows(docs, budget=budget).select("doc_id", F.size(F.split("text", " ")).alias("size")).groupBy("doc_id", "size").count().collect()
        assert sorted(map(repr, ((r.id, r.size, r.n) for r in taken))) == sorted(map(repr, ((r.doc_id, r.size, r["count"]) for r in got)))
    assert mixing.mixed_rows(docs).groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6
