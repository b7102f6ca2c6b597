"""What a batch takes in a Python worker beside its input and its result is bounded, and nothing stays from batch to batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brindle.encoding import byte_encoding
from brindle.functions import bpe
from brindle.functions import text as T
from brindle.operators import tokens as ops
from brindle.plans import queries as Q
from brindle.sources import flat, importer


def traced(f):
    """(f's result, MB of Python and numpy at most, MB afterwards), from here on."""
    tracemalloc.start()
    got = f()
    now, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return got, most / 1e6, now / 1e6


def distinct(n, seed=1):
    rng = random.Random(seed)
    return [" " + "".join(rng.choices("abcdefgh", k=9)) for _ in range(n)]


def test_pieces_merged_together_equal_pieces_merged_alone():
    rng = random.Random(3)
    pieces = [bytes(rng.choices(b"ab  eint", k=rng.randint(1, 90))) for _ in range(1500)] + [bytes(rng.choices(range(256), k=rng.randint(1, 70))) for _ in range(1000)]
    for enc in (Q.encoding("qwen"), Q.encoding("tekken", id_offset=1000), byte_encoding(), byte_encoding(merges=(b"ab", b"abc", b"aa", b"aaaa", b"ababc", b"bc"))):
        ids, size = enc.merger.merge(pa.array(pieces, pa.binary()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [enc.merger.ids_of(p).tolist() for p in pieces]


def test_slices_change_nothing(monkeypatch):
    m = byte_encoding(merges=(b"ab", b"abc"), specials={"<s>": 300}).merger
    rows = pa.array([["abc", "é"], None, [], ["x" * 200], *([["ab", "c"]] * 50)])
    whole = m.encode(rows)
    monkeypatch.setattr(bpe, "SLICE", 16)
    assert m.encode(rows).equals(whole) and whole.null_count == 1
    assert m.count(rows).to_pylist() == [None if x is None else len(x) for x in whole.to_pylist()]
    assert m.decode(whole).to_pylist() == [None if x is None else "".join(x).encode() for x in rows.to_pylist()]
    assert m.decode(whole.slice(1, 3)).to_pylist() == [None, b"", b"x" * 200]
    assert [len(x) for x in bpe.row_slices(pa.array(["abc", None, "", "defg", "x"]), 4)] == [3, 1, 1]


def test_nothing_stays_of_a_batch():
    m = Q.encoding().merger
    m.encode(pa.array([["a"]]))  # what is built once
    _, _, left = traced(lambda: m.encode(pa.array([distinct(50_000)])) and None)
    assert left < 2


def test_decoding_takes_a_slice_beside_its_result():
    m = Q.encoding().merger
    ids = pa.array([np.arange(50_000, dtype=np.int32)] * 40)
    _, most, _ = traced(lambda: m.decode(ids))
    assert most < 80  # 2 million ids, 13 MB of bytes; all at once took 10 times their bytes and more


def test_spans_are_given_in_slices():
    pieces = pa.array([["ab", "c"] * 50_000] * 20)
    out = list(ops._byte_spans.func(iter([pieces])))
    assert len(out) > 1 and sum(map(len, out)) == 20 and pa.concat_arrays(out)[19]["ends"].as_py()[-1] == 150_000


def test_normalising_holds_a_slice_of_texts():
    texts = pa.array(["é" * 500] * 20_000)
    got, most, _ = traced(lambda: T._nfc.func(texts))
    assert most < 10 and got[0].as_py() == "é" * 500


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counting_returns_numbers_and_shuffles_ids(spark, sf_dir):
    enc = Q.encoding()
    rows = spark.createDataFrame([("Hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.count_tokens("t", enc)).collect()] == [2, 0, None]
    assert "merged(" not in plan(rows.select(T.count_tokens("t", enc)))
    assert "hashpartitioning(piece" not in plan(ops.token_counts(rows, "t", enc))
    assert {r.id: r.n for r in ops.token_counts(rows.union(rows), "t", enc).collect()} == {i: 2 for i in enc.merger.encode(pa.array([["Hello", " world"]]))[0].as_py()}


def test_no_expression_per_piece_or_token_in_spark(spark):
    enc = Q.encoding()
    rows = spark.createDataFrame([(1, "<|im_start|>x<|im_end|>")], "k int, t string")
    assert "struct" not in plan(rows.select(T.encode_with_special("t", enc)))
    tokens = plan(ops.token_rows(rows, ["k"], "t", enc, "char"))
    assert "zip_with" not in tokens and "arrays_zip" not in tokens


def plain(raw):
    """Where the characters of any bytes begin."""
    begins, at = [], 0
    while at < len(raw):
        begins.append(at)
        try:
            wide = next(w for w in range(1, 5) if at + w <= len(raw) and len(raw[at : at + w].decode("utf-8", "ignore")) == 1)
            assert raw[at : at + wide].decode()
        except (StopIteration, UnicodeDecodeError):
            c = raw[at]
            wide = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4 if c < 0xF8 else 1
            wide = wide if at + wide <= len(raw) else 1
        at += wide
    return begins


def test_bytes_are_cut_where_characters_begin():
    rng = random.Random(9)
    raws = [bytes(rng.choices(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xff\xed\xa0", k=rng.randint(0, 30))) for _ in range(2000)] + [None, b"", "é".encode() + b"\xc3"]
    texts = [None if r is None else T.as_text(r)[0] for r in raws]
    got = T.cut_bytes(pa.array(raws, pa.binary()), pa.array([None if t is None else list(t) for t in texts], pa.list_(pa.string()))).to_pylist()
    assert got == [None if r is None else [r[a:z] for a, z in zip(plain(r), [*plain(r)[1:], len(r)])] for r in raws]


def test_the_reference_gets_a_bounded_number_of_texts(spark):
    enc = byte_encoding("llama3")

    def reference(texts):
        if sum(map(len, texts)) > 1 << 16:
            raise ValueError("too much at once")
        return [list(t.encode()) for t in texts]

    texts = spark.range(2000).selectExpr("repeat('ab c', 50) AS text").coalesce(1)
    assert importer.verify(texts, enc, reference).count() == 0
    assert importer.verify(texts, enc, lambda texts: [[0] for _ in texts]).count() == 2000


@pytest.mark.parametrize("tokens, documents", [(1 << 20, 1 << 16), (8, 3)])
def test_flat_shards_are_read_in_ranges(tmp_path, monkeypatch, tokens, documents):
    ids = [list(range(i % 7)) for i in range(50)] + [list(range(100))] + [[5]] * 10
    batch = pa.table({"key": pa.array([None, *range(1, 61)], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})
    writer = flat.FlatWriter(str(tmp_path))
    monkeypatch.setattr(flat, "TOKENS", tokens)
    monkeypatch.setattr(flat, "DOCUMENTS", documents)
    writer.commit([writer.write(iter(batch.to_batches(max_chunksize=17)))])
    reader = flat.FlatReader(str(tmp_path))
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist()
    assert all(len(b) == 1 or len(b.column("ids").flatten()) <= tokens for b in got)


def test_a_flat_shard_is_not_held_whole(tmp_path):
    ids = pa.array([np.arange(10_000, dtype=np.int32)] * 1000)
    writer = flat.FlatWriter(str(tmp_path))
    writer.commit([writer.write(iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), ids], names=["key", "ids"])]))])
    reader = flat.FlatReader(str(tmp_path))
    n, most, _ = traced(lambda: sum(len(b) for b in reader.read(reader.partitions()[0])))
    assert n == 1000 and most < 20  # 40 MB of tokens
