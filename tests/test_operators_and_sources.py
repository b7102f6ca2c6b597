import base64
import gzip
import json

import pytest
from cases import SAMPLES
from pyspark.sql import functions as F

from brindle.encoding import BadVocabulary, byte_encoding, get_encoding
from brindle.functions import text as T
from brindle.functions.grammars import GRAMMARS
from brindle.operators import tokens as ops
from brindle.operators import views, vocabulary
from brindle.plans.queries import RANKS, encoding
from brindle.sources import corpus, files, flat, importer
from brindle.streaming import tokens as streams

TOKENIZER_JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, s, "n" if i % 3 else None) for i, s in enumerate(SAMPLES)] + [(100, None, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_counts_do_not_depend_on_partitions(spark, docs):
    enc = encoding("o200k")
    per_token = {r.id: r.n for r in ops.token_counts(docs, "text", enc).collect()}
    rows = ops.token_rows(docs, ["doc_id"], "text", enc)
    again = {r.id: r.n for r in rows.repartition(7).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_token == again
    budget = ops.token_budget(docs, ["lang"], "text", enc, "rollup").collect()
    assert {r.lang: r.tokens for r in budget if r.documents == docs.count()} and max(r.tokens for r in budget) == sum(per_token.values())


def test_relational_decoding_equals_the_texts(spark, docs):
    enc = encoding()
    rows = ops.token_rows(docs, ["doc_id"], "text", enc)
    got = {r.doc_id: bytes(r.bytes).decode() for r in ops.decode_rows(rows, vocabulary.vocabulary(spark, enc), ["doc_id"]).collect()}
    assert got == {i: s for i, s in enumerate(SAMPLES) if s}
    with pytest.raises(Exception, match="unknown token id"):
        ops.decode_rows(spark.createDataFrame([(1, 0, 77777)], "doc_id long, pos int, id int"), vocabulary.vocabulary(spark, enc), ["doc_id"]).collect()


def test_offsets_of_the_flat_batch(spark, docs):
    enc = encoding()
    sizes = {r.doc_id: max(0, r.n) for r in docs.select("doc_id", F.coalesce(T.count_tokens("text", enc), F.lit(0)).alias("n")).collect()}
    at, expected = 0, {}
    for k in sorted(sizes):
        expected[k] = (at, at + sizes[k])
        at += sizes[k]
    for parts in (1, 5):
        got = {r.doc_id: (r.start, r.end) for r in ops.csr_offsets(docs.repartition(parts), "doc_id", "text", enc).collect()}
        assert got == expected
    assert all(len(r.ids) == r.end - r.start for r in ops.flat_batch(docs, "doc_id", "text", enc).collect())


def test_piece_rows_with_spans(spark, docs):
    for r in ops.piece_rows(docs, ["doc_id"], "text", "qwen", spans=True).collect():
        assert SAMPLES[r.doc_id].encode()[r.start : r.end].decode() == r.piece


def test_mismatches_and_splitting(spark):
    a = spark.createDataFrame([(1, [1]), (2, [2]), (3, None)], "k int, v array<int>")
    b = spark.createDataFrame([(1, [1]), (2, [3]), (4, [4])], "k int, v array<int>")
    assert {r.k for r in ops.mismatches(a, b, ["k"], "v").collect()} == {2, 3, 4}
    parts = ops.split_documents(spark.createDataFrame([(1, "a\n\n\n\nb c\n\n"), (2, None), (3, "")], "k int, t string"), ["k"], "t").collect()
    assert [(r.k, r.pos, r.part) for r in parts] == [(1, 0, "a"), (1, 1, "b c")]


def test_wrapping_and_id_predicates(spark):
    enc = encoding()
    r = spark.createDataFrame([([5, 6],)], "ids array<int>").select(T.with_static_specials("ids", [1], [2, 3]).alias("w"), T.attention_mask("ids").alias("m"), T.add_offset("ids", 10).alias("o")).first()
    assert (r.w, r.m, r.o) == ([1, 5, 6, 2, 3], [1, 1], [15, 16])
    ids = spark.createDataFrame([(0,), (50255,), (50256,), (50259,), (-1,)], "i long")
    assert [tuple(r) for r in ids.select(T.is_known_id("i", enc), T.is_special_id("i", enc)).collect()] == [(True, False), (True, False), (True, True), (False, False), (False, False)]


def test_vocabulary_joins(spark):
    enc = byte_encoding(merges=(b"ab", b"abc", b"cd"), specials={"<s>": 400})
    texts = spark.createDataFrame([("abcd", 258), ("<s>", 400), ("zz", 7)], "t string, i int")
    assert [r.id for r in vocabulary.encode_single_tokens(texts.select("t"), "t", enc).orderBy("t").collect()] == [400, None, None]
    assert {r.i: r.bytes and bytes(r.bytes) for r in vocabulary.decode_single_tokens(texts.select("i"), "i", enc).collect()} == {258: b"cd", 400: b"<s>", 7: b"\x07"}
    assert {r.t: (r.id, r.len) for r in vocabulary.longest_matches(texts, "t", "t", enc).collect()} == {"abcd": (257, 3), "<s>": (60, 1), "zz": (122, 1)}
    assert {(r.id, r.prefix_id) for r in vocabulary.shorter_prefixes(spark, enc).collect()} == {(256, 97), (257, 256), (258, 99)}
    assert {(r.left, r.right, r.id) for r in vocabulary.merge_table(spark, enc).collect()} == {(97, 98, 256), (256, 99, 257), (99, 100, 258)}
    s = vocabulary.vocabulary_stats(spark, enc).first()
    assert (s.vocab_size, s.n_specials, s.n_vocab, s.max_len) == (259, 1, 401, 3)


def test_every_long_token_of_a_vocabulary_has_two_parents(spark):
    enc = encoding()
    pairs = vocabulary.merge_table(spark, enc).collect()
    assert len(pairs) == 50_000
    for r in pairs[::500]:
        assert enc.decode_single_token_bytes(r.left) + enc.decode_single_token_bytes(r.right) == enc.decode_single_token_bytes(r.id)


def test_unicode_class_ranges(spark):
    import unicodedata

    ranges = vocabulary.unicode_classes(spark, {"N": r"\p{N}", "S": r"\s"}).collect()
    inside = lambda c, p: any(r["class"] == c and r.lo <= p <= r.hi for r in ranges)
    for p in range(0x3000):
        if unicodedata.category(chr(p)) in ("Nd", "Nl", "No") and p < 0x0560:
            assert inside("N", p)
        if chr(p).isspace() and p not in range(0x1C, 0x20):
            assert inside("S", p)


def test_sql_functions(spark):
    enc = encoding()
    views.register(spark, enc, "t")
    ids = enc.merger.ids_of(b"Hello").tolist()
    r = spark.sql("SELECT t_encode('Hello') e, t_count('Hello, you') n, t_decode(t_encode('Hé llo')) d, t_pieces('a b') p, t_encode(CAST(NULL AS STRING)) z").first()
    assert r.e == ids and r.n == 3 and r.d == "Hé llo" and r.p == ["a", " b"] and r.z is None
    assert spark.sql("SELECT count(*) FROM t_vocab").first()[0] == 50259


# -- files ------------------------------------------------------------------------------------


def test_encoding_files_round_trip(tmp_path):
    enc = byte_encoding("tekken", (b"ab", b"abc"), name="mine", specials={"<s>": 3, "é": 7}, nfc=True, id_offset=12)
    files.write_encoding(enc, str(tmp_path))
    got = get_encoding("mine", str(tmp_path))
    assert (got.ranks, got.specials, got.grammar, got.nfc, got.id_offset) == (dict(enc.ranks), dict(enc.specials), "tekken", True, 12)
    assert get_encoding("mine", str(tmp_path)) is got
    (tmp_path / "mine.special").unlink()
    assert files.load_encoding("mine", str(tmp_path)).specials == {}


def test_damaged_files_are_refused(tmp_path):
    enc = byte_encoding(name="mine")
    files.write_encoding(enc, str(tmp_path))
    raw = (tmp_path / "mine.vocab").read_bytes()
    for damaged in (raw[:-1], raw + b"x", raw[:2], b"\0\0\0\0", raw[:-4] + b"\xff\xff\0\0"):
        (tmp_path / "mine.vocab").write_bytes(damaged)
        with pytest.raises(BadVocabulary):
            files.read_vocab(str(tmp_path / "mine.vocab"))
    (tmp_path / "mine.enc").write_text("scanner=nothing\n")
    with pytest.raises(BadVocabulary):
        files.load_encoding("mine", str(tmp_path))
    with pytest.raises(KeyError):
        files.load_encoding("unheard_of", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        files.load_encoding("cl100k_base", str(tmp_path))


def test_flat_tokens_round_trip(spark, docs, tmp_path):
    encoded = docs.select("doc_id", T.encode("text", encoding()).alias("ids"))
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        flat.write_flat(encoded, path)
        got = {r.key: r.ids for r in flat.read_flat(spark, path).collect()}
        assert got == {r.doc_id: r.ids or [] for r in encoded.collect()}
    flat.write_flat(encoded.where("false"), str(tmp_path / "none"))
    assert flat.read_flat(spark, str(tmp_path / "none")).count() == 0


def test_flat_tokens_of_two_appends_and_null_keys(spark, tmp_path):
    """Appends add to what is there, an overwrite takes its place, a null key is none of the numbers."""
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, ids array<int>").coalesce(1)
    read = lambda: sorted(map(repr, ((r.key, r.ids) for r in flat.read_flat(spark, str(tmp_path / "f")).collect())))
    flat.write_flat(rows((1, [1, 2])), str(tmp_path / "f"))
    flat.write_flat(rows((2, [3]), (None, [4]), (-1, [5]), (3, None)), str(tmp_path / "f"))
    assert read() == sorted(map(repr, [(1, [1, 2]), (2, [3]), (None, [4]), (-1, [5]), (3, [])]))
    rows((9, [9])).selectExpr("doc_id AS key", "ids").write.format("flattokens").mode("overwrite").save(str(tmp_path / "f"))
    assert read() == [repr((9, [9]))]


def test_tokens_as_arrays_of_the_caller(spark):
    encoded = spark.createDataFrame([(2, [5, 6]), (1, [7]), (3, None)], "doc_id long, ids array<int>")
    tokens, offsets, keys = ops.to_numpy(encoded, "doc_id")
    assert tokens.tolist() == [7, 5, 6] and offsets.tolist() == [0, 1, 3, 3] and keys == [1, 2, 3]
    with pytest.raises(ValueError, match="3 tokens"):
        ops.to_numpy(encoded, "doc_id", most=2)


def test_a_source_that_is_no_path_is_refused():
    for source in ("someone/model", "https://host/tokenizer.json"):
        with pytest.raises((FileNotFoundError, RuntimeError, importer.ImportRefused)):
            importer.parse(source)


def test_corpus_readers(spark, tmp_path):
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: http://a\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "x.wet.gz").write_bytes(gzip.compress(record(b"warcinfo", b"i")) + gzip.compress(record(b"conversion", "tëxt".encode())))
    assert [(r.uri, r.text) for r in corpus.read_wet(spark, str(tmp_path / "x.wet.gz")).collect()] == [("http://a", "tëxt")]
    (tmp_path / "t.txt").write_text("a\n\nb")
    assert corpus.read_texts(spark, str(tmp_path / "t.txt")).first().text == "a\n\nb"


# -- importing --------------------------------------------------------------------------------


def test_import_of_a_published_definition(spark, tmp_path):
    with pytest.raises(importer.ImportRefused):  # its grammar is none of ours
        importer.import_encoding(spark, TOKENIZER_JSON, "other", str(tmp_path))
    top = json.load(open(TOKENIZER_JSON))
    top["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": GRAMMARS["llama3"]}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    (tmp_path / "tokenizer.json").write_text(json.dumps(top))
    corpus_df = spark.createDataFrame([(s,) for s in SAMPLES if "ſ" not in s], "text string")
    enc = importer.import_encoding(spark, str(tmp_path / "tokenizer.json"), "mine", str(tmp_path), [corpus_df])
    assert enc.vocab_size == 50256 and enc.specials == {"<|endoftext|>": 50256}
    assert get_encoding("mine", str(tmp_path)).ranks == enc.ranks


def test_import_of_a_rank_list_and_a_failed_verification(spark, tmp_path):
    enc = importer.import_encoding(spark, RANKS, "ranks", str(tmp_path), pattern=GRAMMARS["o200k"])
    assert enc.grammar == "o200k"
    with pytest.raises(importer.ImportRefused, match="differ"):
        importer.import_encoding(spark, RANKS, "wrong", str(tmp_path), pattern=GRAMMARS["o200k"], reference=lambda texts: [[0] for _ in texts])
    assert not list(tmp_path.glob("wrong*"))


def test_import_of_tekken(spark, tmp_path):
    vocab = [{"rank": i, "token_bytes": base64.b64encode(bytes([i])).decode()} for i in range(256)] + [{"rank": 256, "token_bytes": base64.b64encode(b"ab").decode()}, {"rank": 257, "token_bytes": base64.b64encode(b"cut").decode()}]
    top = {"config": {"pattern": GRAMMARS["tekken"], "default_num_special_tokens": 10, "default_vocab_size": 267}, "vocab": vocab, "special_tokens": [{"rank": 0, "token_str": "<unk>"}, {"rank": 1}]}
    (tmp_path / "tekken.json").write_text(json.dumps(top))
    enc = importer.import_encoding(spark, str(tmp_path / "tekken.json"), "tek", str(tmp_path))
    assert enc.id_offset == 10 and enc.specials == {"<unk>": 0, "<special_1>": 1} and enc.vocab_size == 257
    assert spark.createDataFrame([("ab",)], "t string").select(T.encode("t", enc)).first()[0] == [266]


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "Lowercase"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}}, {"model": {"type": "Unigram", "vocab": {}}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "a"}}, {"type": "Split", "pattern": {"Regex": "b"}}, {"type": "ByteLevel"}]}},
        {"model": {"type": "BPE", "vocab": {}, "byte_fallback": True}},
    ],
)
def test_definitions_that_would_not_be_exact_are_refused(change):
    top = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": {}}, "added_tokens": []}
    importer.parse_tokenizer_json(json.dumps(top).encode())
    with pytest.raises(importer.ImportRefused):
        importer.parse_tokenizer_json(json.dumps(top | change).encode())
    with pytest.raises(importer.ImportRefused):
        importer.parse_tekken(b'{"config": {}, "vocab": []}')


# -- streams ----------------------------------------------------------------------------------


def test_a_character_split_over_batches_waits(spark, tmp_path):
    enc = byte_encoding()
    src = tmp_path / "src"
    schema = "key string, pos long, id int"
    for n, part in enumerate(("aé".encode()[:2], "aé€".encode()[2:5], "€".encode()[2:])):
        spark.createDataFrame([("k", n * 10 + i, b) for i, b in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(src))
    import os
    import time

    for i, f in enumerate(sorted(src.glob("*.parquet"), key=lambda p: p.stat().st_mtime)):
        os.utime(f, (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = streams.run_available(streams.detokenize_stream(stream, "key", "pos", "id", enc), f"file://{tmp_path}/out")
    assert [r.text for r in out.orderBy("first_pos").collect()] == ["a", "é", "€"]


def _run_files(spark, tmp_path, parts, **options):
    """A file a batch, in order."""
    import os
    import time

    src, schema = tmp_path / "src", "key string, pos long, id int"
    src.mkdir()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(src / f"{n}.parquet", index=False)
        os.utime(src / f"{n}.parquet", (time.time() - 100 + n, time.time() - 100 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = streams.run_available(streams.detokenize_stream(stream, "key", "pos", "id", byte_encoding(), **options), f"file://{tmp_path}/out")
    return [(r.first_pos, r.text) for r in out.orderBy("first_pos").collect()]


def test_tokens_wait_for_those_before_them(spark, tmp_path):
    a, b, c, d = "abcd".encode()
    parts = [[("k", 0, a), ("k", 2, c)], [("k", 3, d)], [("k", 1, b), ("k", 0, a)]]
    assert _run_files(spark, tmp_path, parts, gapless=True) == [(0, "a"), (1, "bcd")]


def test_late_and_unknown_tokens_fail_a_stream(spark, tmp_path):
    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir()
    with pytest.raises(Exception, match="comes after"):
        _run_files(spark, tmp_path / "one", [[("k", 5, 97)], [("k", 1, 98)]])
    with pytest.raises(Exception, match="unknown token id 300"):
        _run_files(spark, tmp_path / "two", [[("k", 0, 300)]])


def test_windowed_counts_and_encoding_of_a_stream(spark, tmp_path):
    enc = encoding()
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a b' t UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'c' UNION ALL SELECT timestamp'2024-01-01 03:00:00', NULL")
    got = streams.windowed_token_counts(rows, "ts", "t", enc).orderBy("window_start").collect()
    assert [(r.documents, r.tokens) for r in got] == [(2, 3), (1, None)]
    rows.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src"))
    out = streams.run_available(streams.encode_stream(stream, "t", enc).select("t", "ids"), f"file://{tmp_path}/out")
    assert {r.t: r.ids and len(r.ids) for r in out.collect()} == {"a b": 2, "c": 1, None: None}
