import random

import pytest
import tiktoken
from cases import SAMPLES

from brindle.encoding import BadVocabulary, Encoding, byte_encoding, encoding_name_for_model
from brindle.functions import text as T
from brindle.functions.bpe import merge_piece
from brindle.functions.grammars import GRAMMARS, classify
from brindle.plans.queries import encoding

NAMES = ["cl100k", "cl100k_imported", "llama3", "qwen", "o200k", "tekken"]


def oracle(enc):
    return tiktoken.Encoding("o", pat_str=GRAMMARS[enc.grammar], mergeable_ranks=dict(enc.ranks), special_tokens=dict(enc.specials))


@pytest.mark.parametrize("grammar", NAMES)
def test_ids_equal_the_oracle(spark, grammar):
    enc = encoding(grammar)
    o = oracle(enc)
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string")
    got = {r.i: r for r in df.select("i", T.encode("text", enc).alias("ids"), T.count_tokens("text", enc).alias("n"), T.pretokenize("text", grammar).alias("p")).collect()}
    for i, s in enumerate(SAMPLES):
        if "ſ" in s and grammar in ("cl100k", "o200k", "cl100k_imported"):
            pass  # folds like the oracle
        assert got[i].ids == o.encode_ordinary(s), s
        assert got[i].n == len(got[i].ids) and "".join(got[i].p) == s


def test_trailing_white_space_tells_the_two_cl100k_grammars_apart(spark):
    df = spark.createDataFrame([("x \n  ",)], "t string")
    assert df.select(T.pretokenize("t", "cl100k")).first()[0] == ["x", " \n  "]
    assert df.select(T.pretokenize("t", "cl100k_imported")).first()[0] == ["x", " \n", "  "]


def test_merge_takes_the_lowest_rank_and_the_leftmost():
    enc = byte_encoding(merges=(b"bc", b"ab", b"aa", b"aaa"))
    ids = lambda p: merge_piece(p, enc.ranks)
    assert ids(b"abc") == [97, 256] and ids(b"ab") == [257] and ids(b"aaaa") == [258, 258] and ids(b"aaa") == [259] and ids(b"aaaaa") == [258, 259]


def test_merge_equals_a_plain_loop():
    def plain(piece, ranks):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    for _ in range(200):
        merges = list(dict.fromkeys(bytes(rng.choices(b"abc", k=rng.randint(2, 4))) for _ in range(8)))
        ranks = dict(byte_encoding(merges=tuple(merges)).ranks)
        piece = bytes(rng.choices(b"abc", k=rng.randint(1, 20)))
        if piece not in ranks:
            assert merge_piece(piece, ranks) == plain(piece, ranks)


def test_long_pieces_do_not_take_quadratic_time():
    assert len(merge_piece(b"ab" * 100_000, encoding().ranks)) > 0


@pytest.mark.parametrize("unit", ["byte", "char"])
def test_spans_tile_the_text(spark, unit):
    enc = encoding("o200k")
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string")
    for r in df.select("text", T.encode_with_offsets("text", enc, unit).alias("t"), T.token_spans(T.encode("text", enc), enc, unit).alias("s")).collect():
        assert r.t.spans == r.s and len(r.s) == len(r.t.ids)
        ends = [s.end for s in r.s]
        assert [s.start for s in r.s] == [0, *ends[:-1]][: len(ends)]
        assert (ends[-1] if ends else 0) == (len(r.text.encode()) if unit == "byte" else len(r.text))


def test_a_split_character_belongs_to_its_first_token(spark):
    enc = byte_encoding()
    r = spark.createDataFrame([("é",)], "t string").select(T.encode_with_offsets("t", enc, "char").alias("x")).first().x
    assert r.ids == [0xC3, 0xA9] and [(s.start, s.end) for s in r.spans] == [(0, 1), (1, 1)]
    with pytest.raises(ValueError):
        T.encode_with_offsets("t", enc, "word")


def test_nulls_and_empty_batches(spark):
    enc = encoding()
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, None)], "i int, t string")
    got = df.select("i", T.encode("t", enc).alias("e"), T.encode_with_special("t", enc).alias("s"), T.decode(T.encode("t", enc), enc).alias("d"), T.nfc("t").alias("n"), T.encode_with_offsets("t", enc).alias("o")).orderBy("i").collect()
    assert [r.e for r in got][::3] == [None, None] and got[1].e == [] and got[0].s is None and got[1].s == []
    assert [r.d for r in got] == [None, "", "a b", None] == [r.n for r in got]
    assert df.where("false").select(T.encode("t", enc).alias("e")).collect() == []


SPECIAL_TEXTS = ["<|endoftext|>", "a<|im_start|>user\nhi<|im_end|>b", "<|im_end|><|im_end|>", "none", "<|endof", "", "x <|endoftext|> y"]


def test_special_tokens_equal_the_oracle(spark):
    enc = encoding()
    o = oracle(enc)
    df = spark.createDataFrame([(t,) for t in SPECIAL_TEXTS], "t string")
    for r in df.select("t", T.encode_with_special("t", enc).alias("all"), T.encode_with_special("t", enc, {"<|im_end|>"}).alias("some"), T.encode("t", enc).alias("none")).collect():
        assert r["all"] == o.encode(r.t, allowed_special="all")
        assert r.some == o.encode(r.t, allowed_special={"<|im_end|>"}, disallowed_special=())
        assert r.none == o.encode_ordinary(r.t)


def test_the_lowest_id_wins_where_specials_begin_together(spark):
    enc = byte_encoding(specials={"<ab": 400, "<abc>": 300, "<a": 500})
    assert spark.createDataFrame([("<abc><ab",)], "t string").select(T.encode_with_special("t", enc)).first()[0] == [300, 400]


def test_guard(spark):
    enc = encoding()
    df = spark.createDataFrame([("fine <|im_start|>",), ("bad <|endoftext|>",)], "t string")
    assert [r[0] for r in df.select(T.has_disallowed("t", enc, {"<|im_start|>"})).collect()] == [False, True]
    assert [r[0] for r in df.select(T.has_disallowed("t", enc, "all")).collect()] == [False, False]
    assert [r[0] for r in df.select(T.has_disallowed("t", enc, "all", {"fine"})).collect()] == [True, False]  # an explicit set is not reduced
    assert spark.createDataFrame([("fine <|im_start|>",)], "t string").select(T.encode_guarded("t", enc, {"<|im_start|>"})).first()[0][-1] == 50257
    with pytest.raises(Exception, match="disallowed special token"):
        df.select(T.encode_guarded("t", enc, {"<|im_start|>"})).collect()


def test_nfc_runs_between_special_tokens(spark):
    enc = Encoding("n", "qwen", encoding("qwen").ranks, {"<é>": 50256}, nfc=True)
    got = spark.createDataFrame([("é<é>á",)], "t string").select(T.encode_with_special("t", enc).alias("i"), T.encode("t", enc).alias("o")).first()
    o = oracle(encoding("qwen"))
    assert got.i == [*o.encode_ordinary("é"), 50256, *o.encode_ordinary("á")]
    assert got.o == o.encode_ordinary("é<é>á")


def test_decoding_modes(spark):
    enc = byte_encoding(specials={"<s>": 300})
    df = spark.createDataFrame([([0xC3, 0xA9, 300],), ([0xE2, 0x80],), ([65, 299, -5],)], "ids array<int>")
    good = spark.createDataFrame([([0xC3, 0xA9, 300],), ([0xE2, 0x80],)], "ids array<int>")
    assert [r[0] for r in good.select(T.decode("ids", enc)).collect()] == ["é<s>", "�"]
    assert [r[0] for r in good.select(T.decode("ids", enc, errors="ignore")).collect()] == ["é<s>", ""]
    assert [r[0] for r in df.select(T.decode("ids", enc, on_unknown="skip")).collect()][2] == "A"
    for bad in (T.decode("ids", enc, errors="strict"), T.decode("ids", enc)):
        with pytest.raises(Exception):
            df.select(bad).collect()


def test_any_bytes_survive(spark):
    rng = random.Random(5)
    raws = [bytes(rng.choices(range(256), k=rng.randint(0, 60))) for _ in range(200)] + ["héllo 世界".encode(), b"\xe2\x80", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xa0x", None]
    for enc in (encoding("cl100k"), encoding("o200k")):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw binary")
        got = {r.i: r for r in df.select("i", T.encode_binary("raw", enc).alias("ids"), T.decode_bytes(T.encode_binary("raw", enc), enc).alias("b")).collect()}
        for i, r in enumerate(raws):
            assert (None if r is None else bytes(got[i].b)) == r
        assert got[200].ids == oracle(enc).encode_ordinary("héllo 世界")


def test_scalar_facts():
    enc = encoding()
    o = oracle(enc)
    assert enc.n_vocab == o.n_vocab == 50259 and enc.eot_token == 50256 and enc.vocab_size == 50256 and enc.max_token_value == o.max_token_value
    assert enc.encode_single_token("<|im_end|>") == 50258 and enc.encode_single_token(b"a") == o.encode_single_token(b"a")
    assert enc.decode_single_token_bytes(50256) == b"<|endoftext|>" and enc.decode_single_token_bytes(1000) == o.decode_single_token_bytes(1000)
    assert enc.known_id(50258) and not enc.known_id(50259) and not enc.known_id(-1) and enc.is_special_token(50257)
    assert enc.token_byte_values() == o.token_byte_values()
    for f, x in ((enc.encode_single_token, "no such token"), (enc.decode_single_token_bytes, 99999)):
        with pytest.raises(KeyError):
            f(x)
    with pytest.raises(KeyError):
        byte_encoding().eot_token


def test_model_names():
    assert [encoding_name_for_model(m) for m in ("gpt-4o", "gpt-4o-2024-05-13", "GPT-4", "openai/gpt-oss-20b", "Qwen/Qwen2.5-7B", "meta-llama/Llama-3.1-8B")] == ["o200k_base", "o200k_base", "cl100k_base", "o200k_harmony", "qwen3", "llama3"]
    for bad in ("gpt-5x", "gpt-4ox", "llama"):
        with pytest.raises(KeyError):
            encoding_name_for_model(bad)


def test_bad_vocabularies_are_refused():
    good = {bytes([i]): i for i in range(256)}
    for ranks in ({}, {**good, b"ab": 300}, {b: r for b, r in good.items() if r != 9} | {b"ab": 9}, {**good, b"x" * 256: 256}):
        with pytest.raises(BadVocabulary):
            Encoding("x", "qwen", ranks)
    for specials in ({"": 1}, {"x" * 65: 1}, {"x": -1}, {f"<{i}>": 1000 + i for i in range(4097)}):
        with pytest.raises(BadVocabulary):
            Encoding("x", "qwen", good, specials)
    assert classify("nothing known") is None and classify(GRAMMARS["qwen"]) == "qwen"
