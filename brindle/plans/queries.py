"""The registered queries of the tokenization engine, each over its whole table, and their SQL.

A query returns scalar columns (arrays are exploded or joined), so that results can be compared as sets of rows.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..encoding import Encoding, byte_encoding
from ..functions.boundaries import all_texts, unnormalised
from ..functions import text as T
from ..operators import tokens as ops
from ..operators import views, vocabulary
from ..sources import flat, importer
from ..sources.files import load_encoding, read_rank_list, write_encoding
from ..sources.scratch import new_folder
from ..streaming import tokens as streams
from . import oracle

#: A public rank list; another path may be set. It is read, never copied.
RANKS = os.environ.get("BRINDLE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SPECIALS = {"<|endoftext|>": 50256, "<|im_start|>": 50257, "<|im_end|>": 50258}
GRAMMARS = ("cl100k", "llama3", "qwen", "o200k", "tekken")
OFFSET = 1000


@functools.lru_cache(maxsize=16)
def encoding(grammar: str = "llama3", nfc: bool = False, id_offset: int = 0) -> Encoding:
    return Encoding(f"bpe50k_{grammar}", grammar, read_rank_list(RANKS), {} if id_offset else SPECIALS, nfc, id_offset)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.spread(_read(spark, sf_dir, "documents"))


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


DOCS = "select doc_id, text from documents"


def _encoded(select: str, grammar: str = "llama3", rows: str = DOCS, keys: str = "doc_id", offset: int = 0) -> str:
    return oracle.encoded(rows, keys, grammar, RANKS, offset) + "\n" + select


# -- pieces -----------------------------------------------------------------------------------


def _pretok(grammar: str, table: str, keys: list[str], text: str) -> Query:
    return lambda spark, sf_dir: ops.piece_rows(ops.spread(_read(spark, sf_dir, table)), keys, text, grammar)


for _g in GRAMMARS:
    _query(f"pretok_{_g}", f"with {oracle.pieces_cte(DOCS, 'doc_id', _g)} select doc_id, pos::int as pos, piece from pieces")(_pretok(_g, "documents", ["doc_id"], "text"))
_query("pretok_pages", f"with {oracle.pieces_cte('select page_id, html as text from pages', 'page_id', 'o200k')} select page_id, pos::int as pos, piece from pieces")(_pretok("o200k", "pages", ["page_id"], "html"))
_query("pretok_conversations", f"with {oracle.pieces_cte('select conv_id, turn, text from conversations', 'conv_id, turn', 'qwen')} select conv_id, turn, pos::int as pos, piece from pieces")(_pretok("qwen", "conversations", ["conv_id", "turn"], "text"))


@_query("piece_spans", f'with {oracle.pieces_cte(DOCS, "doc_id", "o200k")} select doc_id, pos::int as pos, piece, (sum(octet_length(encode(piece))) over w - octet_length(encode(piece)))::bigint as "start", (sum(octet_length(encode(piece))) over w)::bigint as "end" from pieces window w as (partition by doc_id order by pos)')
def piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.piece_rows(_docs(spark, sf_dir), ["doc_id"], "text", "o200k", spans=True)


@_query("piece_counts", f"with {oracle.pieces_cte(DOCS, 'doc_id', 'llama3')} select piece, count(*) as n from pieces group by piece")
def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.piece_counts(_docs(spark, sf_dir), "text", "llama3")


@_query("piece_topk", f"with {oracle.pieces_cte(DOCS, 'doc_id', 'o200k')} select piece, count(*) as n from pieces group by piece order by n desc, piece limit 50")
def piece_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.piece_counts(_docs(spark, sf_dir), "text", "o200k").orderBy(F.desc("n"), "piece").limit(50)


@_query("piece_stats", f"with {oracle.pieces_cte('select doc_id, lang, text from documents', 'doc_id, lang', 'llama3')} select lang, count(*) as pieces, count(distinct piece) as distinct_pieces, max(length(piece)) as longest from pieces group by lang")
def piece_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counts by (lang, piece) first: what is shuffled are distinct pieces, with partial counts
    rows = ops.piece_rows(_docs(spark, sf_dir), ["lang"], "text", "llama3")
    distinct = rows.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("lang").agg(F.sum("n").alias("pieces"), F.count(F.lit(1)).alias("distinct_pieces"), F.max(F.length("piece")).cast("long").alias("longest"))


# -- encoding ---------------------------------------------------------------------------------


def _tokens(grammar: str) -> Query:
    return lambda spark, sf_dir: ops.token_rows(_docs(spark, sf_dir), ["doc_id"], "text", encoding(grammar))


for _g in GRAMMARS:
    _query("encode_docs" if _g == "llama3" else f"encode_docs_{_g}", _encoded("select doc_id, pos, id from enc", _g))(_tokens(_g))


@_query("encode_conversations", _encoded("select conv_id, turn, pos, id from enc", "o200k", "select conv_id, turn, text from conversations", "conv_id, turn"))
def encode_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.token_rows(_read(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", encoding("o200k"))


@_query("encode_pages_counts", _encoded("select p.page_id, count(enc.id)::int as n_tokens from pages p left join enc using (page_id) group by 1", "llama3", "select page_id, html as text from pages", "page_id"))
def encode_pages_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", T.count_tokens("html", encoding()).alias("n_tokens"))


@_query("encode_id_offset", _encoded("select doc_id, pos, id from enc", "tekken", offset=OFFSET))
def encode_id_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.token_rows(_docs(spark, sf_dir), ["doc_id"], "text", encoding("tekken", id_offset=OFFSET))


@_query("encode_bytes_only", "select doc_id, octet_length(encode(text))::int as n_tokens, hex(encode(text)) as bytes from documents")
def encode_bytes_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the 256 bytes: ids are the bytes."""
    encoded = _docs(spark, sf_dir).select("doc_id", T.encode("text", byte_encoding("o200k")).alias("ids"))
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2, "0")), "").alias("bytes"))


@_query("count_tokens", _encoded("select d.doc_id, count(enc.id)::int as n_tokens from documents d left join enc using (doc_id) group by d.doc_id"))
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.count_tokens("text", encoding()).alias("n_tokens"))


_PER_DOC = ", per as (select d.doc_id, d.lang, d.source, count(enc.id) as n from documents d left join enc using (doc_id) group by all) "
_BUDGET = "select lang, source, count(*) as documents, sum(n)::bigint as tokens, avg(n) as mean_tokens, max(n)::int as most_tokens from per group by "


def _budget(sets: str) -> Query:
    return lambda spark, sf_dir: ops.token_budget(_docs(spark, sf_dir), ["lang", "source"], "text", encoding(), sets)


for _name, _sets, _by in (("token_budget", "group", "lang, source"), ("token_budget_cube", "cube", "cube (lang, source)"), ("token_budget_rollup", "rollup", "rollup (lang, source)")):
    _query(_name, _encoded("", "llama3").rstrip() + _PER_DOC + _BUDGET + _by)(_budget(_sets))


@_query("token_counts", _encoded("select id, count(*) as n from enc group by id", "o200k"))
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.token_counts(_docs(spark, sf_dir), "text", encoding("o200k"))
    return out.select("id", F.col("n").cast("long").alias("n"))


@_query("token_topk", _encoded("select id, count(*) as n from enc group by id order by n desc, id limit 50"))
def token_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.token_counts(_docs(spark, sf_dir), "text", encoding()).orderBy(F.desc("n"), "id").limit(50)


@_query("token_length_histogram", _encoded("select octet_length(v.tok)::int as len, count(*) as n from enc join v on v.r = enc.id group by 1"))
def token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encoding()
    counts = ops.token_counts(_docs(spark, sf_dir), "text", enc)
    known = vocabulary.vocabulary(spark, enc).select("id", "len")
    return counts.join(F.broadcast(known), "id").groupBy("len").agg(F.sum("n").alias("n"))


_SPANS = '(sum({w}) over s - {w})::bigint as "start", (sum({w}) over s)::bigint as "end" from enc join v on v.r = enc.id window s as (partition by doc_id order by pos)'
_LEADS = "len(list_filter(range(octet_length(v.tok)), lambda i: ('0x' || substr(hex(v.tok), 2 * i + 1, 2))::int & 192 <> 128))"


@_query("offsets_byte", _encoded("select doc_id, pos, id, " + _SPANS.format(w="octet_length(v.tok)")))
def offsets_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.token_rows(_docs(spark, sf_dir), ["doc_id"], "text", encoding(), "byte")


@_query("offsets_char", _encoded("select doc_id, pos, id, " + _SPANS.format(w="w").replace("join v on v.r", f"join (select r, {_LEADS} as w from v) as v on v.r")))
def offsets_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.token_rows(_docs(spark, sf_dir), ["doc_id"], "text", encoding(), "char")


@_query("csr_offsets", _encoded(", per as (select d.doc_id, count(enc.id) as n from documents d left join enc using (doc_id) group by 1) select doc_id, (sum(n) over (order by doc_id) - n)::bigint as \"start\", (sum(n) over (order by doc_id))::bigint as \"end\" from per"))
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.csr_offsets(_docs(spark, sf_dir), "doc_id", "text", encoding())


@_query("static_wrap", _encoded(", per as (select d.doc_id, coalesce(string_agg(enc.id::varchar, ' ' order by pos), '') as ids, count(enc.id) as n from documents d left join enc using (doc_id) group by 1) select doc_id, trim('50257 ' || ids || case when n > 0 then ' ' else '' end || '50258') as input_ids, (n + 2)::int as attended from per"))
def static_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = T.with_static_specials(T.encode("text", encoding()), [50257], [50258])
    wrapped = _docs(spark, sf_dir).select("doc_id", ids.alias("ids")).withColumn("mask", T.attention_mask("ids"))
    return wrapped.select("doc_id", F.array_join("ids", " ").alias("input_ids"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("attended"))


# -- special tokens ---------------------------------------------------------------------------

_MARKED = "'<|im_start|>' || text || '<|im_end|><|endoftext|>'"
_AROUND = "select doc_id, 0 as pos, 50257 as id from documents union all select doc_id, pos + 1, id from enc union all select doc_id, n + 1, 50258 from per union all select doc_id, n + 2, 50256 from per"


@_query("encode_with_special", _encoded(", per as (select d.doc_id, count(enc.id)::int as n from documents d left join enc using (doc_id) group by 1) " + _AROUND))
def encode_with_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|><|endoftext|>"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.encode_with_special(marked, encoding())).alias("pos", "id"))


@_query("encode_special_as_text", _encoded("select doc_id, pos, id from enc", "llama3", f"select doc_id, {_MARKED} as text from documents"))
def encode_special_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinary encoding of texts that hold special strings: they are text."""
    marked = F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|><|endoftext|>"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.encode(marked, encoding())).alias("pos", "id"))


@_query("guard_rejects", "select conv_id, turn, contains(t, '<|im_end|>') or contains(t, '<|endoftext|>') as rejected from (select conv_id, turn, case when role = 'user' then text || '<|im_end|>' when role = 'system' then '<|im_start|>' || text else text end as t from conversations) as x")
def guard_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("role") == "user", F.concat("text", F.lit("<|im_end|>"))).when(F.col("role") == "system", F.concat(F.lit("<|im_start|>"), "text")).otherwise(F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.has_disallowed(text, encoding(), {"<|im_start|>"}).alias("rejected"))


@_query("guarded_counts", _encoded(", per as (select c.conv_id, c.turn, count(enc.id) as n from conversations c left join enc using (conv_id, turn) group by all) select conv_id, turn, (n + 1)::int as n_tokens from per", "llama3", "select conv_id, turn, text from conversations", "conv_id, turn"))
def guarded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<|im_start|>"), "text")
    ids = T.encode_guarded(text, encoding(), allowed_special={"<|im_start|>"})
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(ids).alias("n_tokens"))


@_query("special_counts", "select content, count(*) as n from (select unnest(['<|im_start|>', '<|im_end|>', '<|endoftext|>']) as content from documents) as x group by content")
def special_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|><|endoftext|>"))
    return ops.special_counts(_docs(spark, sf_dir), marked, encoding())


@_query("chat_prompt_tokens", _encoded(", per as (select conv_id, count(*) as n from enc group by 1), turns as (select conv_id, count(*) as t from conversations group by 1) select conv_id, (per.n + 2 * t)::bigint as n_tokens from per join turns using (conv_id)", "llama3", "select conv_id, turn, role || chr(10) || text as text from conversations", "conv_id, turn"))
def chat_prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per conversation if each turn stands between its markers."""
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>"))
    counted = _read(spark, sf_dir, "conversations").select("conv_id", F.size(T.encode_with_special(turn, encoding())).alias("n"))
    return counted.groupBy("conv_id").agg(F.sum("n").alias("n_tokens"))


# -- decoding ---------------------------------------------------------------------------------


@_query("decode_roundtrip", "select doc_id, text from documents")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encoding("o200k")
    return _docs(spark, sf_dir).select("doc_id", T.decode(T.encode("text", enc), enc, errors="strict").alias("text"))


@_query("decode_rows", "select conv_id, turn, hex(encode(coalesce(text, ''))) as bytes from conversations")
def decode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encoding()
    turns = _read(spark, sf_dir, "conversations")
    rows = ops.token_rows(turns, ["conv_id", "turn"], "text", enc)
    return ops.decode_rows(rows, vocabulary.vocabulary(spark, enc), ["conv_id", "turn"], documents=turns).select("conv_id", "turn", F.hex("bytes").alias("bytes"))


@_query("decode_special", f"select doc_id, {_MARKED} as text from documents")
def decode_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, marked = encoding(), F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|><|endoftext|>"))
    return _docs(spark, sf_dir).select("doc_id", T.decode(T.encode_with_special(marked, enc), enc).alias("text"))


@_query("decode_skip_unknown", "select doc_id, text from documents")
def decode_skip_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encoding()
    ids = F.concat(F.array(F.lit(1_000_000), F.lit(-1)), T.encode("text", enc))
    return _docs(spark, sf_dir).select("doc_id", T.decode(ids, enc, on_unknown="skip").alias("text"))


@_query("binary_roundtrip", "select doc_id, hex(encode(text)) || 'C3E280FF80' as bytes from documents")
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8, encoded and decoded."""
    enc, raw = encoding("o200k"), F.concat(F.col("text").cast("binary"), F.lit(bytes.fromhex("C3E280FF80")))
    return _docs(spark, sf_dir).select("doc_id", F.hex(T.decode_bytes(T.encode_binary(raw, enc), enc)).alias("bytes"))


@_query("flat_roundtrip", _encoded("select d.doc_id, count(enc.id)::int as n_tokens, coalesce(sum(enc.id), 0)::bigint as id_sum from documents d left join enc using (doc_id) group by 1"))
def flat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through flat token files and back."""
    folder = new_folder(spark, "flat")
    flat.write_flat(_docs(spark, sf_dir).select("doc_id", T.encode("text", encoding()).alias("ids")), folder)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return flat.read_flat(spark, folder).select(F.col("key").alias("doc_id"), F.size("ids").alias("n_tokens"), total.alias("id_sum"))


# -- vocabulary -------------------------------------------------------------------------------

_V = "with " + oracle.vocabulary_cte(RANKS)
_SPECIAL_ROWS = "specials as (select * from (values (50256, '<|endoftext|>'), (50257, '<|im_start|>'), (50258, '<|im_end|>')) as t(r, content))"


@_query("vocabulary_stats", f"{_V} select count(*) as vocab_size, 3::bigint as n_specials, 50259::bigint as n_vocab, 50258::bigint as max_token_value, max(octet_length(tok))::bigint as max_len, sum(octet_length(tok))::bigint as total_bytes from v")
def vocabulary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary_stats(spark, encoding())


@_query("token_byte_values", f"{_V} select (row_number() over (order by tok) - 1)::int as place, hex(tok) as bytes from v")
def token_byte_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.token_byte_values(spark, encoding()).select("place", F.hex("bytes").alias("bytes"))


@_query("rank_table", f"{_V} select r as id, hex(tok) as bytes from v")
def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import rank_table as table

    return table(spark, RANKS).select("id", F.hex("bytes").alias("bytes"))


@_query("special_tokens", "select * from (values ('<|endoftext|>', 50256), ('<|im_start|>', 50257), ('<|im_end|>', 50258)) as t(content, id)")
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.special_tokens(spark, encoding())


@_query("single_token_lookup", f"{_V}, {oracle.pieces_cte(DOCS, 'doc_id', 'llama3')} select distinct piece, v.r as id from pieces left join v on v.tok = encode(piece)")
def single_token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = ops.piece_counts(_docs(spark, sf_dir), "text", "llama3").select("piece")
    return vocabulary.encode_single_tokens(pieces, "piece", encoding())


@_query("single_token_bytes", f"{_V}, {_SPECIAL_ROWS}, every as (select r, hex(tok) as bytes from v union all select r, hex(encode(content)) from specials) select o_orderkey, bytes from orders left join every on r = o_orderkey")
def single_token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select("o_orderkey")
    return vocabulary.decode_single_tokens(rows, "o_orderkey", encoding()).select("o_orderkey", F.hex("bytes").alias("bytes"))


@_query("known_ids", "select l_orderkey, l_linenumber, l_orderkey between 0 and 50258 as known, l_orderkey between 50256 and 50258 as special from lineitem")
def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encoding()
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.is_known_id("l_orderkey", enc).alias("known"), T.is_special_id("l_orderkey", enc).alias("special"))


@_query("shorter_prefixes", f"{_V} select a.r as id, arg_max(b.r, octet_length(b.tok)) as prefix_id from (select r, unnest(range(1, octet_length(tok))) as k, hex(tok) as h from v) a join v b on hex(b.tok) = substr(a.h, 1, 2 * a.k) group by a.r")
def shorter_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.shorter_prefixes(spark, encoding())


@_query("longest_matches", f"{_V}, cut as (select doc_id, hex(encode(text)) as h from documents where text <> ''), m as (select doc_id, unnest(range(1, least(length(h) // 2, (select max(octet_length(tok)) from v)) + 1)) as k, h from cut) select doc_id, arg_max(v.r, k) as id, max(k)::int as len from m join v on hex(v.tok) = substr(h, 1, 2 * k) group by doc_id")
def longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.longest_matches(_docs(spark, sf_dir), "doc_id", "text", encoding())


@_query("merge_table", f"{_V.replace('with ', 'with recursive ')}, {oracle.MERGE_TABLE} select l.r as \"left\", x.r as \"right\", made.r as id from made join v l on l.tok = made.a join v x on x.tok = made.b")
def merge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.merge_table(spark, encoding())


@_query("unicode_classes")
def unicode_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.unicode_classes(spark)


@_query("pair_lookup", _encoded(", pairs as (select distinct id as \"left\", lead(id) over (partition by doc_id order by pos) as \"right\" from enc) select p.\"left\", p.\"right\", m.r as id from pairs p join v a on a.r = p.\"left\" join v b on b.r = p.\"right\" left join v m on m.tok = a.tok || b.tok"))
def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tokens that stand next to each other, with the token that both together would be."""
    ids = _docs(spark, sf_dir).select(T.encode("text", encoding()).alias("ids"))
    pairs = ids.select(F.explode(F.arrays_zip(F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))).alias("left"), F.slice("ids", 2, F.greatest(F.size("ids"), F.lit(0))).alias("right"))).alias("p"))
    return vocabulary.pair_lookup(pairs.select("p.left", "p.right").distinct(), encoding())


@_query("encoding_files", f"{_V}, {_SPECIAL_ROWS} select r as id, hex(tok) as bytes, false as special from v union all select r, hex(encode(content)), true from specials")
def encoding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as .vocab, .special and .enc, and loaded by name."""
    folder = new_folder(spark, "encodings")
    write_encoding(encoding(), folder, "mine")
    return vocabulary.vocabulary(spark, load_encoding("mine", folder)).select("id", F.hex("bytes").alias("bytes"), "special")


@_query("tokenizer_json", f"{_V} select r as id, hex(tok) as bytes, false as special from v union all select 50256, hex(encode('<|endoftext|>')), true")
def tokenizer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = {b: c for c, b in importer.byte_alphabet().items()}
    split = {"type": "Split", "pattern": {"Regex": _pattern("llama3")}, "behavior": "Isolated", "invert": False}
    steps = [split, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
    vocab = {"".join(signs[x] for x in b): r for b, r in encoding().ranks.items()} | {"<|endoftext|>": 50256}
    top = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "model": {"type": "BPE", "vocab": vocab}, "added_tokens": [{"content": "<|endoftext|>", "id": 50256}]}
    enc = importer.to_encoding(importer.parse_tokenizer_json(json.dumps(top).encode()), "imported")
    return vocabulary.vocabulary(spark, enc).select("id", F.hex("bytes").alias("bytes"), "special")


def _tekken(used: int = 40_000, reserved: int = 10) -> dict:
    """A tekken definition of the rank list's first ranks."""
    import base64

    tokens = [{"rank": r, "token_bytes": base64.b64encode(b).decode()} for b, r in encoding().ranks.items()]
    return {"config": {"pattern": _pattern("tekken"), "default_vocab_size": used + reserved, "default_num_special_tokens": reserved}, "vocab": tokens, "special_tokens": [{"rank": 1, "token_str": "<s>"}]}


@_query("tekken_json", f"{_V} select r + 10 as id, hex(tok) as bytes, false as special from v where r < 40000 union all select 1, hex(encode('<s>')), true")
def tekken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = importer.to_encoding(importer.parse_tekken(json.dumps(_tekken()).encode()), "tekken")
    return vocabulary.vocabulary(spark, enc).select("id", F.hex("bytes").alias("bytes"), "special")


@_query("import_refusals", "select * from (values ('as it is', false), ('lower-casing', true), ('two splits', true), ('another model', true), ('byte fallback', true), ('another pattern', true), ('prefix space', true), ('no pattern', true)) as t(what, refused)")
def import_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that the engine would not follow exactly are refused."""
    split = {"type": "Split", "pattern": {"Regex": _pattern("llama3")}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    plain = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "model": {"type": "BPE", "vocab": {c: i for i, c in enumerate(importer.byte_alphabet())}}}
    steps = lambda *s: {"pre_tokenizer": {"type": "Sequence", "pretokenizers": list(s)}}
    changes = {
        "as it is": {}, "lower-casing": {"normalizer": {"type": "Lowercase"}}, "two splits": steps(split, split, level), "another model": {"model": {"type": "Unigram"}},
        "byte fallback": {"model": plain["model"] | {"byte_fallback": True}}, "another pattern": steps(split | {"pattern": {"Regex": ".+"}}, level), "prefix space": steps(split, level | {"add_prefix_space": True}), "no pattern": steps(level),
    }

    def refused(change: dict) -> bool:
        try:
            importer.to_encoding(importer.parse_tokenizer_json(json.dumps(plain | change).encode()), "x")
        except importer.ImportRefused:
            return True
        return False

    return spark.createDataFrame([(what, refused(change)) for what, change in changes.items()], "what string, refused boolean")


_BOUNDARIES = "select i, decode(unhex(h)) as text from (values " + ", ".join(f"({i}, '{t.encode().hex()}')" for i, t in enumerate(all_texts())) + ") as t(i, h)"


@_query("encode_boundaries", _encoded("select i, pos, id from enc", "o200k", _BOUNDARIES, "i"))
def encode_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on both sides of every boundary that the grammars draw."""
    return ops.token_rows(spark.createDataFrame(list(enumerate(all_texts())), "i int, text string"), ["i"], "text", encoding("o200k"))


# -- texts ------------------------------------------------------------------------------------


@_query("split_paragraphs", "select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, part from (select page_id, unnest(range(len(p))) as i, unnest(p) as part from (select page_id, string_split(html, '</p>') as p from pages) as a) as b where part <> ''")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split_documents(_read(spark, sf_dir, "pages"), ["page_id"], "html", "</p>")


_CHANGES = "".join(unnormalised()) + "z"
_NOT_NFC = "text || " + " || ".join(f"chr({ord(c)})" for c in _CHANGES)


@_query("nfc_docs", f"select doc_id, nfc_normalize({_NOT_NFC}) as text, false as was_nfc, true as is_nfc from documents")
def nfc_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("text", F.lit(_CHANGES))
    out = _docs(spark, sf_dir).select("doc_id", T.nfc(raw).alias("text"), T.is_nfc(raw).alias("was_nfc"))
    return out.withColumn("is_nfc", T.is_nfc("text"))


@_query("encode_nfc", _encoded("select doc_id, pos, id from enc", "qwen", f"select doc_id, nfc_normalize({_NOT_NFC}) as text from documents"))
def encode_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("text", F.lit(_CHANGES))
    return ops.token_rows(_docs(spark, sf_dir).select("doc_id", raw.alias("text")), ["doc_id"], "text", encoding("qwen", nfc=True))


# -- SQL, import, streams ---------------------------------------------------------------------


@_query("sql_functions", _encoded("select d.doc_id, count(enc.id)::int as n_tokens, d.text as decoded from documents d left join enc using (doc_id) group by all"))
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register(spark, encoding(), "tok")
    _docs(spark, sf_dir).createOrReplaceTempView("brindle_documents")
    return spark.sql("SELECT doc_id, size(ids) AS n_tokens, tok_decode(ids) AS decoded FROM (SELECT doc_id, tok_encode(text) AS ids FROM brindle_documents)")


@_query("import_verify", "select count(text) as texts, 0::bigint as mismatches, 50256::int as vocab_size from documents")
def import_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a published definition's own library encodes in another way than the engine: none."""
    enc = encoding("llama3")
    reference = importer.library_reference(RANKS, importer.Definition(dict(enc.ranks), {}, _pattern("llama3")))
    docs = _docs(spark, sf_dir)
    bad = importer.verify(docs, enc, reference).select(F.lit(0).alias("t"), F.lit(1).alias("m"))
    both = bad.union(docs.select(F.col("text").isNotNull().cast("int"), F.lit(0)))
    return both.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("texts"), F.coalesce(F.sum("m"), F.lit(0)).alias("mismatches"), F.lit(enc.vocab_size).alias("vocab_size"))


def _pattern(grammar: str) -> str:
    from ..functions.grammars import GRAMMARS as patterns

    return patterns[grammar]


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reader = spark.readStream.schema(_read(spark, sf_dir, table).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)  # streams read folders, not files


@_query("stream_encode", _encoded("select c.conv_id, c.turn, count(enc.id)::int as n_tokens from conversations c left join enc using (conv_id, turn) group by all", "llama3", "select conv_id, turn, text from conversations", "conv_id, turn"))
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.encode_stream(_stream(spark, sf_dir, "conversations"), "text", encoding()).select("conv_id", "turn", F.size("ids").alias("n_tokens"))
    return streams.run_available(out, new_folder(spark, "stream"))


@_query("windowed_token_counts", _encoded("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as documents, sum(n)::bigint as tokens from (select event_id, ts, event_type, count(enc.id) as n from events left join enc using (event_id) group by all) as x group by all", "llama3", "select event_id, props as text from events", "event_id"))
def windowed_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed_token_counts(_read(spark, sf_dir, "events"), "ts", "props", encoding(), by=("event_type",))


@_query("stream_detokenize", "select conv_id || ':' || turn as \"key\", 0::bigint as first_pos, text from conversations where text <> ''")
def stream_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, as a stream of tokens, back to text by a stateful decoder (a turn without tokens isn't in such a stream)."""
    enc = encoding()
    turns = _stream(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    rows = ops.token_rows(turns, ["key"], "text", enc)
    return streams.run_available(streams.detokenize_stream(rows, "key", "pos", "id", enc, gapless=True), new_folder(spark, "detokenize"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
