"""SQL (DuckDB) for the registered queries: the grammars in RE2, and merging by a recursive query.

RE2 has no look-ahead. A private-use character goes before the last white-space character of a run that stands before
something else, and no alternative matches it, so that the run is cut there and the mark vanishes.
"""

from __future__ import annotations

# White space, the same without line breaks, and the parts of the grammars in RE2.
_WS = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS_IN_LINE = _WS.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}\x{0C}")
_MARK = r"\x{E000}"
_SHORT = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)"
_UPPER, _LOWER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_HEAD = rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?"
_SIGNS = rf" ?[^{_WS}\p{{L}}\p{{N}}{_MARK}]+"
_TAIL = rf"[{_WS}]*[\r\n]+|[{_WS}]+"
RE2 = {
    "cl100k": rf"{_SHORT}|{_HEAD}\p{{L}}+|\p{{N}}{{1,3}}|{_SIGNS}[\r\n]*|[{_WS}]+\z|[{_WS}]*[\r\n]|[{_WS}]+",
    "llama3": rf"{_SHORT}|{_HEAD}\p{{L}}+|\p{{N}}{{1,3}}|{_SIGNS}[\r\n]*|{_TAIL}",
    "qwen": rf"{_SHORT}|{_HEAD}\p{{L}}+|\p{{N}}|{_SIGNS}[\r\n]*|{_TAIL}",
    "o200k": rf"{_HEAD}{_UPPER}*{_LOWER}+{_SHORT}?|{_HEAD}{_UPPER}+{_LOWER}*{_SHORT}?|\p{{N}}{{1,3}}|{_SIGNS}[\r\n/]*|{_TAIL}",
    "tekken": rf"{_HEAD}{_UPPER}*{_LOWER}+|{_HEAD}{_UPPER}+{_LOWER}*|\p{{N}}|{_SIGNS}[\r\n/]*|{_TAIL}",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def split_sql(text: str, grammar: str) -> str:
    """An expression: the list of a text's pieces."""
    marked = f"regexp_replace({text}, {_quoted(f'([{_WS}])([{_WS_IN_LINE}][^{_WS}])')}, '\\1' || chr(57344) || '\\2', 'g')"
    return f"regexp_extract_all({marked}, {_quoted(RE2[grammar])})"


def pieces_cte(rows: str, keys: str, grammar: str) -> str:
    """pieces(keys, pos, piece) of a query `rows` that gives keys and text."""
    return f"pieces as (select {keys}, unnest(range(len(p))) as pos, unnest(p) as piece from (select {keys}, {split_sql('text', grammar)} as p from ({rows}) as src) as cut)"


def vocabulary_cte(path: str) -> str:
    """v(tok, r) of a rank list."""
    return f"v as materialized (select from_base64(split_part(l, ' ', 1)) as tok, split_part(l, ' ', 2)::int as r from read_csv({_quoted(path)}, columns={{'l': 'VARCHAR'}}, delim='\x01', header=false, quote='', escape=''))"


#: bpe(piece, ids) of the distinct pieces of a table `pieces`. A step joins each unfinished piece's pair of lowest rank.
MERGE_CTES = """
px as materialized (select distinct piece, encode(piece) as b from pieces),
whole as materialized (select px.piece, v.r from px join v on v.tok = px.b),
s0 as (select piece, list_transform(range(1, octet_length(b) + 1), lambda i: unhex(substr(hex(b), 2 * i - 1, 2))) as toks from px anti join whole using (piece)),
rec as (
  select piece, toks, true as go from s0
  union all
  select x.piece,
    case when m.i is null then x.toks else list_concat(list_concat(x.toks[1:m.i-1], [x.toks[m.i] || x.toks[m.i+1]]), x.toks[m.i+2:]) end,
    m.i is not null
  from rec x left join (
    select y.piece, arg_min(y.i, v.r::bigint * 1000000 + y.i) as i
    from (select piece, unnest(range(1, len(toks))) as i, toks from rec where go and len(toks) > 1) y
    join v on v.tok = y.toks[y.i] || y.toks[y.i+1] group by y.piece) m on m.piece = x.piece
  where x.go),
parts as (select piece, unnest(range(len(toks))) as k, unnest(toks) as tok from rec where not go),
bpe as materialized (
  select piece, 0 as k, r as id from whole
  union all
  select parts.piece, parts.k, v.r from parts join v on v.tok = parts.tok)"""


#: made(r, a, b): tokens of two bytes and more that come out as two parts if only merges of lower rank are done.
MERGE_TABLE = """
s0 as (select r, list_transform(range(1, octet_length(tok) + 1), lambda i: unhex(substr(hex(tok), 2 * i - 1, 2))) as toks, true as go from v where octet_length(tok) > 1),
rec as (
  select r, toks, go from s0
  union all
  select x.r,
    case when m.i is null then x.toks else list_concat(list_concat(x.toks[1:m.i-1], [x.toks[m.i] || x.toks[m.i+1]]), x.toks[m.i+2:]) end,
    m.i is not null
  from rec x left join (
    select y.r, arg_min(y.i, v.r::bigint * 1000000 + y.i) as i
    from (select r, unnest(range(1, len(toks))) as i, toks from rec where go and len(toks) > 1) y
    join v on v.tok = y.toks[y.i] || y.toks[y.i+1] and v.r < y.r group by y.r) m on m.r = x.r
  where x.go),
made as (select r, toks[1] as a, toks[2] as b from rec where not go and len(toks) = 2)"""


def encoded(rows: str, keys: str, grammar: str, path: str, offset: int = 0) -> str:
    """A WITH clause that ends in enc(keys, pos, id)."""
    return f"""with recursive {vocabulary_cte(path)}, {pieces_cte(rows, keys, grammar)}, {MERGE_CTES},
enc as (select {keys}, (row_number() over (partition by {keys} order by p.pos, b.k) - 1)::int as pos, (b.id + {offset})::int as id from pieces p join bpe b using (piece))"""
