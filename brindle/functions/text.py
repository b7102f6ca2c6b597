"""Column functions over text, piece and token-id columns.

Splitting, counting, wrapping and guarding are native expressions; merging, span arithmetic, decoding and NFC are Arrow
functions that take whole batches and work on them in slices. A null text gives null, an empty text gives no tokens.
"""

from __future__ import annotations

import codecs
import re
import threading
import unicodedata
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from ..encoding import Encoding
from .bpe import _offsets, _parts, raw_bytes, row_slices
from .grammars import java_pattern

#: Below U+0300 no character changes under NFC, so only other texts are looked at.
_MAYBE_NOT_NFC = r"[^\x{0}-\x{2FF}]"


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("there is no active SparkSession")
    return spark


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- pieces -----------------------------------------------------------------------------------


def pretokenize(text: Column | str, grammar: str) -> Column:
    """array<string> of the pieces; they tile the text."""
    return F.regexp_extract_all(_col(text), F.lit(java_pattern(grammar)), F.lit(0))


def _each(values: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each row, null for null; as many rows are Python objects at a time as make a slice."""
    return pa.concat_arrays([pa.array([None if x is None else f(x) for x in part.to_pylist()], kind) for part in row_slices(values)])


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: unicodedata.normalize("NFC", t), pa.string())


@F.arrow_udf(ArrayType(StringType()))
def _nfc_each(texts: pa.Array) -> pa.Array:
    rows, offsets, flat = _parts(texts)
    return pa.ListArray.from_arrays(_offsets(offsets, rows), _each(flat, lambda t: unicodedata.normalize("NFC", t), pa.string()))


@F.arrow_udf(BooleanType())
def _is_nfc(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: unicodedata.is_normalized("NFC", t), pa.bool_())


def is_nfc(text: Column | str) -> Column:
    """Whether a text is in NFC. Only texts with characters from U+0300 on are sent to Python."""
    text = _col(text)
    suspect = text.rlike(_MAYBE_NOT_NFC)
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(_is_nfc(F.when(suspect, text)), F.lit(True)))


def nfc(text: Column | str) -> Column:
    """The text in NFC. Only texts with characters from U+0300 on are sent to Python (others go there as null)."""
    text = _col(text)
    return F.coalesce(_nfc(F.when(text.rlike(_MAYBE_NOT_NFC), text)), text)


# -- encoding ---------------------------------------------------------------------------------


def merge_pieces(pieces: Column | str, enc: Encoding) -> Column:
    """array<string> or array<binary> of pieces to array<int> of ids."""
    worker = enc.on_workers(_session())

    @F.arrow_udf("array<int>")
    def merged(p: pa.Array) -> pa.Array:
        return worker().encode(p)

    return merged(_col(pieces))


def encode(text: Column | str, enc: Encoding) -> Column:
    """array<int> of token ids; special tokens' strings in a text are ordinary text."""
    text = _col(text)
    return merge_pieces(pretokenize(nfc(text) if enc.nfc else text, enc.grammar), enc)


encode_ordinary = encode


def count_tokens(text: Column | str, enc: Encoding) -> Column:
    """Number of tokens of ordinary encoding; the ids themselves are not made."""
    text, worker = _col(text), enc.on_workers(_session())

    @F.arrow_udf("int")
    def counted(p: pa.Array) -> pa.Array:
        return worker().count(p)

    return counted(pretokenize(nfc(text) if enc.nfc else text, enc.grammar))


def _alternation(strings: Collection[str]) -> str:
    return "|".join(re.sub(r"([^A-Za-z0-9_\s<>/])", r"\\\1", s) for s in strings)


def _ordered(enc: Encoding, some: Collection[str] | None) -> list[str]:
    return [s for s, _ in enc.special_items if some is None or s in some]


def encode_with_special(text: Column | str, enc: Encoding, allowed: Collection[str] | None = None) -> Column:
    """array<int> of ids in which the special strings (allowed, or all) become their own ids."""
    strings = _ordered(enc, allowed)
    if not strings:
        return encode(text, enc)
    text, worker, special, pattern = _col(text), enc.on_workers(_session()), _alternation(strings), java_pattern(enc.grammar)
    between, marks = F.split(text, special, -1), F.regexp_extract_all(text, F.lit(special), F.lit(0))
    if enc.nfc:  # between special tokens
        between = _nfc_each(between)

    @F.arrow_udf("array<int>")
    def merged(segments: pa.Array, specials: pa.Array) -> pa.Array:
        return worker().encode_marked(segments, specials)

    # named here, since Spark can't make up a name for a function of a lambda
    return merged(F.transform(between, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))), marks).alias("ids")


def disallowed_strings(enc: Encoding, allowed_special: Collection[str] | str = (), disallowed_special: Collection[str] | str = "all") -> list[str]:
    """Strings that the guard refuses: "all" means the special tokens that are not allowed; an explicit set is taken as it is."""
    allowed = enc.special_tokens_set if allowed_special == "all" else set(allowed_special)
    return sorted(enc.special_tokens_set - allowed if disallowed_special == "all" else set(disallowed_special))


def has_disallowed(text: Column | str, enc: Encoding, allowed_special: Collection[str] | str = (), disallowed_special: Collection[str] | str = "all") -> Column:
    """Whether the guard would refuse a text: use it to route offenders to a table of rejects."""
    strings = disallowed_strings(enc, allowed_special, disallowed_special)
    text = _col(text)
    return text.rlike(_alternation(strings)) if strings else F.when(text.isNotNull(), F.lit(False))


def encode_guarded(text: Column | str, enc: Encoding, allowed_special: Collection[str] | str = (), disallowed_special: Collection[str] | str = "all") -> Column:
    """Ids with the allowed special tokens; a text that holds a disallowed one fails the query."""
    text = _col(text)
    bad = has_disallowed(text, enc, allowed_special, disallowed_special)
    safe = F.when(bad, F.raise_error(F.lit("a text holds a disallowed special token"))).otherwise(text)
    allowed = enc.special_tokens_set if allowed_special == "all" else set(allowed_special) & enc.special_tokens_set
    return encode_with_special(safe, enc, allowed) if allowed else encode(safe, enc)


_SPANS = "array<struct<start:bigint,end:bigint>>"


def token_spans(ids: Column | str, enc: Encoding, unit: str = "byte") -> Column:
    """array<struct<start, end>> of the tokens' places in the (normalized) text, in bytes or code points.

    A character that is split over tokens counts for the first of them, so that spans stay contiguous.
    """
    if unit not in ("byte", "char"):
        raise ValueError(f"unit must be 'byte' or 'char', not {unit!r}")
    worker = enc.on_workers(_session())

    @F.arrow_udf(_SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for i in row_slices(batch):
                starts, ends = worker().spans(i, unit)
                yield _structs(i, start=pa.array(starts), end=pa.array(ends))

    return spans(_col(ids))


def _structs(lists: pa.Array, **values: pa.Array) -> pa.Array:
    """Lists as long as those of lists, of structs of these values."""
    rows, offsets, _ = _parts(lists)
    return pa.ListArray.from_arrays(_offsets(offsets, rows), pa.StructArray.from_arrays(list(values.values()), names=list(values)))


def encode_with_offsets(text: Column | str, enc: Encoding, unit: str = "byte") -> Column:
    """struct<ids, spans>; ids are computed once."""
    if unit not in ("byte", "char"):
        raise ValueError(f"unit must be 'byte' or 'char', not {unit!r}")
    text, worker = _col(text), enc.on_workers(_session())

    @F.arrow_udf(f"struct<ids:array<int>,spans:{_SPANS}>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for ids in row_slices(worker().encode(batch)):
                starts, ends = worker().spans(ids, unit)
                yield pa.StructArray.from_arrays([ids, _structs(ids, start=pa.array(starts), end=pa.array(ends))], names=["ids", "spans"])

    return both(pretokenize(nfc(text) if enc.nfc else text, enc.grammar))


def encode_to_rows(text: Column | str, enc: Encoding, unit: str) -> Column:
    """array<struct<id, start, end>>: ids and spans as posexplode takes them, without an expression per token in Spark."""
    if unit not in ("byte", "char"):
        raise ValueError(f"unit must be 'byte' or 'char', not {unit!r}")
    text, worker = _col(text), enc.on_workers(_session())

    @F.arrow_udf("array<struct<id:int,start:bigint,end:bigint>>")
    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for ids in row_slices(worker().encode(batch)):
                starts, ends = worker().spans(ids, unit)
                yield _structs(ids, id=ids.flatten(), start=pa.array(starts), end=pa.array(ends))

    return rows(pretokenize(nfc(text) if enc.nfc else text, enc.grammar))


# -- bytes that need not be UTF-8 -------------------------------------------------------------


_ODD = threading.local()


def _lenient(error: UnicodeError) -> tuple[str, int]:
    """For Python's codec: a character that classifies malformed bytes, and where to go on.

    A lead byte with enough bytes after it takes them unchecked; any other byte from 0x80 on is one Latin-1 character.
    """
    raw, at = error.object, error.start
    c = raw[at]
    wide = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4 if c < 0xF8 else 1
    if at + wide > len(raw):
        wide = 1
    point = c if wide == 1 else c & (0x7F >> wide)
    for b in raw[at + 1 : at + wide]:
        point = point << 6 | b & 0x3F
    _ODD.found.append((at, wide))
    # surrogates and numbers beyond Unicode are neither letter, number nor space: a private character stands for them
    return chr(point) if point < 0xD800 or 0xDFFF < point < 0x110000 else "\ue000", at + wide


codecs.register_error("brindle.lenient", _lenient)


def as_text(raw: bytes) -> tuple[str, list[tuple[int, int]]]:
    """The bytes as characters, and where malformed ones lie: (first byte, how many bytes stand behind its character)."""
    _ODD.found = []
    return raw.decode("utf-8", "brindle.lenient"), _ODD.found


@F.arrow_udf(StringType())
def _as_text(raw: pa.Array) -> pa.Array:
    return _each(raw, lambda r: as_text(r)[0], pa.string())


def cut_bytes(raw: pa.Array, pieces: pa.Array) -> pa.Array:
    """raw (binary) cut as its texts (as_text) have been cut into pieces: list<binary>."""
    rows, offsets, flat = _parts(pieces)
    starts, data = raw_bytes(raw)
    cuts = np.zeros(len(flat) + 1, dtype=np.int32)
    cuts[0] = starts[0]
    a = 0
    for part in row_slices(raw):
        z = a + len(part)
        begins = (data[starts[a] : starts[z]] & 0xC0) != 0x80  # where characters begin
        for at, r in zip((starts[a:z] - starts[a]).tolist(), part.to_pylist()):
            for i, wide in as_text(r)[1] if r else ():
                begins[at + i : at + i + wide] = False
                begins[at + i] = True
        places = np.append(np.flatnonzero(begins), len(begins)) + starts[a]
        chars = np.cumsum(pc.utf8_length(flat.slice(offsets[a], offsets[z] - offsets[a])).to_numpy(), dtype=np.int64)
        if (chars[-1] if len(chars) else 0) != len(places) - 1:
            raise ValueError("pieces do not tile their text")
        cuts[offsets[a] + 1 : offsets[z] + 1] = places[chars]
        a = z
    values = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(_offsets(offsets, rows), values)


def encode_binary(raw: Column | str, enc: Encoding) -> Column:
    """array<int> of ids of a binary column, valid UTF-8 or not; decoding gives the same bytes again. NFC is not applied."""
    worker = enc.on_workers(_session())

    @F.arrow_udf("array<int>")
    def merged(bytes_: pa.Array, pieces: pa.Array) -> pa.Array:
        return worker().encode(cut_bytes(bytes_, pieces))

    return merged(_col(raw), pretokenize(_as_text(_col(raw)), enc.grammar))


# -- decoding ---------------------------------------------------------------------------------


def decode_bytes(ids: Column | str, enc: Encoding, on_unknown: str = "error") -> Column:
    """binary of the tokens' bytes; on_unknown: error or skip."""
    if on_unknown not in ("error", "skip"):
        raise ValueError("on_unknown must be 'error' or 'skip'")
    worker = enc.on_workers(_session())

    @F.arrow_udf("binary")
    def joined(i: pa.Array) -> pa.Array:
        return worker().decode(i, on_unknown)

    return joined(_col(ids).cast("array<int>"))


def decode(ids: Column | str, enc: Encoding, errors: str = "replace", on_unknown: str = "error") -> Column:
    """string of the tokens' bytes. errors: replace (U+FFFD) and strict (fails) are native; others go to Python's codec."""
    raw = decode_bytes(ids, enc, on_unknown)
    if errors == "replace":
        return F.make_valid_utf8(raw.cast("string"))
    if errors == "strict":
        return F.validate_utf8(raw.cast("string"))

    @F.arrow_udf("string")
    def text(b: pa.Array) -> pa.Array:
        return _each(b, lambda x: x.decode("utf-8", errors), pa.string())

    return text(raw)


# -- id arrays --------------------------------------------------------------------------------


def with_static_specials(ids: Column | str, prefix: Collection[int] = (), suffix: Collection[int] = ()) -> Column:
    """prefix + ids + suffix, as a model expects them around each text."""
    side = lambda x: F.array(*(F.lit(int(i)) for i in x)).cast("array<int>")
    return F.concat(side(prefix), _col(ids), side(suffix))


def attention_mask(ids: Column | str) -> Column:
    return F.array_repeat(F.lit(1), F.size(_col(ids)))


def add_offset(ids: Column | str, offset: int) -> Column:
    return F.transform(_col(ids), lambda i: i + F.lit(int(offset)))


def is_known_id(token_id: Column | str, enc: Encoding) -> Column:
    """Whether an id is a token: the base ids are one range, and specials a short list."""
    i = _col(token_id)
    base = (i >= enc.id_offset) & (i < enc.id_offset + enc.vocab_size)
    return base | i.isin([int(x) for x in enc.specials.values()]) if enc.specials else base


def is_special_id(token_id: Column | str, enc: Encoding) -> Column:
    i = _col(token_id)
    return i.isin([int(x) for x in enc.specials.values()]) if enc.specials else F.when(i.isNotNull(), F.lit(False))
