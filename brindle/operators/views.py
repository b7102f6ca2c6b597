"""The functions of one encoding, registered for SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..encoding import Encoding
from ..functions.grammars import java_pattern
from .vocabulary import vocabulary


def register(spark: SparkSession, enc: Encoding, prefix: str = "tok") -> list[str]:
    """Temporary functions <prefix>_pieces(text), _encode(text), _count(text), _decode(ids), _decode_bytes(ids) and
    _merge(pieces), and the view <prefix>_vocab. Returns their names."""
    worker = enc.on_workers(spark)

    @F.arrow_udf("array<int>")
    def merge(pieces: pa.Array) -> pa.Array:
        return worker().encode(pieces)

    @F.arrow_udf("binary")
    def decode_bytes(ids: pa.Array) -> pa.Array:
        return worker().decode(ids)

    spark.udf.register(f"{prefix}_merge", merge)
    spark.udf.register(f"{prefix}_decode_bytes", decode_bytes)
    pattern = java_pattern(enc.grammar).replace("\\", "\\\\").replace("'", "\\'")
    pieces = f"regexp_extract_all(x, '{pattern}', 0)"
    for name, kind, argument, body in (
        ("pieces", "ARRAY<STRING>", "x STRING", pieces),
        ("encode", "ARRAY<INT>", "x STRING", f"{prefix}_merge({pieces})"),
        ("count", "INT", "x STRING", f"size({prefix}_merge({pieces}))"),
        ("decode", "STRING", "x ARRAY<INT>", f"make_valid_utf8(CAST({prefix}_decode_bytes(x) AS STRING))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({argument}) RETURNS {kind} RETURN {body}")
    vocabulary(spark, enc).createOrReplaceTempView(f"{prefix}_vocab")
    return [f"{prefix}_{n}" for n in ("pieces", "encode", "count", "decode", "decode_bytes", "merge", "vocab")]
