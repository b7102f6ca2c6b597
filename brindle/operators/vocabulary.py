"""Vocabulary introspection: an encoding's tables, and look-ups as joins with them.

These tables are bounded by the limits of an encoding (2**18 tokens of 255 bytes), so they may be broadcast.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..encoding import Encoding
from ..functions.bpe import merge_piece


def vocabulary(spark: SparkSession, enc: Encoding) -> DataFrame:
    """(id, bytes, len, special) of every token."""
    return enc.tables(spark)


def vocabulary_stats(spark: SparkSession, enc: Encoding) -> DataFrame:
    """One row: vocab_size, n_specials, n_vocab, max_token_value, max_len, total_bytes."""
    base = ~F.col("special")
    v = vocabulary(spark, enc).agg(
        F.count_if(base).alias("vocab_size"), F.count_if("special").alias("n_specials"), (F.max("id") + 1).cast("long").alias("n_vocab"),
        F.max("id").cast("long").alias("max_token_value"), F.max(F.when(base, F.col("len"))).cast("long").alias("max_len"), F.sum(F.when(base, F.col("len"))).alias("total_bytes"),
    )
    return v


def token_byte_values(spark: SparkSession, enc: Encoding) -> DataFrame:
    """(place, bytes) of the ordinary tokens in byte order, place counting from 0. The table is bounded, so one window numbers it."""
    order = Window.orderBy("bytes")
    return vocabulary(spark, enc).where("not special").select((F.row_number().over(order) - 1).alias("place"), "bytes")


def special_tokens(spark: SparkSession, enc: Encoding) -> DataFrame:
    return vocabulary(spark, enc).where("special").select(F.col("bytes").cast("string").alias("content"), "id").orderBy("id")


def encode_single_tokens(df: DataFrame, token: str, enc: Encoding) -> DataFrame:
    """df with id: the token whose bytes a string or binary column holds, null if there is none (an ordinary token comes first)."""
    v = vocabulary(df.sparkSession, enc)
    first = v.groupBy("bytes").agg(F.min_by("id", "special").alias("id"))
    return df.join(F.broadcast(first.withColumnRenamed("bytes", "_bytes")), F.col(token).cast("binary") == F.col("_bytes"), "left").drop("_bytes")


def decode_single_tokens(df: DataFrame, token_id: str, enc: Encoding) -> DataFrame:
    """df with bytes of a token id column, null for an unknown id."""
    v = vocabulary(df.sparkSession, enc).select(F.col("id").alias("_id"), "bytes")
    return df.join(F.broadcast(v), F.col(token_id) == F.col("_id"), "left").drop("_id")


def shorter_prefixes(spark: SparkSession, enc: Encoding) -> DataFrame:
    """(id, prefix_id): for each ordinary token the longest token that is a proper prefix of it."""
    v = vocabulary(spark, enc).where("not special")
    cut = v.where("len > 1").select("id", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"), "bytes")
    cut = cut.select("id", "k", F.substring("bytes", F.lit(1), F.col("k")).alias("prefix"))
    known = F.broadcast(v.select(F.col("bytes").alias("prefix"), F.col("id").alias("prefix_id")))
    return cut.join(known, "prefix").groupBy("id").agg(F.max_by("prefix_id", "k").alias("prefix_id"))


def longest_matches(df: DataFrame, key: str, raw: str, enc: Encoding) -> DataFrame:
    """(key, id, len): the longest token that a row's bytes begin with (keys must be unique; empty and null rows have none)."""
    v = vocabulary(df.sparkSession, enc).where("not special")
    longest = max(map(len, enc.ranks))
    b = df.select(F.col(key), F.col(raw).cast("binary").alias("_b")).where(F.octet_length("_b") > 0)
    cut = b.select(key, F.explode(F.sequence(F.lit(1), F.least(F.octet_length("_b"), F.lit(longest)))).alias("len"), "_b")
    cut = cut.select(key, "len", F.substring("_b", F.lit(1), F.col("len")).alias("_p"))
    known = F.broadcast(v.select(F.col("bytes").alias("_p"), "id"))
    return cut.join(known, "_p").groupBy(key).agg(F.max_by("id", "len").alias("id"), F.max("len").alias("len"))


def pair_lookup(pairs: DataFrame, enc: Encoding, left: str = "left", right: str = "right") -> DataFrame:
    """pairs with id: the ordinary token whose bytes are those of both tokens together, null if there is none. Unknown ids are left out."""
    v = vocabulary(pairs.sparkSession, enc).where("not special")
    one, two = (F.broadcast(v.select(F.col("id").alias("_i" + s), F.col("bytes").alias("_b" + s))) for s in "lr")
    both = pairs.join(one, F.col(left) == F.col("_il")).join(two, F.col(right) == F.col("_ir"))
    known = F.broadcast(v.select(F.col("bytes").alias("_m"), "id"))
    return both.join(known, F.concat("_bl", "_br") == F.col("_m"), "left").select(left, right, "id")


def merge_table(spark: SparkSession, enc: Encoding) -> DataFrame:
    """(left, right, id): the two tokens that merging joins last to make each token; tokens that no merge reaches are left out."""
    ranks = dict(enc.ranks)
    offset = enc.id_offset
    # the merge of a token's bytes with all lower ranks; a pair of tokens is what the token was made of
    rows = []
    for b, r in ranks.items():
        if len(b) > 1:
            lower = _Below(ranks, r)
            parts = merge_piece(b, lower)
            if len(parts) == 2:
                rows.append((parts[0] + offset, parts[1] + offset, r + offset))
    return spark.createDataFrame(pa.table(list(zip(*rows)) or [[], [], []], schema=pa.schema([("left", pa.int32()), ("right", pa.int32()), ("id", pa.int32())])))


class _Below:
    """A rank table as it was before the token of a rank came in."""

    def __init__(self, ranks: dict[bytes, int], top: int) -> None:
        self.ranks, self.top = ranks, top

    def get(self, b: bytes) -> int | None:
        r = self.ranks.get(b)
        return r if r is not None and r < self.top else None

    def __getitem__(self, b: bytes) -> int:
        return self.ranks[b]


def unicode_classes(spark: SparkSession, classes: dict[str, str] | None = None) -> DataFrame:
    """(class, lo, hi): maximal ranges of code points per class, as this engine's regex sees them (islands and gaps)."""
    # The classes that the grammars use.
    classes = classes or {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s", "UPPER": r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", "LOWER": r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"}
    points = spark.range(0x110000).where("id < 55296 or id > 57343").select(F.col("id").alias("cp"))
    # UTF-32 bytes to a character
    char = F.decode(F.unhex(F.lpad(F.hex("cp"), 8, "0")), "UTF-32")
    hits = points.select("cp", F.explode(F.array_compact(F.array(*(F.when(char.rlike("(?U)^" + p), F.lit(c)) for c, p in classes.items())))).alias("class"))
    island = F.col("cp") - F.row_number().over(Window.partitionBy("class").orderBy("cp"))
    return hits.withColumn("_g", island).groupBy("class", "_g").agg(F.min("cp").alias("lo"), F.max("cp").alias("hi")).drop("_g")
