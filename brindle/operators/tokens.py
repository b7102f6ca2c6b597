"""Token and piece operators over DataFrames.

Per-row results (ids, counts, spans) never shuffle: a document's tokens are made where the document is read. Corpus-wide
statistics are counted where the texts are read (partial counts), so that shuffling follows the number of distinct pieces or
ids, not of tokens. Keys named by the caller are carried through; a null text has no pieces and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..encoding import Encoding
from ..functions.bpe import _offsets, _parts, row_slices, running
from ..functions import text as T
from ..sources.scratch import written


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if Spark would read it in fewer partitions than there are cores: a small file is often one row group,
    which one task reads, while encoding is bound by CPU. Rows are the same either way; columns that nobody asks for aren't dealt."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if parts < cores else df


@F.arrow_udf(StructType([StructField("starts", ArrayType(LongType())), StructField("ends", ArrayType(LongType()))]))
def _byte_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for pieces in row_slices(batch):
            rows, offsets, flat = _parts(pieces)
            both = running(pc.binary_length(flat).to_numpy(), offsets)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(_offsets(offsets, rows), pa.array(x)) for x in both], names=["starts", "ends"])


def piece_rows(df: DataFrame, keys: Sequence[str], text: str, grammar: str, spans: bool = False) -> DataFrame:
    """(keys, pos, piece[, start, end]): a row per piece, pos from 0; spans in bytes."""
    pieces = df.select(*keys, T.pretokenize(text, grammar).alias("_pieces"))
    if not spans:
        return pieces.select(*keys, F.posexplode("_pieces").alias("pos", "piece"))
    both = pieces.withColumn("_s", _byte_spans("_pieces"))
    zipped = both.select(*keys, F.posexplode(F.arrays_zip(F.col("_pieces").alias("p"), F.col("_s.starts").alias("s"), F.col("_s.ends").alias("e"))).alias("pos", "_z"))
    return zipped.select(*keys, "pos", F.col("_z.p").alias("piece"), F.col("_z.s").alias("start"), F.col("_z.e").alias("end"))


def token_rows(df: DataFrame, keys: Sequence[str], text: str, enc: Encoding, unit: str | None = None) -> DataFrame:
    """(keys, pos, id[, start, end]): a row per token, pos from 0; spans in the unit asked for."""
    if unit is None:
        return df.select(*keys, F.posexplode(T.encode(text, enc)).alias("pos", "id"))
    rows = df.select(*keys, F.posexplode(T.encode_to_rows(text, enc, unit)).alias("pos", "_t"))
    return rows.select(*keys, "pos", "_t.id", "_t.start", "_t.end")


def piece_counts(df: DataFrame, text: str, grammar: str) -> DataFrame:
    """(piece, n): how often each distinct piece occurs."""
    return df.select(F.explode(T.pretokenize(text, grammar)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def token_counts(df: DataFrame, text: str, enc: Encoding) -> DataFrame:
    """(id, n): how often each token occurs. Each task counts its distinct pieces batch by batch and gives a row for each id, so
    that only these are shuffled, however many distinct pieces there are."""
    worker = enc.on_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum((worker().occurrences(b.column(0)) for b in batches), np.zeros(1, dtype=np.int64))
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(n[ids])], names=["id", "n"])

    pieces = df.select(T.pretokenize(T.nfc(text) if enc.nfc else text, enc.grammar).alias("pieces"))
    return pieces.mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def token_budget(df: DataFrame, by: Sequence[str], text: str, enc: Encoding, sets: str = "group") -> DataFrame:
    """Documents, tokens, mean and most tokens per group; sets: group, rollup or cube over by."""
    counted = df.select(*by, T.count_tokens(text, enc).alias("_n"))
    grouped = {"group": counted.groupBy, "rollup": counted.rollup, "cube": counted.cube}[sets](*by)
    return grouped.agg(F.count(F.lit(1)).alias("documents"), F.sum("_n").alias("tokens"), F.avg("_n").alias("mean_tokens"), F.max("_n").alias("most_tokens"))


def decode_rows(tokens: DataFrame, vocabulary: DataFrame, keys: Sequence[str], pos: str = "pos", token_id: str = "id", documents: DataFrame | None = None) -> DataFrame:
    """(keys, bytes) of token rows, all relational: join with the vocabulary (a bounded table), then an ordered listagg.

    An id that the vocabulary lacks fails the query. documents: all keys; those without any token get no bytes (an empty
    value), else they are left out.
    """
    known = vocabulary.select(F.col("id").alias("_id"), "bytes")
    joined = tokens.join(F.broadcast(known), tokens[token_id] == known["_id"], "left")
    checked = joined.withColumn("bytes", F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("unknown token id "), F.col(token_id)))).otherwise(F.col("bytes")))
    ordered = checked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, "bytes"))).alias("_b"))
    decoded = ordered.select(*keys, F.concat_ws("", F.transform("_b", lambda b: F.hex(b["bytes"]))).alias("_hex")).select(*keys, F.unhex("_hex").alias("bytes"))
    if documents is None:
        return decoded
    return documents.select(*keys).join(decoded, list(keys), "left").select(*keys, F.coalesce("bytes", F.lit(b"")).alias("bytes"))


def split_documents(df: DataFrame, keys: Sequence[str], text: str, separator: str = "\n\n") -> DataFrame:
    """(keys, pos, part): texts cut at a literal separator; empty parts are dropped, pos counts what stays."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in separator)
    parts = F.filter(F.split(text, quoted, -1), lambda s: s != "")
    return df.select(*keys, F.posexplode(parts).alias("pos", "part"))


def prefix_offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """(key, start, end): running sums of size in order of key, over any number of rows.

    The sizes are written once, so that whatever makes them runs once; then they are dealt to key ranges, sorted and written with
    the number of their range. A table with one row per range holds the sums before each; within a range a window adds up.
    """
    n = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = written(sizes.select(key, size), "sizes")
    dealt = written(once.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = dealt.withColumn("_ran", F.sum(size).over(within)).join(F.broadcast(sums), "_part")
    return ran.select(key, (F.col("_before") + F.col("_ran") - F.col(size)).alias("start"), (F.col("_before") + F.col("_ran")).alias("end"))


def csr_offsets(df: DataFrame, key: str, text: str, enc: Encoding) -> DataFrame:
    """(key, start, end): where each document's tokens stand in the flat token array of the corpus, in order of key."""
    sizes = df.select(key, F.coalesce(T.count_tokens(text, enc), F.lit(0)).cast("long").alias("n"))
    return prefix_offsets(sizes, key, "n")


def flat_batch(df: DataFrame, key: str, text: str, enc: Encoding) -> DataFrame:
    """(key, ids, start, end): encoded documents with their places in the flat array. Texts are encoded once."""
    encoded = written(df.select(key, F.coalesce(T.encode(text, enc), F.array().cast("array<int>")).alias("ids")), "encoded")
    return encoded.join(prefix_offsets(encoded.select(key, F.size("ids").cast("long").alias("n")), key, "n"), key)


def to_numpy(encoded: DataFrame, key: str, ids: str = "ids", most: int = 1 << 28):
    """(tokens uint32, offsets int64, keys) of encoded documents in order of key, for a caller on the driver.

    It is for results that fit there: more than `most` tokens are refused, before anything is brought.
    """
    import numpy as np

    total = encoded.agg(F.sum(F.greatest(F.size(ids), F.lit(0)).cast("long"))).first()[0] or 0
    if total > most:
        raise ValueError(f"{total} tokens are more than {most}: write them with write_flat instead")
    table = encoded.select(F.col(key).alias("k"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("i")).orderBy("k").toArrow()
    column = table.column("i").combine_chunks()
    sizes = [0] if not len(table) else np.concatenate([[0], np.diff(column.offsets.to_numpy())])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.cumsum(sizes, dtype=np.int64), table.column("k").to_pylist()


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, left, right) where two encodings of the same rows differ, rows of one side only included."""
    left, right = (x.select(*keys, F.col(value).alias(name), F.lit(True).alias(f"_{name}")) for x, name in ((a, "left"), (b, "right")))
    both = left.join(right, list(keys), "full")
    return both.where(F.col("_left").isNull() | F.col("_right").isNull() | ~F.col("left").eqNullSafe(F.col("right"))).select(*keys, "left", "right")


def special_counts(df: DataFrame, text: Column | str, enc: Encoding) -> DataFrame:
    """(content, n): how often each special token's string occurs in the texts."""
    strings = [s for s, _ in enc.special_items]
    found = F.explode(F.regexp_extract_all(T._col(text), F.lit(T._alternation(strings)), F.lit(0))) if strings else F.explode(F.array().cast("array<string>"))
    return df.select(found.alias("content")).groupBy("content").agg(F.count(F.lit(1)).alias("n"))
