"""Token operators on streams.

Encoding is stateless, so every column function works on a stream as it is. What needs state: token totals per event-time
window (native, with a watermark), and decoding a stream of tokens per key, where a character may be split over tokens that
arrive in different batches; the bytes that are not yet a character are the state.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..encoding import Encoding
from ..functions import text as T


def encode_stream(stream: DataFrame, text: str, enc: Encoding, name: str = "ids") -> DataFrame:
    return stream.withColumn(name, T.encode(text, enc))


def windowed_token_counts(stream: DataFrame, time: str, text: str, enc: Encoding, window: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, by, documents, tokens) per window of event time; rows later than `late` are left out on a stream."""
    counted = stream.select(F.col(time), *by, T.count_tokens(text, enc).alias("_n")).withWatermark(time, late)
    grouped = counted.groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("documents"), F.sum("_n").alias("tokens"))
    return grouped.select(F.col("window.start").alias("window_start"), *by, "documents", "tokens")


def detokenize_stream(stream: DataFrame, key: str, pos: str, token_id: str, enc: Encoding, gapless: bool = False, idle: str | None = None) -> DataFrame:
    """(key, first_pos, text): the whole characters that each batch adds to a key's text, first_pos being its first token's.

    Tokens of a batch go by pos; the bytes of an incomplete last character wait in the state for their other bytes. gapless: pos
    counts a key's tokens from 0, so tokens that come before their predecessors wait in the state for them, and one that comes a
    second time is left out; else a token behind one that has been given already fails the stream. An id that the encoding
    lacks fails it, as in the batch decoder. idle ("10 minutes"): a key that gets nothing for that long is closed: what waits
    is given as it is (incomplete bytes as U+FFFD) and its state is dropped.
    """
    worker = enc.on_workers(stream.sparkSession)
    wait = pd.Timedelta(idle) // pd.Timedelta("1ms") if idle else 0

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        merger = worker()
        following, waiting, early = state.get if state.exists else (0, b"", b"")
        tokens = dict(np.frombuffer(early, np.int64).reshape(-1, 2).tolist())
        for frame in frames:
            tokens |= dict(zip(frame["pos"].tolist(), frame["id"].tolist()))
        late = [p for p in tokens if p < following]
        if late and not gapless:
            raise ValueError(f"the token at {late[0]} of {k[0]!r} comes after those up to {following - 1}")
        order = sorted(p for p in tokens if p >= following)
        if gapless and not state.hasTimedOut:
            order = [p for i, p in enumerate(order) if p == following + i]
        early = {p: i for p, i in tokens.items() if p >= following and (not order or p > order[-1])}
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = decoder.decode(waiting + decoded(merger, [tokens[p] for p in order]), state.hasTimedOut)
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((order[-1] + 1 if order else following, decoder.getstate()[0], np.array(sorted(early.items()), np.int64).tobytes()))
            if wait:
                state.setTimeoutDuration(wait)
        if order or out:
            yield pd.DataFrame({"key": [k[0]], "first_pos": [order[0] if order else following], "text": [out]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(pos).cast("long").alias("pos"), F.col(token_id).cast("int").alias("id"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(run, "key string, first_pos long, text string", "following long, waiting binary, early binary", "append", timeout)


def decoded(merger, ids: list[int]) -> bytes:
    """The bytes of token ids; an unknown one is an error."""
    i = np.array(ids, dtype=np.int64)
    bad = i[(i < 0) | (i >= len(merger.starts) - 1)]
    known = np.setdiff1d(i, bad)
    lost = known[merger.starts[known + 1] == merger.starts[known]] if len(known) else known
    if len(bad) or len(lost):
        raise ValueError(f"unknown token id {int([*bad, *lost][0])}")
    return b"".join(merger.bytes[merger.starts[x] : merger.starts[x + 1]].tobytes() for x in ids)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into Parquet files of a shared folder, and read them."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")
