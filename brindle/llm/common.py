"""Shared plumbing of the training-data operators.

Everything here works on Arrow batches or on DataFrames; nothing keeps state on
the driver that grows with the input.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written by materialize() in this process, oldest first.
_SCRATCH: list[str] = []

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy block holds at most (a longer document is a block of its own).
BLOCK_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder := "file://" + tempfile.mkdtemp(prefix="brindle-"))
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/brindle-{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folders() -> list[str]:
    """The folders that new_folder() has named and nobody has deleted."""
    return list(_SCRATCH)


def drop_folders(spark: SparkSession, *folders: str) -> None:
    """Delete folders of new_folder() that nothing reads any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in _SCRATCH:
            _SCRATCH.remove(folder)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of finished jobs now: it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def own_names(spark: SparkSession, n: int, each: int) -> np.ndarray:
    """n * each numbers of which a partitioning by hash into n partitions gives each partition one in every n, in order."""
    found = np.zeros(0, dtype=np.int32)
    size = 4 * n * each
    while len(found) < n * each:
        rows = spark.range(size).select(F.col("id").cast("int").alias("b")).select("b", F.pmod(F.hash("b"), F.lit(n)).alias("p")).toArrow()
        b, p = rows.column("b").to_numpy(), rows.column("p").to_numpy()
        order = np.lexsort((b, p))
        cuts = run_starts(p[order])
        place = np.arange(len(b)) - np.repeat(cuts[:-1], np.diff(cuts))
        found = b[order][np.lexsort((p[order], place))][: n * each] if np.bincount(p, minlength=n).min() >= each else b[:0]
        size *= 2
    return found.astype(np.int32)


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has, for an operator's own columns beside them."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_of(column) -> "F.Column":
    """Number of words of a text column; null counts 0. JVM only."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# -- Arrow batches as numpy blocks ------------------------------------------------------------


def column_numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a string or binary array without nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, dtype=kind, count=array.offset + len(array) + 1)[array.offset :].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), ends - ends[0]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows whose texts hold about limit bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = string_buffers(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and where each document's words begin (n+1 word offsets)."""
    n = len(data)
    solid = np.empty(n + 1, dtype=bool)
    solid[:n] = ~SPACE[data]
    solid[n] = False
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a document begins here, so no word goes on
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first))
    ends = np.flatnonzero(before & (~solid | first))
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(0, 2**64, size=256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**64, dtype=np.uint64)) | 1
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS, _INVERSE = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 2**64), size)
    return _POWERS, _INVERSE


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other (the finalizer of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of code(byte) * base**i; the hash of data[s:e] is (p[e] - p[s]) / base**s."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many spans of a block; equal bytes have equal hashes in any block."""
    inverse = powers(len(prefix))[1]
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


# -- pairs within buckets ---------------------------------------------------------------------


def bucket_cells(rows: DataFrame, keys: Sequence[str], member: str, cap: int) -> DataFrame:
    """rows whose bucket (keys) has two members or more, dealt to cells of at most about 2*cap members.

    A bucket of more than cap members is cut into g chunks by hash of member; its cells are the pairs of chunks, so any two
    members meet in exactly one cell: (c, c) if both are in chunk c, else the cross pairs of (c, d). Adds chunk, cx, cy.
    Nothing is dropped: the grid is the exact way for hot buckets.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.ceil(F.col("_n") / F.lit(cap)).cast("int").alias("_g"))
    dealt = rows.join(sizes, keys).withColumn("chunk", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_g")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return dealt.withColumn("cx", F.least("chunk", "_o")).withColumn("cy", F.greatest("chunk", "_o")).drop("_o", "_g")


def run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Indices at which a run of equal (lexicographically sorted) keys begins, and the length at the end."""
    n = len(sorted_keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def pairs_in_runs(bounds: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j within the runs, in slices of about limit pairs."""
    n = int(bounds[-1])
    end = np.repeat(bounds[1:], np.diff(bounds))
    count = end - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + limit, side="right")) - 1)
        i = np.repeat(np.arange(first, last), count[first:last])
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(total[first:last] - total[first], count[first:last])
        first = last


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by links a-b (hooking and pointer jumping)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component.

    Alternating large-star and small-star steps; each round is written to the shared folder. Only minima are aggregated, so
    a hub costs no task more than its partial minimum, and the joins that bring the minima back can be split by AQE.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = materialize(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
