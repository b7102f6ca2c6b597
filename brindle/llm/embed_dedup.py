"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised; a table's key is `hashes` quantised random projections floor((a.x + b) / width), with a Gaussian
(2-stable), so that the chance to share a key falls with Euclidean distance, that is with cosine. Vectors that share a key
in any of `tables` tables are compared by exact cosine in double precision, and linked at the threshold.

The number of hashes follows the number of vectors (about TARGET random vectors share a bucket), and the number of tables
follows from it, so that a pair just at the threshold is missed with probability `miss` at most; closer pairs far less.
Equal vectors collapse before the search. A hot bucket is cut into a grid of cells (common.bucket_cells); a pair that meets
in several tables counts in the first one only, which both sides can tell from the keys they carry, so links need no
distinct. Within a cell only star links leave; components are joined afterwards.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing (n_links 0,
component their own id); vectors of different length never link; equal rows are separate vectors; a null id is linked and
counted, but never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_cells, connected_components, local_roots, materialize, pairs_in_runs, partitions, run_starts

SEED = 7
TARGET = 4.0
CELL_CAP = 2048
#: Bits of the sketch (signs of projections) that a pair must agree on before its vectors travel.
SKETCH = 128


def collision_chance(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees at a Euclidean distance."""
    if distance <= 0:
        return 1.0
    t = width / distance
    normal = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, threshold: float, width: float, miss: float) -> tuple[int, int]:
    """(hashes a key, tables) for n vectors."""
    near = collision_chance(math.sqrt(2 - 2 * threshold), width)
    far = collision_chance(math.sqrt(2), width)
    hashes = max(2, math.ceil(math.log(max(n, 2) / TARGET) / math.log(1 / far)))
    return hashes, max(1, math.ceil(math.log(miss) / math.log(1 - near**hashes)))


def _projections(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def table_keys(x: np.ndarray, tables: int, hashes: int, width: float) -> np.ndarray:
    """(rows, tables) 64-bit keys of unit vectors."""
    a, b = _projections(x.shape[1], tables, hashes, width)
    cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, hashes).astype(np.uint64)
    key = np.full((len(x), tables), x.shape[1], dtype=np.uint64)
    for h in range(hashes):
        key = (key ^ cells[:, :, h]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for i, v in enumerate(column):
        yield i, v.values.to_numpy(zero_copy_only=False)


def _hashed(tables: int, hashes: int, width: float):
    """mapInArrow function: (rep, v) to (rep, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = batch.column(0)
            by_dim: dict[int, list] = {}
            for i, v in _unit(batch.column(1)):
                by_dim.setdefault(len(v), []).append((i, v))
            for rows in by_dim.values():
                x = np.stack([v for _, v in rows])
                keys = table_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes, width)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, type=pa.int32()), pa.array(keys.ravel()))
                sides = np.random.default_rng([SEED, x.shape[1], 1]).standard_normal((x.shape[1], SKETCH))
                sketch = np.packbits(x @ sides > 0, axis=1).view("<i8")
                yield pa.RecordBatch.from_arrays([reps.take(pa.array([i for i, _ in rows])), flat, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], names=["rep", "keys", "s0", "s1"])

    return run


def sketch_reach(threshold: float) -> int:
    """Sketch bits in which vectors at the threshold differ at most, but for a chance of about 1e-10."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 6.5 * math.sqrt(SKETCH * p * (1 - p)))


_CELL = "slot int, key long, cx int, cy int, chunk int, rep long"


def _promising(reach: int):
    """mapInArrow function: cells to their rows that have a partner whose sketch is near. Vectors only travel for these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        c = {n: table.column(n).to_numpy() for n in table.column_names}
        order = np.lexsort((c["cy"], c["cx"], c["key"], c["slot"]))
        c = {n: v[order] for n, v in c.items()}
        cross, keep = c["cx"] != c["cy"], np.zeros(len(order), dtype=bool)
        s0, s1 = c["s0"].view(np.uint64), c["s1"].view(np.uint64)
        for i, j in pairs_in_runs(run_starts(c["slot"], c["key"], c["cx"], c["cy"])):
            near = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j]) <= reach
            near &= ~cross[i] | (c["chunk"][i] != c["chunk"][j])
            keep[i[near]] = keep[j[near]] = True
        names = [x.split()[0] for x in _CELL.split(", ")]
        yield from pa.Table.from_arrays([pa.array(c[n][keep]) for n in names], names=names).to_batches(1 << 16)

    return run


def _links(threshold: float):
    """mapInArrow function: cells to (a, b, na, links): star links, and per vector the linked vectors it counts here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        c = {n: table.column(n).to_numpy() for n in ("slot", "key", "cx", "cy", "chunk", "rep", "size")}
        vectors = table.column("v").combine_chunks()
        width = vectors.value_lengths().to_numpy()
        order = np.lexsort((width, c["cy"], c["cx"], c["key"], c["slot"]))
        c = {n: v[order] for n, v in c.items()}
        width = width[order]
        cross, bounds = c["cx"] != c["cy"], run_starts(c["slot"], c["key"], c["cx"], c["cy"], width)
        vectors, keys = vectors.take(pa.array(order)), table.column("keys").combine_chunks().take(pa.array(order))
        keys = keys.flatten().to_numpy().reshape(len(order), -1)
        starts = np.concatenate([[0], np.cumsum(width)])
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        count = np.zeros(len(order), dtype=np.int64)
        a, b = [], []
        for i, j in pairs_in_runs(bounds, 1 << 18):
            meet = ~cross[i] | (c["chunk"][i] != c["chunk"][j])
            i, j = i[meet], j[meet]
            if not len(i):
                continue
            # a pair that shares an earlier table's key has been handled there; dense groups thin out after a few tables
            last = int(c["slot"][i].max())
            for t in range(last):
                fresh = (keys[i, t] != keys[j, t]) | (c["slot"][i] <= t)
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            at = np.flatnonzero(np.append(True, width[i[1:]] != width[i[:-1]]))  # runs hold vectors of one width
            dots = np.concatenate([_cosines(flat, starts, x, y, width[x[0]]) for x, y in zip(np.split(i, at[1:]), np.split(j, at[1:]))])
            near = dots >= threshold
            i, j = i[near], j[near]
            a.append(i), b.append(j)
            np.add.at(count, i, c["size"][j])
            np.add.at(count, j, c["size"][i])
        if not a:
            return
        reps, node = np.unique(c["rep"], return_inverse=True)
        root = local_roots(len(reps), node[np.concatenate(a)], node[np.concatenate(b)])
        total = np.zeros(len(reps), dtype=np.int64)
        np.add.at(total, node, count)
        out = np.flatnonzero((root != np.arange(len(reps))) | (total > 0))
        yield pa.RecordBatch.from_arrays([pa.array(reps[out]), pa.array(reps[root[out]]), pa.array(total[out])], names=["a", "b", "links"])

    return run


def _cosines(flat: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    reach = np.arange(width)
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x = flat[starts[nodes][:, None] + reach]
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.einsum("ij,ij->i", x[at[: len(i)]], x[at[len(i) :]])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, width: float = 1.2, miss: float = 1e-3) -> DataFrame:
    """(id_col, n_links, component_id, kept): a row per row of vectors."""
    spark = vectors.sparkSession
    v = F.col(vector)
    finite = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # scaled by the largest component, so that no square overflows; -0.0 becomes 0.0
    wide = F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0))
    scaled = F.transform(wide, lambda x: x / F.array_max(F.transform(wide, F.abs)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(finite, scaled).alias("v"))
    rows = rows.withColumn("_h", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v"), 256)))
    rows = materialize(rows, "vectors")
    reps = rows.where("_h is not null").groupBy("_h").agg(F.min("id").alias("rep0"), F.first("v").alias("v"), F.count(F.lit(1)).alias("size"))
    # nodes of the search are hashes of vectors, since a class of null ids has no id to go by
    reps = materialize(reps.withColumn("rep", F.xxhash64("_h")), "reps")
    hashes, tables = plan_tables(reps.count(), threshold, width, miss)
    keyed = materialize(reps.select("rep", "v").mapInArrow(_hashed(tables, hashes, width), "rep long, keys array<long>, s0 long, s1 long"), "keys")
    slots = keyed.select("rep", "s0", "s1", F.posexplode("keys").alias("slot", "key"))
    cells = bucket_cells(slots, ["slot", "key"], "rep", CELL_CAP)
    n = partitions(spark)
    cells = cells.repartition(n, "slot", "key", "cx", "cy").mapInArrow(_promising(sketch_reach(threshold)), _CELL)
    full = cells.join(keyed.select("rep", "keys"), "rep").join(reps.select("rep", "v", "size"), "rep").repartition(n, "slot", "key", "cx", "cy")
    found = materialize(full.mapInArrow(_links(threshold), "a long, b long, links long"), "links")
    names = reps.select("rep", "rep0")
    # components are named by the smallest id: links between nodes, then the least id of each component
    roots = connected_components(found.where("a <> b"))
    named = names.join(roots, names["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("rep0").alias("component_id"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    classes = named.join(least, "root").join(links, "rep", "left").select("rep", "component_id", F.coalesce("more", F.lit(0)).alias("more"))
    classes = reps.select("rep", "_h", "size").join(classes, "rep").select("_h", "component_id", (F.col("more") + F.col("size") - 1).alias("n_links"))
    out = rows.select("id", "_h").join(classes, "_h", "left")
    component = F.when(F.col("_h").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
