"""SimHash near-duplicate detection with pigeonring filtering.

A text's fingerprint is the bitwise majority of the XXH64 of its word shingles. Fingerprints that differ in at most
`radius` bits link; documents of a connected component are one group.

Candidates come from pigeonring chains: the 64 bits are cut into `segments` consecutive segments on a ring. If two
fingerprints differ in at most r bits, some start i exists from which every chain of l consecutive segments differs in at
most floor(l * r / segments) bits. The first `key_segments` of the chain make the bucket key (all patterns that the budgets
allow are probed), the rest of the chain prunes the bucket's pairs, and only what is left gets the full Hamming check.
The filter is exact: no link is lost.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and links like any other; fewer words
than a shingle make one shingle of all words; equal rows and repeated ids each get their row; a null id joins its group
but never names it (a group of null ids only has a null component); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_cells, connected_components, local_roots, materialize, own_prefix, pairs_in_runs, partitions, run_starts

SEED = 42
#: Members of a bucket from which on it is cut into a grid of cells.
CELL_CAP = 2048
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of one text given in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist())
    return majority(np.fromiter((digest(flat[s:e], SEED) for s, e in spans), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, _SLICE):
        part = hashes[i : i + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "_fp") -> DataFrame:
    """docs without its text, with the fingerprint as a signed long in column name."""
    rest, body = [c for c in docs.columns if c not in (text, name)], own_prefix(docs) + "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(body)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(values.view(np.int64))], names=[*rest, name])

    source = docs.select(*rest, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(body))
    schema = docs.select(*rest).schema.add(name, "long")
    return source.mapInArrow(run, schema)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def budgets(radius: int, segments: int) -> list[int]:
    """Most differences of a chain of 1, 2, ... segments."""
    return [length * radius // segments for length in range(1, segments + 1)]


def probe_masks(radius: int, segments: int, start: int, key_segments: int) -> list[int]:
    """Every difference pattern that the key's segments can show within the chain's budgets."""
    bounds, allowed = segment_bounds(segments), budgets(radius, segments)
    masks = [(0, 0)]
    for step in range(key_segments):
        low, width = bounds[(start + step) % segments]
        grown = []
        for mask, used in masks:
            for more in range(allowed[step] - used + 1):
                grown += [(mask | sum(1 << (low + x) for x in bits), used + more) for bits in combinations(range(width), more)]
        masks = grown
    return sorted(m for m, _ in masks)


def _key_mask(segments: int, start: int, key_segments: int) -> int:
    bounds = segment_bounds(segments)
    return sum(((1 << width) - 1) << low for low, width in (bounds[(start + s) % segments] for s in range(key_segments)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_rows(reps: DataFrame, radius: int, segments: int, key_segments: int) -> DataFrame:
    """(slot, key, exact, fp, rep): a row per start on the ring and admissible pattern. exact: the row is unprobed."""
    masks = [(start, _signed(_key_mask(segments, start, key_segments)), [_signed(m) for m in probe_masks(radius, segments, start, key_segments)]) for start in range(segments)]
    slots = F.array(*(F.struct(F.lit(s).cast("int").alias("slot"), F.lit(k).alias("mask"), F.lit(m).alias("flip")) for s, k, flips in masks for m in flips))
    rows = reps.select("fp", "rep", F.explode(slots).alias("s"))
    return rows.select(F.col("s.slot").alias("slot"), F.col("fp").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip")).alias("key"), (F.col("s.flip") == 0).alias("exact"), "fp", "rep")


def chain_links(radius: int, segments: int):
    """mapInArrow function: cells of buckets to star links (a, b) of representatives whose fingerprints link."""
    bounds, allowed = segment_bounds(segments), budgets(radius, segments)
    masks = np.array([((1 << w) - 1) << low for low, w in bounds], dtype=np.uint64)

    def within(difference: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which pairs pass the chain that starts at their slot."""
        alive = np.arange(len(difference))
        used = np.zeros(len(difference), dtype=np.int64)
        for step in range(segments):
            d, s = difference[alive], slot[alive]
            used = used + np.bitwise_count(d & masks[(s + step) % segments])
            ok = used <= allowed[step]
            alive, used = alive[ok], used[ok]
        return alive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        c = {n: table.column(n).to_numpy() for n in ("slot", "key", "cx", "cy", "chunk", "rep", "fp", "exact")}
        order = np.lexsort((c["cy"], c["cx"], c["key"], c["slot"]))
        c = {n: v[order] for n, v in c.items()}
        fp, cross = c["fp"].view(np.uint64), c["cx"] != c["cy"]
        a, b = [], []
        for i, j in pairs_in_runs(run_starts(c["slot"], c["key"], c["cx"], c["cy"])):
            meet = (c["exact"][i] | c["exact"][j]) & (~cross[i] | (c["chunk"][i] != c["chunk"][j]))
            i, j = i[meet], j[meet]
            keep = within(fp[i] ^ fp[j], c["slot"][i])
            a.append(i[keep]), b.append(j[keep])
        if not a:
            return
        # nodes by representative: the smallest of a local component stands for its links
        reps, node = np.unique(c["rep"], return_inverse=True)
        root = local_roots(len(reps), node[np.concatenate(a)], node[np.concatenate(b)])
        moved = np.flatnonzero(root != np.arange(len(reps)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(reps[moved]), pa.array(reps[root[moved]])], names=["a", "b"])

    return run


def linked_fingerprints(fps: DataFrame, radius: int = 2, segments: int = 5, key_segments: int = 2) -> DataFrame:
    """(fp, root): distinct fingerprints that differ in radius or fewer bits from another one, with the least of their component."""
    if radius < 0 or segments <= radius or not 0 < key_segments <= segments:
        raise ValueError("segments must exceed radius, and key_segments be 1..segments")
    cells = bucket_cells(bucket_rows(fps.withColumn("rep", F.col("fp")), radius, segments, key_segments), ["slot", "key"], "fp", CELL_CAP)
    links = cells.repartition(partitions(fps.sparkSession), "slot", "key", "cx", "cy").mapInArrow(chain_links(radius, segments), "a long, b long")
    return connected_components(links).withColumnRenamed("node", "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, segments: int = 5, key_segments: int = 2) -> DataFrame:
    """(id_col, fp long, component_id long): a row per document. Fingerprints link at radius or fewer differing bits.

    Equal fingerprints collapse before the search, so copies cost a partial minimum; only distinct fingerprints meet.
    """
    rows = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), shingle=shingle, name="fp"), "fp")
    # a fingerprint is its own node, so that those of null ids link too; the least id names a component afterwards
    roots = linked_fingerprints(rows.select("fp").distinct(), radius, segments, key_segments)
    reps = rows.groupBy("fp").agg(F.min("id").alias("rep")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = reps.join(named, "root").select("fp", "component_id")
    return rows.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(column) -> "F.Column":
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that are not the first of their group; rows that repeat an id stay or go together, null ids stay."""
    own = own_prefix(docs) + "gone"
    gone = components.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(own)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(own), "left_anti")
