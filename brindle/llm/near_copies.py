"""Groups of near copies: texts whose sets of word shingles have a Jaccard similarity of 4/5 or more, and what these link.

SimHash comes first: the groups that pigeonring chains find among the fingerprints of the sets (simhash.linked_fingerprints,
at a small radius, where unrelated texts hardly ever meet) are links to be, each of which is verified on the whole sets. What
lies further apart, which no fingerprint radius finds without drowning in chance pairs, is completed by an exact join: with
all sets in one global order, two similar sets of sizes n and m share one of the first n - ceil(4n/5) + 1 of the one and as
many of the other. Any order is right; the shingles of a bounded sample go last, the most frequent at the very end, so that
common passages make few candidates. Only pairs of different groups are looked at: each member of a bucket with the bucket's
least node; where groups still differ in a bucket, each member with the nearest one of another group by their sketches, which
joins what a large group consists of by no more pairs than it has rows; and where they differ then, all pairs that pass.

No pair is missed, and no pair links unverified (on sets of 64-bit shingle hashes). Before whole sets travel, a pair must pass
its sketches: counts of members by SLOTS hash slots, modulo 16, whose differences add up to no more than the sets' difference,
which is at most (n + m) / 9 for similar sets. Buckets are looked at in a grid of cells, whose rows carry the sketches, so that
only pairs that pass leave a cell; before their texts travel, these must pass wider sketches, which have about a slot for each
member. What is asked of a text is asked where it lies: a bitmap of the nodes of all pairs goes there, not the texts to the pairs.

Defined cases: a null text counts as empty; texts without words are one group; fewer words than a shingle make one shingle of
all words; a null id joins its group and never names it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bucket_cells, connected_components, free_shuffles, materialize, mix64, pairs_in_runs, partitions, prefix_hashes, run_starts, span_hashes, text_blocks, word_bounds
from .simhash import linked_fingerprints, majority

SEED = 42
SLOTS = 256
#: Slots of the wide sketches at least and at most (powers of two).
WIDE_SLOTS = 512, 8192
#: Bits of the bitmap of nodes that are asked for; where nodes fill it, more texts than needed pass, and none is missed.
ASKED_BITS = 1 << 25
CELL_CAP = 2048
#: Members of sets that a task keeps at hand.
HELD = 1 << 21
#: Pairs whose sketches are compared at once.
COMPARED = 1 << 16
SAMPLE_DOCS, COMMON = 4000, 1 << 16


def block_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = 5) -> Iterator[np.ndarray]:
    """For each text of a block the sorted hashes of its word shingles: each hashes the hashes of its words, in order."""
    starts, ends, first = word_bounds(data, offsets)
    words = span_hashes(prefix_hashes(LOWER[data]), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    whole = max(0, len(words) - shingle + 1)
    total = np.zeros(whole, dtype=np.uint64)
    for j in range(shingle):
        total += words[j : j + whole] * _WEIGHTS[j % len(_WEIGHTS)] ** np.uint64(j // len(_WEIGHTS) + 1)
    hashes = mix64(total + np.uint64(shingle))
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        k = min(shingle, z - a)
        if k == shingle:
            s = np.sort(hashes[a : z - k + 1])
            yield s[run_starts(s)[:-1]]
        elif k:
            part = sum(int(words[a + j]) * int(_WEIGHTS[j % len(_WEIGHTS)]) ** (j // len(_WEIGHTS) + 1) for j in range(k)) + k
            yield mix64(np.array([part & (2**64 - 1)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


_WEIGHTS = np.random.default_rng(42).integers(0, 2**64, size=16, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a text's word shingles."""
    return next(block_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shingle))


def similar(both, n, m):
    """Whether sets of n and m members that share both of them have a Jaccard similarity of 4/5 or more."""
    return 9 * both >= 4 * (n + m)


def slot_counts(s: np.ndarray) -> np.ndarray:
    """Members of a set by hash slot, modulo 16."""
    return (np.bincount((s >> np.uint64(20)).astype(np.int64) % SLOTS, minlength=SLOTS) & 15).astype(np.uint8)


def sketch(s: np.ndarray) -> bytes:
    """The slot counts of a set, two to a byte."""
    c = slot_counts(s)
    return (c[::2] | c[1::2] << 4).tobytes()


def unpacked_sketches(column: pa.Array) -> np.ndarray:
    """A column of sketches to a row of slot counts each."""
    packed = np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8).reshape(-1, SLOTS // 2)
    out = np.empty((len(packed), SLOTS), dtype=np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def least_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the sets of two arrays of slot counts differ in at least."""
    d = (x - y) & 15
    return np.minimum(d, 16 - d).sum(axis=-1, dtype=np.int64)


def wide_sketch(s: np.ndarray) -> bytes:
    """Members of a set by hash slot, modulo 4 and four to a byte; as many slots as members, within WIDE_SLOTS."""
    slots = min(max(WIDE_SLOTS[0], 1 << (len(s) - 1).bit_length()), WIDE_SLOTS[1])
    c = np.bincount((s >> np.uint64(20)).astype(np.int64) & (slots - 1), minlength=slots).astype(np.uint8) & 3
    return (c[::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6).tobytes()


def wide_difference(x: bytes, y: bytes) -> int:
    """What the sets of two wide sketches differ in at least. The longer sketch is folded to the slots of the shorter one."""
    counts = []
    for v in (x, y):
        packed = np.frombuffer(v, np.uint8)
        c = np.stack([packed >> k & 3 for k in (0, 2, 4, 6)], axis=1).ravel()
        counts.append(c.reshape(-1, 4 * min(len(x), len(y))).sum(axis=0, dtype=np.uint8))
    d = (counts[0] - counts[1]) & 3
    return int(np.minimum(d, 4 - d).sum(dtype=np.int64))


_SETS = (("node", "long"), ("n", "integer"), ("fp", "long"), ("sketch", "binary"), ("prefix", "binary"), ("text", "binary"))


def _sets(shingle: int, common: np.ndarray):
    """mapInArrow function: (id, text) with the set's name, size, fingerprint, sketch and prefix; the set itself can be had from the text."""
    known = np.argsort(common)
    table = common[known]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def one(s: np.ndarray) -> tuple:
        n = len(s)
        m = n - (4 * n + 4) // 5 + 1
        first = s
        if len(table):
            at = np.minimum(np.searchsorted(table, s), len(table) - 1)
            hit = table[at] == s
            if hit.any():
                late = s[hit]
                first = np.concatenate([s[~hit], late[np.argsort(known[at[hit]])]])
        node = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), SEED)).view(np.int64))
        return node, n, int(np.uint64(majority(s)).view(np.int64)), sketch(s), first[:m].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in text_blocks(batches, "text"):
            columns = zip(*(one(s) for s in block_sets(data, offsets, shingle)))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(columns, types)), b.column("text")], names=["id", *(name for name, _ in _SETS)])

    return run


def _sample(source: DataFrame) -> DataFrame:
    """About SAMPLE_DOCS texts from all over the table: a limit would first bring as many of each partition to one task."""
    return source.select("text").sample(min(1.0, SAMPLE_DOCS / max(1, source.count())), SEED).where(F.length("text") < 200_000)


def _common(source: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that several texts of a sample have, the most frequent last. They only decide the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_blocks(batches, "text"):
            s, c = np.unique(np.concatenate(list(block_sets(data, offsets, shingle))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c)], names=["s", "c"])

    got = _sample(source).mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    got = got.where("c > 1").orderBy(F.desc("c"), "s").limit(COMMON).toArrow().column("s").to_numpy()
    return got.view(np.uint64)[::-1]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to a row (s, node, n) for each member of their prefixes; equal sets of a batch give one."""
    for b in batches:
        seen, out, size = set(), [], 0
        for node, n, prefix in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), b.column("prefix")):
            if node in seen:
                continue
            seen.add(node)
            first = np.frombuffer(prefix.as_buffer(), "<i8")
            out.append((first, np.full(len(first), node), np.full(len(first), n, dtype=np.int32)))
            size += len(first)
            if size > 1 << 16:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    s, node, n = (np.concatenate(c) for c in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(s), pa.array(node), pa.array(n)], names=["s", "node", "n"])


def _close(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of such sizes can be similar."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of s and node to those of buckets of two nodes or more, with the least node (hub) and whether the sizes fit it.

    A bucket may go over any number of batches: of the open one the hub and the last row are carried on.
    """
    carried = None  # rows that stand before the next batch, and whether they have been given
    for b in batches:
        c = {k: b.column(k).to_numpy() for k in ("s", "node", "n")}
        given = np.zeros(b.num_rows, dtype=bool)
        if carried is not None:
            c = {k: np.concatenate([carried[0][k], v]) for k, v in c.items()}
            given = np.concatenate([carried[1], given])
        keep = run_starts(c["s"], c["node"])[:-1]
        c, given = {k: v[keep] for k, v in c.items()}, given[keep]
        if not len(given):
            continue
        runs = run_starts(c["s"])
        size = np.diff(runs)
        hub = np.repeat(runs[:-1], size)
        many = np.repeat(size, size) > 1
        rows = np.flatnonzero(many & ~given)
        if len(rows):
            met = _close(c["n"][hub[rows]], c["n"][rows]) & (rows != hub[rows])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[k][rows]) for k in ("s", "node", "n")), pa.array(c["node"][hub[rows]]), pa.array(met)], names=["s", "node", "n", "hub", "met"])
        last = np.unique([runs[-2], len(given) - 1])
        carried = {k: v[last] for k, v in c.items()}, np.full(len(last), size[-1] > 1)


def _cross_pairs(nearest: bool):
    """mapInArrow function: cells of buckets to pairs (a, b) of nodes of different groups whose sketches pass, without those of
    the hub. nearest: of each row only the pair of the least difference, so that there are no more pairs than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(batches)
        c = {k: table.column(k).to_numpy() for k in table.column_names if k != "sketch"}
        order = np.lexsort((c["cy"], c["cx"], c["s"]))
        c = {k: v[order] for k, v in c.items()}
        slots = unpacked_sketches(table.column("sketch"))[order]
        odd = np.packbits(slots & 1, axis=1).view(np.uint64)
        n = c["n"].astype(np.int64)
        best, mate = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), dtype=np.int64)

        def pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            a, b = c["node"][i], c["node"][j]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for i, j in pairs_in_runs(run_starts(c["s"], c["cx"], c["cy"])):
            meet = (c["root"][i] != c["root"][j]) & ((c["cx"][i] == c["cy"][i]) | (c["chunk"][i] != c["chunk"][j])) & (c["node"][i] != c["hub"][i]) & (c["node"][j] != c["hub"][j])
            i, j = i[meet], j[meet]
            close = _close(n[i], n[j])
            i, j = i[close], j[close]
            apart = sum(np.bitwise_count(odd[i, k] ^ odd[j, k]).astype(np.int64) for k in range(odd.shape[1]))
            keep = 9 * apart <= n[i] + n[j]
            i, j = i[keep], j[keep]
            cuts = [slice(k, k + COMPARED) for k in range(0, len(i), COMPARED)]
            apart = np.concatenate([np.zeros(0, dtype=np.int64), *(least_difference(slots[i[k]], slots[j[k]]) for k in cuts)])
            keep = 9 * apart <= n[i] + n[j]
            i, j, apart = i[keep], j[keep], apart[keep]
            if nearest:
                row, other, apart = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart])
                by = np.lexsort((c["node"][other], apart, row))
                by = by[run_starts(row[by])[:-1]]
                by = by[apart[by] < best[row[by]]]
                best[row[by]], mate[row[by]] = apart[by], other[by]
            elif len(i):
                yield pairs(i, j)
        some = np.flatnonzero(best < np.iinfo(np.int64).max)
        if len(some):
            yield pairs(some, mate[some])

    return run


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and sketches of both to those that may be similar."""
    for b in batches:
        n, m = b.column("xn").to_numpy(), b.column("yn").to_numpy()
        x, y = (unpacked_sketches(b.column(k)) for k in ("x", "y"))
        yield b.select(["a", "b"]).filter(pa.array(_close(n, m) & (9 * least_difference(x, y) <= n.astype(np.int64) + m)))


def _wide_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and wide sketches of both to those that may be similar."""
    for b in batches:
        apart = [wide_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("x"), b.column("y"))]
        most = b.column("xn").to_numpy().astype(np.int64) + b.column("yn").to_numpy()
        yield b.select(["a", "b"]).filter(pa.array(9 * np.array(apart, dtype=np.int64) <= most))


def _verified(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        members = 0

        def of(node: int, value: pa.Scalar) -> np.ndarray:
            """The set of a node; a node often comes again soon."""
            nonlocal members
            if node not in held:
                if members > HELD:
                    held.clear()
                    members = 0
                held[node] = shingle_set(_unpacked(value), shingle)
                members += len(held[node])
            return held[node]

        for b in batches:
            keep = []
            for i, j, tx, ty in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("x"), b.column("y")):
                x, y = of(i, tx), of(j, ty)
                keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """The nodes of the pairs as bits, at their values modulo ASKED_BITS."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    words = nodes.select(F.expr(f"cast((node & {ASKED_BITS - 1}) >> 5 as int)").alias("w"), F.expr("shiftleft(1L, cast(node & 31 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(ASKED_BITS // 32, dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _asked(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of nodes of the bitmap; equal sets of a batch give one."""
    for b in batches:
        at = b.column("node").to_numpy() & (ASKED_BITS - 1)
        hit = np.flatnonzero(bitmap[at >> 5] >> (at & 31).astype(np.uint32) & 1)
        if len(hit):
            _, first = np.unique(b.column("node").to_numpy()[hit], return_index=True)
            yield b.take(pa.array(hit[np.sort(first)]))


def _facts(bitmap: np.ndarray):
    """mapInArrow function: (node, n, sketch) of those that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _asked(batches, bitmap)

    return run


def _wide_facts(bitmap: np.ndarray, shingle: int):
    """mapInArrow function: (node, text) to (node, n, sketch) of those that are asked for, with wide sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in text_blocks(_asked(batches, bitmap)):
            n, wide = zip(*((len(s), wide_sketch(s)) for s in block_sets(data, offsets, shingle)))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int32()), pa.array(wide, pa.binary())], names=["node", "n", "sketch"])

    return run


def _packed(bitmap: np.ndarray):
    """mapInArrow function: (node, text) to (node, z) of those that are asked for: texts compressed, behind their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _asked(batches, bitmap):
            z = [len(t.as_buffer()).to_bytes(8, "little") + pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(z, pa.binary())], names=["node", "z"])

    return run


def _unpacked(value: pa.Scalar) -> bytes:
    raw = value.as_buffer()
    return pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), codec="zstd", asbytes=True)


def _two(pairs: DataFrame, facts: DataFrame, **columns: str) -> DataFrame:
    """pairs with columns of facts for a (named x...) and for b (named y...)."""
    for side, v in (("a", "x"), ("b", "y")):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *(F.col(c).alias(v + end) for end, c in columns.items())), side)
    return pairs


def _links(pairs: DataFrame, sets: DataFrame, shingle: int, passed: bool = False) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar. passed: their sketches have been compared."""
    left = materialize(pairs.distinct(), "pairs")
    texts, bitmap = sets.select("node", "text"), _bitmap(left)
    if passed:
        facts, passes = texts.mapInArrow(_wide_facts(bitmap, shingle), "node long, n int, sketch binary"), _wide_passes
    else:
        facts, passes = sets.select("node", "n", "sketch").mapInArrow(_facts(bitmap), "node long, n int, sketch binary"), _passes
    facts = facts.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    left = materialize(_two(left, facts, n="n", **{"": "sketch"}).mapInArrow(passes, "a long, b long"), "passes")
    # packed before the only shuffle of texts: both joins meet them as they are grouped
    texts = texts.mapInArrow(_packed(_bitmap(left)), "node long, z binary").groupBy("node").agg(F.first("z").alias("z"))
    out = materialize(_two(left, texts, **{"": "z"}).select("a", "b", "x", "y").mapInArrow(_verified(shingle), "a long, b long"), "links")
    free_shuffles(pairs.sparkSession)
    return out


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are of different groups."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias("r" + side)), side, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _different(buckets: DataFrame) -> DataFrame:
    """The rows of buckets of three nodes or more, one bucket for each set of nodes: all shingles of a passage have the same."""
    nodes = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_h{k}") for k in (1, 2)]
    heads = buckets.groupBy("s").agg(F.count(F.lit(1)).alias("_size"), *nodes).where("_size > 2").groupBy("_size", "_h1", "_h2").agg(F.min("s").alias("s"))
    return buckets.select("s", "node", "n", "hub").join(heads.select("s"), "s", "left_semi")


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(id_col, component_id): a row per document; the component is named by its least id."""
    n = partitions(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    schema = source.select("id").schema
    for name, kind in _SETS:
        schema = schema.add(name, kind)
    sets = materialize(source.mapInArrow(_sets(shingle, _common(source, shingle)), schema), "sets", compression="zstd")
    # groups of fingerprints: each set with the least of its group
    nodes = sets.where("n > 0").select("node", "fp").distinct()
    grouped = nodes.join(linked_fingerprints(nodes.select("fp").distinct()), "fp", "left").select("node", F.coalesce("root", "fp").alias("g"))
    hubs = grouped.groupBy("g").agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a < _z").select("g", "a")
    links = _links(grouped.join(hubs, "g").where("a < node").select("a", F.col("node").alias("b")), sets, shingle)
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))  # stars: a set is in one group
    # the others, by the prefix filter
    prefixes = sets.where("n > 0").select("node", "n", "prefix").mapInArrow(_prefixes, "s long, node long, n int")
    buckets = materialize(prefixes.repartition(n, "s").sortWithinPartitions("s", "node").mapInArrow(_buckets, "s long, node long, n int, hub long, met boolean"), "buckets")
    pairs = buckets.where("met").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = links.union(_links(_rooted(pairs, roots), sets, shingle))
    buckets = materialize(_different(buckets), "different")
    sketches = sets.groupBy("node").agg(F.first("sketch").alias("sketch"))
    for nearest in (True, False):
        roots = connected_components(links)
        rows = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rows.groupBy("s").agg((F.min("root") < F.max("root")).alias("_mixed")).where("_mixed").select("s")
        cells = bucket_cells(rows.join(mixed, "s", "left_semi"), ["s"], "node", CELL_CAP).join(sketches, "node")
        pairs = cells.repartition(n, "s", "cx", "cy").mapInArrow(_cross_pairs(nearest), "a long, b long")
        links = links.union(_links(pairs, sets, shingle, passed=True))
    roots = connected_components(links)
    ids = sets.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    return ids.join(least, "root").select(F.col("id").alias(id_col), "component_id")
