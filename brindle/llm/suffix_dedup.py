"""Removal of repeated byte strings by suffix arrays and longest-previous-factor (LPF) arrays.

A byte goes if it lies in a string of `length` bytes (50) that also starts in a document with a smaller id. In suffix
order, the earlier places that share the longest prefix with a position are its previous and next smaller ones (PSV, NSV)
by document order; LPF is the longer of the two matches, and a window is repeated if LPF >= length.

One suffix array over the whole corpus would not be distributed, so the suffixes that can match are brought together first:

1. Equal texts collapse to the one with the smallest id; the others are repeated as a whole.
2. Every window of `length` bytes has a minimizer: the k-mer with the least hash in it. Equal windows have equal minimizers
   at equal offsets, so a window can only be repeated if its minimizer occurs in two documents. Minimizers are counted by
   hash in packed blocks, after a local pass that keeps one entry a block (a passage of a third of all documents costs one
   entry a block).
3. Around each shared minimizer a segment (all windows that hold it) goes to the bucket of the k-mer. A bucket's distinct
   segments get a suffix array (prefix doubling to depth `length`), its lcp values and its LPF array by the time of a
   segment's first document: a window of that document is repeated if LPF >= length. In any later document, the whole segment
   is. Each occurrence comes back with the set of its repeated windows.

Hashes only choose what meets; what is removed has been compared byte by byte by the suffix array. Texts travel compressed, are shuffled
once (by content, into a bucketed table in the shared folder) and then stay.

Defined cases: a null text is empty; texts shorter than `length` keep all; a null id comes after all others and is never
earlier than anything; rows that share an id never remove each other's bytes; equal rows get equal results; an empty table
gives an empty result. remove_repeats() drops bytes of a character that a cut has split.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folders, materialize, mix64, new_folder, own_prefix, partitions, run_starts

LENGTH = 50
KMER = 16
REACH = LENGTH - KMER  # a window that holds the k-mer begins this many bytes before it at most
SEGMENT = REACH + LENGTH
HALF = REACH // 2
NULL_ID = 2**63 - 1
BLOCK = 1 << 21
BUCKET_BYTES = 1 << 20
#: Distinct segments of a numpy pass over a bucket's suffixes.
CHUNK = 12_000
#: Segments that are cut out of texts at once.
SPOTS = 1 << 14
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# -- suffix arrays ----------------------------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    rank = np.zeros(len(keys), dtype=np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]).astype(np.uint64) if len(keys) else []
    return rank


def prefix_ranks(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rank of every suffix among the suffixes by their first depth bytes (all bytes if None); equal prefixes share a rank."""
    n = len(data)
    rank, known = _dense(data.astype(np.uint64)) + np.uint64(1), 1
    while known < (n if depth is None else min(depth, n)):
        step = known if depth is None else min(known, depth - known)
        after = np.zeros(n, dtype=np.uint64)  # past the end: before everything
        after[: n - step] = rank[step:]
        rank = _dense((rank << np.uint64(32)) | after) + np.uint64(1)
        known += step
    return rank


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    return np.argsort(prefix_ranks(data, depth), kind="stable")


def lpf_array(lcp: np.ndarray, time: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix in suffix order: the longest prefix shared with a suffix of smaller time.

    By symmetry of PSV and NSV one pass goes left and one right; in each, a suffix whose neighbour is not earlier jumps to
    that neighbour's own answer, all suffixes at once. Matches under `least` are given as 0, which ends a walk.
    """
    out = np.zeros(len(time), dtype=np.int64)
    for flip in (False, True):
        t = time[::-1] if flip else time
        l = np.concatenate([[0], lcp[1:][::-1]]) if flip else lcp  # noqa: E741
        n = len(t)
        link, reach = np.arange(n) - 1, l.copy()
        link[:1] = 0
        reach[:1] = 0
        reach[reach < least] = 0
        while True:
            late = np.flatnonzero((reach > 0) & (t[link] >= t))
            if not len(late):
                break
            via = link[late]
            reach[late] = np.minimum(reach[late], reach[via])
            link[late] = np.where(reach[late] > 0, link[via], link[late])
        out = np.maximum(out, reach[::-1] if flip else reach)
    return out


# -- minimizers -------------------------------------------------------------------------------


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position (zero past the end), big-endian, as one number."""
    x = np.zeros(len(data) + 8, dtype=np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[:-step] = (x[:-step] << np.uint64(8 * step)) | x[step:]
        x[-step:] = 0
    return x[: len(data)]


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from every position that has as many."""
    w = words8(data)
    n = max(0, len(data) - KMER + 1)
    h = w[:n] * _M1 + w[8 : 8 + n] * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


def minimizers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the minimizers of all windows within documents of a block, in order."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = kmer_hashes(data)
    m = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # ties: the first
    width = 1
    while width < REACH + 1:
        step = min(width, REACH + 1 - width)
        m = np.minimum(m[: len(m) - step], m[step:])
        width += step
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    first, last = offsets[:-1], np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    at = (m[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.cumsum(inside[:n]) > 0]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, mix64(h[at])


# -- steps ------------------------------------------------------------------------------------


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (r1, r2, id, n, z): content key, compressed text."""
    for b in batches:
        keys, sizes, packed = [], [], []
        for value in b.column(1):
            raw = value.as_buffer()
            keys.append(hashlib.sha256(raw).digest()[:16])
            sizes.append(raw.size)
            packed.append(pa.compress(raw, codec="zstd", asbytes=True))
        key = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), b.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["r1", "r2", "id", "n", "z"])


def _number_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds block (the content key of its first text) and start: each text's place in a block of about BLOCK bytes."""
    block, used = 0, BLOCK
    for b in batches:
        blocks, starts = [], []
        for r1, n in zip(b.column("r1").to_pylist(), b.column("n").to_pylist()):
            if used >= BLOCK:
                block, used = r1, 0
            blocks.append(block)
            starts.append(used)
            used += n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.int64()), pa.array(starts, pa.int64())], names=[*b.schema.names, "block", "start"])


def _texts(b: pa.RecordBatch, limit: int = 4 * BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows, decompressed."""
    sizes = b.column("n").to_numpy()
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(total, total[first] + limit, side="right")) - 1)
        z = b.column("z")
        data = b"".join(pa.decompress(z[i].as_buffer(), int(sizes[i]), codec="zstd", asbytes=True) if sizes[i] else b"" for i in range(first, last))
        yield first, last, np.frombuffer(data, dtype=np.uint8), total[first : last + 1] - total[first]
        first = last


def _block_texts(b: pa.RecordBatch, blocks: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What _texts gives, a block at a time: minimizers take some fifty times their text in memory."""
    cuts = run_starts(blocks)
    for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
        for first, last, data, offsets in _texts(b.slice(x, y - x)):
            yield x + first, x + last, data, offsets


def _entries(buckets: int):
    """Texts to (bucket, block, keys, places): a block's distinct minimizer hashes for each bucket; bucket < 0: places known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, starts = b.column("block").to_numpy(), b.column("start").to_numpy()
            for first, last, data, offsets in _block_texts(b, blocks):
                at, h = minimizers(data, offsets)
                doc = np.searchsorted(offsets, at, side="right") - 1 + first
                place = (at - offsets[doc - first] + starts[doc]).astype(np.uint32)
                block = blocks[doc]
                order = np.lexsort((doc, h, block))
                h, doc, place, block = h[order], doc[order], place[order], block[order]
                runs = run_starts(block, h)
                many = np.repeat(doc[runs[1:] - 1] != doc[runs[:-1]], np.diff(runs))
                rows: list[tuple[int, int, bytes, bytes]] = []
                known = np.flatnonzero(many)
                cuts = run_starts(block[known])
                for x, y in zip(cuts, cuts[1:]):
                    rows.append((-1 - int(block[known[x]]) % buckets, int(block[known[x]]), b"", place[known[x:y]].tobytes()))
                # one entry a hash and block; of a hash that is shared within the block, the first stands for all
                keep = np.zeros(len(h), dtype=bool)
                keep[~many] = True
                keep[runs[:-1]] = True
                h, place, block, many = h[keep], place[keep], block[keep], many[keep]
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((bucket, block))
                bucket, block = bucket[order], block[order]
                key = (h[order] // np.uint64(buckets) & ~np.uint64(1)) | many[order]  # lowest bit: shared already
                place = place[order]
                cuts = run_starts(block, bucket)
                short = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :6])  # 47 bits beside the bucket; chance hits only cost time
                for x, y in zip(cuts, cuts[1:]):
                    rows.append((int(bucket[x]), int(block[x]), short[x:y].tobytes(), place[x:y].tobytes()))
                if rows:
                    yield _rows(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), ("bucket", "block", "keys", "places"))

    return run


def _rows(rows: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)], names=list(names))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of their buckets to (block, places): where minimizers stand that occur in two documents."""
    out: list[tuple[int, bytes]] = []
    for rows in _by_bucket(batches):
        if rows[0][0] < 0:
            out += [(r[1], r[3]) for r in rows]
        else:
            counts = np.array([len(r[2]) // 6 for r in rows])
            key = np.zeros((int(counts.sum()), 8), dtype=np.uint8)
            key[:, :6] = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, 6)
            key = key.view("<u8").ravel()
            done = (key & np.uint64(1)).astype(bool)
            place = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32)
            block = np.repeat(np.array([r[1] for r in rows]), counts)
            order = np.argsort(key >> np.uint64(1))
            runs = run_starts(key[order] >> np.uint64(1))
            size = np.diff(runs)
            shared = np.repeat((size > 1) | np.logical_or.reduceat(done[order], runs[:-1]), size)
            found = order[shared & ~done[order]]
            found = found[np.argsort(block[found], kind="stable")]
            cuts = run_starts(block[found])
            out += [(int(block[found[x]]), place[found[x:y]].tobytes()) for x, y in zip(cuts, cuts[1:])]
        while len(out) >= 2000:
            yield _rows(out[:2000], (pa.int64(), pa.binary()), ("block", "places"))
            out = out[2000:]
    if out:
        yield _rows(out, (pa.int64(), pa.binary()), ("block", "places"))


def _to_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(starts, r1s, r2s, places of a block) to (r1, r2, places): places within each document."""
    for b in batches:
        rows = []
        for starts, r1s, r2s, parts in zip(*(b.column(n) for n in ("starts", "r1s", "r2s", "places"))):
            start = starts.values.to_numpy()
            at = np.unique(np.frombuffer(b"".join(p.as_buffer() for p in parts), dtype=np.uint32)).astype(np.int64)
            doc = np.searchsorted(start, at, side="right") - 1
            cuts = run_starts(doc)
            k1, k2 = r1s.values, r2s.values
            for x, y in zip(cuts, cuts[1:]):
                d = int(doc[x])
                rows.append((k1[d].as_py(), k2[d].as_py(), (at[x:y] - start[d]).astype(np.uint32).tobytes()))
        if rows:
            yield _rows(rows, (pa.int64(), pa.int64(), pa.binary()), ("r1", "r2", "places"))


_RECORD = np.dtype([("r1", "<i8"), ("r2", "<i8"), ("id", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1"), ("segment", "u1", (SEGMENT,))])


def _segments(buckets: int):
    """Texts with places to (bucket, records): a segment around each shared minimizer, packed and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.arange(SEGMENT) - REACH
        for b in batches:
            keys = [b.column(n).to_numpy() for n in ("r1", "r2", "id")]
            for first, last, data, offsets in _texts(b):
                spots = [np.frombuffer(b.column("places")[i].as_buffer(), dtype=np.uint32) for i in range(first, last)]
                doc = np.repeat(np.arange(last - first), [len(s) for s in spots])
                at = np.concatenate(spots).astype(np.int64)
                here = at + offsets[doc]
                padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                records = np.zeros(len(at), dtype=_RECORD)
                for name, k in zip(("r1", "r2", "id"), keys):
                    records[name] = k[first + doc]
                records["at"] = at
                records["left"] = np.minimum(at, REACH)
                records["right"] = np.minimum(offsets[doc + 1] - here, LENGTH)
                for x in range(0, len(at), SPOTS):  # the places of all bytes take eight times what they hold
                    part = records[x : x + SPOTS]
                    segment = padded[here[x : x + SPOTS, None] + reach + REACH]
                    segment[(reach < -part["left"][:, None].astype(int)) | (reach >= part["right"][:, None].astype(int))] = 0
                    part["segment"] = segment
                w = np.ascontiguousarray(records["segment"][:, REACH : REACH + KMER]).view(">u8").astype(np.uint64)
                h = mix64(w[:, 0] * _M1 + w[:, 1] * _M2)
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((h, bucket))
                cuts = run_starts(bucket[order])
                rows = [(int(bucket[order[x]]), y - x, pa.compress(records[order[x:y]].tobytes(), codec="zstd", asbytes=True)) for x, y in zip(cuts, cuts[1:])]
                if rows:
                    yield _rows(rows, (pa.int32(), pa.int32(), pa.binary()), ("bucket", "n", "records"))

    return run


def repeated_windows(segment: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(segments, REACH+1) LPF of each window's suffix where it is LENGTH or more, else 0, over distinct segments of whole k-mers.

    first: the least id that holds each segment, which is its suffixes' time. Suffixes stand in order of their first LENGTH
    bytes; suffixes that share these, in order of time.
    """
    out = np.zeros((len(segment), REACH + 1), dtype=np.int64)
    o = np.arange(REACH + 1)
    valid = (o >= REACH - left[:, None].astype(int)) & (o + LENGTH <= REACH + right[:, None].astype(int))
    data = segment.ravel()
    levels = _window_ranks(data)
    who, off = np.nonzero(valid)
    suffix, time = who * SEGMENT + off, first[who]
    order = np.lexsort((time, levels[-1][1][suffix]))
    out[who[order], off[order]] = lpf_array(_window_lcp(data, levels, suffix[order]), time[order], LENGTH)
    return out


def _window_ranks(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(depth, prefix_ranks(data, depth)) of depths that double from eight bytes to LENGTH."""
    levels = [(8, _dense(words8(data)) + np.uint64(1))]
    while levels[-1][0] < LENGTH:
        known, rank = levels[-1]
        step = min(known, LENGTH - known)
        after = np.zeros(len(data), dtype=np.uint64)
        after[: len(data) - step] = rank[step:]
        levels.append((known + step, _dense((rank << np.uint64(32)) | after) + np.uint64(1)))
    return levels


def _window_lcp(data: np.ndarray, levels: list[tuple[int, np.ndarray]], suffix: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it (0 for the first), LENGTH at most: a halving search on the ranks, then bytes."""
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    lcp = np.zeros(len(suffix), dtype=np.int64)
    whole = levels[-1][1][a] == levels[-1][1][b]
    for depth, rank in reversed(levels[:-1]):
        last = len(data) - 1
        same = (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]) & (np.maximum(a, b) <= last)
        lcp[1:][same] += depth
        a, b = a + depth * same, b + depth * same
    differ = np.zeros(len(a), dtype=bool)
    for _ in range(8):  # eight bytes that differ somewhere, or the end
        inside = np.maximum(a, b) < len(data)
        differ |= ~inside
        differ[inside] |= data[a[inside]] != data[b[inside]]
        lcp[1:] += ~differ
        a, b = a + 1, b + 1
    lcp[1:][whole] = LENGTH
    return np.minimum(lcp, LENGTH)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in order of their first column to lists of rows that share it: one bucket is held at a time."""
    rows: list[tuple] = []
    for b in batches:
        for row in zip(b.column(0).to_pylist(), *(b.column(i) for i in range(1, b.num_columns))):
            if rows and rows[0][0] != row[0]:
                yield rows
                rows = []
            rows.append((row[0], *(x.as_py() for x in row[1:])))
    if rows:
        yield rows


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in order of their buckets to (r1, r2, hits): per occurrence, the place of its minimizer and the set of repeated windows."""
    for rows in _by_bucket(batches):
        yield from _resolve_bucket(np.frombuffer(b"".join(pa.decompress(z, n * _RECORD.itemsize, codec="zstd", asbytes=True) for _, n, z in rows), dtype=_RECORD))


def _shares_side(segment: np.ndarray, group: np.ndarray) -> np.ndarray:
    """1 for segments that share the HALF bytes on one side of the k-mer with another segment of their group, else 0."""
    out = np.zeros(len(segment), dtype=np.int64)
    for a in (REACH - HALF, REACH + KMER):
        side = np.zeros((len(segment), -(-HALF // 8) * 8), dtype=np.uint8)
        side[:, :HALF] = segment[:, a : a + HALF]
        h = group.astype(np.uint64)
        for w in side.view("<u8").T:
            h = mix64(h * _M1 + w)
        order = np.argsort(h)
        runs = run_starts(h[order])
        out[order[np.repeat(np.diff(runs) > 1, np.diff(runs))]] = 1
    return out


def _resolve_bucket(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    wide = np.zeros((len(records), 88), dtype=np.uint8)
    wide[:, :SEGMENT] = records["segment"]
    wide[:, 84], wide[:, 85] = records["left"], records["right"]
    words = wide.view("<u8")
    kmer = np.ascontiguousarray(records["segment"][:, REACH : REACH + KMER]).view("<u8")
    order = np.lexsort((*words.T, kmer[:, 1], kmer[:, 0]))
    sorted_words = words[order]
    new = np.append(True, (sorted_words[1:] != sorted_words[:-1]).any(axis=1))
    unique = np.cumsum(new) - 1  # of each record in order
    heads = order[new]
    ids = records["id"][order]
    first = np.minimum.reduceat(ids, np.flatnonzero(new))
    k = kmer[heads]
    groups = run_starts(k[:, 0], k[:, 1])
    size = np.diff(groups)
    lpf = np.zeros((len(heads), REACH + 1), dtype=np.uint8)
    # a window reaches HALF bytes to the left of the k-mer or to the right of it: segments that share neither side with
    # another one of their k-mer only share the k-mer, and no window
    maybe = _shares_side(records["segment"][heads], np.repeat(np.arange(len(size)), size))
    busy = np.flatnonzero(np.add.reduceat(maybe, groups[:-1]) > 1)
    i = 0
    while i < len(busy):  # whole k-mers, about CHUNK segments at a time
        j, total = i, 0
        while j < len(busy) and (j == i or total + size[busy[j]] <= CHUNK):
            total += size[busy[j]]
            j += 1
        rows = np.concatenate([np.arange(groups[g], groups[g + 1]) for g in busy[i:j]])
        rows = rows[maybe[rows] > 0]
        some = records[heads[rows]]
        lpf[rows] = repeated_windows(np.ascontiguousarray(some["segment"]), some["left"], some["right"], first[rows])
        i = j
    o = np.arange(REACH + 1)
    for x in range(0, len(order), 1 << 18):
        part = order[x : x + (1 << 18)]
        rec = records[part]
        valid = (o >= REACH - rec["left"][:, None].astype(int)) & (o + LENGTH <= REACH + rec["right"][:, None].astype(int))
        which = unique[x : x + len(part)]
        # all of a segment that an earlier document holds is repeated; else what LPF says
        hit = valid & ((first[which] < rec["id"])[:, None] | (lpf[which] >= LENGTH))
        some = hit.any(axis=1)
        if not some.any():
            continue
        rec, mask = rec[some], (hit[some].astype(np.uint64) << o.astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        by = np.lexsort((rec["at"], rec["r2"], rec["r1"]))
        rec, mask = rec[by], mask[by]
        out = np.zeros(len(rec), dtype=_HIT)
        out["at"], out["mask"] = rec["at"], mask
        cuts = run_starts(rec["r1"], rec["r2"])
        rows = [(int(rec["r1"][a]), int(rec["r2"][a]), out[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield _rows(rows, (pa.int64(), pa.int64(), pa.binary()), ("r1", "r2", "hits"))


_HIT = np.dtype([("at", "<u4"), ("mask", "<u8")])


def removed_bytes(n: int, hits: bytes) -> np.ndarray:
    """Which of n bytes the hits of a document cover."""
    h = np.frombuffer(hits, dtype=_HIT)
    who, off = np.nonzero((h["mask"][:, None] >> np.arange(REACH + 1, dtype=np.uint64)) & np.uint64(1))
    start = h["at"][who].astype(np.int64) - REACH + off
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + LENGTH, -1)
    return np.cumsum(change[:n]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r1, r2, n, z, hits) to what is removed and the digest and text of what stays."""
    for b in batches:
        rows = []
        for first, last, data, offsets in _texts(b):
            for i in range(first, last):
                text = data[offsets[i - first] : offsets[i - first + 1]]
                gone = removed_bytes(len(text), b"".join(h.as_buffer() for h in b.column("hits")[i]))
                starts, ends = spans(gone)
                rows.append((b.column("r1")[i].as_py(), b.column("r2")[i].as_py(), int(gone.sum()), hashlib.sha256(text[~gone].tobytes()).hexdigest(), starts.tolist(), ends.tolist()))
        if rows:
            yield _rows(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), ("r1", "r2", "n_removed", "kept_sha256", "starts", "ends"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts). rows: a row per row of docs (id, r1, r2, n_bytes, sha, first): content key, and the least id with that
    content. cuts: (r1, r2, n_removed, kept_sha256, starts, ends) for each content of which the first document loses bytes."""
    spark = docs.sparkSession
    n = partitions(spark)
    size = int(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # an estimate by file sizes
    buckets = max(4 * n, min(1 << 20, (size if size < 1 << 60 else 0) // BUCKET_BYTES))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(id_col).isNull().alias("nameless"), body.alias("text"))
    packed = rows.select("id", "text").mapInArrow(_pack_texts, "r1 long, r2 long, id long, n long, z binary")
    texts = packed.groupBy("r1", "r2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("z").alias("z"))
    texts = texts.mapInArrow(_number_blocks, "r1 long, r2 long, id long, n long, z binary, block long, start long")
    name = f"brindle_texts_{uuid.uuid4().hex}"
    folder = new_folder(spark, "texts")
    texts.write.bucketBy(n, "r1", "r2").format("parquet").option("compression", "none").option("path", folder).saveAsTable(name)
    texts = spark.table(name)
    entries = texts.mapInArrow(_entries(buckets), "bucket int, block long, keys binary, places binary")
    shared = entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "block long, places binary")
    shared = shared.groupBy("block").agg(F.collect_list("places").alias("places"))
    where = texts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("start", F.col("n"), "r1", "r2"))).alias("d"))
    where = where.withColumn("d", F.filter("d", lambda x: x["n"] > 0)).select("block", F.col("d.start").alias("starts"), F.col("d.r1").alias("r1s"), F.col("d.r2").alias("r2s"))
    places = materialize(shared.join(where, "block").mapInArrow(_to_documents, "r1 long, r2 long, places binary"), "places")
    suspects = texts.select("r1", "r2", "id", "n", "z").join(places, ["r1", "r2"])
    records = suspects.mapInArrow(_segments(buckets), "bucket int, n int, records binary")
    hits = records.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, "r1 long, r2 long, hits binary")
    hits = hits.groupBy("r1", "r2").agg(F.collect_list("hits").alias("hits"))
    cuts = texts.select("r1", "r2", "n", "z").join(hits, ["r1", "r2"]).mapInArrow(_cut, "r1 long, r2 long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>")
    sha = F.sha2("text", 256)
    half = lambda i: F.conv(F.substring(sha, i, 16), 16, -10).cast("long")
    rows = rows.select("id", "nameless", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha"), half(1).alias("r1"), half(17).alias("r2"))
    firsts = rows.groupBy("r1", "r2").agg(F.min("id").alias("first"))
    cuts = materialize(cuts, "cuts")
    spark.sql(f"drop table {name}")
    drop_folders(spark, folder)
    return rows.join(firsts, ["r1", "r2"]), cuts


_EMPTY = hashlib.sha256(b"").hexdigest()


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256): a row per row of docs."""
    rows, cuts = repeats(docs, id_col, text)
    out = rows.join(cuts.select("r1", "r2", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256"), ["r1", "r2"], "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        F.when(~F.col("nameless"), F.col("id")).alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes gone from their texts (a null text stays null). All columns and rows are kept."""
    own, (rows, cuts) = own_prefix(docs), repeats(docs, id_col, text)
    sha = F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)
    half = lambda i: F.conv(F.substring(sha, i, 16), 16, -10).cast("long")
    copies = rows.where((F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)).select("id", "r1", "r2").distinct()
    whole = copies.select(F.col("r1").alias(own + "r1"), F.col("r2").alias(own + "r2"), F.col("id").alias(own + "id"), F.lit(True).alias(own + "copy"))
    keyed = docs.withColumn(own + "k1", half(1)).withColumn(own + "k2", half(17)).withColumn(own + "kid", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))
    keyed = keyed.join(whole, (F.col(own + "k1") == F.col(own + "r1")) & (F.col(own + "k2") == F.col(own + "r2")) & (F.col(own + "kid") == F.col(own + "id")), "left")
    found = cuts.select(F.col("r1").alias(own + "c1"), F.col("r2").alias(own + "c2"), F.col("starts").alias(own + "starts"), F.col("ends").alias(own + "ends"))
    keyed = keyed.join(found, (F.col(own + "k1") == F.col(own + "c1")) & (F.col(own + "k2") == F.col(own + "c2")), "left")
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = b.column(at).to_pylist()
            for i, (copy, starts, ends) in enumerate(zip(*(b.column(n).to_pylist() for n in (own + "copy", own + "starts", own + "ends")))):
                if new[i] is None:
                    continue
                if copy:
                    new[i] = ""
                elif starts:
                    raw = new[i].encode()
                    new[i] = b"".join(raw[a:z] for a, z in zip([0, *ends], [*starts, len(raw)])).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(new, b.column(at).type) if i == at else b.column(i) for i in range(len(columns))], names=columns)

    return keyed.select(*columns, own + "copy", own + "starts", own + "ends").mapInArrow(run, docs.schema)
