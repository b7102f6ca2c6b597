"""Byte-pair merging by rank, on Arrow arrays.

A piece starts as single bytes; the adjacent pair whose concatenation has the lowest rank is joined (the leftmost on ties)
until no pair has a rank. Pieces arrive as an Arrow list column; a batch's distinct pieces are found by Arrow's dictionary
encoding, and only those are merged: short ones many at a time in matrices, a pair of each in every step, longer ones one by
one. Everything per occurrence is done in slices, so that what a batch takes beside its input and its result is bounded;
nothing is kept from batch to batch.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values that are worked on at once, and cells of a matrix of pieces.
SLICE, CELLS = 1 << 19, 1 << 19
#: Widths of the matrices; pieces of more bytes are merged one by one.
WIDTHS = (8, 16, 32, 64)
#: Bytes of a vocabulary, up to which its pairs are tabled; with more, all pieces are merged one by one.
TABLED_BYTES = 1 << 22
_NONE = np.int32(2**31 - 1)


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of the tokens that a piece ends in. A heap of pairs keeps long pieces at n log n."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it has been swallowed
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """The pairs of tokens that make a token, for merging many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.base = max(ranks.values()) + 1
        made = {}
        for b, r in ranks.items():
            for k in range(1, len(b)):
                if (left := ranks.get(b[:k])) is not None and (right := ranks.get(b[k:])) is not None:
                    made[left * self.base + right] = r
        keys = np.fromiter(made, dtype=np.int64, count=len(made))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(made.values(), dtype=np.int32, count=len(made))[order], _NONE)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        each = self.of_byte.astype(np.int64)
        self.of_bytes = self.find(np.repeat(each, 256), np.tile(each, 256)).reshape(256, 256)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs make, _NONE for nothing; a negative right is no token."""
        wanted = np.where(right < 0, -1, left.astype(np.int64) * self.base + right)
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)

    def merge(self, pieces: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (a row per piece, in front) and their number, of rows of bytes, as many of each as size says."""
        width = pieces.shape[1]
        out, many = np.zeros(pieces.shape, dtype=np.int32), size.copy()
        column = np.arange(width)
        tokens = np.where(column < size[:, None], self.of_byte[pieces], np.int32(-1))
        ranks = np.full(pieces.shape, _NONE)  # of each token with the next; nothing follows the last
        ranks[:, :-1] = np.where(column[1:] < size[:, None], self.of_bytes[pieces[:, :-1], pieces[:, 1:]], _NONE)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the lowest
            made = ranks[np.arange(len(rows)), at]
            on = made < _NONE
            if not on.all():
                out[rows[~on], :width] = tokens[~on]
                rows, tokens, ranks, at, made = rows[on], tokens[on], ranks[on], at[on], made[on]
            if not len(rows):
                break
            width -= 1  # each row that is left loses a token in each step
            behind = column[:width] > at[:, None]
            tokens = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            ranks = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            i = np.arange(len(rows))
            tokens[i, at] = made
            after = tokens[i, np.minimum(at + 1, width - 1)]
            ranks[i, at] = self.find(made, np.where(at + 1 < width, after, -1))
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.find(tokens[inner, at[inner] - 1], made[inner])
            many[rows] -= 1
        return out, many


class Merger:
    """Merges pieces of one vocabulary; lives in a worker."""

    def __init__(self, ranks: dict[bytes, int], offset: int = 0, specials: dict[str, int] | None = None) -> None:
        self.ranks, self.offset, self.specials = ranks, offset, specials or {}
        by_id = {r + offset: b for b, r in ranks.items()} | {i: s.encode() for s, i in self.specials.items()}
        top = max(by_id, default=-1) + 1
        lengths = np.fromiter((len(by_id.get(i, b"")) for i in range(top)), dtype=np.int64, count=top)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.is_known = np.fromiter((i in by_id for i in range(top)), dtype=bool, count=top)
        self.lengths = {"byte": lengths, "char": np.add.reduceat(np.append((self.bytes & 0xC0) != 0x80, False).astype(np.int64), self.starts[:-1]) * (lengths > 0) if top else lengths}

    @functools.cached_property
    def pairs(self) -> Pairs | None:
        return Pairs(self.ranks) if sum(map(len, self.ranks)) <= TABLED_BYTES else None

    @functools.cached_property
    def whole(self) -> tuple[pa.Array, np.ndarray]:
        """The ordinary tokens, and their ranks."""
        return pa.array(list(self.ranks), pa.binary()), np.fromiter(self.ranks.values(), dtype=np.int32, count=len(self.ranks))

    def ids_of(self, piece: bytes) -> np.ndarray:
        return np.array(merge_piece(piece, self.ranks), dtype=np.int32) + np.int32(self.offset)

    def merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of an array of binary: the ids of all pieces, one after another, and how many each has."""
        tokens, ranks = self.whole
        found = pc.fill_null(pc.index_in(pieces, value_set=tokens), -1).to_numpy(zero_copy_only=False)
        starts, data = raw_bytes(pieces)
        length, size = np.diff(starts), np.ones(len(pieces), dtype=np.int64)
        done = [(np.flatnonzero(found >= 0), ranks[found[found >= 0]][:, None])]  # pieces, and their ids in front of rows
        least = 0
        for width in WIDTHS if self.pairs is not None else ():
            group = np.flatnonzero((found < 0) & (length > least) & (length <= width))
            least = width
            for a in range(0, len(group), CELLS // width):
                some = group[a : a + CELLS // width]
                cells = data[np.minimum(starts[some][:, None] + np.arange(width), len(data) - 1)]
                ids, size[some] = self.pairs.merge(cells, length[some])
                done.append((some, ids))
        long = np.flatnonzero((found < 0) & (length > least))
        by_hand = [merge_piece(pieces[i].as_py(), self.ranks) for i in long.tolist()]
        size[long] = [len(x) for x in by_hand]
        size[length == 0] = 0
        first = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(first[-1], dtype=np.int32)
        for some, ids in done:
            column = np.arange(ids.shape[1])
            used = column < size[some][:, None]
            out[(first[some][:, None] + column)[used]] = ids[used]
        for i, x in zip(long.tolist(), by_hand):
            out[first[i] : first[i + 1]] = x
        return out + np.int32(self.offset), size

    def _distinct(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which distinct piece each is; the distinct pieces' ids, one after another, and how many each has."""
        coded = pc.dictionary_encode(flat.cast(pa.binary()))
        return coded.indices.to_numpy(), *self.merge(coded.dictionary)

    def _encode(self, flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and where those of each row end, rows being parted by offsets."""
        which, joined, size = self._distinct(flat)
        first = np.cumsum(size) - size
        ids, ends = [np.zeros(0, dtype=np.int32)], np.zeros(len(offsets), dtype=np.int64)
        for part, total in _totals(size, which, offsets, ends):
            ids.append(joined[np.repeat(first[part] - total[:-1], np.diff(total)) + np.arange(total[-1])])
        return np.concatenate(ids), ends

    def encode(self, pieces: pa.Array) -> pa.Array:
        """list<string or binary> to list<int32>."""
        rows, offsets, flat = _parts(pieces)
        ids, ends = self._encode(flat, offsets)
        return pa.ListArray.from_arrays(_offsets(ends, rows), pa.array(ids))

    def encode_marked(self, segments: pa.Array, marks: pa.Array) -> pa.Array:
        """The pieces of a text's segments (list<list<string>>) and the special strings between them (list<string>) to list<int32>."""
        rows, offsets, parts = _parts(segments)
        _, marked, strings = _parts(marks)
        _, cuts, flat = _parts(parts)
        ids, ends = self._encode(flat, cuts)
        behind = np.ones(len(parts), dtype=bool)  # a special token comes behind each segment but a row's last
        behind[offsets[1:][np.diff(offsets) > 0] - 1] = False
        known = pa.array([s.encode() for s in self.specials], pa.binary())
        number = np.fromiter(self.specials.values(), dtype=np.int32, count=len(self.specials))
        put = number[pc.index_in(strings.cast(pa.binary()), value_set=known).to_numpy()]
        return pa.ListArray.from_arrays(_offsets(ends[offsets] + marked, rows), pa.array(np.insert(ids, ends[1:][behind], put)))

    def count(self, pieces: pa.Array) -> pa.Array:
        """list<string or binary> to the number of ids (int32)."""
        rows, offsets, flat = _parts(pieces)
        which, _, size = self._distinct(flat)
        ends = np.zeros(len(offsets), dtype=np.int64)
        for _ in _totals(size, which, offsets, ends):
            pass
        return pa.array(np.diff(ends).astype(np.int32), mask=np.array([r is None for r in rows], dtype=bool))

    def occurrences(self, pieces: pa.Array) -> np.ndarray:
        """How often each id occurs, at the place of that number."""
        which, joined, size = self._distinct(_parts(pieces)[2])
        often = np.bincount(which, minlength=len(size))
        return np.bincount(joined, np.repeat(often, size), len(self.is_known)).astype(np.int64)

    def spans(self, ids: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all tokens, in bytes or code points from the start of their row."""
        _, offsets, flat = _parts(ids)
        return running(self.lengths[unit][flat.to_numpy()] if len(flat) else np.zeros(0, dtype=np.int64), offsets)

    def decode(self, ids: pa.Array, on_unknown: str = "error") -> pa.Array:
        """list<int> to binary."""
        rows, offsets, flat = _parts(ids)
        if flat.null_count:
            raise KeyError("a token id is null")
        x, top = flat.to_numpy(), len(self.is_known)
        inside = np.where((x >= 0) & (x < top), x, top)  # top stands for unknown ids
        if on_unknown == "error" and not (good := np.append(self.is_known, False)[inside]).all():
            raise KeyError(f"unknown token id {int(x[~good][0])}")
        data, ends, lengths = [np.zeros(0, np.uint8)], np.zeros(len(offsets), dtype=np.int64), np.append(self.lengths["byte"], 0)
        for part, total in _totals(lengths, inside, offsets, ends, SLICE // 8):
            data.append(self.bytes[np.repeat(self.starts[part] - total[:-1], np.diff(total)) + np.arange(total[-1])])
        if ends[-1] >= 2**31:
            raise OverflowError("a batch decodes to 2 GB or more; spark.sql.execution.arrow.maxRecordsPerBatch makes batches smaller")
        return binary(ends, np.concatenate(data), rows)


def row_ranges(values: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to so many values (of lists) or bytes (of strings) together, a row at least; one without rows if there are none."""
    size = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_binary(values.type) else pc.list_value_length(values)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = z = 0
    while z < len(ends) or not z:
        z = min(len(ends), max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right"))))
        yield a, z
        if not z:
            return
        a = z


def row_slices(values: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """The rows in such ranges."""
    return (values.slice(a, z - a) for a, z in row_ranges(values, most))


def running(each: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of values that are each so long, from the start of their row."""
    ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    base = np.repeat(ends[offsets[:-1]], np.diff(offsets))
    return ends[:-1] - base, ends[1:] - base


def binary(ends: np.ndarray, data: np.ndarray, rows: list) -> pa.Array:
    """An array of binary of n+1 offsets and the bytes of all rows; null where rows says None."""
    out = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return out if all(rows) else pc.if_else(pa.array([r is not None for r in rows]), out, pa.scalar(None, pa.binary()))


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n+1 offsets of an array of strings or binary, and the bytes that they count in."""
    _, at, data = values.cast(pa.binary()).buffers()
    if not len(values):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    return np.frombuffer(at, dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64), np.frombuffer(data or b"", dtype=np.uint8)


def _totals(size: np.ndarray, which: np.ndarray, offsets: np.ndarray, ends: np.ndarray, step: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of which with the running sums of their sizes (from 0); ends gets the sum up to each of the offsets in which."""
    before, step = 0, step or SLICE
    for a in range(0, len(which), step):
        part = which[a : a + step]
        total = np.concatenate([[0], np.cumsum(size[part], dtype=np.int64)])
        low, high = np.searchsorted(offsets, [a, a + len(part)], side="right")
        ends[low:high] = before + total[offsets[low:high] - a]
        before += int(total[-1])
        yield part, total


def _parts(lists: pa.Array) -> tuple[list, np.ndarray, pa.Array]:
    """(per row: None if null else True, n+1 offsets, values) of a list array; null rows have no values."""
    valid = lists.is_valid().to_pylist()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return [x or None for x in valid], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), lists.flatten()


def _offsets(offsets: np.ndarray, rows: list) -> pa.Array:
    """Arrow list offsets; a null at a row's start makes the row null."""
    mask = np.array([r is None for r in rows] + [False], dtype=bool)
    return pa.array(offsets.astype(np.int32), mask=mask)
