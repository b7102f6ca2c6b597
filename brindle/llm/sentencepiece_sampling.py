"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is cut into chunks before each space that follows a non-space; no piece crosses such a cut, so the lattice of a text
is the chain of its chunks' lattices and chunks can be sampled on their own. Forward filtering sums, for every position of a
chunk, the weights of all segmentations of what lies before it; backward sampling then draws pieces from the end, each with
its exact conditional probability. The draws are a hash of the row key and the chunk's place, so a row always gets the same
segmentation, whatever its neighbours or the partitioning. seed=None takes the most likely segmentation (Viterbi) instead.

The model's pieces are ranked merges without probabilities; a piece's weight is (rank + RANK_OFFSET)**-alpha, a Zipf law over its
rank. Characters that are no piece, control pieces, and a literal U+2581 are spelled in byte pieces, so every text survives.

Texts go in blocks. A block's distinct chunks get their lattices together (one walk of the pieces' trie from all places at
once, one filtering step per position), and a step of the sampling loop draws the next piece of every unfinished chunk.

Defined cases: a null text gives null ids; an empty text gives no ids; decode(encode(x)) == x for every text; a null key
counts as the empty string; rows with equal key and text get equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import mix64, own_prefix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
RANK_OFFSET = 16.0
#: Characters of a block of texts.
BLOCK = 1 << 21
SEED = 5
#: Rows of an output batch.
ROWS = 1000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: ids of normal pieces by text, of byte pieces by byte, and what each id decodes to."""

    normal: dict[str, int]
    byte: list[int]
    spoken: list[bytes]
    longest: int

    @staticmethod
    def parse(model: bytes) -> "Pieces":
        """Read a SentencePiece model file: message field 1 is a piece (1: text, 3: type; 1 normal, 4 user defined, 6 byte)."""
        normal: dict[str, int] = {}
        byte = [-1] * 256
        spoken: list[bytes] = []
        for number, value in _fields(model):
            if number != 1:
                continue
            piece = dict(_fields(value))
            text, kind = piece.get(1, b"").decode(), piece.get(3, 1)
            i = len(spoken)
            if kind == 6:
                byte[int(text[3:5], 16)] = i
                spoken.append(bytes([int(text[3:5], 16)]))
            elif kind in (1, 4):
                normal[text] = i
                spoken.append(text.replace(SPACE, " ").encode())
            else:
                spoken.append(b"")
        if min(byte) < 0:
            raise ValueError("the model has no piece for some byte, so it can't spell every text")
        return Pieces(normal, byte, spoken, max(map(len, normal), default=1))


#: Chunks: a run of spaces with the non-spaces after it.
_CHUNK = re.compile(r" +[^ ]*|[^ ]+")


@dataclass
class Lattice:
    """One chunk: for every node (position), the edges that end there: where they begin, their ids, cumulative chance."""

    first: np.ndarray  # edges of node p: first[p] .. first[p+1]
    begin: np.ndarray
    ids: list[tuple[int, ...]]
    chance: np.ndarray  # cumulative within a node, the last is 1
    log_total: float
    best: tuple[int, ...] = ()


def build_lattice(chunk: str, pieces: Pieces, alpha: float) -> Lattice:
    """Forward filtering over the segmentations of a chunk, in logarithms."""
    n = len(chunk)
    text = chunk.replace(" ", SPACE) if SPACE not in chunk else None
    log_alpha = np.full(n + 1, -np.inf)
    log_alpha[0] = 0.0
    top = [(0.0, None)] + [(-np.inf, None)] * n
    first, begin, ids, chance = [0, 0], [], [], []
    normal, longest = pieces.normal, pieces.longest
    for end in range(1, n + 1):
        start_ids, weights = [], []
        for start in range(max(0, end - longest), end):
            if text is not None:
                i = normal.get(text[start:end])
            else:  # a literal U+2581 must not turn into a space
                part = chunk[start:end]
                i = None if SPACE in part else normal.get(part.replace(" ", SPACE))
            if i is not None:
                start_ids.append((start, (i,)))
                weights.append(-alpha * np.log(i + RANK_OFFSET))
            elif start == end - 1:
                spelled = tuple(pieces.byte[b] for b in chunk[start].encode("utf-8", "surrogatepass"))
                start_ids.append((start, spelled))
                weights.append(-alpha * len(spelled) * np.log(len(pieces.spoken) + RANK_OFFSET))
        scores = np.array([log_alpha[s] + w for (s, _), w in zip(start_ids, weights)])
        peak = scores.max()
        p = np.exp(scores - peak)
        log_alpha[end] = peak + np.log(p.sum())
        cumulative = np.cumsum(p) / p.sum()
        cumulative[-1] = 1.0
        top[end] = max(((top[s][0] + w, k) for k, ((s, _), w) in enumerate(zip(start_ids, weights))), key=lambda x: x[0])
        top[end] = (top[end][0], len(begin) + top[end][1])
        begin += [s for s, _ in start_ids]
        ids += [i for _, i in start_ids]
        chance.append(cumulative)
        first.append(len(begin))
    best: list[tuple[int, ...]] = []
    at = n
    while at > 0:
        edge = top[at][1]
        best.append(ids[edge])
        at = begin[edge]
    return Lattice(np.array(first), np.array(begin, dtype=np.int32), ids, np.concatenate(chance) if chance else np.zeros(0), float(log_alpha[n]), tuple(i for piece in reversed(best) for i in piece))


_EMPTY = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 19
#: Stands for a literal U+2581, which must not turn into a space; no piece holds it.
_LITERAL = 0x110000


class Trie:
    """The normal pieces as a trie, its edges in an open-addressing table that is probed for many places at once."""

    def __init__(self, pieces: Pieces) -> None:
        states: dict[str, int] = {"": 0}
        for piece in pieces.normal:
            for end in range(1, len(piece) + 1):
                states.setdefault(piece[:end], len(states))
        keys = np.array([(states[t[:-1]] << 21) | ord(t[-1]) for t in states if t], dtype=np.uint64)
        targets = np.array([i for t, i in states.items() if t], dtype=np.int32)
        self.bits = max(_SLOT_BITS, int(len(keys)).bit_length() + 2)
        self.piece = np.full(len(states), -1, dtype=np.int32)
        for t, i in pieces.normal.items():
            self.piece[states[t]] = i
        size = 1 << self.bits
        self.keys, self.targets = np.full(size, _EMPTY), np.zeros(size, dtype=np.int32)
        for k, t, slot in zip(keys, targets, self._slots(keys).tolist()):
            while self.keys[slot] != _EMPTY:
                slot = (slot + 1) % size
            self.keys[slot], self.targets[slot] = k, t
        self.longest = pieces.longest
        self.weights: dict[float, np.ndarray] = {}

    def weight(self, alpha: float) -> np.ndarray:
        """Log weight of each piece by id."""
        if alpha not in self.weights:
            self.weights[alpha] = -alpha * np.log(np.arange(int(self.piece.max(initial=0)) + 1) + RANK_OFFSET)
        return self.weights[alpha]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        q = (state.astype(np.uint64) << np.uint64(21)) | char
        slot = self._slots(q)
        out = np.full(len(q), -1, dtype=np.int32)
        held = self.keys[slot]
        hit = held == q
        out[hit] = self.targets[slot[hit]]
        open_ = np.flatnonzero(~hit & (held != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == q[open_]
            out[open_[hit]] = self.targets[slot[open_[hit]]]
            open_ = open_[~hit & (held != _EMPTY)]
        return out


class Table:
    """The lattices of a block's distinct chunks in flat arrays, forward-filtered together."""

    def __init__(self, chunks: list[str], pieces: Pieces, trie: Trie, alpha: float) -> None:
        self.pieces = pieces
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        raw = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        char = np.where(raw == 32, 0x2581, np.where(raw == 0x2581, _LITERAL, raw)).astype(np.uint64)
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(chunks)), sizes)
        n = len(char)
        # walk the trie from all places at once; what dies drops out
        live, state = np.arange(n), np.zeros(n, dtype=np.int32)
        last = ends[which]
        begin, length, piece = [], [], []
        for size in range(1, trie.longest + 1):
            inside = live + size <= last[live]
            live, state = live[inside], state[inside]
            state = trie.step(state, char[live + size - 1])
            ok = state >= 0
            live, state = live[ok], state[ok]
            if not len(live):
                break
            found = trie.piece[state]
            some = found >= 0
            begin.append(live[some]), length.append(np.full(int(some.sum()), size)), piece.append(found[some].astype(np.int64))
            if size == 1:
                lone = np.ones(n, dtype=bool)
                lone[live[some]] = False
        lone = np.flatnonzero(lone) if n and begin else np.arange(n)
        cp = raw[lone].astype(np.int64)
        bytes_of = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        spelled = np.concatenate([np.ones(sum(map(len, begin)), dtype=np.int64), bytes_of])
        weight = np.concatenate([*(trie.weight(alpha)[p] for p in piece), bytes_of * (-alpha * np.log(len(pieces.spoken) + RANK_OFFSET))])
        begin.append(lone), length.append(np.ones(len(lone), dtype=np.int64)), piece.append(-1 - cp)
        begin, length, piece = map(np.concatenate, (begin, length, piece))
        # nodes: one more than characters in each chunk
        source = begin + which[begin] if n else begin
        target = source + length
        start = ends - sizes
        level = (begin + length - start[which[begin]]) if n else begin
        order = np.argsort((level << 40) | target, kind="stable")  # all edges of a level together, and there by node; a node's by length
        source, target, piece, spelled, weight, level = (x[order] for x in (source, target, piece, spelled, weight, level))
        logs = np.zeros(n + len(chunks))
        chance = np.empty(len(source))
        cuts = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        levels = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else np.zeros(1, np.int64)
        cut_at = np.searchsorted(cuts, levels)
        for a, b, c, d in zip(levels, levels[1:], cut_at, cut_at[1:]):
            groups = cuts[c:d] - a
            per = np.diff(np.append(groups, b - a))
            v = logs[source[a:b]] + weight[a:b]
            peak = np.maximum.reduceat(v, groups)
            e = np.exp(v - np.repeat(peak, per))
            total = np.add.reduceat(e, groups)
            logs[target[cuts[c:d]]] = peak + np.log(total)
            chance[a:b] = e / np.repeat(total, per)
        # cumulative within each node, edge by edge: a sum over several nodes would round by what else is in the block
        nth = np.arange(len(target)) - np.repeat(cuts, np.diff(np.append(cuts, len(target))))
        rest, k = np.flatnonzero(nth), 1
        while len(rest):
            turn = nth[rest] == k
            chance[rest[turn]] += chance[rest[turn] - 1]
            rest, k = rest[~turn], k + 1
        self.source, self.piece, self.spelled, self.chance = source, piece, spelled, chance
        self.begin = np.zeros(n + len(chunks), dtype=np.int64)  # a node's first edge and its last one
        self.begin[target[cuts]] = cuts
        self.end = np.zeros(n + len(chunks), dtype=np.int64)
        self.end[target[cuts]] = np.append(cuts[1:], len(target)) - 1 if len(cuts) else 0
        self.home = start + np.arange(len(chunks))
        self.last = ends + np.arange(len(chunks))
        self.log_total = logs[self.last] if len(chunks) else logs

    def draw(self, chunks: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each): one segmentation drawn per chunk, by its seed."""
        node, home = self.last[chunks], self.home[chunks]
        live = np.arange(len(chunks))
        drawn, owner = [], []
        step = 0
        while len(live):
            step = (step + 0x9E3779B97F4A7C15) % 2**64
            u = (mix64(seeds[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = node[live]
            edge, end = self.begin[at], self.end[at]
            open_ = np.flatnonzero((u >= self.chance[edge]) & (edge < end))
            while len(open_):  # to the first edge whose cumulative chance is above u
                edge[open_] += 1
                open_ = open_[(u[open_] >= self.chance[edge[open_]]) & (edge[open_] < end[open_])]
            drawn.append(edge)
            owner.append(live)
            node[live] = self.source[edge]
            live = live[node[live] > home[live]]
        # place of each draw: a chunk's k-th draw is its k-th piece from the end
        turns = np.zeros(len(chunks), dtype=np.int64)
        for o in owner:
            turns[o] += 1
        ends = np.cumsum(turns)
        edges = np.empty(int(turns.sum()), dtype=np.int64)
        for k, (o, e) in enumerate(zip(owner, drawn)):
            edges[ends[o] - 1 - k] = e
        sizes, piece = self.spelled[edges], self.piece[edges]
        per = np.add.reduceat(sizes, ends - turns) if len(edges) else np.zeros(len(chunks), np.int64)
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        at = np.cumsum(sizes) - sizes
        normal = piece >= 0
        out[at[normal]] = piece[normal]
        table = np.array(self.pieces.byte, dtype=np.int32)
        for width in range(1, 5):
            some = np.flatnonzero(~normal & (sizes == width))
            cp = -1 - piece[some]
            for j in range(width):
                low = cp >> (6 * (width - 1 - j))
                byte = low if width == 1 else ((0xF00 >> width) & 0xFF) | low if j == 0 else 0x80 | (low & 0x3F)
                out[at[some] + j] = table[byte]
        return out, per


def row_seed(key: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), seed)


@dataclass
class Encoder:
    """Encodes texts, block by block."""

    pieces: Pieces
    alpha: float = 0.5
    seed: int | None = SEED
    trie: Trie = field(init=False)

    def __post_init__(self) -> None:
        self.trie = Trie(self.pieces)

    def encode(self, texts: list[str | None], keys: list[str]) -> list[np.ndarray | None]:
        """Piece ids of each text; a dummy space goes before it, as in the model's training."""
        out: list[np.ndarray | None] = []
        first = 0
        while first < len(texts):  # blocks of about a megabyte
            last, size = first, 0
            while last < len(texts) and (last == first or size < BLOCK):
                size += len(texts[last] or "")
                last += 1
            out += self._block(texts[first:last], keys[first:last])
            first = last
        return out

    def _block(self, texts: list[str | None], keys: list[str]) -> list[np.ndarray | None]:
        chunks = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        if self.seed is None:
            return [None if t is None else np.array([i for x in c for i in build_lattice(x, self.pieces, self.alpha).best], dtype=np.int32) for t, c in zip(texts, chunks)]
        index: dict[str, int] = {}
        names = np.array([index.setdefault(x, len(index)) for c in chunks for x in c], dtype=np.int64)
        counts = np.array([len(c) for c in chunks], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        seeds = np.array([row_seed(k, self.seed) for k in keys], dtype=np.uint64)
        place = np.arange(len(names), dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)
        if not len(names):
            return [None if t is None else np.zeros(0, dtype=np.int32) for t in texts]
        ids, per = Table(list(index), self.pieces, self.trie, self.alpha).draw(names, mix64(np.repeat(seeds, counts) + place * np.uint64(0xD6E8FEB86659FD93)))
        ends = np.concatenate([[0], np.cumsum(per)])[bounds]
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, ends[:-1], ends[1:])]


def decode(ids, pieces: Pieces) -> str:
    """The text of ids that encode() made."""
    spoken = pieces.spoken
    raw = b"".join([spoken[i] for i in ids])
    return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def load_pieces(spark, path: str = MODEL_PATH) -> Pieces:
    """Read the model on the driver through Spark's file readers or, for a path of this machine, directly."""
    if "://" not in path:
        with open(path, "rb") as f:
            return Pieces.parse(f.read())
    return Pieces.parse(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def encode_documents(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", alpha: float = 0.5, seed: int | None = SEED, name: str = "ids") -> DataFrame:
    """docs with the sampled piece ids in column name (array<int>; one of that name is replaced). The model (32,000 pieces) travels with the function."""
    columns, own = [c for c in docs.columns if c != name], own_prefix(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, alpha, seed)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                found = encoder.encode(part.column(own + "text").to_pylist(), part.column(own + "key").to_pylist())
                ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in found])])
                flat = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
                missing = pa.array([x is None for x in found] + [False])
                offsets = pa.array(ends.astype(np.int32), mask=missing.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*columns, name])

    source = docs.select(*columns, F.col(text).alias(own + "text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias(own + "key"))
    return source.mapInArrow(run, docs.select(*columns).schema.add(name, ArrayType(IntegerType())))


def decode_documents(encoded: DataFrame, pieces: Pieces, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """encoded with the text of its ids in column name."""
    columns = [c for c in encoded.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode(x, pieces) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, name])

    return encoded.mapInArrow(run, encoded.select(*columns).schema.add(name, "string"))


def round_trip(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", alpha: float = 0.5, seed: int | None = SEED) -> DataFrame:
    """docs without its text, with n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 and lossless: what the
    ids decode to, worked out where they are made, so that they need not travel twice."""
    rest, own = [c for c in docs.columns if c not in (text, "n_pieces", "ids_sha256", "decoded_sha256", "lossless")], own_prefix(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, alpha, seed)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = part.column(own + "text").to_pylist()
                found = encoder.encode(texts, part.column(own + "key").to_pylist())
                back = [None if x is None else decode(x.tolist(), pieces) for x in found]
                sha = lambda raw: hashlib.sha256(raw).hexdigest()
                arrays = [
                    pa.array([None if x is None else len(x) for x in found], pa.int64()),
                    pa.array([None if x is None else sha(x.astype("<i4").tobytes()) for x in found], pa.string()),
                    pa.array([None if t is None else sha(t.encode("utf-8", "surrogatepass")) for t in back], pa.string()),
                    pa.array([t == x for t, x in zip(back, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *arrays], names=[*rest, "n_pieces", "ids_sha256", "decoded_sha256", "lossless"])

    source = docs.select(*rest, F.col(text).alias(own + "text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias(own + "key"))
    schema = docs.select(*rest).schema.add("n_pieces", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("lossless", "boolean")
    return source.mapInArrow(run, schema)
