"""Language-model scoring by a hierarchical Pitman-Yor model over word contexts.

Restaurants form three levels. A token's context is the two words before it (fewer at a document's start); the parent of that
restaurant is the one of the single word before the token, which all contexts ending in that word share, and all of those
share the root restaurant, whose base measure is uniform over the known words and one unknown word. Every context that the
training texts hold has its own restaurant; none are merged or left out.

Seating is sampled by Gibbs sweeps from one table per dish: in a restaurant, the tables of a dish are taken away and its
customers seated again by the Chinese-restaurant rule, given the restaurant's other tables and the parent's predictive
probability. Customers come one by one until there are GROUP, then in groups of 1/GROUP of those seated, each group at the
rates at which it comes in (frozen within the group). Every draw is a hash of its dish, sweep and customer, so scores don't
depend on how tables are dealt out. Dishes of a sweep see the other dishes' tables as the sweep before left them. A pass over
the lower levels makes SWEEPS sweeps; after the first pass the root (and what is seated with it) is sampled given the tables
below, and the second pass averages predictive probabilities over its last KEPT sweeps.

Distribution: a word's restaurant and those of all contexts that end in it are dealt to one bucket by that word, so the lower
levels need nothing but the root's numbers for the words in the bucket. Those go up to the words' own partitions, summed per
bucket, and come back. Words with a share of 1/VERY or more of the tokens (by a sample drawn by hash) are split: their contexts
are dealt by both words, and their own restaurant is seated with the root; pairs of such a share are dealt by pair and dish,
and only their totals, at most VERY numbers, are summed on the driver (a pass takes those of the pass before). Words among the most frequent travel as two bytes, others as hashes (of 64 bits; 48 where they
only name a context).
Counts are 64-bit and exact. What each document's tokens got comes back summed by bucket and document.

Memory: a task holds a bucket at a time (about BUCKET_BYTES of the input, whatever its size). One trigram's tokens always meet
in one bucket, as an entry each.

Disk: tokens are dealt to buckets in PARTS passes over the texts, a share of the buckets each, so that only a share of what is
shuffled lies beside the buckets. The passes must see the same blocks; blocks are named by place and content, and where a pass
finds others (a source whose rows come in another order), all are dealt in one pass.

Defined cases: a null text is empty and has the one token `end`; a null id counts as the empty string in the fold hash;
repeated rows are separate documents; without training documents every token is unknown and has probability 1, and the base
score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop_folders, free_shuffles, materialize, mix64, new_folder, own_names, partitions, prefix_hashes, run_starts, span_hashes, text_blocks, word_bounds

CODES = 60_000
SAMPLE_DOCS = 4000
VERY = 256
SWEEPS, KEPT = 5, 3
STRENGTH = (1.0, 1.0, 1.0)  # theta of the root, the one-word and the two-word contexts
GROUP = 32
SEED = 3
END, START = np.uint64(0x5EED0E4D5EED0E4D), np.uint64(0x5EED57A75EED57A7)
BLOCK = 1 << 21
BUCKET_BYTES = 2 << 20
#: Bytes of the input for each partition of the root and the split restaurants: buckets exchange a message with each.
UPPER_BYTES = 8 << 20
#: Passes that deal an input of PARTED_BYTES or more.
PARTS, PARTED_BYTES = 2, 8 << 20
TAIL = 0xFFFF
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_FIXED = float(1 << 24)


# -- tokens -----------------------------------------------------------------------------------


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens before each document): words and the end of every document."""
    starts, ends, first = word_bounds(data, offsets)
    words = span_hashes(prefix_hashes(LOWER[data]), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    docs = len(offsets) - 1
    bounds = first + np.arange(docs + 1)  # one more token a document
    h = np.empty(len(words) + docs, dtype=np.uint64)
    is_word = np.ones(len(h), dtype=bool)
    is_word[bounds[1:] - 1] = False
    h[is_word] = words
    h[bounds[1:] - 1] = END
    return h, bounds


def _before(x: np.ndarray, bounds: np.ndarray, start) -> np.ndarray:
    """What stands before each token of its document."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[bounds[:-1]] = start
    return out


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of a context: the word before the last and the last."""
    return mix64(mix64(one * _A) + two * _B)


def dish_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(context * _C) + word * _A)


# -- packed columns ---------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind each other, each by byte planes, compressed."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    head = b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    body = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return struct.pack("<iq", len(arrays), len(body)) + head + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(raw: pa.Buffer) -> list[np.ndarray]:
    count, size = struct.unpack("<iq", raw[:12].to_pybytes())
    kinds = [struct.unpack("<2sq", raw[12 + 10 * i : 22 + 10 * i].to_pybytes()) for i in range(count)]
    body = np.frombuffer(pa.decompress(raw[12 + 10 * count :], size, codec="zstd"), np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        dtype = np.dtype("<" + kind.decode())
        out.append(np.ascontiguousarray(body[at : at + n * dtype.itemsize].reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of hashes: words without a code name a context by these."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(len(h), 8)[:, :6]).ravel()


def _long(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<struct<g:int,z:binary>>": pa.list_(pa.struct([("g", pa.int32()), ("z", pa.binary())]))}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


# -- what is frequent -------------------------------------------------------------------------


@dataclass(frozen=True)
class Frequent:
    """Words that travel as codes (hashes, the most frequent first), and the words and pairs that are split (sorted hashes)."""

    codes: np.ndarray
    words: np.ndarray
    pairs: np.ndarray


def _rank(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted table, -1 if it has none."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


def _frequent(source: DataFrame) -> Frequent:
    """By about SAMPLE_DOCS training documents, drawn by hash. Codes decide how words travel; what is split is seated with the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_blocks(batches, "text"):
            h, bounds = _tokens(data, offsets)
            two = _before(h, bounds, START)
            for kind, x in ((0, h), (1, pair_hash(_before(two, bounds, START), two))):
                keys, counts = np.unique(x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "h", "n"])

    step = max(1, source.count() // SAMPLE_DOCS)
    chosen = source.where(F.pmod(F.xxhash64("id", "text"), F.lit(step)) == 0).select("text")
    counted = materialize(chosen.mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")).where("n > 1"), "sample")
    total = counted.where("kind = 0").agg(F.sum("n")).first()[0] or 0

    def top(kind: int, most: int, least: float) -> np.ndarray:
        got = counted.where((F.col("kind") == kind) & (F.col("n") >= least)).orderBy(F.desc("n"), "h").limit(most).select("h").collect()
        return np.array([r["h"] for r in got], dtype=np.int64).view(np.uint64)

    words = np.append(top(0, VERY - 2, max(2, total / VERY)), [START, END])
    codes = np.append([START, END], top(0, CODES, 2)).astype(np.uint64)
    codes = codes[np.sort(np.unique(codes, return_index=True)[1])]
    return Frequent(codes, np.unique(words), np.unique(np.append(top(1, VERY - 1, max(2, total / VERY)), pair_hash(*np.array([[START], [START]])))))


# -- gathering --------------------------------------------------------------------------------

_MESSAGE = "bucket int, block long, n long, data binary, extra binary"


def _gather(f: Frequent, names: np.ndarray, part_of: np.ndarray, this: int):
    """(id, held, text) to messages: each block's tokens by bucket (data: codes, tail hashes; extra: held documents), and its documents
    (bucket < 0; the data in the first part only). Of the buckets only those of this part."""
    buckets = np.uint64(len(names))
    by_hash = np.argsort(f.codes)
    table = f.codes[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            for lo in range(0, rows.num_rows, 60_000):  # documents of a block are numbered in 16 bits
                part = rows.slice(lo, 60_000)
                o = offsets[lo : lo + part.num_rows + 1]
                h, bounds = _tokens(data[o[0] : o[-1]], o - o[0])
                held = part.column("held").to_numpy(zero_copy_only=False)
                ids = part.column("id")
                flat, null = ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False)
                named = xxhash.xxh3_64(struct.pack("<q", part.column("row")[0].as_py()))
                for x in (flat, null, held, bounds, h):
                    named.update(np.ascontiguousarray(x).tobytes())
                block = int(np.uint64(named.intdigest()).view(np.int64))
                doc = np.repeat(np.arange(part.num_rows, dtype=np.uint16), np.diff(bounds))
                known, w = np.unique(np.append(h, START), return_inverse=True)
                w, start = w[:-1].astype(np.int32), w[-1]
                two = _before(w, bounds, start)
                one = _before(two, bounds, start)
                place = _rank(table, known)
                code = np.where(place < 0, TAIL, by_hash[place]).astype(np.uint16)
                route = mix64(known)[two]
                very = np.flatnonzero((_rank(f.words, known) >= 0)[two])
                pair = pair_hash(known[one[very]], known[two[very]])
                often = _rank(f.pairs, pair) >= 0
                route[very] = np.where(often, dish_key(pair, known[w[very]]), pair)
                route = (route % buckets).astype(np.uint32)
                order = np.flatnonzero(part_of[route] == this)
                order = order[np.argsort(route[order].astype(np.uint16) if buckets < 1 << 16 else route[order], kind="stable")]
                cuts = run_starts(route[order])
                out = [(-1 - block % len(names), block, part.num_rows, b"" if this else _pack(flat, null, held, np.diff(bounds).astype("<u4")), b"")]
                flags = held.tobytes()
                for a, b in zip(cuts, cuts[1:]):
                    at = order[a:b]
                    three = [two[at], one[at], w[at]]
                    coded = [code[x] for x in three]
                    two_tail, one_tail, tail = (known[x[c == TAIL]] for x, c in zip(three, coded))
                    out.append((int(names[route[at[0]]]), block, b - a, _pack(*coded, doc[at], _short(two_tail), _short(one_tail), tail), flags))
                yield _batch(out, _MESSAGE)

    return run


# -- buckets ----------------------------------------------------------------------------------

_UP = "array<struct<g:int,z:binary>>"
_KEPT = f"bucket int, block long, n long, data binary, extra binary, up {_UP}, stats array<double>"


def _organise(f: Frequent, uppers: int):
    """Messages to a row a bucket: its tokens in order of context and word, what goes up at first, and statistics. Documents' rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for bucket, block, n, data, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
                if bucket < 0:
                    yield _batch([(bucket, block, n, data.as_py(), b"", [], None)], _KEPT)
                else:
                    parts.setdefault(bucket, []).append((block, n, data.as_py(), extra.as_py()))
        for bucket in sorted(parts):
            data, extra = _sorted_bucket(f.codes, parts.pop(bucket))
            s = Section(f, pa.py_buffer(data), pa.py_buffer(extra))
            row = (bucket, 0, len(s.doc), data, extra, s.up(uppers, first=True), s.stats())
            del s, data, extra
            yield _batch([row], _KEPT)
            del row

    return run


def _sorted_bucket(codes: np.ndarray, parts: list[tuple]) -> tuple[bytes, bytes]:
    arrays = [_unpack(pa.py_buffer(p[2])) for p in parts]
    coded = [np.concatenate([a[k] for a in arrays]) for k in range(3)]
    doc = np.concatenate([a[3] for a in arrays])
    tails = [_long(np.concatenate([a[4 + k] for a in arrays])) if k < 2 else np.concatenate([a[6] for a in arrays]) for k in range(3)]
    used = np.zeros(1 << 16, dtype=bool)
    for c in coded:
        used[c] = True
    used[TAIL] = False
    sizes = np.cumsum([0, *map(len, tails)])
    every = np.concatenate(tails)
    by_hash = np.argsort(every)
    new = run_starts(every[by_hash])[:-1]
    distinct = every[by_hash[new]]
    known = np.sort(np.concatenate([codes[np.flatnonzero(used)], distinct]))
    known = known[run_starts(known)[:-1]]
    places = np.empty(len(every), dtype=np.int32)
    places[by_hash] = np.repeat(np.searchsorted(known, distinct), np.diff(np.append(new, len(every))))
    dense = np.zeros(1 << 16, dtype=np.int32)
    dense[np.flatnonzero(used)] = np.searchsorted(known, codes[np.flatnonzero(used)])
    ids = []
    for k, c in enumerate(coded):
        x = dense[c]
        x[c == TAIL] = places[sizes[k] : sizes[k + 1]]
        ids.append(x)
    two, one, word = ids
    order = np.argsort(two.astype(np.int64) << 42 | one.astype(np.int64) << 21 | word) if len(known) < 1 << 21 else np.lexsort((word, one, two))
    two, one, word = two[order], one[order], word[order]
    heads = run_starts(two, one, word)
    which = np.repeat(np.arange(len(parts), dtype=np.uint32), [p[1] for p in parts])[order]
    step = lambda x: np.diff(x[heads[:-1]], prepend=0).astype("<i4")
    data = _pack(np.diff(known, prepend=np.uint64(0)), step(two), step(one), word[heads[:-1]].astype("<u4"), np.diff(heads).astype("<u4"), which, doc[order])
    return data, _pack(np.array([p[0] for p in parts], dtype="<i8"), np.array([len(p[3]) for p in parts], dtype="<i8"), np.frombuffer(b"".join(p[3] for p in parts), np.uint8))


@dataclass
class Totals:
    """Fixed numbers of the model and totals of the restaurants that are not in one bucket."""

    discount: tuple[float, float, float]
    tokens: float
    words: float
    root: np.ndarray  # customers and tables
    split: np.ndarray  # customers and tables of the split words' restaurants
    pairs: np.ndarray  # of the split pairs'


def discounts(ones_and_twos: np.ndarray) -> tuple[float, float, float]:
    return tuple(float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5 for a, b in ones_and_twos.reshape(3, 2))


def uniform(key: np.ndarray, sweep: int, customer: np.ndarray) -> np.ndarray:
    return (mix64(mix64(key + np.uint64(SEED) + np.uint64(sweep) * _B) + customer.astype(np.uint64) * _A) >> np.uint64(11)) * 2.0**-53


def seat(n: np.ndarray, others: np.ndarray, p: np.ndarray, theta: float, d: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes with n customers in restaurants with so many other tables, p being the parent's probability."""
    t = np.minimum(n, 1).astype(np.int64)
    alive = np.flatnonzero(n > 1)
    alive = alive[np.argsort(-n[alive], kind="stable")]
    size, others, p, key = n[alive], others[alive], p[alive], key[alive]
    tables, seated = np.ones(len(alive), dtype=np.int64), 1
    while True:
        m = int(np.searchsorted(-size, -seated, side="left"))  # those with more customers than are seated
        if not m:
            break
        group = max(1, seated // GROUP)
        now = tables[:m]
        new = (theta + d * (others[:m] + now)) * p[:m]
        rate = new / (new + seated - d * now)
        if group == 1:
            now += uniform(key[:m], sweep, np.full(m, seated)) < rate
        else:
            count = np.minimum(size[:m] - seated, group)
            who = np.repeat(np.arange(m), count)
            customer = seated + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            now += np.bincount(who, weights=uniform(key[:m][who], sweep, customer) < rate[who], minlength=m).astype(np.int64)
        seated += group
    t[alive] = tables
    return t


class Section:
    """A bucket: types (two-word context, word) in order, their restaurants, and the tokens."""

    def __init__(self, f: Frequent, data: pa.Buffer, extra: pa.Buffer) -> None:
        known, two, one, word, size, which, self.doc = _unpack(data)
        self.known = np.cumsum(known)
        two, one, word = np.cumsum(two, dtype=np.int32), np.cumsum(one, dtype=np.int32), word.astype(np.int32)
        self.word, self.which = word, which
        self.type = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.blocks, self.docs, held = _unpack(extra)
        self.first = np.concatenate([[0], np.cumsum(self.docs)])
        self.trained = held[self.first[self.which] + self.doc] == 0
        self.c3 = np.bincount(self.type, weights=self.trained, minlength=len(size)).astype(np.int64)
        # restaurants of pairs
        heads = run_starts(two, one)
        self.context = np.repeat(np.arange(len(heads) - 1, dtype=np.int32), np.diff(heads))
        head = heads[:-1]
        self.pair = pair_hash(self.known[one[head]], self.known[two[head]])
        self.split = _rank(f.words, self.known)  # by word
        self.often = np.full(len(head), -1)
        very = self.split[two[head]] >= 0
        self.often[very] = _rank(f.pairs, self.pair[very])
        # dishes of single words' restaurants
        keys, dish = np.unique(two.astype(np.int64) * len(self.known) + word, return_inverse=True)
        self.dish = dish.astype(np.int32)
        self.rest, self.served = keys // len(self.known), keys % len(self.known)
        self.apart = self.split[self.rest]  # -1: the restaurant is here
        self.present = np.zeros(len(self.known), dtype=bool)
        self.present[word] = True
        self.t3 = np.minimum(self.c3, 1)
        self.n2 = np.bincount(self.dish, weights=self.t3, minlength=len(keys)).astype(np.int64)
        self.t2 = np.minimum(self.n2, 1)
        self.split_pairs = len(f.pairs)
        self.count = np.zeros(len(self.known), dtype=np.int64)

    def without_tokens(self) -> "Section":
        """Types are enough for sweeps."""
        del self.which, self.doc, self.type, self.trained
        return self

    def _by_upper(self, uppers: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(upper partition, words present that belong there, dishes of split restaurants that do), in a fixed order."""
        g = (mix64(self.known ^ _C) % np.uint64(uppers)).astype(np.int64)
        words, dishes = np.flatnonzero(self.present), np.flatnonzero(self.apart >= 0)
        words, dishes = words[np.argsort(g[words], kind="stable")], dishes[np.argsort(g[self.served[dishes]], kind="stable")]
        edge_w, edge_d = np.searchsorted(g[words], np.arange(uppers + 1)), np.searchsorted(g[self.served[dishes]], np.arange(uppers + 1))
        for x in np.flatnonzero(np.diff(edge_w)):
            yield int(x), words[edge_w[x] : edge_w[x + 1]], dishes[edge_d[x] : edge_d[x + 1]]

    def up(self, uppers: int, first: bool) -> list[dict]:
        """What each upper partition gets: customers of the root by word (and, at first, counts), customers of split restaurants by dish."""
        here = self.apart < 0
        n1 = np.bincount(self.served[here], weights=self.t2[here], minlength=len(self.known)).astype("<u8")
        c = np.bincount(self.word, weights=self.c3, minlength=len(self.known)).astype("<u8")
        out = []
        for g, words, dishes in self._by_upper(uppers):
            place = np.searchsorted(words, self.served[dishes])
            counts = [c[words]] if first else [np.zeros(0, dtype="<u8")]
            out.append({"g": g, "z": _pack(self.known[words], n1[words], *counts, self.apart[dishes].astype("<u2"), place.astype("<u4"), self.n2[dishes].astype("<u8"))})
        return out

    def stats(self) -> list[float]:
        """Trained tokens, types and dishes with 1 and 2 customers, then customers and tables of the split pairs."""
        mine = self.n2[self.apart < 0]
        return [float(self.c3.sum()), *(float((x == k).sum()) for x in (mine, self.c3) for k in (1, 2)), *self.pair_totals().ravel()]

    def pair_totals(self) -> np.ndarray:
        kind = self.often[self.context]
        some = kind >= 0
        return np.stack([np.bincount(kind[some], weights=x[some], minlength=self.split_pairs) for x in (self.c3, self.t3)])

    def come_down(self, messages: pa.Scalar, uppers: int) -> None:
        """Take what the upper partitions answered: customers and tables of words at the root and of dishes in split restaurants, counts."""
        n = len(self.known)
        self.root = np.zeros((2, n))
        answers = {m["g"].as_py(): m["z"] for m in messages}
        for g, words, dishes in self._by_upper(uppers):
            n1, t1, c, n2, t2 = _unpack(answers[g].as_buffer())
            self.root[0, words], self.root[1, words] = n1, t1
            if len(c):
                self.count[words] = c
            self.n2[dishes], self.t2[dishes] = n2, t2

    def sweeps(self, totals: Totals, count: int, kept: int) -> np.ndarray | None:
        """Sweep the restaurants here again and again; each type's predictive probability, averaged over the last kept sweeps."""
        d0, d1, d2 = totals.discount
        p1 = root_probability(totals, *self.root)[self.served]
        inside = self.apart < 0
        contexts, words = len(self.pair), len(self.known)
        c = np.bincount(self.context, weights=self.c3, minlength=contexts)
        apart_pair = self.often >= 0
        c[apart_pair] = totals.pairs[0][self.often[apart_pair]]
        t = np.bincount(self.context, weights=self.t3, minlength=contexts)
        t[apart_pair] = totals.pairs[1][self.often[apart_pair]]
        moving = np.flatnonzero(self.c3 > 1)
        key3 = dish_key(self.pair[self.context[moving]], self.known[self.word[moving]])
        key2 = dish_key(self.known[self.rest], self.known[self.served])
        total = np.zeros(len(self.c3)) if kept else None

        def level_two() -> tuple[np.ndarray, np.ndarray]:
            n, t = (np.bincount(self.rest, weights=x, minlength=words) for x in (self.n2, self.t2))
            rank = self.split >= 0
            n[rank], t[rank] = totals.split[0][self.split[rank]], totals.split[1][self.split[rank]]
            return n, t

        def middle(n: np.ndarray, t: np.ndarray) -> np.ndarray:
            return (self.n2 - d1 * self.t2 + (STRENGTH[1] + d1 * t[self.rest]) * p1) / (STRENGTH[1] + n[self.rest])

        n, tables = level_two()
        p2 = middle(n, tables)
        for sweep in range(count):
            where = self.context[moving]
            new = seat(self.c3[moving], np.maximum(t[where] - self.t3[moving], 0), p2[self.dish[moving]], STRENGTH[2], d2, key3, sweep)
            change = new - self.t3[moving]
            self.t3[moving] = new
            t = np.where(apart_pair, t, t + np.bincount(where, weights=change, minlength=contexts))
            changed = np.bincount(self.dish[moving], weights=change, minlength=len(self.n2)).astype(np.int64)
            self.n2 = np.where(inside, self.n2 + changed, self.n2)
            self.t2 = np.minimum(self.t2, self.n2)
            some = np.flatnonzero(inside & (self.n2 > 1))
            self.t2[some] = seat(self.n2[some], tables[self.rest[some]] - self.t2[some], p1[some], STRENGTH[1], d1, key2[some], sweep)
            n, tables = level_two()
            p2 = middle(n, tables)
            if sweep >= count - kept:
                above, below = (STRENGTH[2] + d2 * t)[self.context], (STRENGTH[2] + c)[self.context]
                total += (self.c3 - d2 * self.t3 + above * p2[self.dish]) / below
        return None if total is None else total / kept

    def customers_of_split(self) -> None:
        """Before going up: the split restaurants' customers are the tables here."""
        n2 = np.bincount(self.dish, weights=self.t3, minlength=len(self.n2)).astype(np.int64)
        self.n2 = np.where(self.apart >= 0, n2, self.n2)


def root_probability(totals: Totals, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    d = totals.discount[0]
    return (n - d * t + (STRENGTH[0] + d * totals.root[1]) / (totals.words + 1)) / (STRENGTH[0] + totals.root[0])


# -- the upper partitions ---------------------------------------------------------------------

_ANSWER = "bucket int, g int, z binary, stats array<double>"


def _seat_above(f: Frequent, totals: Totals | None):
    """(bucket, g, z) of whole upper partitions to the answers, and statistics: words, then customers and tables of the root and
    of the split restaurants, then words and dishes with 1 and 2 customers. Rows without a partition pass on (their statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for bucket, g, z, stats in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if g < 0:
                    yield _batch([(bucket, g, b"", stats.as_py())], _ANSWER)
                else:
                    parts.setdefault(g, []).append((bucket, z.as_py()))
        for g in sorted(parts):
            rows = sorted(parts.pop(g))
            arrays = [_unpack(pa.py_buffer(z)) for _, z in rows]
            sizes = [len(a[0]) for a in arrays]
            known, at = np.unique(np.concatenate([a[0] for a in arrays]), return_inverse=True)
            add = lambda at, column, n: np.bincount(at, weights=np.concatenate([a[column] for a in arrays]), minlength=n).astype(np.int64)
            n1 = add(at, 1, len(known))
            first = len(arrays[0][2]) == len(arrays[0][0])
            c = add(at, 2, len(known)) if first else np.zeros(len(known), np.int64)
            rank = np.concatenate([a[3] for a in arrays]).astype(np.int64)
            place = np.concatenate([at[lo : lo + n][a[4]] for a, n, lo in zip(arrays, sizes, np.cumsum([0, *sizes]))])
            keys, dish = np.unique(rank * len(known) + place, return_inverse=True)
            rest, served = keys // max(1, len(known)), keys % max(1, len(known))
            n2 = add(dish, 5, len(keys))
            t2 = np.minimum(n2, 1)
            root = lambda: n1 + np.bincount(served, weights=t2, minlength=len(known)).astype(np.int64)
            t1 = np.minimum(root(), 1)
            if totals is not None:
                d0, d1, _ = totals.discount
                p1 = root_probability(totals, root(), t1)[served]
                some = np.flatnonzero(n2 > 0)
                t2[some] = seat(n2[some], np.maximum(totals.split[1][rest[some]] - t2[some], 0), p1[some], STRENGTH[1], d1, dish_key(f.words[rest[some]], known[served[some]]), SWEEPS)
                n = root()
                t1 = np.where(n > 0, np.maximum(t1, 1), 0)
                flat = np.full(len(known), 1 / (totals.words + 1))
                t1 = seat(n, np.maximum(totals.root[1] - t1, 0), flat, STRENGTH[0], d0, dish_key(np.full(len(known), START), known), SWEEPS)
            n0 = root()
            split = [np.bincount(rest, weights=x, minlength=len(f.words)) for x in (n2, t2)]
            counts = [float((c > 0).sum()), float(n0.sum()), float(t1.sum()), *split[0], *split[1], *(float((x == k).sum()) for x in (n0, n2) for k in (1, 2))]
            yield _batch([(-1, g, b"", counts)], _ANSWER)
            lo = dlo = 0
            for (bucket, _), a in zip(rows, arrays):
                mine, dishes = at[lo : lo + len(a[0])], dish[dlo : dlo + len(a[3])]
                lo, dlo = lo + len(a[0]), dlo + len(a[3])
                counts = c[mine].astype("<i8") if first else np.zeros(0, dtype="<i8")
                yield _batch([(bucket, g, _pack(n0[mine], t1[mine], counts, n2[dishes], t2[dishes]), None)], _ANSWER)

    return run


def _pass_up(f: Frequent, totals: Totals, uppers: int):
    """Buckets with their answers, swept, to what goes up again, and the split pairs' totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, data, extra, down in zip(b.column("bucket").to_pylist(), b.column("data"), b.column("extra"), b.column("down")):
                s = Section(f, data.as_buffer(), extra.as_buffer()).without_tokens()
                s.come_down(down, uppers)
                s.sweeps(totals, SWEEPS, 0)
                s.customers_of_split()
                rows = [(bucket, m["g"], m["z"], None) for m in s.up(uppers, first=False)] + [(bucket, -1, b"", s.pair_totals().ravel().tolist())]
                del s  # before the next one is made
                yield _batch(rows, _ANSWER)

    return run


def _pass_down(f: Frequent, totals: Totals, uppers: int):
    """Buckets with both answers (the first one for counts) to (block, m, scores): for each document, its tokens' known ones,
    base and log10 probability, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, extra, first, down in zip(b.column("data"), b.column("extra"), b.column("first"), b.column("down")):
                s = Section(f, data.as_buffer(), extra.as_buffer())
                s.come_down(first, uppers)
                s.come_down(down, uppers)
                score = np.log10(s.sweeps(totals, SWEEPS, KEPT))[s.type]
                count = s.count[s.word]
                base, known = np.log10(count + 1.0)[s.type], (count > 0)[s.type]
                at, docs = s.first[s.which] + s.doc, int(s.first[-1])
                n = np.bincount(at, minlength=docs)
                out = [np.bincount(at, weights=x, minlength=docs) for x in (known, base, score)]
                rows = []
                for block, lo, size in zip(s.blocks.tolist(), s.first.tolist(), s.docs.tolist()):
                    some = np.flatnonzero(n[lo : lo + size])
                    if len(some):
                        k, x, y = (v[lo + some] for v in out)
                        rows.append((block, _pack(some.astype("<u2"), k.astype("<u4"), np.rint(x * _FIXED).astype("<i8"), y.astype("<f4"))))
                del s, score, base, known, at, n, out, count
                yield _batch(rows, "block long, scores binary")

    return run


def _finish(tokens: float, words: float):
    """Blocks' documents with what their buckets gave, to a row per document."""
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.log10(tokens + words + 1)
        for b in batches:
            for data, scores in zip(b.column("data"), b.column("scores")):
                ids, null, held, size = _unpack(data.as_buffer())
                known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids))
                for x in sorted(z.as_py() for z in scores):  # in a fixed order
                    doc, k, whole_base, y = _unpack(pa.py_buffer(x))
                    known[doc] += k
                    base[doc] += whole_base
                    score[doc] += y
                arrays = (pa.array(ids, mask=null), pa.array(held), pa.array(size.astype(np.int64)), pa.array(known), pa.array(base / _FIXED - size * whole), pa.array(score))
                yield pa.RecordBatch.from_arrays(list(arrays), names=names)

    return run


def fold(id_column, folds: int = 7) -> "F.Column":
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def _sums(rows: DataFrame, column: str = "stats") -> np.ndarray:
    """Element-wise sum of an array column of some hundred elements."""
    got = rows.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["i"]] = r["x"]
    return out


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; held_out: a boolean column
    that says which documents are only scored."""
    spark = docs.sparkSession
    n = partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    f = _frequent(source.where("not held").select("id", "text"))
    size = int(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # an estimate by file sizes
    each = max(4, -(-(size if size < 1 << 60 else 0) // (BUCKET_BYTES * n)))
    names = own_names(spark, n, each)
    uppers = max(1, min(n, -(-size // UPPER_BYTES)))
    numbered = source.withColumn("row", F.monotonically_increasing_id())

    def dealt(parts: int) -> tuple[str, str]:
        """The buckets, as a bucketed table: they are shuffled once and met where they are."""
        folder, table = new_folder(spark, "dishes"), f"brindle_dishes_{uuid.uuid4().hex}"
        part_of = np.arange(len(names)) // n % parts
        for this in range(parts):
            rows = numbered.mapInArrow(_gather(f, names, part_of, this), _MESSAGE).repartition(n, "bucket").mapInArrow(_organise(f, uppers), _KEPT)
            rows.write.mode("append").bucketBy(n, "bucket").format("parquet").option("compression", "none").option("path", folder).saveAsTable(table)
            del rows
            free_shuffles(spark)
        return folder, table

    parts = PARTS if PARTED_BYTES <= size < 1 << 60 else 1
    folder, table = dealt(parts)
    if parts > 1 and not spark.table(table).where("bucket < 0").groupBy("block").count().where(F.col("count") != parts).isEmpty():
        spark.sql(f"drop table {table}")
        drop_folders(spark, folder)
        folder, table = dealt(1)
    kept = spark.table(table)
    buckets = kept.where("bucket >= 0").select("bucket", "data", "extra")

    def answered(messages: DataFrame, totals: Totals | None, label: str) -> DataFrame:
        return materialize(messages.repartition(n, "g").mapInArrow(_seat_above(f, totals), _ANSWER), label, compression="none")

    def met(left: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        packed = answers.where("bucket >= 0 and g >= 0").groupBy("bucket").agg(F.collect_list(F.struct("g", "z")).alias(name))
        return left.join(packed.hint("shuffle_hash"), "bucket")

    messages = kept.where("bucket >= 0").select("bucket", F.explode("up").alias("u")).select("bucket", "u.g", "u.z", F.lit(None).cast("array<double>").alias("stats"))
    first = answered(messages, None, "above")
    below, above = _sums(kept), _sums(first.where("bucket < 0"))
    w, p = len(f.words), len(f.pairs)
    below = below if len(below) else np.zeros(5 + 2 * p)
    above = above if len(above) else np.zeros(7 + 2 * w)
    rates = discounts(np.concatenate([above[-4:-2], above[-2:] + below[1:3], below[3:5]]))
    totals = Totals(rates, below[0], above[0], above[1:3], above[3 : 3 + 2 * w].reshape(2, w), below[5:].reshape(2, p))
    again = met(buckets, first, "down").mapInArrow(_pass_up(f, totals, uppers), _ANSWER)
    again = again.withColumn("g", F.when(F.col("g") >= 0, F.col("g")).otherwise(-1 - F.col("bucket")))
    second = answered(again, totals, "again")
    free_shuffles(spark)
    pairs, above = _sums(second.where("bucket >= 0")), _sums(second.where("bucket < 0"))
    if len(above):
        totals = Totals(rates, totals.tokens, totals.words, above[1:3], above[3 : 3 + 2 * w].reshape(2, w), pairs.reshape(2, p))
    scores = met(met(buckets, first, "first"), second, "down").mapInArrow(_pass_down(f, totals, uppers), "block long, scores binary")
    scores = materialize(scores, "scores", compression="none")
    blocks = materialize(kept.where("bucket < 0 and length(data) > 0").select("block", "data"), "blocks", compression="none")
    spark.sql(f"drop table {table}")
    drop_folders(spark, folder)
    free_shuffles(spark)
    met_scores = blocks.join(scores.groupBy("block").agg(F.collect_list("scores").alias("scores")), "block")
    out = met_scores.select("data", "scores").mapInArrow(_finish(totals.tokens, totals.words), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(totals.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
