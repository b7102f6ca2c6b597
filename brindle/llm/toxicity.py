"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts common subsequences of three letters, each weighted by DECAY to the power of its span, up to a span of
SPAN. Between the letters may stand anything, so gapped and inserted-character insults keep most of their kernel value.
Landmarks are strings chosen from the labelled sentences; a linear SVM is trained on the Nyström features
K(x, landmarks) K(landmarks, landmarks)^(-1/2). As the features are linear in the landmarks' subsequence counts, the trained
machine folds into one weight per letter triple, and scoring is a sum of table look-ups over each window of WINDOW letters.
A document's margin is that of its worst window; Platt's sigmoid makes it a score.

Text is read in windows: runs of non-space characters, where single characters with spaces between them ("i d i o t") count
as one run. Letters are compared without case; anything else is a gap.

Labels are of documents, so training looks for the windows that explain them, as in multiple-instance learning: positives are
windows of the labelled toxic texts, negatives words and windows of the clean ones. A toxic text's first witnesses are its
windows that begin with strings which cover the toxic texts and hardly occur in clean ones; then, in rounds, the machine
takes its own worst window of each toxic text as a witness more, and its worst windows of clean texts as hard negatives.
Witnesses also count with characters put in (virtual examples). Landmarks are the witnesses' words and words of clean texts.
Training uses at most `max_labelled` labelled rows of each class, chosen by hash among those whose texts have at most
`max_chars` characters (both are documented parameters); scoring reads every whole text.

Defined cases: a null or empty text scores as a text without any window; a label that is null or names no document is
ignored; without labelled rows of both classes the score is 1 if all labels are toxic, else 0; a null id counts as the
empty string in the fold hash; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, mix64, own_prefix, run_starts, text_blocks
from .suffix_dedup import words8

DECAY = 0.75
SPAN = 6
WINDOW = 10
LETTERS = 32
SEED = 11
#: Strings from different words that explain a toxic document in training.
COVER = 3
#: Share of toxic documents among those that hold such a string.
PURE = 0.9
#: A clean document counts this much in the sigmoid: they are rarer among the training rows than among documents.
CLEAN_COST = 4.0
SLICE = 1 << 20
#: Bounds of training: strings tried for the cover, and words of clean texts among the negatives (frequent, rare).
STRINGS, FREQUENT_WORDS, RARE_WORDS = 3000, 2000, 4000
#: Witnesses that a toxic text starts with at most.
WITNESSES = 4
_TRIPLES = LETTERS**3
_OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]

#: 0: a gap; 1..26: a-z; 27..31: other letters, by the low bits of their last UTF-8 byte (equal for both cases in Latin-1).
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:192] = 27 + (np.arange(128, 192) & 31) % 5
_LEAD = 255
_CODE[192:256] = _LEAD


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, left, new offsets): a code per character but spaces, and how many of its window's characters are left from it on."""
    code = _CODE[data]
    space = SPACE[data]
    # a space between two single characters is a gap, not an end
    keep = code != _LEAD
    place = np.concatenate([[0], np.cumsum(keep)])
    offsets = place[offsets]
    code, space = code[keep], space[keep]
    n = len(code)
    if not n:
        return code, np.zeros(0, dtype=np.int32), offsets
    solid = ~space
    before, after = np.zeros(n + 2, dtype=bool), np.zeros(n + 2, dtype=bool)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    # single: a solid character with nothing solid beside it
    before[1:n] = solid[:-1]
    before[:n][edge[:n]] = False
    after[: n - 1] = solid[1:]
    after[: n - 1][edge[1:n]] = False
    single = solid & ~before[:n] & ~after[:n]
    joined = np.zeros(n, dtype=bool)
    if n > 2:
        joined[1:-1] = space[1:-1] & single[:-2] & single[2:] & ~edge[1 : n - 1] & ~edge[2:n]
    end = space & ~joined
    # distance to the next end of window
    stop = np.flatnonzero(end | np.append(edge[1:n], True) if n else end)
    left = np.zeros(n, dtype=np.int32)
    if n:
        which = np.searchsorted(stop, np.arange(n))
        last = stop[which]
        left = (last - np.arange(n) + ~end[last]).astype(np.int32)
    return code, left, offsets


def start_sums(code: np.ndarray, left: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every character, the weighted sum of weights[triple] over the subsequences that begin there."""
    out = np.zeros(len(code), dtype=np.float64)
    live = np.flatnonzero((left > 2) & (code > 0))
    first = code[live].astype(np.int32) * (LETTERS * LETTERS)
    width = 2
    for a, b in _OFFSETS:
        if b != width:
            some = left[live] > b
            live, first, width = live[some], first[some], b
        out[live] += weights[first + code[live + a].astype(np.int32) * LETTERS + code[live + b]] * DECAY**b
    return out


def window_values(code: np.ndarray, left: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every character, the value of the window of WINDOW characters that begins there."""
    total = np.concatenate([[0.0], np.cumsum(start_sums(code, left, weights))])
    at = np.arange(len(code))
    return total[at + np.minimum(left, WINDOW)] - total[at]


def worst(code: np.ndarray, left: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest window value, where) of each document; 0 and -1 without any."""
    n = len(offsets) - 1
    best, where = np.zeros(n), np.full(n, -1)
    first = 0
    while first < n:  # about SLICE characters at a time
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        at = offsets[first]
        value = window_values(code[at : offsets[last]], left[at : offsets[last]], weights)
        for d in range(first, last):
            if offsets[d + 1] > offsets[d]:
                where[d] = offsets[d] + int(np.argmax(value[offsets[d] - at : offsets[d + 1] - at]))
                best[d] = value[where[d] - at]
        first = last
    return best, where


def _features(strings: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """Sums of matrix rows over the subsequences of each string: kernel values against the matrix's landmarks."""
    out = np.zeros((len(strings), matrix.shape[1]))
    for i, s in enumerate(strings):
        code = _CODE[np.frombuffer(s, dtype=np.uint8)]
        code = code[code != _LEAD][: WINDOW + SPAN].astype(np.int64)
        for a, b in _OFFSETS:
            n = min(len(code) - b, WINDOW)
            if n > 0:
                t = code[:n] * (LETTERS * LETTERS) + code[a : a + n] * LETTERS + code[b : b + n]
                t = t[(code[:n] > 0) & (code[a : a + n] > 0) & (code[b : b + n] > 0)]
                out[i] += matrix[t].sum(axis=0) * DECAY**b
    return out


def _profile(s: bytes) -> np.ndarray:
    """A string's weighted subsequence counts."""
    out = np.zeros(_TRIPLES)
    code = _CODE[np.frombuffer(s, dtype=np.uint8)]
    code = code[code != _LEAD].astype(np.int64)
    for a, b in _OFFSETS:
        n = len(code) - b
        if n > 0:
            ok = (code[:n] > 0) & (code[a : a + n] > 0) & (code[b : b + n] > 0)
            np.add.at(out, (code[:n] * (LETTERS * LETTERS) + code[a : a + n] * LETTERS + code[b : b + n])[ok], DECAY**b)
    return out


def kernel(s: bytes, t: bytes) -> float:
    """The subsequence kernel of two strings."""
    return float(_profile(s) @ _profile(t))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 3e-2) -> np.ndarray:
    """Squared-hinge linear SVM with bias (last weight), by Newton steps on the active set."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    eye[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < 1
        if not on.any():
            break
        a = x[on] * cost[on, None]
        new = np.linalg.solve(eye + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, rtol=1e-6, atol=1e-8):
            break
        w = new
    return w


@dataclass(frozen=True)
class Model:
    """weights: by letter triple; margin = worst window + bias; score = sigmoid(slope * margin + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        code, left, offsets = letters_of(data, offsets)
        value = window_values(code, left, self.weights)
        best = np.zeros(len(offsets) - 1)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full):
            best[full] = np.maximum(0.0, np.maximum.reduceat(value, offsets[full])) if self.bias < 0 else np.maximum.reduceat(value, offsets[full])
        return 1 / (1 + np.exp(-np.clip(self.slope * (best + self.bias) + self.shift, -40, 40)))


_EDGES = b".,;:!?()[]\"'*%$&#-_"


def _gapped(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with characters put in: one gap, one letter, and gaps all over."""
    if len(word) < 4:
        return []
    at = int(rng.integers(1, len(word)))
    letter = bytes([int(rng.integers(97, 123))])
    out = [word[:at] + b"*" + word[at:]] + ([word[:at] + letter + word[at:]] if len(word) > 4 else [])
    return out + ([b".".join(bytes([c]) for c in word)] if max(word) < 128 else [])


def _witnesses(text: bytes, strings: list[bytes]) -> list[int]:
    """Where the first WITNESSES of a text's windows begin that start with one of the strings (places count characters)."""
    lower, found = text.lower(), {}
    for rank, s in enumerate(strings):
        at = lower.find(s)
        if at >= 0:
            found.setdefault(at, rank)
    best = sorted(found, key=found.get)[:WITNESSES]
    whole = np.concatenate([[0], np.cumsum(_CODE[np.frombuffer(text, np.uint8)] != _LEAD)])
    return [int(whole[at]) for at in best]


def _apart(texts: list[bytes], hashes: int = 8, alike: int = 3) -> list[int]:
    """Which training texts to keep: none that shares `alike` of `hashes` word min-hashes with one before it, since near
    copies of a document make all its words look telling."""
    odd = np.random.default_rng(SEED).integers(1, 2**63, size=hashes, dtype=np.uint64) | np.uint64(1)
    held: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, t in enumerate(texts):
        words = {zlib.crc32(w) for w in t.lower().split()}
        h = np.fromiter(words, dtype=np.uint64, count=len(words))
        least = [int(x) for x in mix64(h[:, None] * odd).min(axis=0)] if len(h) else []
        met = Counter(j for k in enumerate(least) for j in held.get(k, ()))
        if len(h) >= 10 and met and max(met.values()) >= alike:
            continue
        out.append(i)
        for k in enumerate(least):
            held.setdefault(k, []).append(i)
    return out


def _string_counts(docs: list[np.ndarray], names: list[bytes], least: int, wanted: dict[bytes, int] | None = None) -> dict[bytes, int]:
    """In how many documents (of word numbers) a word, or a part of 4 to 6 bytes of a word, stands, if in `least` or more.
    Parts are numbers of up to six bytes, counted in slices, so that little memory is needed. wanted: only these."""
    ids = np.concatenate([np.zeros(0, np.int32), *docs])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    by_word = np.argsort(ids, kind="stable")
    used, first, times = np.unique(ids[by_word], return_index=True, return_counts=True)
    doc = doc[by_word]
    out = {names[i]: int(n) for i, n in zip(used.tolist(), times.tolist()) if n >= least and not 4 <= len(names[i]) <= 6 and (wanted is None or names[i] in wanted)}
    size = np.array([len(names[i]) for i in used.tolist()], dtype=np.int64)
    data = np.frombuffer(b"".join(names[i] for i in used.tolist()), np.uint8)
    start, owner = np.cumsum(size) - size, np.repeat(np.arange(len(used)), size)
    whole = words8(data)
    left = np.repeat(start + size, size) - np.arange(len(data))
    for n in (4, 5, 6):
        ok = left >= n
        code, word = whole[ok] >> np.uint64(8 * (8 - n)), owner[ok]
        if wanted is not None:
            known = np.array(sorted(int.from_bytes(g, "big") for g in wanted if len(g) == n), dtype=np.uint64)
            some = np.isin(code, known)
            code, word = code[some], word[some]
        part = mix64(code) % np.uint64(8)
        for k in range(8):
            c, w = code[part == k], word[part == k]
            values, c = np.unique(c, return_inverse=True)
            pairs = np.repeat(c, times[w]) * max(1, len(docs)) + doc[np.repeat(first[w], times[w]) + np.arange(times[w].sum()) - np.repeat(np.cumsum(times[w]) - times[w], times[w])]
            count = np.bincount(np.sort(pairs)[run_starts(np.sort(pairs))[:-1]] // max(1, len(docs)), minlength=len(values)) if len(pairs) else np.zeros(0, int)
            out |= {int(values[i]).to_bytes(n, "big"): int(count[i]) for i in np.flatnonzero(count >= least)}
    return out


def _grams(word: bytes) -> set[bytes]:
    """A word and its parts of 4 to 6 bytes."""
    return {word[i : i + n] for n in (4, 5, 6) for i in range(len(word) - n + 1)} | {word}


def train(texts: list[bytes], toxic: np.ndarray, landmarks: int = 256, rounds: int = 6) -> Model:
    """Fit on labelled texts."""
    seen: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        seen.setdefault(t, i)
    keep = sorted(seen.values())
    texts, toxic = [texts[i] for i in keep], toxic[keep].astype(bool)
    if not texts or toxic.all() or not toxic.any():
        return Model(np.zeros(_TRIPLES), 0.0, 1.0, 0.0, float(len(texts) > 0 and bool(toxic.all())))
    rng = np.random.default_rng(SEED)
    keep = _apart(texts)
    texts, toxic = [texts[i] for i in keep], toxic[keep]
    places: dict[bytes, int] = {}  # each word once, documents by number
    words = [np.fromiter({places.setdefault(w, len(places)) for x in t.lower().split() if 3 <= len(w := x.strip(_EDGES)) <= 40}, dtype=np.int32) for t in texts]
    names = list(places)
    del places
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    # counts of documents by the strings in their words; only strings of several toxic documents are kept
    in_toxic = Counter(_string_counts([ws for ws, bad in zip(words, toxic) if bad], names, max(2, n_toxic // 500)))
    in_clean = Counter(_string_counts([ws for ws, bad in zip(words, toxic) if not bad], names, 1, in_toxic))
    held = np.bincount(np.concatenate([np.zeros(0, np.int32), *(ws for ws, bad in zip(words, toxic) if not bad)]), minlength=len(names))
    clean_words_in = Counter({names[i]: int(held[i]) for i in np.flatnonzero(held)})
    gain = {w: np.sqrt(k) * (np.log((k + 0.5) / (n_toxic + 1)) - np.log((in_clean[w] + 0.5) / (n_clean + 1))) for w, k in in_toxic.items()}
    # only what toxic documents hold more often than chance explains, given how many strings are tried
    rate, bar = n_toxic / (n_toxic + n_clean), np.log(len(in_toxic) + 1) + 3

    def surprise(k: int, other: int) -> float:
        n = k + other
        return k * np.log(k / (n * rate)) + (other * np.log(other / (n * (1 - rate))) if other else 0.0)

    gain = {w: g for w, g in gain.items() if g > 0 and surprise(in_toxic[w], in_clean[w]) > bar and in_toxic[w] >= PURE * (in_toxic[w] + in_clean[w])} or gain
    # strings that cover the toxic documents: a greedy cover, so that what only keeps company with insults adds little;
    # a document stays open until COVER strings from different words explain it
    need = {i: COVER for i in range(len(words)) if toxic[i]}
    ranked = sorted((w for w in gain if gain[w] > 0), key=lambda w: (-gain[w], w))[:STRINGS]
    holders: dict[bytes, set[int]] = {w: set() for w in ranked}
    within: dict[bytes, Counter] = {w: Counter() for w in ranked}  # the words that a string is part of
    for i in need:
        for word in map(names.__getitem__, words[i]):
            for w in _grams(word) & holders.keys():
                holders[w].add(i)
                within[w][word] += 1
    cover: list[bytes] = []
    while need and ranked and len(cover) < landmarks:
        share = lambda w: len(holders[w] & need.keys()) * gain[w] / np.sqrt(len(holders[w]) or 1)
        best = max(ranked, key=lambda w: (share(w), len(w), w))
        if len(holders[best] & need.keys()) < 2:
            break
        cover.append(best)
        for i in holders[best] & need.keys():
            need[i] -= 1
            if not need[i]:
                del need[i]
        # other parts of the same words are explained by this one
        ranked = [w for w in ranked if 2 * sum(k for word, k in within[w].items() if best in word) < sum(within[w].values())]
    if not cover:
        cover = sorted(in_toxic, key=lambda w: (-in_toxic[w], w))[:1] or [b"###"]
    # the words of toxic documents that hold them, as they are written there
    held = np.bincount(np.concatenate([ws for ws, bad in zip(words, toxic) if bad]), minlength=len(names))
    around = Counter({w: int(held[i]) for i in np.flatnonzero(held) if (w := names[i]) not in clean_words_in and any(g in w for g in cover)})
    picked = list(dict.fromkeys([*cover, *(w for w, _ in sorted(around.items(), key=lambda x: (-x[1], x[0]))[: 2 * landmarks])]))
    in_clean = clean_words_in
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT_WORDS]]
    rare = sorted(w for w in in_clean if in_clean[w] < 3)
    clean_words = common + [rare[i] for i in rng.permutation(len(rare))[:RARE_WORDS]]
    marks = picked[: landmarks // 2]
    marks = list(dict.fromkeys(marks + clean_words[: landmarks - len(marks)]))
    del words, names, held, in_toxic, in_clean, clean_words_in, gain, holders, within, around  # the driver's memory is small
    matrix, filled = np.empty((_TRIPLES, len(marks))), 0
    for mark in marks:
        profile = _profile(mark)
        if profile.any():
            matrix[:, filled] = profile / np.sqrt((profile**2).sum())
            filled += 1
    matrix = matrix[:, :filled]
    if not matrix.shape[1]:
        return Model(np.zeros(_TRIPLES), 0.0, 1.0, 0.0, n_toxic / (n_toxic + n_clean))
    values, vectors = np.linalg.eigh(matrix.T @ matrix)
    some = values > 1e-6 * values.max()
    whiten = vectors[:, some] / np.sqrt(values[some])  # K_LL^(-1/2) on its range
    basis = matrix @ whiten  # letter triple -> Nyström feature
    del matrix

    room = sum(map(len, texts))
    code, left, offsets, at = np.empty(room, dtype=np.uint8), np.empty(room, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64), 0
    for i in range(0, len(texts), 200):
        some = texts[i : i + 200]
        c, rest, o = letters_of(np.frombuffer(b"".join(some), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
        code[at : at + len(c)], left[at : at + len(c)], offsets[i + 1 : i + 1 + len(some)] = c, rest, o[1:] + at
        at += len(c)
    code, left = code[:at], left[:at]

    def windows(where: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(where), basis.shape[1]))
        for i, p in enumerate(where):
            part, rest = code[p : p + WINDOW + SPAN].astype(np.int64), left[p : p + WINDOW + SPAN]
            for a, b in _OFFSETS:
                n = min(len(part) - b, WINDOW)
                if n > 0:
                    x, y, z = part[:n], part[a : a + n], part[b : b + n]
                    ok = (x > 0) & (y > 0) & (z > 0) & (rest[:n] > b) & (rest[:n] + np.arange(n) == rest[0])
                    rows[i] += basis[(x * LETTERS + y)[ok] * LETTERS + z[ok]].sum(axis=0) * DECAY**b
        return rows

    bad = [i for i in range(len(texts)) if toxic[i]]
    first = [offsets[i] + at for i in bad for at in _witnesses(texts[i], picked)] or [offsets[i] for i in bad if offsets[i + 1] > offsets[i]]
    if not first:  # the toxic texts hold nothing to learn from
        return Model(np.zeros(_TRIPLES), 0.0, 1.0, 0.0, n_toxic / (n_toxic + n_clean))
    virtual = _features([g for w in picked for g in _gapped(w, rng)], basis)
    witnesses = windows(np.array(first, dtype=np.int64))
    negative = [_features(clean_words, basis)]
    w = np.zeros(basis.shape[1] + 1)
    best = np.zeros(len(texts))
    for turn in range(rounds):
        x = np.concatenate([witnesses, virtual, *negative])
        n_pos = len(witnesses) + len(virtual)
        y = np.where(np.arange(len(x)) < n_pos, 1.0, -1.0)
        w = _svm(x, y, np.where(y > 0, len(y) / (2 * n_pos), 2 * len(y) / (2 * (len(y) - n_pos))))
        best, where = worst(code, left, offsets, basis @ w[:-1])
        margin = best + w[-1]
        hard = where[~toxic & (where >= 0) & (margin > -1)]
        if turn + 1 < rounds:
            negative.append(windows(hard))
            found = where[toxic & (where >= 0) & (margin > 0)]  # the texts that the machine explains, by its own witness
            witnesses = windows(np.unique(np.concatenate([np.array(first, dtype=np.int64), found])))
    margin = best + w[-1]
    # insults with characters put in count as toxic in the sigmoid too; each as a text of its own
    more = _features([g for word in picked[:landmarks] for g in _gapped(word, rng)], basis) @ w[:-1] + w[-1]
    slope, shift = _platt(np.concatenate([margin, more]), np.concatenate([toxic, np.ones(len(more), bool)]), np.concatenate([np.ones(len(margin)), np.full(len(more), 0.25 * n_toxic / max(1, len(more)))]))
    return Model((basis @ w[:-1]).astype(np.float64), float(w[-1]), slope, shift)


def _platt(margin: np.ndarray, toxic: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton's method, with Platt's smoothed targets."""
    up, down = cost[toxic].sum(), cost[~toxic].sum()
    target = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    cost = np.where(toxic, cost, CLEAN_COST * cost)
    cost = cost / cost.sum()
    middle, scale = margin.mean(), margin.std() + 1e-9
    x = np.column_stack([(margin - middle) / scale, np.ones(len(margin))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((cost * (np.logaddexp(0, z) - target * z)).sum() + 1e-6 * (w @ w))

    w = np.array([1.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (cost * (p - target)) + 2e-6 * w
        step = np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w) - 1e-4 * size * (grad @ step):
            size /= 2
        w = w - size * step
        if size * np.abs(step).max() < 1e-7:
            break
    slope, shift = float(w[0] / scale), float(w[1] - w[0] * middle / scale)
    return (slope, shift) if slope > 0 else (1.0, 0.0)


# -- DataFrame operator -----------------------------------------------------------------------


def fold(id_column, folds: int = 5) -> "F.Column":
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 2500, max_chars: int = 100_000) -> Model:
    """Train on labelled documents: of each class max_labelled labels, the first by hash of those whose texts have up to max_chars."""
    known = docs.where(F.col(text).isNotNull() & (F.length(text) <= max_chars)).select(F.col(id_col).alias("_id"))
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).alias("_y"))
    ticket = F.xxhash64(F.col("_id").cast("string"), F.lit(SEED))
    rows = rows.join(known, "_id", "left_semi").distinct()
    chosen = materialize(rows.where("_y = 0").orderBy(ticket, "_id").limit(max_labelled).union(rows.where("_y = 1").orderBy(ticket, "_id").limit(max_labelled)), "labels")
    # at most 2 * max_labelled rows are broadcast
    found = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text")).where(F.col("_text").isNotNull() & (F.length("_text") <= max_chars))
    # of rows that repeat an id one is taken, so that what comes to the driver is bounded too
    found = found.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    # the bounded sample is trained on in one task, so that neither texts nor features come to the driver
    row = found.select("_id", "_y", F.col("_text").cast("binary").alias("_text")).repartition(1).mapInArrow(_trained, _MODEL).first()
    if row is None:
        return train([], np.zeros(0, dtype=int))
    return Model(np.frombuffer(row["weights"], np.float64), row["bias"], row["slope"], row["shift"], row["constant"])


_MODEL = "weights binary, bias double, slope double, shift double, constant double"


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled rows to one row: the model."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    rows.sort()
    m = train([r[2] for r in rows], np.array([r[1] for r in rows], dtype=int))
    values = (m.weights.astype(np.float64).tobytes(), m.bias, m.slope, m.shift, m.constant)
    kinds = (pa.binary(), *[pa.float64()] * 4)
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in _MODEL.split(", ")])


def score_documents(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs without its text, with a score between 0 and 1 in column name (one of that name is replaced); each whole text is read."""
    rest, body = [c for c in docs.columns if c not in (text, name)], own_prefix(docs) + "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, body):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(model.score(data, offsets))], names=[*rest, name])

    source = docs.select(*rest, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(body))
    return source.mapInArrow(run, docs.select(*rest).schema.add(name, "double"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more. All columns stay."""
    columns, body = docs.columns, own_prefix(docs) + "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, body):
            clean = model.score(data, offsets) < threshold
            yield rows.select(columns).filter(pa.array(clean))

    return docs.withColumn(body, F.coalesce(F.col(text).cast("binary"), F.lit(b""))).mapInArrow(run, docs.schema)
