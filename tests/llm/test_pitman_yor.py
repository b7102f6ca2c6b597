"""Scores against a plain sampler that keeps every restaurant in a dict and is fed the same draws."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute as pc
import pytest
from helpers import WORD, lower

from brindle.llm import pitman_yor as P
from brindle.llm.common import prefix_hashes, span_hashes

M = (1 << 64) - 1


def word_hash(w):
    if w is None:
        return int(P.END)
    if w == "<start>":
        return int(P.START)
    raw = np.frombuffer(w.encode(), np.uint8)
    return int(span_hashes(prefix_hashes(raw), np.array([0]), np.array([len(raw)]))[0])


def mix(x):
    x &= M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


A, B, C = int(P._A), int(P._B), int(P._C)


def pair(one, two):
    return mix(mix(one * A) + two * B)


def dish(context, word):
    return mix(mix(context * C) + word * A)


def draw(key, sweep, customer):
    return (mix(mix(key + P.SEED + sweep * B) + customer * A) >> 11) * 2.0**-53


def seated(n, others, p, theta, d, key, sweep):
    t, j = 1, 1
    while j < n:
        new = (theta + d * (others + t)) * p
        rate = new / (new + j - d * t)
        group = max(1, j // P.GROUP)
        t += sum(draw(key, sweep, i) < rate for i in range(j, min(n, j + group)))
        j += group
    return t


class Plain:
    def __init__(self, trained, split, pairs, codes):
        """trained: lists of word hashes. split, pairs: hashes of words and pairs whose restaurants are seated with the root."""
        self.split, self.pairs = split, pairs
        self.c3 = Counter()
        self.c1 = Counter()
        self.codes = codes
        for words in trained:
            for one, two, w in self.contexts(words):
                self.c3[one, two, w] += 1
                self.c1[w] += 1
        self.words = len(self.c1)
        t3 = dict.fromkeys(self.c3, 1)
        n2 = Counter((two, w) for _, two, w in self.c3)
        n1 = Counter(w for _, w in n2)
        ones = [[sum(x == k for x in c.values()) for k in (1, 2)] for c in (n1, n2, self.c3)]
        self.d = P.discounts(np.array(ones, dtype=float).ravel())
        self.c_pair = Counter()
        for (one, two, _), c in self.c3.items():
            self.c_pair[one, two] += c
        # a first pass below, the root, a second pass
        t2, t1 = dict.fromkeys(n2, 1), dict.fromkeys(n1, 1)
        split_t = Counter(two for two, _ in n2)
        split_n = Counter()
        for (two, _), n in n2.items():
            split_n[two] += n
        pair_t = Counter((one, two) for one, two, _ in self.c3)
        self.root = sum(n1.values()), sum(t1.values())
        state = self.lower(dict(t3), dict(n2), dict(t2), n1, t1, split_n, split_t, pair_t)
        a3, a2, at2 = state[-1][:3]
        new_n2 = Counter()
        for (_, two, w), t in a3.items():
            new_n2[two, w] += t
        up = Counter()
        for (two, w), t in at2.items():
            up[w] += t if two not in split else 0
        hot = {k: 1 for k in new_n2 if k[0] in split}
        base = lambda: up + Counter({w: sum(t for (_, x), t in hot.items() if x == w) for w in n1})
        n, ones_ = base(), 1
        fresh = {}
        for two, w in hot:
            p = self.p_root(n[w], ones_)
            fresh[two, w] = seated(new_n2[two, w], max(split_t[two] - 1, 0), p, P.STRENGTH[1], self.d[1], dish(two, w), P.SWEEPS)
        hot = fresh
        n = base()
        t1 = {w: seated(n[w], max(self.root[1] - 1, 0), 1 / (self.words + 1), P.STRENGTH[0], self.d[0], dish(int(P.START), w), P.SWEEPS) for w in n}
        split_n, split_t = Counter(), Counter()
        for k in hot:
            split_n[k[0]] += new_n2[k]
            split_t[k[0]] += hot[k]
        pair_t = Counter()
        for (one, two, _), t in a3.items():
            pair_t[one, two] += t
        self.root = sum(n.values()), sum(t1.values())
        start2 = {k: (new_n2[k] if k[0] in split else v) for k, v in n2.items()}
        startt = {k: (hot[k] if k[0] in split else 1) for k in n2}
        self.kept = self.lower(dict(t3), start2, startt, n, t1, split_n, split_t, pair_t)[-P.KEPT :]

    def contexts(self, words):
        """Words that have no code name contexts by 48 bits."""
        short = lambda h: h if h in self.codes else h & (1 << 48) - 1
        one = two = int(P.START)
        for w in words:
            yield one, two, w
            one, two = two, short(w)

    def p_root(self, n, t):
        d = self.d[0]
        return (n - d * t + (P.STRENGTH[0] + d * self.root[1]) / (self.words + 1)) / (P.STRENGTH[0] + self.root[0])

    def lower(self, t3, n2, t2, n1, t1, split_n, split_t, pair_t):
        out = []
        frozen = {k: t for k, t in pair_t.items() if k in self.pairs}
        p1 = lambda w: self.p_root(n1.get(w, 0), t1.get(w, 0))

        def level_two():
            n, t = Counter(), Counter()
            for (two, _), x in n2.items():
                n[two] += x
            for (two, _), x in t2.items():
                t[two] += x
            for two in self.split:
                n[two], t[two] = split_n[two], split_t[two]
            return n, t

        def p2(two, w, n, t):
            d = self.d[1]
            return (n2.get((two, w), 0) - d * t2.get((two, w), 0) + (P.STRENGTH[1] + d * t[two]) * p1(w)) / (P.STRENGTH[1] + n[two])

        n, t = level_two()
        for sweep in range(P.SWEEPS):
            t_pair = Counter()
            for (one, two, _), x in t3.items():
                t_pair[one, two] += x
            new = {}
            for (one, two, w), c in self.c3.items():
                others = max(frozen.get((one, two), t_pair[one, two]) - t3[one, two, w], 0)
                new[one, two, w] = seated(c, others, p2(two, w, n, t), P.STRENGTH[2], self.d[2], dish(pair(one, two), w), sweep)
            t3 = new
            fresh = Counter()
            for (_, two, w), x in t3.items():
                fresh[two, w] += x
            n2 = {k: (v if k[0] in self.split else fresh[k]) for k, v in n2.items()}
            t2 = {k: (v if k[0] in self.split else seated(n2[k], t[k[0]] - v, p1(k[1]), P.STRENGTH[1], self.d[1], dish(*k), sweep)) for k, v in t2.items()}
            n, t = level_two()
            t_pair = Counter()
            for (one, two, _), x in t3.items():
                t_pair[one, two] += x
            out.append((t3, n2, t2, dict(n), dict(t), t_pair | frozen, (n1, t1)))
        return out

    def probability(self, one, two, w):
        total = 0
        for t3, n2, t2, n, t, t_pair, (n1, t1) in self.kept:
            p = self.p_root(n1.get(w, 0), t1.get(w, 0))
            d = self.d[1]
            p = (n2.get((two, w), 0) - d * t2.get((two, w), 0) + (P.STRENGTH[1] + d * t.get(two, 0)) * p) / (P.STRENGTH[1] + n.get(two, 0))
            d = self.d[2]
            total += (self.c3.get((one, two, w), 0) - d * t3.get((one, two, w), 0) + (P.STRENGTH[2] + d * t_pair.get((one, two), 0)) * p) / (P.STRENGTH[2] + self.c_pair.get((one, two), 0))
        return total / P.KEPT

    def score(self, words):
        return sum(math.log10(self.probability(*x)) for x in self.contexts(words))


def corpus(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 80))
        words = [f"w{min(int(x), 400)}" for x in rng.zipf(1.4, n)]
        rows.append((i, i % 7 == 2, " ".join(words)))
    return rows + [(100, False, "the Same LINE again " * 40), (101, True, "the same line again new words"), (102, False, None)]


def score(spark, rows, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame(rows, "doc_id long, held boolean, text string").repartition(2)
        return {r.doc_id: r for r in P.score_documents(docs, docs["held"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("very", [3, 256])
def test_scores_equal_a_plain_sampler(spark, monkeypatch, very):
    """With few and with many words split, whatever the number of partitions."""
    monkeypatch.setattr(P, "VERY", very)
    rows = corpus()
    tokens = {i: [word_hash(w) for w in WORD.findall(lower(t))] + [word_hash(None)] for i, _, t in rows}
    source = spark.createDataFrame([(i, (t or "").encode()) for i, held, t in rows if not held], "id long, text binary")
    f = P._frequent(source)
    pairs = defaultdict(bool)
    for words in tokens.values():
        one = two = int(P.START)
        for w in words:
            if np.uint64(pair(one, two)) in f.pairs and np.uint64(two) in f.words:
                pairs[one, two] = True
            one, two = two, w
    assert len(pairs) >= 1
    plain = Plain([tokens[i] for i, held, _ in rows if not held], set(map(int, f.words)), set(pairs), set(map(int, f.codes)))
    want = {i: plain.score(w) for i, w in tokens.items()}
    for n in (2, 7):
        got = score(spark, rows, n)
        assert {i: r.score for i, r in got.items()} == pytest.approx(want, rel=1e-5)


def test_contexts_are_words(spark):
    """A sentence that training texts hold scores far above its words in another order."""
    rows = [(i, False, f"alpha beta gamma delta epsilon x{i} y{i}") for i in range(30)]
    rows += [(i, False, f"epsilon gamma x{i} alpha delta y{i} beta") for i in range(30, 34)]
    rows += [(90, True, "alpha beta gamma delta epsilon"), (91, True, "gamma alpha epsilon beta delta")]
    got = score(spark, rows, 4)
    assert got[90].score > got[91].score + 3 and got[90].base_score == pytest.approx(got[91].base_score)


def test_probabilities_of_a_context_sum_to_one(spark):
    """One held-out document for each word that can follow a context, and one for an unknown word."""
    rows = [(0, False, "a b c a b d a b c b b a"), (1, False, "b a b c d a")]
    for i, w in enumerate(["a", "b", "c", "d", "zzz"]):
        rows.append((10 + i, True, f"a b {w}"))
    rows.append((20, True, "a b"))
    got = score(spark, rows, 3)
    # P(a b w end) = P(a) P(b|a) P(w|a b) P(end|b w): ask the plain sampler for what isn't P(w|a b)
    source = spark.createDataFrame([(i, t.encode()) for i, held, t in rows if not held], "id long, text binary")
    f = P._frequent(source)
    tokens = {i: [word_hash(w) for w in t.split()] + [word_hash(None)] for i, _, t in rows}
    plain = Plain([tokens[0], tokens[1]], set(map(int, f.words)), set(), set(map(int, f.codes)))
    a, b, end, start = word_hash("a"), word_hash("b"), word_hash(None), int(P.START)
    before = math.log10(plain.probability(start, start, a)) + math.log10(plain.probability(start, a, b))
    total = sum(10 ** (got[10 + i].score - before - math.log10(plain.probability(b, word_hash(w), end))) for i, w in enumerate(["a", "b", "c", "d", "zzz"]))
    assert total + 10 ** (got[20].score - before) == pytest.approx(1, rel=1e-4)


def test_large_restaurants_are_seated_alike():
    """Groups stand for single customers: mean tables of 2,000 customers against seating one by one."""
    rng = np.random.default_rng(1)
    key = rng.integers(0, 2**63, 300).astype(np.uint64)
    t = P.seat(np.full(300, 2000), np.full(300, 50), np.full(300, 0.02), 1.0, 0.5, key, 0)
    want = []
    for _ in range(300):
        n = 1
        for j in range(1, 2000):
            new = (1 + 0.5 * (50 + n)) * 0.02
            n += rng.random() < new / (new + j - 0.5 * n)
        want.append(n)
    assert abs(t.mean() - np.mean(want)) < 4 * np.std(want) / math.sqrt(150)


def _scored(spark, docs):
    return sorted((repr(r.doc_id), *r[1:6], round(r.base_score, 5), round(r.score, 3)) for r in P.score_documents(docs, P.fold(docs["doc_id"]) == 2).collect())


def test_passes_deal_a_share_of_the_buckets_each(spark, monkeypatch, tmp_path):
    """Two passes send every token once and give the scores of one; passes that see other blocks give way to one."""
    rng = np.random.default_rng(5)
    rows = [(k if k % 9 else None, " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 80)) % 300)) for k in range(200)] + [(7, None), (7, ""), (7, "w1 w2 w1")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(P, "PARTED_BYTES", 1 << 61)
    once = _scored(spark, docs)
    calls, gather = [], P._gather

    def seen(f, names, part_of, this):
        calls.append((int(part_of.max()) + 1, float((part_of == this).mean())))
        return gather(f, names, part_of, this)

    monkeypatch.setattr(P, "PARTED_BYTES", 0)
    monkeypatch.setattr(P, "_gather", seen)
    assert _scored(spark, docs) == once and calls == [(2, 0.5), (2, 0.5)]

    def moved(f, names, part_of, this):
        run = seen(f, names, part_of, this)
        return (lambda batches: run(b.set_column(b.schema.get_field_index("row"), "row", pc.add(b.column("row"), 1)) for b in batches)) if this else run

    calls.clear()
    monkeypatch.setattr(P, "_gather", moved)
    assert _scored(spark, docs) == once and calls == [(2, 0.5), (2, 0.5), (1, 1.0)]
