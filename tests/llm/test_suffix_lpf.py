import numpy as np
import pytest
from test_documents import brute_removed

from brindle.llm import suffix_dedup as S


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_lpf_equals_brute_force():
    """Longest prefix shared with a suffix of smaller time, over texts with few letters."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        raw = rng.integers(97, 97 + rng.integers(2, 4), size=int(rng.integers(1, 90))).astype(np.uint8).tobytes()
        time = rng.integers(0, 12, size=len(raw))
        order = S.suffix_array(np.frombuffer(raw, np.uint8))
        lcp = np.array([0] + [common(raw[a:], raw[b:]) for a, b in zip(order, order[1:])])
        got = S.lpf_array(lcp, time[order])
        want = [max([common(raw[i:], raw[j:]) for j in range(len(raw)) if time[j] < time[i]], default=0) for i in order]
        assert got.tolist() == want


def test_window_lcp_is_real():
    """lcp values of suffixes of joined segments, up to a window's length."""
    rng = np.random.default_rng(5)
    base = rng.integers(97, 99, size=S.SEGMENT).astype(np.uint8)
    segments = np.array([np.where(rng.random(S.SEGMENT) < p, 99, base) for p in (0, 0, 0.01, 0.05, 0.2, 0.5)]).astype(np.uint8)
    data = segments.ravel()
    levels = S._window_ranks(data)
    suffix = np.array([w * S.SEGMENT + o for w in range(6) for o in range(S.REACH + 1)])
    order = suffix[np.argsort(levels[-1][1][suffix], kind="stable")]
    raw = data.tobytes()
    want = [0] + [min(common(raw[a:], raw[b:]), S.LENGTH) for a, b in zip(order.tolist(), order.tolist()[1:])]
    assert S._window_lcp(data, levels, order).tolist() == want and 0 < sum(0 < x < S.LENGTH for x in want)


def rows():
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, size=n)))
    passage = letters(120)
    return [(i, letters(40) + (passage[i : i + 80] if i % 2 else letters(30)) + letters(40)) for i in range(40)]


def removed(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeat_report(docs).collect()}


def test_spans_come_from_lpf():
    """The windows of a first document are repeated exactly where LPF says so: another LPF, another result."""
    text = [t.encode() for _, t in rows()]
    records = np.zeros(2, dtype=S._RECORD)
    a, b = 41 + 34, 43  # the same 16 bytes of the passage in documents 1 and 3
    passage_at = {1: 40, 3: 40}
    for k, (doc, shift) in enumerate(((1, 2), (3, 0))):
        at = passage_at[doc] + 20 + shift
        whole = text[doc]
        records[k] = (doc, doc, doc, at, min(at, S.REACH), min(len(whole) - at, S.LENGTH), np.frombuffer(whole[at - S.REACH : at + S.LENGTH], np.uint8))
    hits = lambda: sum(np.bitwise_count(np.frombuffer(h.as_buffer(), S._HIT)["mask"]).sum() for b in S._resolve_bucket(records) for h in b.column("hits"))
    real = S.lpf_array
    assert hits() > 0
    try:
        S.lpf_array = lambda lcp, time, least=1: np.zeros(len(lcp), dtype=np.int64)
        assert hits() == 0
        S.lpf_array = lambda lcp, time, least=1: np.full(len(lcp), S.LENGTH)
        assert hits() > 2 * (S.REACH + 1) - 10
    finally:
        S.lpf_array = real


def test_repeats_equal_brute_force_and_leave_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert removed(spark) == brute_removed(rows())
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("partitions", [1, 9])
def test_results_do_not_depend_on_partitions(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert removed(spark) == brute_removed(rows())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_the_largest_id_is_an_id(spark):
    last = 2**63 - 1
    got = S.repeat_report(spark.createDataFrame([(last, "x"), (None, "y")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {last, None}
