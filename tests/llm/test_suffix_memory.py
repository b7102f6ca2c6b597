import tracemalloc

import numpy as np
import pyarrow as pa

from brindle.llm import suffix_dedup as S


def packed_texts():
    """Eight megabytes of texts in one batch, of which half is a passage that two texts share."""
    rng = np.random.default_rng(12)
    shared = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(500)]
    texts = [shared[i % 500] + rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
    return next(S._number_blocks(S._pack_texts([batch])))


def peak(run, batch):
    """MB of numpy arrays and Python objects at most, and the rows."""
    tracemalloc.start()
    try:
        rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_minimizers_of_a_batch_take_a_block_at_a_time():
    """Two workers of an executor do this side by side; before, eight megabytes of text took several hundred."""
    batch = packed_texts()
    assert len(set(batch.column("block").to_pylist())) == 4
    mb, rows = peak(S._entries(96), batch)
    starts, blocks = batch.column("start").to_numpy(), batch.column("block").to_pylist()
    got = {(r["block"], p) for r in rows if r["bucket"] >= 0 for p in np.frombuffer(r["places"], np.uint32).tolist()}
    want = set()
    for first, last, data, offsets in S._texts(batch, 1):
        firsts, (at, h) = {}, S.minimizers(data, offsets)
        for place, key in zip(at.tolist(), h.tolist()):
            firsts.setdefault(key, place)  # each text's own; no two texts of a block share one, or the first of them stands
        want |= {(blocks[first], int(starts[first]) + p) for p in firsts.values()}
    assert got <= want and {b for b, _ in got} == set(blocks)
    assert mb < 180, mb


def test_segments_of_a_batch_are_cut_out_in_slices():
    batch = packed_texts()
    places = [S.minimizers(data, offsets)[0].astype(np.uint32).tobytes() for _, _, data, offsets in S._texts(batch, 1)]
    mb, rows = peak(S._segments(96), batch.append_column("places", pa.array(places, pa.binary())))
    assert sum(r["n"] for r in rows) == sum(len(p) // 4 for p in places)
    texts, ids = [data.tobytes() for _, _, data, _ in S._texts(batch, 1)], batch.column("id").to_pylist()
    for r in rows[::7]:
        for x in np.frombuffer(pa.decompress(r["records"], r["n"] * S._RECORD.itemsize, codec="zstd", asbytes=True), S._RECORD)[::5]:
            text, at, left, right = texts[ids.index(x["id"])], *(int(x[k]) for k in ("at", "left", "right"))
            assert x["segment"][S.REACH - left : S.REACH + right].tobytes() == text[at - left : at + right]
            assert not x["segment"][: S.REACH - left].any() and not x["segment"][S.REACH + right :].any()
    assert mb < 300, mb
