"""Exact top-k inner-product search with ball trees.

The vectors are dealt to shards by hash; a task takes one shard at a time from its sorted stream, builds a ball tree over it
(nodes split by their two far poles, inner nodes kept), and then lets the query blocks that follow descend it: branch and
bound, the child of higher upper bound q.centre + |q| * radius first, subtrees left out whole when their bound is below the
query's current k-th score. Queries meet the shards in waves, one shard in the first and four times as many in each later
one; after each wave the k-th scores of all shards so far are shared, so that later waves prune from the root on. A shard's
vectors travel once a wave, whatever the number of queries; nothing is broadcast.

Components are quantised to integers and scores are exact integers: sums in double precision where these are exact, else in
64-bit integers, else in Python's (scores beyond a long stop at its ends), all through the same tree.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors meet those of their own
length; a candidate never is its own query's row (of queries given as a table of their own, rows with the query's id are left
out); ties go to the smaller id; fewer candidates than k give fewer rows; repeated ids are separate candidates, and separate
queries with a set of rows each; null ids are no queries, and as candidates come after all others on ties; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

LEAF = 64
#: Queries that descend a tree together.
BLOCK = 2048
#: Vectors of a shard: at least, and bytes of components at most.
SHARD, SHARD_BYTES = 4096, 64 << 20
#: Below this, sums of products are exact in double precision; and in 64-bit integers.
_EXACT, _LONG = 2.0**52, 2.0**62
_LAST = np.iinfo(np.int64).max
_NONE = -np.inf


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of every component; rows that take no part are left out."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("x"))
    lifted = F.transform("x", lambda x: x * F.lit(scale))
    whole = F.transform(lifted, lambda x: F.rint(x))
    return out.select("id", F.zip_with(lifted, whole, lambda x, r: F.when(r > x, r - 1).otherwise(r)).alias("v"))


class BallTree:
    """Balls over the rows of x. Node i holds order[first[i]:last[i]]; child[i] is its left child (the right one follows), 0 for a leaf."""

    def __init__(self, x: np.ndarray, leaf: int | None = None) -> None:
        leaf = leaf or LEAF
        self.order = np.arange(len(x))
        self.first, self.last, self.child = [0], [len(x)], [0]
        centres, radii, i = [], [], 0
        while i < len(self.first):
            a, b = self.first[i], self.last[i]
            part = x[self.order[a:b]]
            centre = part.mean(axis=0)
            apart = ((part - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(np.sqrt(apart.max(initial=0)))
            if b - a > leaf:
                far = part[np.argmax(apart)]
                pole = part[np.argmax(((part - far) ** 2).sum(axis=1))]
                middle = a + (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part @ (pole - far), (b - a) // 2)]
                self.child[i] = len(self.first)
                self.first += [a, middle]
                self.last += [middle, b]
                self.child += [0, 0]
            i += 1
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.longest = np.abs(self.centres).max(initial=0)


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row, the positions of the k best by (score descending, id ascending)."""
    return np.lexsort((ids, -scores), axis=1)[:, :k]


@dataclass
class Work:
    """What a search did: leaves scored and subtrees left out, each times queries."""

    scored: int = 0
    pruned: int = 0


def search(x: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, mine: np.ndarray, k: int, floor: np.ndarray, tree: BallTree | None = None, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows of x for each row of q, -inf where there is none that can beat floor.

    A candidate is left out if its own is the query's mine. Exact: a subtree is left out only if its bound, with room for
    rounding, is below the k-th score known so far.
    """
    tree, work = tree or BallTree(x), work or Work()
    size = max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) * max(x.shape[1], 1)
    kind = np.float64 if size < _EXACT else np.int64 if size < _LONG else object
    best = np.full((len(q), k), _NONE, dtype=np.float64 if kind is np.float64 else object)
    who = np.full((len(q), k), _LAST)
    if kind is not np.float64:
        x, q = (m if kind is np.float64 else m.astype(np.int64) if kind is np.int64 else np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape) for m in (x, q))
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    centres, flat = tree.centres, q.astype(np.float64)
    kth = floor.astype(np.float64).copy()

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        b = flat[rows] @ centres[node] + norms[rows] * tree.radii[node]
        return b + 1e-9 * (np.abs(b) + norms[rows] * (tree.longest + 1)) + 1e-6

    def visit(node: int, rows: np.ndarray, bounds: np.ndarray) -> None:
        going = bounds >= kth[rows]
        work.pruned += len(rows) - int(going.sum())
        rows = rows[going]
        if not len(rows):
            return
        left = tree.child[node]
        if not left:
            score(rows, tree.order[tree.first[node] : tree.last[node]])
            return
        one, two = bound(left, rows), bound(left + 1, rows)
        nearer = one >= two
        for side, first, then in ((nearer, left, left + 1), (~nearer, left + 1, left)):
            group = rows[side]
            if len(group):
                a, b = (one, two) if first == left else (two, one)
                visit(first, group, a[side])
                visit(then, group, b[side])

    def score(rows: np.ndarray, here: np.ndarray) -> None:
        work.scored += len(rows)
        s = q[rows] @ x[here].T
        s = s if kind is np.float64 else s.astype(object)
        out = np.broadcast_to(own[here], s.shape) == mine[rows][:, None]
        s = np.where(out, _NONE, s)
        reach = (s >= kth[rows][:, None]).any(axis=1)
        rows, s, out = rows[reach], s[reach], out[reach]
        if not len(rows):
            return
        both, names = np.concatenate([best[rows], s], axis=1), np.concatenate([who[rows], np.where(out, _LAST, ids[here])], axis=1)
        top = _better(both, names, k)
        best[rows], who[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        kth[rows] = np.maximum(floor[rows], best[rows, -1].astype(np.float64))

    if len(x) and len(q):
        everyone = np.arange(len(q))
        visit(0, everyone, bound(0, everyone))
    return best, who


def _long(scores: np.ndarray) -> pa.Array:
    if scores.dtype == object:
        return pa.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], pa.int64())
    return pa.array(scores.astype(np.int64))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _numbers(column: pa.Array, missing: int) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False)


_FOUND = "q long, query_id long, vec_id long, score long"


def _descend(k: int):
    """Rows in order of (shard, kind), a shard's vectors before its queries, to candidates (q, query_id, vec_id, score)."""

    def answer(shard: tuple, block: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
        x, ids, own, tree = shard
        block = block.combine_chunks()
        at = {c: block.column(c).combine_chunks() if block.num_rows else block.column(c) for c in ("id", "own", "q", "floor", "v")}
        qids, qs = at["id"].to_numpy(), at["q"].to_numpy()
        best, who = search(x, ids, own, _matrix(at["v"], width), _numbers(at["own"], _LAST), k, _numbers(at["floor"].cast(pa.float64()), 0), tree)
        row, col = np.nonzero(best != _NONE)
        found = who[row, col]
        yield pa.RecordBatch.from_arrays([pa.array(qs[row]), pa.array(qids[row]), pa.array(found, mask=found == _LAST), _long(best[row, col])], names=["q", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, vectors, shard, waiting = None, [], None, []
        width = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, vectors, waiting
            if not waiting:
                return
            if shard is None:
                t = pa.Table.from_batches(vectors) if vectors else None
                if t is not None:
                    at = {c: t.column(c).combine_chunks() for c in ("id", "own", "v")}
                    x = _matrix(at["v"], width)
                    shard, vectors = (x, _numbers(at["id"], _LAST), _numbers(at["own"], _LAST - 1), BallTree(x)), []
            if shard is not None:
                yield from answer(shard, pa.Table.from_batches(waiting), width)
            waiting = []

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            widths = batch.column("width").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (widths[1:] != widths[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
            for a, b in zip(cuts, cuts[1:]):
                if (widths[a], shards[a]) != name:
                    yield from flush()
                    name, width, vectors, shard = (widths[a], shards[a]), int(widths[a]), [], None
                part = batch.slice(a, b - a)
                if not kinds[a]:
                    vectors.append(part)
                    continue
                waiting.append(part)
                if sum(w.num_rows for w in waiting) >= BLOCK:
                    yield from flush()
        yield from flush()

    return run


def top_k(vectors: DataFrame, queries: DataFrame | Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors are (id long, v array<double> of whole numbers); queries are a condition on
    them, or a table of the same columns."""
    spark = vectors.sparkSession
    n = partitions(spark)
    row = F.monotonically_increasing_id()
    if isinstance(queries, Column):
        rows = materialize(vectors.select("id", "v", F.coalesce(queries, F.lit(False)).alias("asks"), row.alias("own")), "vectors")
        vectors, asked = rows.drop("asks"), rows.where("asks and id is not null").select("id", "v", "own", F.col("own").alias("q"))
    else:
        vectors = materialize(vectors.select("id", "v", F.col("id").alias("own")), "vectors")
        asked = materialize(queries.where("id is not null").select("id", "v", F.col("id").alias("own"), row.alias("q")), "queries")
    # shards by length of the vectors
    widths = vectors.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.greatest(F.lit(SHARD), F.ceil(F.col("_n") / F.lit(4 * n))), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES // 8) / F.greatest("width", F.lit(1)))))
    widths = materialize(widths.select("width", F.ceil(F.col("_n") / size).cast("int").alias("shards")), "widths")
    most = widths.agg(F.max("shards")).first()[0] or 0
    sized = lambda df: df.withColumn("width", F.size("v")).join(widths, "width")
    placed = sized(vectors).select("width", F.pmod(F.xxhash64("own", "id", F.lit(1)), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "own", F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("floor"), "v")
    homes = sized(asked).withColumn("home", F.pmod(F.xxhash64("q", F.lit(2)), F.col("shards")).cast("int"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    found, first, last = None, 0, 1
    while first < most or found is None:
        wave = homes.where(F.lit(first) < F.col("shards"))
        if found is not None:
            kth = found.groupBy("q").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).drop("_n")
            wave = wave.join(kth, "q", "left")
        else:
            wave = wave.withColumn("floor", F.lit(None).cast("long"))
        steps = F.sequence(F.lit(first), F.least(F.lit(last), F.col("shards")) - 1)
        wave = wave.withColumn("_s", F.explode(steps)).select("width", F.pmod(F.col("home") + F.col("_s"), F.col("shards")).alias("shard"), F.lit(1).alias("kind"), "id", "own", "q", "floor", "v")
        both = placed.union(wave).withColumn("floor", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))))
        new = both.repartition(n, "width", "shard").sortWithinPartitions("width", "shard", "kind").mapInArrow(_descend(k), _FOUND)
        new = new if found is None else new.union(found.select("q", "query_id", "vec_id", "score"))
        found = materialize(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        first, last = last, 4 * last + 1
    return found.select("query_id", "rank", "vec_id", "score")
