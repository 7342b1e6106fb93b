"""Exact top-k by inner product with no-random-access aggregation.

A stated query set meets all points in blocks of bounded size.  In a block
every dimension is a list sorted by component.  A query reads its lists
sequentially, to doubling depths, from the end its component favours, keeping
for every point a lower bound (unread components at their worst) and an upper
bound (unread components at the list's reading position).  It stops when no
point outside the survivors - those whose upper bound reaches the k-th lower
bound - can qualify and these are few, or when the lists end; the survivors'
scores are then resolved in full.  Block results (k per query) are merged by a window.

Defined results: vectors that are null or hold null or non-finite components,
and null ids, take no part; rows equal in id and vector are one point; a
shorter vector counts as zero in the missing components; ties go to the
smaller id; a point never answers a query of its own id; fewer than k points
give fewer rows; empty tables give no rows; other columns are not read.
Scores must fit a long; they are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import materialize

POINT_BLOCK = 8192
QUERY_BLOCK = 1024
QUERY_STEP = 128  # queries whose bounds a task holds at a time


def finite_vector(v: Column) -> Column:
    """True for a vector without null, NaN or infinite components (false for null)."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def quantized(v: Column, scale: int = 256) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():]
    if (size == dims).all():
        return flat[:len(size) * dims].reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    for i, n in enumerate(size):
        out[i, :n] = flat[at[i]:at[i] + n]
    return out


class Lists:
    """The sorted lists of one block, read to a common depth.

    At a depth, an unread component is bounded by the list's last value (the
    worst that can come) and by the value at the reading position (the best
    that can come).  A query reads the descending list where its component is
    positive and the ascending one where it is negative, so for all queries
    the bounds are products with the same two substituted matrices.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.sorted = np.sort(self.points, axis=0)
        order = np.argsort(self.points, axis=0, kind="stable")
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(order), dtype=np.int32)[:, None], axis=0)
        self._read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Substituted matrices [descending | ascending] for the lower and the upper bound."""
        if depth not in self._read:
            n = len(self.points)
            top, bottom = self.rank >= n - depth, self.rank < depth
            fill = lambda t, b: np.hstack([np.where(top, self.points, t), np.where(bottom, self.points, b)])
            self._read[depth] = (fill(self.sorted[0], self.sorted[-1]),
                                 fill(self.sorted[n - depth], self.sorted[depth - 1]))
        return self._read[depth]


def nra(lists: Lists, ids: np.ndarray, queries: np.ndarray, own: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and exact scores of the k best points for each query (all sums exact in float64)."""
    n = len(ids)
    q = queries.astype(np.float64)
    signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).T
    found: list = [None] * len(q)
    open_, depth = np.arange(len(q)), 0
    while len(open_):
        depth = min(n, max(1, n // 16, 2 * depth))
        low_m, high_m = lists.bounds(depth)
        low, high = low_m @ signed[:, open_], high_m @ signed[:, open_]
        later = []
        for c, i in enumerate(open_):
            mine = ids == own[i]
            low[mine, c], high[mine, c] = -np.inf, -np.inf
            bar = np.partition(low[:, c], n - k)[n - k] if n > k else -np.inf
            alive = np.flatnonzero((high[:, c] >= bar) & ~mine)
            if len(alive) > max(4 * k, n // 32) and depth < n:
                later.append(i)
                continue
            score = lists.points[alive] @ q[i]
            best = np.lexsort((ids[alive], -score))[:k]
            found[i] = ids[alive][best], score[best]
        open_ = np.array(later, np.int64)
    return found


def _search(k: int):
    def block(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if queries.num_rows and points.num_rows:
            size = lambda t: int(np.diff(t.column("vec").combine_chunks().offsets.to_numpy()).max())
            dims = max(1, size(queries), size(points))
            P, Q = _matrix(points.column("vec"), dims), _matrix(queries.column("vec"), dims)
            # floats hold every bound exactly while no sum of products passes 2 ** 53
            if float(np.abs(P).max(initial=0)) * float(np.abs(Q).max(initial=0)) * dims >= 2.0 ** 52:
                P, Q = P.astype(object), Q.astype(object)
            ids = points.column("vec_id").to_numpy()
            qid, qkey = queries.column("query_id").to_pylist(), queries.column("query_key").to_pylist()
            found = []
            if P.dtype == object:
                for i, own in enumerate(qid):
                    keep = np.flatnonzero(ids != own)
                    s = P[keep] @ Q[i]
                    best = sorted(range(len(keep)), key=lambda j: (-s[j], ids[keep[j]]))[:k]
                    found.append((ids[keep[best]], s[best]))
            else:
                lists = Lists(P)
                for at in range(0, len(qid), QUERY_STEP):
                    found += nra(lists, ids, Q[at:at + QUERY_STEP], qid[at:at + QUERY_STEP], k)
            for i, (vec, score) in enumerate(found):
                out[0] += [qid[i]] * len(vec)
                out[1] += [qkey[i]] * len(vec)
                out[2] += [int(x) for x in vec]
                out[3] += [int(x) for x in score]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "query_key", "vec_id", "score"])

    return block


def top_k(queries: DataFrame, points: DataFrame, *, k: int = 5, point_block: int = POINT_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (query_id, vec) against ``points`` (vec_id, vec); vec array<long>."""
    points = materialize(points.select("vec_id", "vec").distinct(), "topk-points")
    queries = materialize(queries.select("query_id", "vec").distinct(), "topk-queries")
    n_p = max(1, -(-points.count() // point_block))
    n_q = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = points.withColumn("pb", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_p)).cast("int")).withColumn("qb", every(n_q))
    q = (queries.withColumn("query_key", F.xxhash64("query_id", "vec"))
         .withColumn("qb", F.pmod("query_key", F.lit(n_q)).cast("int")).withColumn("pb", every(n_p)))
    found = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInArrow(
        _search(k), "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
