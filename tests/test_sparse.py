"""Posting-list search against scoring every point, and the embedders."""

import hashlib
import re

import numpy as np
import pytest

from tidewater.operators import sparse, vectors

POINTS, QUERIES = "id string, slots array<int>, values array<double>", "query_id long, slots array<int>, values array<double>"


def brute(points, queries, k):
    out = {}
    for q, qs, qw in queries:
        scored = []
        for i, ps, pw in points:
            both = set(qs) & {s for s, w in zip(ps, pw) if w}
            if both:
                a, b = dict(zip(qs, qw)), dict(zip(ps, pw))
                scored.append((-round(sum(a[s] * b[s] for s in sorted(both)), 12), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def some(rng, n, dim, nnz, names):
    """Random sparse rows; in many dimensions each has one strong slot of 20."""
    rows = []
    for i in range(n):
        s = np.sort(rng.choice(dim, rng.integers(1, nnz), replace=False))
        w = rng.normal(size=len(s)) + (s % 5 == 0)
        if dim > 1000:
            s = np.append(s[s >= 20], rng.integers(20))
            w = np.append(w[:len(s) - 1] * 0.3, 5.0)
            s, w = np.sort(s), w[np.argsort(s)]
        rows.append((names(i), s.tolist(), np.round(w / np.linalg.norm(w), 3).tolist()))
    return rows


@pytest.mark.parametrize("dim,nnz,block_rows", [(30, 12, 8), (4000, 30, 16), (16, 16, 64)])
def test_same_hits_as_scoring_everything(spark, monkeypatch, dim, nnz, block_rows):
    monkeypatch.setattr(sparse, "STRIP", 7)
    monkeypatch.setattr(sparse, "QUERY_ROWS", 10)
    rng = np.random.default_rng(dim)
    pts, qs = some(rng, 400, dim, nnz, lambda i: f"p{i}"), some(rng, 25, dim, nnz, lambda i: i)
    postings = spark.createDataFrame(pts, POINTS).repartition(3)
    stats = {}
    got = {}
    table = sparse.posting_table(postings, block_rows=block_rows, norm=None).cache()
    for r in sorted(sparse.sparse_topk(table, spark.createDataFrame(qs, QUERIES), k=4, norm=None, stats=stats).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    want = brute(pts, qs, 4)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items() if h}
    assert all(s == pytest.approx(t) for q in got for (_, s), (_, t) in zip(got[q], want[q]))
    if dim == 4000:
        assert stats["skipped"] > 0.3


def test_odd_points_and_queries(spark):
    pts = [("a", [1], [1.0]), ("b", [1], [1.0]), ("c", [], []), ("d", None, None), (None, [1], [1.0]), ("e", [2], [-1.0]), ("f", [3], [0.0])]
    qs = [(1, [1], [1.0]), (2, [], []), (3, None, None), (4, [2], [1.0]), (5, [9], [1.0]), (6, [3], [1.0]), (None, [1], [1.0])]
    table = sparse.posting_table(spark.createDataFrame(pts, POINTS), norm=None)
    got = sorted((r.query_id, r["rank"], r.id, r.similarity) for r in sparse.sparse_topk(table, spark.createDataFrame(qs, QUERIES), k=5, norm=None).collect())
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (4, 1, "e", -1.0)]
    nothing = sparse.posting_table(spark.createDataFrame([], POINTS), norm=None)
    assert sparse.sparse_topk(nothing, spark.createDataFrame(qs, QUERIES), norm=None).count() == 0
    assert sparse.sparse_topk(table, spark.createDataFrame([], QUERIES), norm=None).count() == 0


def test_sparse_and_dense_embeddings_agree(spark):
    texts = [(1, "The river, the RIVER!"), (2, ""), (3, None), (4, "x " * 5000), (5, "größe été 42 日本"), (1, "again")]
    df = spark.createDataFrame(texts, "id long, text string")
    for dim in (16, 1 << 20):
        for r, (i, t) in zip(vectors.embed_sparse(df, "id", dim=dim).collect(), texts):
            total = {}
            for w in re.findall(r"\w+", (t or "").lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                total[int(h[:8], 16) % dim] = total.get(int(h[:8], 16) % dim, 0) + (1 if int(h[8], 16) % 2 == 0 else -1)
            total = {s: v for s, v in total.items() if v}
            norm = sum(v * v for v in total.values()) ** 0.5
            assert r.id == i and dict(zip(r.slots, r["values"])) == total and r.norm == pytest.approx(norm)
            assert r.slots == sorted(r.slots)
    dense = [r.vector for r in vectors.embed_hashing(df, "id", dim=16, as_float=False).collect()]
    lists = vectors.embed_sparse(df, "id", dim=16).collect()
    assert [v is None for v in dense] == [not r.slots for r in lists] == [False, True, True, False, False, False]
    assert all(v is None or [(s, w) for s, w in enumerate(v) if w] == [(s, w / r.norm) for s, w in zip(r.slots, r["values"])] for v, r in zip(dense, lists))


def test_embedder_of_the_callers_own(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "a" * i) for i in range(7)], "id long, text string").coalesce(1)
    out = {r.id: r.vector for r in vectors.embed_with(df, "id", lambda t: np.array([[len(x), 1.0] for x in t]), dim=2, batch_rows=2).collect()}
    assert out == {i: None if i == 3 else [float(i), 1.0] for i in range(7)}
    with pytest.raises(Exception, match="the embedder returned"):
        vectors.embed_with(df, "id", lambda t: np.zeros((len(t), 3)), dim=2).collect()


def test_token_lists_are_added_up_in_bounded_runs(spark, monkeypatch):
    """Runs cover every row once, hold one long row or few tokens, and give the vectors of the whole batch."""
    import pyarrow as pa
    monkeypatch.setattr(vectors, "SLICE_TOKENS", 10)
    rows = [["a"] * n if n is not None else None for n in (3, 4, 25, 0, None, 6, 6, 1)]
    batch = pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)
    runs = list(vectors._slices(batch))
    assert [r for run in runs for r in run.to_pylist()] == rows
    assert all(len(run) == 1 or sum(len(r or []) for r in run.to_pylist()) <= 10 for run in runs)
    assert list(vectors._slices(pa.array([], pa.list_(pa.string())))) == []
    sizes = [len(vectors._hashed(run, vectors._TokenCodes(8), 8)[3]) for run in runs]
    assert sum(sizes) == len(rows)


def test_a_task_scores_one_block_at_a_time(spark, monkeypatch):
    """However many blocks an Arrow batch could hold, the scorer is handed one."""
    from pyspark.sql import DataFrame
    points = spark.createDataFrame([(f"p{i}", [i % 5, 7], [1.0, 0.5]) for i in range(60)], POINTS)
    queries = spark.createDataFrame([(1, [1, 7], [1.0, 1.0])], QUERIES)
    table = sparse.posting_table(points, norm=None, block_rows=4)
    monkeypatch.setattr(DataFrame, "mapInArrow", None)  # batches of many blocks come this way
    got = sparse.sparse_topk(table, queries, k=3, norm=None).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["p1", "p11", "p16"]
