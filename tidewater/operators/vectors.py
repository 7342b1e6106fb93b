"""Vectors: feature-hashing text embedder, exact cosine top-k search,
upsert (same id replaces the point), search-result context assembly."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import normalize_vector
from tidewater.operators.common import delete_folder, last_complete, mark_complete, spread, subfolders
from tidewater.session import materialize

# Fixed value: default number of results of a search.
TOP_K = 5


# ------------------------------------------------------------ embedding

def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs of the whole text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != F.lit(""))


class _TokenCodes(dict):
    """Slot and sign of a token in one integer, +(slot + 1) or -(slot + 1): first 32 bits of its md5 modulo ``dim``, parity of
    the next nibble (signed hashing keeps dot products unbiased).  Each distinct token is hashed once per worker."""

    def __init__(self, dim: int, limit: int = 500_000):
        super().__init__()
        self.dim, self.limit = dim, limit

    def __missing__(self, token: str) -> int:
        h = hashlib.md5(token.encode()).digest()
        code = int.from_bytes(h[:4], "big") % self.dim + 1
        if h[4] & 0x10:
            code = -code
        if len(self) >= self.limit:
            self.clear()
        self[token] = code
        return code


def _hashed(batch: pa.Array, codes: _TokenCodes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the non-zero components of a batch of token lists, in that order, and the length of each row's vector."""
    size = np.diff(batch.offsets.to_numpy())
    if batch.null_count:
        size = np.where(batch.is_valid().to_numpy(zero_copy_only=False), size, 0)
    tokens = batch.flatten().dictionary_encode()
    code = np.array([codes[t] for t in tokens.dictionary.to_pylist()], np.int64)[tokens.indices.to_numpy()]
    at = np.repeat(np.arange(len(batch)), size) * dim + np.abs(code) - 1
    cell, where = np.unique(at, return_inverse=True)
    total = np.bincount(where, np.sign(code), len(cell))
    cell, total = cell[total != 0], total[total != 0]
    row = cell // dim
    return row, cell % dim, total, np.sqrt(np.bincount(row, total * total, len(batch)))


#: tokens that are hashed and added up at a time
SLICE_TOKENS = 1 << 18


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch of token lists in runs of rows of at most about ``SLICE_TOKENS`` tokens (one row at least): bounds a worker's memory."""
    ends = batch.offsets.to_numpy()
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_TOKENS, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    """One list per row from values in row order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values))


def embed_hashing(df: DataFrame, id_col: str, text_col: str = "text", dim: int = 256,
                  as_float: bool = True, num_partitions: int | None = None) -> DataFrame:
    """L2-normalised signed bag-of-words vectors of fixed ``dim``.

    Row-local, no shuffle: the JVM cuts the text into tokens, an Arrow stage
    hashes each distinct token of a batch once and adds up.  A text
    without tokens has a null vector; repeated ids get a vector each.  This
    is the deterministic stand-in for a hosted embedding model; any other
    embedder plugs in through ``embed_with``.
    """
    @F.arrow_udf("array<double>")
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = _TokenCodes(dim)
        for batch in (part for whole in batches for part in _slices(whole)):
            row, slot, value, norm = _hashed(batch, codes, dim)
            full = np.zeros(len(batch) * dim)
            full[row * dim + slot] = value / norm[row]
            out = _lists(full, np.repeat(np.arange(len(batch)), dim), len(batch))
            yield pc.if_else(pa.array(norm == 0), pa.scalar(None, out.type), out)

    out = spread(df.select(id_col, text_col), num_partitions).select(id_col, dense(tokens(F.col(text_col))).alias("vector"))
    return out.withColumn("vector", F.col("vector").cast("array<float>")) if as_float else out


def embed_sparse(df: DataFrame, id_col: str, text_col: str = "text", dim: int = 256, num_partitions: int | None = None) -> DataFrame:
    """The non-zero components of ``embed_hashing``: (id, slots ascending, values, norm), a weight being value / norm.

    Values are whole numbers (signed token counts); ``dim`` may be large.  No tokens: empty lists.
    """
    @F.arrow_udf("struct<slots: array<int>, values: array<float>, norm: double>")
    def sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = _TokenCodes(dim)
        for batch in (part for whole in batches for part in _slices(whole)):
            row, slot, value, norm = _hashed(batch, codes, dim)
            yield pa.StructArray.from_arrays([_lists(slot.astype(np.int32), row, len(batch)), _lists(value.astype(np.float32), row, len(batch)),
                                              pa.array(norm)], ["slots", "values", "norm"])

    return (spread(df.select(id_col, text_col), num_partitions).select(id_col, sparse(tokens(F.col(text_col))).alias("_e"))
            .select(id_col, "_e.slots", "_e.values", "_e.norm"))


def embed_with(df: DataFrame, id_col: str, encode: Callable[[list[str]], np.ndarray], text_col: str = "text", *, dim: int,
               batch_rows: int = 256, num_partitions: int | None = None) -> DataFrame:
    """Vectors of an embedder of the caller's: ``encode`` turns up to ``batch_rows`` texts into a matrix of ``dim`` columns.

    It runs on the executors (load a model inside it once, behind a cache).
    Null texts are not asked for and have a null vector; a matrix of another
    shape is an error.
    """
    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for lo in range(0, len(known), batch_rows):
                at = known[lo:lo + batch_rows]
                matrix = np.asarray(encode([texts[i] for i in at]), np.float32)
                if matrix.shape != (len(at), dim):
                    raise ValueError(f"the embedder returned {matrix.shape} for {len(at)} texts and dim {dim}")
                for i, v in zip(at, matrix):
                    out[i] = v
            yield pa.array(out, pa.list_(pa.float32()))

    return spread(df.select(id_col, text_col), num_partitions).select(id_col, vectors(F.col(text_col)).alias("vector"))


# ------------------------------------------------------------ search

# Queries scored per numpy product inside a task (bounds the score matrix).
QUERY_BLOCK = 1024
# Points scored per numpy product inside a task.
POINT_BLOCK = 20000
# Points and queries of one cell.
CELL_POINTS, CELL_QUERIES = 16384, 4096


def _sortable(ids: np.ndarray) -> np.ndarray:
    """Ids as a sortable numpy array: strings stay Python objects (fixed
    width unicode arrays would truncate longer ids on assignment)."""
    if ids.dtype == object:
        out = np.empty(len(ids), dtype=object)
        out[:] = [str(x) for x in ids]
        return out
    return ids


def _pad(shape, dtype) -> np.ndarray:
    return np.full(shape, "" if dtype == object else 0, dtype=dtype)


def _order_rows(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per-row order by (score desc, id asc)."""
    return np.lexsort((ids, -scores), axis=-1)


def _rows_topk(sims: np.ndarray, ids: np.ndarray, k: int, decimals: int = 12):
    """Top-k per row of a score matrix, ties broken by smaller id, exact.

    The k-th largest of the row's 64-wide chunk maxima is a lower bound
    for its k-th best score (k chunks each hold a score at least that
    high), so one masked pass keeps only a few candidates per row; those
    are sorted by (score rounded to ``decimals``, id).  A small tolerance
    below the bound keeps scores that tie at that precision.
    """
    b, n = sims.shape
    c = 64
    n_main = n - n % c
    if n <= k or n_main // c < k:
        idm = np.broadcast_to(ids, sims.shape)
        o = _order_rows(np.round(sims, decimals), idm)[:, :k]
        return np.take_along_axis(sims, o, 1), np.take_along_axis(idm, o, 1)
    cm = sims[:, :n_main].reshape(b, n_main // c, c).max(axis=2)
    if n_main < n:
        cm = np.concatenate([cm, sims[:, n_main:].max(axis=1, keepdims=True)], axis=1)
    kth = np.partition(cm, cm.shape[1] - k, axis=1)[:, cm.shape[1] - k]
    thr = kth - 2 * 10.0 ** (-decimals) * np.maximum(1.0, np.abs(kth))
    r, col = np.nonzero(sims >= thr[:, None])
    cs = sims[r, col]
    ci = ids[col]
    o = np.lexsort((ci, -np.round(cs, decimals), r))
    r, cs, ci = r[o], cs[o], ci[o]
    pos = np.arange(len(r)) - np.searchsorted(r, np.arange(b))[r]
    keep = pos < k
    out_s = np.full((b, k), -np.inf)
    out_i = _pad((b, k), ci.dtype)
    out_s[r[keep], pos[keep]] = cs[keep]
    out_i[r[keep], pos[keep]] = ci[keep]
    return out_s, out_i


def _merge_topk(s_old, i_old, s_new, i_new, k: int):
    if s_old.shape[1] == 0:
        return s_new, i_new
    s = np.concatenate([s_old, s_new], axis=1)
    i = np.concatenate([i_old.astype(i_new.dtype) if i_old.dtype != i_new.dtype else i_old, i_new], axis=1)
    o = _order_rows(np.round(s, 12), i)[:, :k]
    return np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)


def _prepare_queries(queries: DataFrame, qid: str, qvec: str) -> pd.DataFrame:
    return queries.select(F.col(qid).alias("qid"),
                          normalize_vector(qvec).alias("qv")).where(F.col("qv").isNotNull())


def _scan_topk(qm: np.ndarray, point_batches, k: int, euclid: bool, tie_decimals: int):
    """Best k (score, id) per query row of ``qm`` over point batches
    ``(matrix, ids)``; queries are scored ``QUERY_BLOCK`` rows at a time and
    merged into a running best (ties: smaller id first)."""
    nq = len(qm)
    best_s = np.full((nq, 0), -np.inf)
    best_i = None
    for m, ids in point_batches:
        if euclid:
            sq = (m * m).sum(1)
            m2 = 2.0 * m
        else:
            norms = np.linalg.norm(m, axis=1)
            keep = norms > 0
            if not keep.any():
                continue
            m, norms, ids = m[keep], norms[keep], ids[keep]
        for lo in range(0, nq, QUERY_BLOCK):
            qb = qm[lo:lo + QUERY_BLOCK]
            if euclid:
                # rank by 2 q.p - |p|^2 (the per-query |q|^2 is added after selection)
                sims = qb @ m2.T
                sims -= sq[None, :]
            else:
                sims = qb @ m.T
                sims /= norms  # queries are unit length
            s_new, i_new = _rows_topk(sims, ids, k, tie_decimals)
            if euclid:
                s_new = -np.maximum((qb * qb).sum(1)[:, None] - s_new, 0.0)
            if best_i is None:
                best_i = _pad((nq, 0), i_new.dtype)
            s_m, i_m = _merge_topk(best_s[lo:lo + QUERY_BLOCK], best_i[lo:lo + QUERY_BLOCK], s_new, i_new, k)
            if s_m.shape[1] != best_s.shape[1]:
                width = s_m.shape[1]
                grow_s = np.full((nq, width), -np.inf)
                grow_i = _pad((nq, width), i_m.dtype)
                grow_s[:, :best_s.shape[1]] = best_s
                grow_i[:, :best_i.shape[1]] = best_i
                best_s, best_i = grow_s, grow_i
            best_s[lo:lo + QUERY_BLOCK], best_i[lo:lo + QUERY_BLOCK] = s_m, i_m
    if best_i is None:
        return best_s, _pad((nq, 0), np.int64)
    return np.round(best_s, tie_decimals), best_i


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def vector_topk(points: DataFrame, queries: DataFrame, *, k: int = TOP_K, id_col: str = "id",
                vec_col: str = "vector", qid_col: str = "query_id", qvec_col: str = "vector",
                carry: list[str] | None = None, point_blocks: int | None = None, query_blocks: int | None = None,
                tie_decimals: int = 12, carry_from: DataFrame | None = None,
                metric: str = "cosine") -> DataFrame:
    """Exact top-k of every query over all points (cosine, or Euclidean
    with score = minus the squared distance), the same way at every size.

    Points and queries are dealt by a hash of their id over ``point_blocks``
    x ``query_blocks`` cells (default: blocks of about ``CELL_POINTS`` and
    ``CELL_QUERIES`` rows, from counts of both sides, so a cell does not grow
    with the data).  A cell holds one block of each side, keeps its own top-k
    per query, and a per-query window picks k of the ``point_blocks * k``
    candidates; nothing goes through the driver and no pair table is formed.

    Ties (scores equal to ``tie_decimals`` places) go to the smaller id.
    Cosine skips zero vectors.  Output: query_id, rank (1-based), id,
    similarity, carry cols.
    """
    carry = carry or []
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    euclid = metric == "euclidean"
    pb = point_blocks or max(1, -(-points.count() // CELL_POINTS))
    query_blocks = query_blocks or max(1, -(-queries.count() // CELL_QUERIES))
    q = (queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).cast("array<double>").alias("qv"))
         .where(F.col("qv").isNotNull()) if euclid else _prepare_queries(queries, qid_col, qvec_col))
    p = (points.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
         .where(F.col("_v").isNotNull()))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = 2 * pb * query_blocks
    p = p.withColumn("_pb", block("_id", pb)).withColumn("_qb", every(query_blocks)).repartition(cells, "_pb", "_qb")
    q = q.withColumn("_qb", block("qid", query_blocks)).withColumn("_pb", every(pb)).repartition(cells, "_pb", "_qb")
    cand = _cells_topk(q, p, ["_pb", "_qb"], k, euclid, tie_decimals)
    return _attach(_best_k(cand, k, qid_col, id_col), points, carry, carry_from, id_col)


def _cells_topk(q: DataFrame, p: DataFrame, cell: list[str], k: int, euclid: bool, tie_decimals: int) -> DataFrame:
    """(query_id, _id, similarity): the ``k`` best points per query of every cell that holds both sides."""
    out_schema = T.StructType([T.StructField("query_id", q.schema["qid"].dataType), T.StructField("_id", p.schema["_id"].dataType),
                               T.StructField("similarity", T.DoubleType())])

    def cell_topk(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ps.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in out_schema.names})
        blocks = ((_matrix(ps["_v"].iloc[lo:lo + POINT_BLOCK]), _sortable(ps["_id"].to_numpy()[lo:lo + POINT_BLOCK]))
                  for lo in range(0, len(ps), POINT_BLOCK))
        best_s, best_i = _scan_topk(_matrix(qs["qv"]), blocks, k, euclid, tie_decimals)
        at = np.nonzero(np.isfinite(best_s))
        return pd.DataFrame({"query_id": qs["qid"].to_numpy()[at[0]], "_id": best_i[at], "similarity": best_s[at]})

    return q.groupBy(*cell).cogroup(p.groupBy(*cell)).applyInPandas(cell_topk, out_schema)


def _best_k(cand: DataFrame, k: int, qid_col: str, id_col: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("_id"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("query_id").alias(qid_col), "rank", F.col("_id").alias(id_col), "similarity")


def _attach(res: DataFrame, points: DataFrame, carry, carry_from, id_col) -> DataFrame:
    if not carry:
        return res
    src = carry_from if carry_from is not None else points
    return res.join(src.select(id_col, *carry), id_col, "left")


# ------------------------------------------------------------ upsert

def upsert(existing: DataFrame, incoming: DataFrame, id_col: str = "id",
           order: str | None = None) -> DataFrame:
    """Merged collection: every incoming point replaces the stored point with
    the same id; other stored points stay.  Within ``incoming`` one row per
    id wins: the last by ``order``, among equals (or without ``order``) the
    greatest row.  new ∪ (old anti-join new on id)."""
    whole = F.struct(*[F.col(c) for c in incoming.columns])
    rank = F.struct(F.col(order).alias("o"), whole.alias("r")) if order else F.struct(whole.alias("r"))
    incoming = incoming.groupBy(id_col).agg(F.max(rank).alias("_m")).select("_m.r.*")
    kept = existing.join(incoming.select(id_col), id_col, "left_anti")
    return incoming.select(*existing.columns).unionByName(kept)


def _manifest(spark: SparkSession, path: str, version: str | None) -> dict[int, int | None]:
    """Generation of every bucket in a version (null: empty); at most one row per bucket."""
    return {r["bucket"]: r["generation"] for r in spark.read.parquet(f"{path}/manifest/{version}").collect()} if version else {}


def _bucket_paths(path: str, manifest: dict[int, int | None], only: set[int] | None = None) -> list[str]:
    return [f"{path}/generation={g:010d}/bucket={b}" for b, g in sorted(manifest.items()) if g is not None and (only is None or b in only)]


def read_collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a stored collection; None before the first."""
    version = last_complete(spark, f"{path}/manifest", "version=")
    if version is None:
        return None
    schema = spark.read.parquet(f"{path}/manifest/{version}/schema").schema
    paths = _bucket_paths(path, _manifest(spark, path, f"{version}/buckets"))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_collection(spark: SparkSession, path: str, incoming: DataFrame, id_col: str = "id", *, order: str | None = None,
                      n_buckets: int = 64, replace_source: str | None = None) -> int:
    """Merge ``incoming`` into the collection stored at ``path``; returns the number of ingested points.

    Points lie in ``n_buckets`` buckets by a hash of their id (fixed by the
    first upsert).  Only the buckets that ``incoming`` touches are read, merged
    (``upsert``) and written, as a new generation; a small manifest then names
    the generation of every bucket, and counts once its success mark is there.
    So untouched files stay as they are, and a run that failed or is repeated
    leaves the stored version whole.  Generations that neither the new
    manifest nor the one before it names are removed at the end; readers of
    the version before keep theirs.  With ``replace_source`` (a column),
    stored points of every source in ``incoming`` go first, so that a source
    that shrank leaves nothing behind; their buckets count as touched.
    """
    manifests = f"{path}/manifest"
    last = last_complete(spark, manifests, "version=")
    before = _manifest(spark, path, f"{last}/buckets" if last else None)
    n_buckets = len(before) or n_buckets
    bucket = F.pmod(F.xxhash64(id_col), F.lit(n_buckets)).cast("int")
    batch = materialize(incoming.withColumn("bucket", bucket), "upsert-batch")
    columns = incoming.columns
    touched = {r[0] for r in batch.select("bucket").distinct().collect()}  # at most n_buckets numbers
    gone = batch.select(F.col(replace_source).alias("_gone")).distinct() if replace_source else None
    if gone is not None and last:
        stored = read_collection(spark, path).join(gone, F.col(replace_source).eqNullSafe(F.col("_gone")), "left_semi")
        touched |= {r[0] for r in stored.select(bucket).distinct().collect()}
    paths = _bucket_paths(path, before, touched)
    existing = spark.read.schema(batch.select(*columns).schema).parquet(*paths) if paths else batch.select(*columns).limit(0)
    if gone is not None:
        existing = existing.join(gone, F.col(replace_source).eqNullSafe(F.col("_gone")), "left_anti")
    seen = Observation(f"ingest-{uuid.uuid4().hex[:8]}")
    merged = upsert(existing.withColumn("_new", F.lit(0)), batch.select(*columns).withColumn("_new", F.lit(1)), id_col, order)
    number = int(last.split("=")[1]) + 1 if last else 0
    target = f"{path}/generation={number:010d}"
    (merged.observe(seen, F.coalesce(F.sum("_new"), F.lit(0)).alias("ingested")).drop("_new").withColumn("bucket", bucket)
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", id_col)
     .write.partitionBy("bucket").mode("overwrite").parquet(target))
    written = {int(n.split("=")[1]) for n in subfolders(spark, target) if n.startswith("bucket=")}
    after = {b: number if b in written else None if b in touched else before.get(b) for b in range(n_buckets)}
    version = f"{manifests}/version={number:010d}"
    spark.createDataFrame(sorted(after.items()), "bucket int, generation long").coalesce(1).write.mode("overwrite").parquet(f"{version}/buckets")
    batch.select(*columns).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{version}/schema")
    mark_complete(spark, version)
    live = {g for m in (before, after) for g in m.values()}
    for name in subfolders(spark, path):
        if name.startswith("generation=") and int(name.split("=")[1]) not in live:
            delete_folder(spark, f"{path}/{name}")
    return seen.get["ingested"]


# ------------------------------------------------------------ context

def search_context(hits: DataFrame, qid_col: str = "query_id", rank_col: str = "rank",
                   text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per query: its number of hits, hit texts in rank order (empty texts
    skipped; a query with empty hits only keeps empty lists) and the distinct sources in order of first appearance (group size is k)."""
    hit = F.when(F.length(text_col) > 0, F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t"),
                                                  F.col(source_col).alias("s")))
    g = hits.groupBy(qid_col).agg(F.array_sort(F.collect_list(hit)).alias("_h"), F.count(F.lit(1)).alias("n_hits"))
    return g.select(qid_col, "n_hits", F.transform("_h", lambda x: x["t"]).alias("contexts"),
                    F.array_distinct(F.transform("_h", lambda x: x["s"])).alias("sources"))
