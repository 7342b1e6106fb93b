"""Approximate cosine top-k: an index of cells in two levels with a byte code per component.

Index.  The number of cells follows the collection.  Centres are fitted on a
bounded sample: first coarse ones, then finer ones inside each.  Every vector
is stored in the cell of its nearest fine centre as a code of one signed byte
per component and a scale.  How many cells a query must look into is measured
while fitting: sample vectors are searched exactly among the others, and the
least number of nearest cells that holds ``target`` of the true hits is kept.

Search.  A query meets the codes of its nearest cells.  The rounding of a code
bounds the error of a score, so a vector is compared exactly only if its score
could reach the k-th best; what is missed is what lies in other cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import normalize_vector
from tidewater.operators.vectors import TOP_K
from tidewater.session import materialize

CELL_ROWS = 256             # vectors that a cell should hold
MAX_VALUES = 1 << 22        # components of all fine centres together (sent to every task)
SAMPLE_VALUES = 1 << 23     # components of the rows that centres are fitted on
TRIAL_QUERIES = 256         # sample rows that the number of probes is measured with
TARGET = 0.98
MAX_K = 128                 # ids kept of equal vectors, and the largest k of a search
STRIP = 1024


class Index(NamedTuple):
    codes: DataFrame        # cell, id, code, scale: one row per distinct vector, under its smallest id
    vectors: DataFrame      # id, v of the same
    twins: DataFrame        # id, twin, place: the smallest ids of equal vectors, itself among them
    coarse: np.ndarray
    fine: np.ndarray
    inside: list[np.ndarray]  # fine centres of each coarse one
    probes: int
    rows: int


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def _spherical(sample: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Unit centres of at most ``n`` groups of unit vectors."""
    centre = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i:i + 4096] @ centre.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, _unit(total), centre)
    return np.unique(centre, axis=0)


def _two_levels(sample: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    coarse = _spherical(sample, max(1, round(cells ** 0.5)), rng)
    home = (sample @ coarse.T).argmax(1)
    fine, inside, at = [], [], 0
    for c in range(len(coarse)):
        mine = sample[home == c]
        part = _spherical(mine, max(1, round(cells * len(mine) / len(sample))), rng) if len(mine) else coarse[c:c + 1]
        fine.append(part)
        inside.append(np.arange(at, at + len(part)))
        at += len(part)
    return coarse, np.concatenate(fine), inside


def nearest_cells(rows: np.ndarray, coarse: np.ndarray, fine: np.ndarray, inside: list[np.ndarray], n: int) -> np.ndarray:
    """Rows x n: the nearest fine cells, nearest first, looked for in the nearest coarse cells (-1 beyond those there are).

    The coarse cells taken are the nearest that hold twice ``n`` fine ones, and four at least.
    """
    sizes = np.array([len(i) for i in inside])
    out = np.full((len(rows), n), -1, np.int32)
    order = np.argsort(-(rows @ coarse.T), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    take = np.maximum((held < 2 * n).sum(1) + 1, min(4, len(coarse)))
    # rows that take the same coarse cells are handled together
    groups: dict[tuple, list[int]] = {}
    for i, (o, t) in enumerate(zip(order, take)):
        groups.setdefault(tuple(sorted(o[:t].tolist())), []).append(i)
    for cells, members in groups.items():
        ids = np.concatenate([inside[c] for c in cells])
        score = rows[members] @ fine[ids].T
        best = ids[np.argsort(-score, axis=1, kind="stable")[:, :n]]
        out[members, :best.shape[1]] = best
    return out


def _probes(sample: np.ndarray, levels, k: int, target: float, seed: int) -> int:
    """Least number of cells in which ``target`` of the true ``k`` nearest of sample rows lie."""
    coarse, fine, inside = levels
    if len(sample) <= k + 1 or len(fine) == 1:
        return len(fine)
    asked = np.random.default_rng(seed).choice(len(sample), min(TRIAL_QUERIES, len(sample)), replace=False)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    hits = np.argpartition(-score, k - 1, axis=1)[:, :k]
    home = nearest_cells(sample, coarse, fine, inside, 1)[:, 0]
    order = nearest_cells(sample[asked], coarse, fine, inside, len(fine))
    rank = np.empty((len(asked), len(fine)), np.int64)
    np.put_along_axis(rank, order.astype(np.int64), np.arange(len(fine))[None, :], axis=1)
    place = np.sort(np.take_along_axis(rank, home[hits], axis=1).ravel())
    return int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1


def _cell_column(vec: Column, levels, n: int) -> Column:
    coarse, fine, inside = levels

    @F.arrow_udf("array<int>")
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list = []
            for lo in range(0, len(batch), STRIP):
                part = batch.slice(lo, STRIP)
                rows = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                out += [c[c >= 0] for c in nearest_cells(rows, coarse, fine, inside, n)]
            yield pa.array(out, pa.list_(pa.int32()))

    return cells(vec)


def _code_column(vec: Column) -> Column:
    """(code, scale): components as signed bytes, ``scale`` times which they are rounded to."""
    @F.arrow_udf("struct<code: binary, scale: double>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.struct([("code", pa.binary()), ("scale", pa.float64())]))
                continue
            rows = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            scale = np.abs(rows).max(1) / 127.0
            codes = np.rint(rows / scale[:, None]).astype(np.int8)
            yield pa.StructArray.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], ["code", "scale"])

    return code(vec)


def build_index(points: DataFrame, *, id_col: str = "id", vec_col: str = "vector", k: int = 20, cells: int | None = None,
                probes: int | None = None, target: float = TARGET, seed: int = 42) -> Index | None:
    """Index every point with a non-zero vector; None if there is none.

    ``cells`` defaults to one per ``CELL_ROWS`` points, as far as
    ``MAX_VALUES`` allows; ``probes`` to what ``target`` of the true ``k``
    nearest of sample points needs.  Equal vectors are indexed once, with
    their ``MAX_K`` smallest ids.  Ids must be unique.
    """
    alike = Window.partitionBy("v").orderBy("id")
    known = materialize(points.select(F.col(id_col).alias("id"), normalize_vector(vec_col).alias("v"))
                        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
                        .withColumn("place", F.row_number().over(alike)).where(F.col("place") <= MAX_K)
                        .withColumn("first", F.first("id").over(alike)), "ann-points")
    p = known.where("place = 1").select("id", "v")
    twins = known.select(F.col("first").alias("id"), F.col("id").alias("twin"), "place")
    size = p.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return None
    cells = max(1, min(cells or -(-size["n"] // CELL_ROWS), MAX_VALUES // size["dim"]))
    drawn = min(max(64 * cells, 4096), SAMPLE_VALUES // size["dim"])
    sample = np.array([r["v"] for r in p.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(drawn).select("v").collect()])
    levels = _two_levels(sample, cells, seed)
    code = _code_column(F.col("v"))
    stored = p.select(_cell_column(F.col("v"), levels, 1)[0].alias("cell"), "id", code.alias("c")).select("cell", "id", "c.code", "c.scale")
    found = probes or _probes(sample[:8192], levels, min(k, 20), target, seed)
    return Index(materialize(stored.hint("rebalance", "cell").sortWithinPartitions("cell"), "ann-codes"), p, twins, *levels,
                 min(found, len(levels[1])), size["n"])


def _candidates(queries: DataFrame, codes: DataFrame, cell: list[str], k: int) -> DataFrame:
    """(qid, id, upper, lower): vectors of a cell whose score could be among the ``k`` best there, with bounds on it."""
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", codes.schema["id"].dataType),
                           T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [left.schema.field("qid").type, right.schema.field("id").type, pa.float64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], schema.names)
        q = left["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(left.num_rows, -1)
        code = np.frombuffer(b"".join(right["code"].to_pylist()), np.int8).reshape(right.num_rows, -1).astype(np.float32)
        scale = right["scale"].to_numpy()
        out: list[list] = [[], [], [], []]
        for lo in range(0, len(q), STRIP):
            part = q[lo:lo + STRIP]
            score = (part.astype(np.float32) @ code.T) * scale
            # rounding of the code, and of the products in single precision
            error = np.abs(part).sum(1)[:, None] * (0.5 * scale)[None, :] + 1e-4
            lower = score - error
            top = min(k, lower.shape[1])
            least = np.partition(lower, lower.shape[1] - top, axis=1)[:, lower.shape[1] - top]
            i, j = np.nonzero(score + error >= least[:, None])
            for column, values in zip(out, (i + lo, j, (score + error)[i, j], lower[i, j])):
                column.append(values)
        i, j, upper, lower = (np.concatenate(c) for c in out)
        return pa.table([left["qid"].combine_chunks().take(pa.array(i)), right["id"].combine_chunks().take(pa.array(j)), pa.array(upper), pa.array(lower)],
                        schema.names)

    return queries.groupBy(*cell).cogroup(codes.groupBy(*cell)).applyInArrow(scan, schema)


def search(index: Index, queries: DataFrame, *, k: int = TOP_K, id_col: str = "id", qid_col: str = "query_id", qvec_col: str = "vector",
           block_rows: int = 20_000, stats: dict | None = None) -> DataFrame:
    """(qid_col, rank, id_col, similarity): the best ``k`` points of the cells that each query looks into, scored exactly.

    A cell with more than ``block_rows`` codes or queries is cut into blocks,
    so that a hot cell is many tasks' work.  Ties (to 12 places) go to the
    smaller id; zero and null vectors take no part; query ids must be unique.
    ``stats`` receives the shares of all (query, point) pairs whose codes were
    read and that were scored exactly.
    """
    if k > MAX_K:
        raise ValueError(f"k is at most {MAX_K}")
    q = materialize(queries.select(F.col(qid_col).alias("qid"), normalize_vector(qvec_col).alias("v"))
                    .where(F.col("qid").isNotNull() & F.col("v").isNotNull()), "ann-queries")
    levels = (index.coarse, index.fine, index.inside)
    asked = q.withColumn("cell", F.explode(_cell_column(F.col("v"), levels, index.probes)))
    blocks = lambda df, out: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(out), F.count(F.lit(1)).alias(out + "_rows"))
    sizes = materialize(blocks(index.codes, "np").join(blocks(asked, "nq"), "cell"), "ann-sizes")  # at most a row per cell
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "cell").withColumn("pb", every("np")).withColumn("qb", deal("qid", "nq")).select("qid", "v", "cell", "pb", "qb")
    right = index.codes.join(sizes, "cell").withColumn("pb", deal("id", "np")).withColumn("qb", every("nq")).select("id", "code", "scale", "cell", "pb", "qb")
    near = materialize(_candidates(left, right, ["cell", "pb", "qb"], k), "ann-near")
    best = Window.partitionBy("qid").orderBy(F.col("lower").desc(), "id")
    least = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("qid").alias("q2"), F.col("lower").alias("least"))
    kept = near.join(least, F.col("qid") == F.col("q2"), "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("qid", "id")
    if stats is not None:
        kept = materialize(kept, "ann-kept")
        pairs = max(1, q.count() * index.rows)
        read = sizes.agg(F.sum(F.col("np_rows") * F.col("nq_rows"))).first()[0] or 0
        stats |= {"probes": index.probes, "cells": len(index.fine), "codes_read": read / pairs, "scored": kept.count() / pairs}
    dot = F.aggregate(F.zip_with("p", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = (kept.join(index.vectors.withColumnRenamed("v", "p"), "id").join(q, "qid").select("qid", "id", F.round(dot, 12).alias("similarity"))
              .join(index.twins.where(F.col("place") <= k), "id").select("qid", F.col("twin").alias("id"), "similarity"))
    order = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), "id")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("qid").alias(qid_col), "rank", F.col("id").alias(id_col), "similarity"))


def vector_topk_approx(points: DataFrame, queries: DataFrame, *, k: int = TOP_K, id_col: str = "id", vec_col: str = "vector",
                       qid_col: str = "query_id", qvec_col: str = "vector", block_rows: int = 20_000, stats: dict | None = None, **index) -> DataFrame:
    """Build an index of ``points`` and search it once; ``index`` are arguments of ``build_index``."""
    built = build_index(points, id_col=id_col, vec_col=vec_col, k=k, **index)
    if built is None:
        none = points.sparkSession.createDataFrame([], T.StructType([
            T.StructField(qid_col, queries.schema[qid_col].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, points.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())]))
        return none
    return search(built, queries, k=k, id_col=id_col, qid_col=qid_col, qvec_col=qvec_col, block_rows=block_rows, stats=stats)
