"""Exact top-k search over sparse vectors: posting lists in blocks, with block maxima.

The index is a table with one row per block of points: the ids, and per slot
the posting list (places in the block and values) with its largest and
smallest weight.  A query's score in a block cannot exceed the sum of its
weights times the block's extremes; that sum comes from a join on the slot
that reads three narrow columns.  The most promising blocks of a query are
scored first, which gives it a threshold (its k-th best score so far); of the
other blocks only those whose bound reaches the threshold are scored.  The
answer is that of scoring every point.

A vector is (slots, values, norm): its weights are ``values / norm``.  Token
counts and other small numbers thus stay small on disk and in shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.vectors import TOP_K
from tidewater.session import materialize

BLOCK_ROWS = 1024
SAMPLE_ROWS = 4096      # points from whose strongest slots the blocks are laid out; results do not depend on it
FIRST_BLOCKS = 2        # blocks per query that are scored before there is a threshold
QUERY_ROWS = 1024       # queries that one task scores against a block at a time
STRIP = 256
PLACES = 12             # scores equal to this many places tie


def _strongest(slots: str, values: str) -> Column:
    """Slot of the largest absolute value (the smallest such slot)."""
    best = F.array_max(F.zip_with(slots, values, lambda s, w: F.struct(F.abs(w).alias("w"), (-s).alias("s"))))
    return (-best["s"]).cast("long")


def posting_table(points: DataFrame, *, id_col: str = "id", slots: str = "slots", values: str = "values", norm: str | None = "norm",
                  block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """One row per block: (block, ids, slots, hi, lo, ends, at, values, norms).

    ``ids`` are sorted.  The posting list of ``slots[i]`` is ``at`` (places in
    ``ids``) and ``values`` from ``ends[i - 1]`` to ``ends[i]``; ``hi`` and
    ``lo`` are the extremes of its weights, 0 included unless all points of
    the block have the slot.  Points with the same strongest slot share
    blocks, so that the extremes of a block say something about its points;
    how many blocks a strong slot gets follows its share of a sample of at
    most about ``SAMPLE_ROWS`` points.  Ids must be unique; points without
    components are in no block.  Store the result before searching it.
    """
    # written first: an embedder behind a filter or an aggregate would run again for each
    p = materialize(points.select(F.col(id_col).alias("id"), F.col(slots).alias("slots"), F.col(values).alias("values"),
                                  (F.col(norm) if norm else F.lit(1.0)).cast("double").alias("norm")), "sparse-points")
    p = p.where(F.col("id").isNotNull() & (F.size("slots") > 0))
    every = max(1, p.count() // SAMPLE_ROWS)
    drawn = p.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(every)) == 0).groupBy(_strongest("slots", "values").alias("s")).count().collect()
    many = {r["s"]: -(-r["count"] * every // block_rows) for r in drawn if r["count"] * every > block_rows}
    cuts = F.coalesce(F.create_map(*[F.lit(x) for item in sorted(many.items()) for x in item])[F.col("leader")], F.lit(1)) if many else F.lit(1)
    block = F.col("leader") * F.lit(1 << 24) + F.pmod(F.xxhash64("id"), cuts)
    p = p.withColumn("leader", _strongest("slots", "values")).select(block.alias("block"), "id", "slots", "values", "norm")
    value_type = p.schema["values"].dataType.elementType
    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(p.schema["id"].dataType)),
                           *[T.StructField(c, t) for c, t in (("slots", ints), ("hi", doubles), ("lo", doubles), ("ends", ints), ("at", ints),
                                                              ("values", T.ArrayType(value_type)), ("norms", doubles))]])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        lists = table["slots"].combine_chunks()
        slot, value = lists.flatten().to_numpy(), table["values"].combine_chunks().flatten()
        at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        keep = np.flatnonzero(value.to_numpy() != 0)
        order = keep[np.lexsort((at[keep], slot[keep]))]
        slot, at, value = slot[order], at[order], value.take(pa.array(order))
        norms = table["norm"].to_numpy()
        weight = value.to_numpy() / norms[at]
        used, first = np.unique(slot, return_index=True)
        ends = np.append(first[1:], len(slot))
        hi, lo = (f.reduceat(weight, first) if len(slot) else weight for f in (np.maximum, np.minimum))
        partly = ends - first < len(lists)
        hi, lo = np.where(partly, np.maximum(hi, 0.0), hi), np.where(partly, np.minimum(lo, 0.0), lo)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
        ids = table["id"].combine_chunks()
        return pa.table([table["block"].slice(0, 1).combine_chunks(), one(ids), one(used.astype(np.int32)), one(hi), one(lo), one(ends.astype(np.int32)),
                         one(at.astype(np.int32)), one(value), one(norms)], schema.names)

    return p.groupBy("block").applyInArrow(build, schema)


def _score_blocks(asked: DataFrame, queries: DataFrame, postings: DataFrame, k: int, parts: int, id_type: T.DataType) -> DataFrame:
    """(qid, id, score): the ``k`` best points of every (qid, block) of ``asked`` that share a slot with the query."""
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def block_scores(row: dict, point: np.ndarray, values: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        norms = row["norms"]
        bounds = np.append(0, row["ends"])
        place = {s: i for i, s in enumerate(row["slots"].tolist())}
        asking = row["asking"]
        for lo in range(0, len(asking), STRIP):
            strip = asking[lo:lo + STRIP]
            by_slot: dict[int, tuple[list, list]] = {}
            for i, q in enumerate(strip):
                for s, w in zip(q["slots"], q["values"]):
                    if s in place:
                        rows, weights = by_slot.setdefault(s, ([], []))
                        rows.append(i)
                        weights.append(w / q["norm"])
            scores, shared = np.zeros((len(strip), len(norms))), np.zeros((len(strip), len(norms)), bool)
            for s in sorted(by_slot):
                rows, weights = by_slot[s]
                part = slice(bounds[place[s]], bounds[place[s] + 1])
                cells = np.ix_(rows, point[part])
                scores[cells] += np.outer(weights, values[part] / norms[point[part]])
                shared[cells] = True
            scores = np.where(shared, np.round(scores, PLACES), -np.inf)
            top = min(k, scores.shape[1])
            kth = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
            i, j = np.nonzero((scores >= kth[:, None]) & shared)
            by = np.lexsort((j, -scores[i, j], i))  # ids are sorted: the place breaks ties
            i, j = i[by], j[by]
            ok = np.arange(len(i)) - np.searchsorted(i, np.arange(len(strip)))[i] < top
            yield [strip[x]["qid"] for x in i[ok]], j[ok], scores[i[ok], j[ok]]

    def score(table: pa.Table) -> pa.Table:
        # a block at a time: an Arrow batch of blocks would hold as many as its rows allow, whatever their size
        q_type, out = table.schema.field("asking").type.value_type.field("qid").type, []
        for batch in table.to_batches():
            for r in range(batch.num_rows):
                one = lambda c: batch.column(c)[r].values  # noqa: E731, B023
                row = {"asking": batch.column("asking")[r].as_py(), **{c: one(c).to_numpy() for c in ("slots", "ends", "norms")}}
                ids = one("ids")
                for qids, at, scores in block_scores(row, one("at").to_numpy(), one("values").to_numpy()):
                    out.append(pa.RecordBatch.from_arrays([pa.array(qids, q_type), ids.take(pa.array(at)), pa.array(scores)], schema.names))
        kinds = [q_type, table.schema.field("ids").type.value_type, pa.float64()]
        return pa.Table.from_batches(out, pa.schema(list(zip(schema.names, kinds))))

    deal = F.pmod(F.xxhash64("qid"), F.lit(parts))
    asking = (asked.join(queries, "qid").groupBy("block", deal.alias("part"))
              .agg(F.collect_list(F.struct("qid", "slots", "values", "norm")).alias("asking")))
    return (asking.join(postings.select("block", "ids", "slots", "ends", "at", "values", "norms"), "block")
            .groupBy("block", "part").applyInArrow(score, schema))


def sparse_topk(postings: DataFrame, queries: DataFrame, *, k: int = TOP_K, qid_col: str = "query_id", slots: str = "slots",
                values: str = "values", norm: str | None = "norm", id_col: str = "id", stats: dict | None = None) -> DataFrame:
    """(qid_col, rank, id_col, similarity): the ``k`` best points of every query by inner product, exactly.

    Points that share no slot with a query are not its hits.  Ties (to
    ``PLACES`` places) go to the smaller id.  ``postings`` must be a stored
    ``posting_table``: its extremes are read once, blocks that are scored
    twice at most.  Query ids must be unique; empty queries have no hits.
    ``stats`` receives the share of (query, block) pairs that were not scored.
    """
    q = materialize(queries.select(F.col(qid_col).alias("qid"), F.col(slots).alias("slots"), F.col(values).cast("array<double>").alias("values"),
                                   (F.col(norm) if norm else F.lit(1.0)).cast("double").alias("norm"))
                    .where(F.col("qid").isNotNull() & (F.size("slots") > 0)), "sparse-queries")
    id_type = postings.schema["ids"].dataType.elementType
    parts = max(1, -(-q.count() // QUERY_ROWS))
    terms = (q.select("qid", "norm", F.explode(F.arrays_zip("slots", "values")).alias("e"))
             .select("qid", F.col("e.slots").alias("slot"), (F.col("e.values") / F.col("norm")).alias("w")))
    extremes = (postings.select("block", F.explode(F.arrays_zip("slots", "hi", "lo")).alias("e"))
                .select("block", F.col("e.slots").alias("slot"), "e.hi", "e.lo"))
    bound = F.sum(F.greatest(F.col("w") * F.col("hi"), F.col("w") * F.col("lo")))
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "block")
    bounds = materialize(terms.join(extremes, "slot").groupBy("qid", "block").agg(bound.alias("bound"))
                         .withColumn("first", F.row_number().over(order) <= FIRST_BLOCKS), "sparse-bounds")
    begun = materialize(_score_blocks(bounds.where("first").select("qid", "block"), q, postings, k, parts, id_type), "sparse-first")
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    enough = begun.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = materialize(bounds.where("not first").join(enough, "qid", "left")
                       .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2 * 10.0 ** -PLACES)).select("qid", "block"), "sparse-rest")
    if stats is not None:
        pairs = bounds.count()
        stats |= {"pairs": pairs, "skipped": 1.0 - (bounds.where("first").count() + rest.count()) / max(1, pairs)}
    every = begun.unionByName(_score_blocks(rest, q, postings, k, parts, id_type))
    return (every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("qid").alias(qid_col), "rank", F.col("id").alias(id_col), F.col("score").alias("similarity")))
