"""Exact nearest neighbours of every row (Euclidean) by metric pruning.

Rows are cut into cells around centres.  What is kept of a cell - the largest
distance to its centre and the ranges of distances to a few pivots - gives,
by the triangle inequality, a lower bound on the distance between a row and
anything in the cell; so does the plane half-way between two centres, which
no row of the farther cell crosses.  A first pass compares each row with its
own cell, which bounds its k-th distance from above; the second pass takes a
row to those cells only whose lower bound is within that.  The rest is
skipped, and the result is that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import materialize

BLOCK_ROWS = 512        # rows that a cell should hold
MAX_CELLS = 4096        # bounds what is sent to every task: centres, radii, pivot ranges
PIVOTS = 8
SAMPLE_VALUES = 1 << 22  # components of the rows that centres are fitted on
BUNDLE_ROWS = 131072    # rows of neighbouring cells that one task holds
VISIT_ROWS = 262144     # visitors of a bundle that one task compares
STRIP = 1024            # visitors per matrix product
BOUND_VALUES = 65536    # rows times cells whose bounds are worked out at once: the arrays stay in a core's cache
PIECE = 4096            # rows of a cell per matrix product
BOX_DIMENSIONS = 32     # longer vectors have no coordinate ranges per cell
_SLACK = 1e-6           # rounding allowed for in lower bounds, as a share of the largest coordinate length


class Cells(NamedTuple):
    """Centres and what is known of the rows around them (at most ``MAX_CELLS`` of each)."""
    centre: np.ndarray      # cells x dimensions
    pivot: np.ndarray       # pivots x dimensions
    radius: np.ndarray      # largest distance of a cell's row to its centre, -1 if it has none
    low: np.ndarray         # cells x pivots: least and largest distance of the cell's rows to a pivot
    high: np.ndarray
    scale: float
    least: np.ndarray | None = None  # cells x dimensions: the coordinate ranges of the cell's rows
    most: np.ndarray | None = None


def _vectors(column) -> np.ndarray:
    """List column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _pair_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of row i of ``a`` to row i of ``b``: the same value for a pair in any batch and either order."""
    d = np.ascontiguousarray(a - b)
    return np.sqrt((d * d).sum(1))


def fit_centres(sample: np.ndarray, cells: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Means of at most ``cells`` groups of the sample rows (Lloyd's iteration)."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([_square(sample[i:i + 4096], centre).argmin(1) for i in range(0, len(sample), 4096)])
        n = np.bincount(home, minlength=len(centre))
        total = np.stack([np.bincount(home, sample[:, j], len(centre)) for j in range(sample.shape[1])], 1)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return np.unique(centre, axis=0)


def far_apart(centre: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres, each the farthest from those before it."""
    chosen, near = [0], _square(centre, centre[:1])[:, 0]
    while len(chosen) < min(n, len(centre)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _square(centre, centre[chosen[-1:]])[:, 0])
    return centre[chosen]


def lower_bounds(rows: np.ndarray, home: np.ndarray, cells: Cells, some: np.ndarray | None = None, reach: np.ndarray | None = None) -> np.ndarray:
    """Rows x cells (or ``some`` of them): no row of the cell is nearer than this (less rounding); infinite for cells without rows.

    A cell that is beyond a row's ``reach`` by its centre alone need not get a sharper bound.
    """
    number = len(cells.centre) if some is None else len(some)
    step = max(16, BOUND_VALUES // max(1, number))
    if len(rows) > step:
        out = np.empty((len(rows), number))
        for lo in range(0, len(rows), step):
            out[lo:lo + step] = lower_bounds(rows[lo:lo + step], home[lo:lo + step], cells, some, None if reach is None else reach[lo:lo + step])
        return out
    pick = (lambda x: x) if some is None else (lambda x: x[some])
    centre, radius = pick(cells.centre), pick(cells.radius)
    square = _square(rows, centre)
    bound = np.sqrt(square) - radius[None, :]
    apart = np.sqrt(_square(cells.centre[home], centre))
    np.copyto(apart, np.inf, where=apart <= _SLACK * cells.scale)
    own = ((rows - cells.centre[home]) ** 2).sum(1)[:, None]
    np.maximum(bound, (square - own) / (2.0 * apart), out=bound)
    to_pivot = np.sqrt(_square(rows, cells.pivot))
    low, high = pick(cells.low), pick(cells.high)
    if reach is not None:
        far = reach + _SLACK * cells.scale
        i, c = np.nonzero(bound <= far[:, None])
        if 4 * len(i) < bound.size:  # few are left: theirs only
            near = bound[i, c]
            for j in range(len(cells.pivot)):
                away = to_pivot[i, j]
                np.maximum(near, low[c, j] - away, out=near)
                np.maximum(near, away - high[c, j], out=near)
            if cells.least is not None:
                least, most, off = pick(cells.least), pick(cells.most), np.zeros(len(i))
                for j in range(rows.shape[1]):
                    x = rows[i, j]
                    out = np.maximum(np.maximum(least[c, j] - x, x - most[c, j]), 0.0)
                    off += out * out
                np.maximum(near, np.sqrt(off), out=near)
            bound[i, c] = near
            bound[:, radius < 0] = np.inf
            return bound
    for j in range(len(cells.pivot)):
        np.maximum(bound, low[None, :, j] - to_pivot[:, j:j + 1], out=bound)
        np.maximum(bound, to_pivot[:, j:j + 1] - high[None, :, j], out=bound)
    if cells.least is not None:
        least, most, off = pick(cells.least), pick(cells.most), np.zeros_like(bound)
        for j in range(rows.shape[1]):
            x = rows[:, j:j + 1]
            out = np.maximum(least[None, :, j] - x, x - most[None, :, j])
            np.maximum(out, 0.0, out=out)
            off += out * out
        np.maximum(bound, np.sqrt(off), out=bound)
    bound[:, radius < 0] = np.inf
    return bound


def _fitted(distinct: DataFrame, n: int, dim: int, block_rows: int, max_cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    count = max(1, min(-(-n // block_rows), max_cells, SAMPLE_VALUES // (4 * dim)))
    order = F.xxhash64(F.lit(seed), "vid")
    sample = (distinct.orderBy(order, "vid").limit(min(16 * count, max(1, SAMPLE_VALUES // dim))).select("v").toArrow())
    rows = _vectors(sample["v"])
    centre = fit_centres(rows, count, seed) if count > 1 else rows.mean(0, keepdims=True)
    return centre, far_apart(centre, PIVOTS)


def _placed(distinct: DataFrame, centre: np.ndarray, pivot: np.ndarray) -> DataFrame:
    """Rows with their cell, the distance to its centre and those to the pivots."""
    schema = T.StructType([*distinct.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("out", T.DoubleType()),
                           T.StructField("to_pivot", T.ArrayType(T.DoubleType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIP):
                part = batch.slice(lo, STRIP)
                rows = _vectors(part.column("v"))
                square = _square(rows, centre)
                home = square.argmin(1)
                away = np.sqrt(_square(rows, pivot))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(np.sqrt(square[np.arange(len(rows)), home])),
                                                  pa.array(list(away), pa.list_(pa.float64()))], schema.names)

    return distinct.mapInArrow(place, schema)


def _known(placed: DataFrame, centre: np.ndarray, pivot: np.ndarray) -> tuple[Cells, dict[int, int]]:
    """Radius, pivot and coordinate ranges of every cell (one aggregate, a row per cell), and the rows it holds."""
    p = range(len(pivot))
    d = range(centre.shape[1]) if centre.shape[1] <= BOX_DIMENSIONS else range(0)
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("out").alias("radius"),
                                      *[F.min(F.col("to_pivot")[j]).alias(f"low{j}") for j in p],
                                      *[F.max(F.col("to_pivot")[j]).alias(f"high{j}") for j in p],
                                      *[F.min(F.col("v")[j]).alias(f"least{j}") for j in d],
                                      *[F.max(F.col("v")[j]).alias(f"most{j}") for j in d]).collect()
    radius, low, high = np.full(len(centre), -1.0), np.zeros((len(centre), len(pivot))), np.zeros((len(centre), len(pivot)))
    least, most = np.zeros(centre.shape), np.zeros(centre.shape)
    for r in rows:
        radius[r["cell"]] = r["radius"]
        low[r["cell"]], high[r["cell"]] = [r[f"low{j}"] for j in p], [r[f"high{j}"] for j in p]
        if d:
            least[r["cell"]], most[r["cell"]] = [r[f"least{j}"] for j in d], [r[f"most{j}"] for j in d]
    scale = float(np.sqrt((centre * centre).sum(1)).max() + radius.max())
    box = (least, most) if d else (None, None)
    return Cells(centre, pivot, radius, low, high, max(scale, 1e-300), *box), {r["cell"]: r["n"] for r in rows}


def bundles(centre: np.ndarray, held: dict[int, int], rows: int) -> np.ndarray:
    """Number of each cell's bundle: cells near each other, of about ``rows`` rows together (halved along the widest coordinate until they fit)."""
    size = np.array([held.get(c, 0) for c in range(len(centre))])
    number, todo, n = np.zeros(len(centre), np.int32), [np.arange(len(centre))], 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or size[part].sum() <= rows:
            number[part] = n
            n += 1
            continue
        part = part[np.argsort(centre[part, np.ptp(centre[part], axis=0).argmax()], kind="stable")]
        total = size[part].cumsum()
        cut = min(max(int(np.searchsorted(total, total[-1] / 2)), 1), len(part) - 1)
        todo += [part[cut:], part[:cut]]
    return number


def _upper_bounds(placed: DataFrame) -> DataFrame:
    """Rows with ``reach``: the largest distance to ``need`` others of the row's block (infinite in a block that is too small)."""
    keep = ["vid", "v", "need", "cell"]
    schema = T.StructType([*[placed.schema[c] for c in keep], T.StructField("reach", T.DoubleType())])

    def own_block(table: pa.Table) -> pa.Table:
        rows, need = _vectors(table["v"]), table["need"].to_numpy()
        reach = np.full(len(rows), np.inf)
        most = min(int(need.max()), len(rows) - 1)
        if most > 0:
            for lo in range(0, len(rows), STRIP):
                square = _square(rows[lo:lo + STRIP], rows)
                at = np.arange(len(square))
                square[at, lo + at] = np.inf
                near = np.argpartition(square, most - 1, axis=1)[:, :most] if most < len(rows) else np.tile(np.arange(len(rows)), (len(square), 1))
                away = _pair_distance(np.repeat(rows[lo:lo + STRIP], most, 0), rows[near.ravel()]).reshape(len(square), most)
                away.sort(1)
                want = need[lo:lo + STRIP]
                enough = want <= most
                reach[lo:lo + STRIP][enough] = away[at[enough], want[enough] - 1]
        return table.select(keep).append_column("reach", pa.array(reach))

    return placed.groupBy("cell", "sub").applyInArrow(own_block, schema)


def _visits(bounded: DataFrame, cells: Cells, bundle: np.ndarray, held: dict[int, int]) -> DataFrame:
    """One row per row and bundle with cells that may hold one of its neighbours (its own among them): how many, and the rows in them."""
    schema = T.StructType([*bounded.select("vid", "v", "need", "reach").schema.fields, T.StructField("home", T.IntegerType()),
                           T.StructField("bundle", T.IntegerType()), T.StructField("cells", T.IntegerType()), T.StructField("rows", T.LongType())])
    size = np.array([held.get(c, 0) for c in range(len(bundle))])
    order = np.argsort(bundle, kind="stable")
    number, first = np.unique(bundle[order], return_index=True)
    strip = max(16, min(STRIP, 4 * BOUND_VALUES // len(bundle)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, strip):
                part = batch.slice(lo, strip)
                home, reach = part.column("cell").to_numpy(), part.column("reach").to_numpy()
                bound = lower_bounds(_vectors(part.column("v")), home, cells, reach=reach)
                # an unbounded reach does not take a row to cells without rows
                goes = ((bound <= (reach + _SLACK * cells.scale)[:, None]) & np.isfinite(bound))[:, order]
                n = np.add.reduceat(goes, first, axis=1, dtype=np.int32)
                rows = np.add.reduceat(goes * size[order], first, axis=1)
                row, to = np.nonzero(n)
                for at in range(0, len(row), 8192):
                    i, j = row[at:at + 8192], to[at:at + 8192]
                    some = part.select(["vid", "v", "need", "reach", "cell"]).take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(number[j]), pa.array(n[i, j]), pa.array(rows[i, j].astype(np.int64))], schema.names)

    return bounded.mapInArrow(visit, schema)


def _best(row: np.ndarray, at: np.ndarray, away: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``need`` nearest entries of every row (ties: smaller place), and their rank."""
    order = np.lexsort((at, away, row))
    row, at, away = row[order], at[order], away[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(need)))[row]
    ok = rank < need[row]
    return row[ok], at[ok], away[ok], rank[ok]


def _compared(visitors: DataFrame, residents: DataFrame, key: list[str], id_type: T.DataType, cells: Cells) -> DataFrame:
    """(vid, other, distance): per visitor and bundle, its ``need`` nearest others within reach (ties: smaller id)."""
    schema = T.StructType([T.StructField("vid", id_type), T.StructField("other", id_type), T.StructField("distance", T.DoubleType())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("vid").type
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], schema.names)
        right = right.sort_by("vid")  # then a resident's position orders ties
        rows, others = _vectors(left["v"]), _vectors(right["v"])
        vid, other = left["vid"].combine_chunks(), right["vid"].combine_chunks()
        reach, need, home = left["reach"].to_numpy(), left["need"].to_numpy(), left["home"].to_numpy()
        # a visitor that lives here is not its own neighbour
        self_at = pc.fill_null(pc.index_in(vid, other), -1).to_numpy()
        length = (others * others).sum(1)
        cell = right["cell"].to_numpy()
        by_cell = np.argsort(cell, kind="stable")
        some, first = np.unique(cell[by_cell], return_index=True)
        ends = np.append(first[1:], len(cell))
        out = [[], [], []]
        for lo in range(0, len(rows), STRIP):
            mine, here, want, home_here = (x[lo:lo + STRIP] for x in (rows, self_at, need, home))
            far = reach[lo:lo + STRIP].copy()
            norm = (mine * mine).sum(1)
            bound = lower_bounds(mine, home_here, cells, some, far)
            best, fresh = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), 0
            # the cells that are nearest for most rows first
            for c in np.argsort(np.minimum(bound, cells.scale * 4).sum(0), kind="stable"):
                for start in range(first[c], ends[c], PIECE):
                    i = np.flatnonzero(bound[:, c] <= far + _SLACK * cells.scale)
                    if not len(i):
                        break
                    place = by_cell[start:min(start + PIECE, ends[c])]
                    longest = length[place].max()
                    square = norm[i, None] + length[None, place] - 2.0 * (mine[i] @ others[place].T)
                    square[here[i][:, None] == place[None, :]] = np.inf
                    limit = far[i] ** 2 * (1 + 1e-9) + 1e-9 * (norm[i] + longest)
                    most = int(want[i].max())
                    if not np.isfinite(limit).all() and most < len(place):
                        # no more than the `need` nearest of a piece can count
                        kth = np.partition(square, most - 1, axis=1)[:, most - 1]
                        np.minimum(limit, kth + 2e-9 * (norm[i] + longest) + 1e-9 * np.abs(kth), out=limit)
                    a, b = np.nonzero((square <= limit[:, None]) & (square < np.inf))
                    a, b = i[a], place[b]
                    away = _pair_distance(mine[a], others[b])
                    ok = away <= far[a]
                    best = tuple(np.append(x, y[ok]) for x, y in zip(best, (a, b, away)))
                    fresh += int(ok.sum())
                    if fresh > len(mine):
                        # a row that has all it needs is taken no farther than the last of them
                        *best, rank = _best(*best, want)
                        full = rank == want[best[0]] - 1
                        far[best[0][full]] = best[2][full]
                        fresh = 0
            i, j, away, _ = _best(*best, want)
            out[0].append(i + lo)
            out[1].append(j)
            out[2].append(away)
        return pa.table([vid.take(pa.array(np.concatenate(out[0]))), other.take(pa.array(np.concatenate(out[1]))), pa.array(np.concatenate(out[2]))], schema.names)

    return visitors.groupBy(*key).cogroup(residents.groupBy(*key)).applyInArrow(compare, schema)


def nearest_neighbours(points: DataFrame, *, k: int, id_col: str = "id", vec_col: str = "vector", block_rows: int = BLOCK_ROWS,
                       max_cells: int = MAX_CELLS, seed: int = 42, stats: dict | None = None) -> DataFrame:
    """(id_col, neighbour, rank, distance): the ``k`` nearest other rows of every row, exactly; ties go to the smaller id.

    Ids must be unique.  Rows with a null id, or a vector that is null,
    empty or holds null or non-finite components, take no part; with fewer than
    ``k`` others, all are returned.  The vectors must have one length, not 0.  Equal
    vectors are searched once: a row's twins are its nearest neighbours, and a
    vector with more than ``k`` of them is not searched at all, so copies cost
    one row whatever their number.

    Scale.  Cells follow the data up to ``max_cells``; centres are fitted on a
    sample of at most ``SAMPLE_VALUES`` components, which decides cost, not
    results.  A cell of more rows than ``2 * block_rows``, or with many
    visitors, is cut into blocks, so a dense spot is many tasks' work.  The
    gain depends on the data: none where all distances are alike.

    ``stats``, if given, receives the number of distinct rows and cells, and
    the share of (row, cell) pairs that were skipped.
    """
    id_type = points.schema[id_col].dataType
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    p = points.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & finite)
    # -0.0 and 0.0 are one value
    p = materialize(p.withColumn("v", F.transform("v", lambda x: x + 0.0)), "nn-rows")
    alike = materialize(p.groupBy("v").agg(F.count("*").alias("g"), F.min("id").alias("vid")), "nn-distinct")
    # vectors that several rows share, with their k + 1 smallest ids
    first = Window.partitionBy("vid").orderBy("id")
    shared = alike.where("g > 1").withColumnRenamed("v", "w")
    twins = materialize(p.join(shared, F.col("v") == F.col("w")).drop("v", "w"), "nn-twins")
    leaders = (twins.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
               .groupBy("vid").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    same = (twins.join(leaders, "vid").select("id", F.explode(F.slice(F.array_except("ids", F.array("id")), 1, k)).alias("neighbour"))
            .withColumn("distance", F.lit(0.0)))

    distinct = alike.where(F.col("g") <= k).select("vid", "v", (F.lit(k + 1) - F.col("g")).cast("int").alias("need"), F.lit(True).alias("asks"))
    distinct = distinct.unionByName(alike.where(F.col("g") > k).select("vid", "v", F.lit(k).cast("int").alias("need"), F.lit(False).alias("asks")))
    size = alike.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return same.select(F.col("id").alias(id_col), "neighbour", F.lit(1).alias("rank"), "distance")
    centre, pivot = _fitted(distinct, size["n"], max(size["dim"], 1), block_rows, max_cells, seed)
    placed = materialize(_placed(distinct, centre, pivot), "nn-placed")
    cells, held = _known(placed, centre, pivot)

    def by(numbers: dict[int, int], per: int, col: str):
        """Column: the number of blocks of the row's cell or bundle (a literal map of at most ``max_cells`` entries)."""
        many = {c: -(-n // per) for c, n in numbers.items() if n > per}
        if not many:
            return F.lit(1)
        return F.coalesce(F.create_map(*[F.lit(x) for item in sorted(many.items()) for x in item])[F.col(col)], F.lit(1))

    sub = lambda n: F.pmod(F.xxhash64(F.lit(seed), "vid"), n).cast("int")
    asking = placed.where("asks").withColumn("sub", sub(by(held, 2 * block_rows, "cell")))
    # a row goes once to a bundle of cells, however many of them it visits: what is shuffled follows rows times bundles
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    bundle = bundles(centre, held, max(block_rows, min(BUNDLE_ROWS, -(-size["n"] // tasks))))
    of = {i: int(b) for i, b in enumerate(bundle)}
    in_bundle: dict[int, int] = {}
    for c, n in held.items():
        in_bundle[of[c]] = in_bundle.get(of[c], 0) + n
    visits = materialize(_visits(_upper_bounds(asking), cells, bundle, held), "nn-visits")
    calls = visits.groupBy("bundle").agg(F.count("*").alias("n"), F.sum("cells").alias("cells"), F.sum("rows").alias("rows")).collect()
    if stats is not None:
        n, asked = size["n"], asking.count()
        stats |= {"rows": n, "cells": len(centre), "skipped": 1.0 - sum(r["cells"] for r in calls) / max(1, asked * len(held)),
                  "pairs_skipped": 1.0 - sum(r["rows"] for r in calls) / max(1, asked * n)}
    subs, parts = by(in_bundle, 2 * BUNDLE_ROWS, "bundle"), by({r["bundle"]: r["n"] for r in calls}, VISIT_ROWS, "bundle")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    visitors = (visits.select("vid", "v", "need", "reach", "home", "bundle").withColumn("part", F.pmod(F.xxhash64("vid"), parts).cast("int"))
                .withColumn("sub", every(subs)))
    number = F.array(*[F.lit(int(b)) for b in bundle])
    residents = placed.select("vid", "v", "cell", F.get(number, F.col("cell")).alias("bundle")).withColumn("sub", sub(subs)).withColumn("part", every(parts))
    near = _compared(visitors, residents, ["bundle", "sub", "part"], id_type, cells)
    # the neighbour's twins are as near as itself; at most k + 1 of them are known and can count
    others = leaders.withColumnRenamed("vid", "other")
    found = (near.join(others, "other", "left").select("vid", "distance", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour")))
    # every member of a small group of twins has what its vector found
    group = leaders.withColumnRenamed("vid", "leader")
    found = (found.join(group, F.col("vid") == F.col("leader"), "left")
             .select(F.explode(F.coalesce("ids", F.array("vid"))).alias("id"), "neighbour", "distance"))
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (found.unionByName(same.select("id", "neighbour", "distance")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("id").alias(id_col), "neighbour", "rank", "distance"))
