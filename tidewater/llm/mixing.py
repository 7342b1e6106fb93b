"""Mixing sources to target weights along a time-varying curriculum.

Targets: the demand (``demand`` times all words) is shared over the sources
by weight; a target stops at ``max_repeat`` times its source's size and the
excess goes to the others by weight (water filling, in closed form over the
source table).  Inside a source, documents come in the order of a hash of
their id; whole passes first, then one partial pass that ends where the
target does, inside one document.

Curriculum: each source has a weight schedule, piecewise linear over the
training progress 0..1.  Its integral, scaled to the target, is the source's
cumulative word demand; the position of a document's pass is the progress at
which the demand reaches the middle of that pass (the inverse of the
integral, a quadratic per schedule piece).  Documents are range-sorted by
position.

Only DataFrame functions.  The running sum inside a source is cut into
``BUCKETS`` hash ranges, so a source that holds a third of all rows is spread
over as many tasks.  The source table (one row per source) is ranked and
filled in one window.

Defined results: null text has size 0 and is never taken (null position);
null source is a source of its own, last in rank; rows with equal id and size
are interchangeable and each counts; an empty table gives no rows; a demand
above ``max_repeat`` times all words takes exactly that; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: (progress, weight factor) knots, dealt to the sources by rank; each integrates to 1
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
BUCKET_DIGITS = 3  # hash ranges per source: 16 ** 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, demand: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target) from (source, size) rows."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    full = (src.withColumn("rank", F.row_number().over(by_name) - 1)
            .withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
            .withColumn("ratio", F.col("cap") / F.col("w"))
            .withColumn("need", F.sum("source_size").over(all_rows) * F.lit(float(demand)))
            .withColumn("used", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("w_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("is_full", F.col("ratio") <= (F.col("need") - F.col("used")) / F.col("w_left")))
    rest = F.col("need") - F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0.0)).over(all_rows)
    free = F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("w"))).over(all_rows)
    return full.withColumns({"rest": rest, "free": free}).select(
        "source", "rank", "source_size",
        F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("rest") * F.col("w") / F.col("free")).alias("target"))


def progress_at(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Progress at which the schedule's integral reaches ``share`` of its total."""
    def pieces(knots):
        out, area = [], 0.0
        total = sum((t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(knots, knots[1:]))
        for (t0, f0), (t1, f1) in zip(knots, knots[1:]):
            f0, f1 = f0 / total, f1 / total
            out.append(F.struct(F.lit(area).alias("a"), F.lit(float(t0)).alias("t"), F.lit(f0).alias("f"),
                                F.lit((f1 - f0) / (t1 - t0)).alias("s")))
            area += (t1 - t0) * (f0 + f1) / 2
        return F.array(*out)

    curves = F.element_at(F.array(*[pieces(k) for k in schedules]), (rank % len(schedules) + 1).cast("int"))
    piece = F.element_at(F.filter(curves, lambda p: p["a"] <= share), -1)
    b = share - piece["a"]
    return piece["t"] + 2 * b / (piece["f"] + F.sqrt(piece["f"] * piece["f"] + 2 * piece["s"] * b))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        schedules=SCHEDULES, demand: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and ``passes``
    (array of struct<pass int, words long, position double>)."""
    sizes = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key")), "mix-sizes")
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    tgt = materialize(targets(sizes, weights=weights, demand=demand, max_repeat=max_repeat), "mix-targets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
              .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (sizes.withColumn("bucket", bucket)
            .withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
    named = tgt.withColumnRenamed("source", "_s")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    size_s = F.col("source_size")
    whole = F.when(size_s > 0, F.floor(budget / size_s)).otherwise(0).cast("long")
    rows = (rows.withColumn("at", F.col("offset") + F.col("within")).withColumn("budget", budget).withColumn("whole", whole)
            .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("whole") * size_s - F.col("at"))))
            .withColumn("taken", F.col("whole") * F.col("size") + F.col("part")))
    words = F.when(F.col("size") == 0, F.array().cast("array<long>")).otherwise(F.concat(
        F.array_repeat(F.col("size"), F.col("whole").cast("int")),
        F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>"))))
    passes = F.transform(words, lambda n, i: F.struct(
        i.cast("int").alias("pass"), n.alias("words"),
        progress_at((i * size_s + F.col("at") + n / 2) / F.col("budget"), F.col("rank"), schedules).alias("position")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", passes.alias("passes"), "key")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per document pass, range-sorted by training position."""
    return (mixed.select("doc_id", "source", "key", F.inline("passes"))
            .orderBy("position", "key", "pass").drop("key"))


def by_first_position(mixed: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the position of its first pass (untaken documents last)."""
    return (mixed.withColumn("position", F.get(F.col("passes"), F.lit(0))["position"])
            .orderBy(F.col("position").asc_nulls_last(), "key")
            .select("doc_id", "source", "size", "source_size", "target", "taken", "position"))
