"""Filter interaction audit: what every order of a set of filters removes, loses and repeats.

Documents are reduced to *mask cells*: one row per part and per set of
filters a document fails, with the number of documents and of labelled good
and toxic ones.  There are at most 2 ** 5 cells per part, whatever the size
of the corpus.  Each cell folds across the array of all orders
(``transform`` over the orders, ``aggregate`` over the steps of one order,
carrying whether the cell's documents are still there), which gives 600
structs weighted by the cell's counts; the cells of a part are merged by
elementwise sums (``zip_with``).  The order array has 5! = 120 entries and
travels as a literal of the plan.

The copy filter needs no join of documents on their text: documents are first
summed per (doc_id, text digest, part, mask) and then per (digest, part,
labels), keeping the smallest id and how many rows carry it, so a text with
any number of copies is a handful of rows when it meets the table-wide
smallest id of its digest.

Defined results: null text counts as empty, null ``lang`` as the part ''; a
document without a label row, or with null labels, is neither good nor toxic,
and one with several label rows is good (toxic) if any of them says so;
rows that share a doc_id are documents of their own and never copies of each
other; a null doc_id is neither smaller nor larger than another; an empty
table has no parts, hence no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
COPY = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of one text: short, repetitive, shouting, marked up."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * capitals > 3 * F.char_length(text),
            text.rlike(r"[#$%&*|]")]


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): bit i of ``mask`` is set if the documents fail filter number i + 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(text))]
    rows = (docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce("lang", F.lit("")).alias("part"),
                        sum(bits[1:], bits[0]).alias("mask"))
            .groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    # rows without an id have no label; their join key is the digest's hash, so that they spread over the tasks
    key = F.coalesce("doc_id", F.xxhash64("digest"))
    flagged = (rows.join(known, (key == F.col("labelled")) & F.col("doc_id").isNotNull(), "left")
               .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}))
    copies = materialize(flagged.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("id"), F.min_by("n", "doc_id").alias("n_id"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")), "audit-copies")
    first = copies.groupBy("digest").agg(F.min("id").alias("first"))
    original = F.col("n_null") + F.when(F.col("id") == F.col("first"), F.col("n_id")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), original.alias("n")),
                   F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - original).alias("n")))
    return (copies.join(first, "digest").select("part", "good", "toxic", F.inline(both))
            .where("n > 0").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]))


def _folded(orders: Column, n_filters: int) -> Column:
    """One cell along every order: a struct of ``COUNTS`` per order and step, in that sequence."""
    def fails(number: Column) -> Column:
        return F.getbit("mask", number - 1) == 1

    def share(condition: Column, weight: str) -> Column:
        return F.when(condition, F.col(weight)).otherwise(F.lit(0).cast("long"))

    def step(state: Column, number: Column) -> Column:
        here, there = state["there"] & fails(number), state["there"]
        only = F.bit_count("mask") == 1
        values = [share(there & ~fails(number), "n"), share(here, "n"), share(~there & fails(number), "n"),
                  share(fails(number) & only, "n"), share(here, "good"), share(here, "toxic")]
        row = F.struct(*[v.alias(c) for v, c in zip(values, COUNTS)])
        return F.struct((there & ~fails(number)).alias("there"), F.array_append(state["steps"], row).alias("steps"))

    none = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>")
    start = F.struct(F.lit(True).alias("there"), none.alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))


def fold(cells: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """One row per part, order of ``filters`` and step from mask cells (part, mask, n, good, toxic)."""
    k = len(filters)
    numbers = list(permutations(range(1, k + 1)))
    orders = F.array(*[F.array(*map(F.lit, o)) for o in numbers])
    merged = (cells.select("part", _folded(orders, k).alias("cell")).groupBy("part").agg(F.collect_list("cell").alias("cells"))
              .select("part", F.aggregate(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), F.element_at("cells", 1), _add).alias("steps")))
    names = F.array(*[F.lit("".join(filters[i - 1] for i in o)) for o in numbers])
    place = F.array(*[F.lit(i) for o in numbers for i in o])  # the filter number at each of the k * k! elements
    removed_by = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda number: F.aggregate(
        F.zip_with("steps", place, lambda s, p: F.when(p == number, s["removed"]).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b))
    return (merged.select("part", removed_by.alias("by_filter"), F.posexplode("steps").alias("at", "row"))
            .select("part", F.element_at(names, F.expr(f"at div {k}").cast("int") + 1).alias("filter_order"),
                    (F.col("at") % k + 1).cast("int").alias("step"), *[F.col(f"row.{c}").alias(c) for c in COUNTS],
                    F.element_at("by_filter", F.element_at(place, F.col("at") + 1)).alias("shapley")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic)."""
    return fold(mask_cells(docs, labels))
