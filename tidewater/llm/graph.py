"""Connected components by alternating large-star and small-star steps.

Nothing is gathered on the driver but one row of counters per round.  Every
round writes its edges to the shared folder, so a lost executor re-reads
them and the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each node to the node's smallest neighbour (or itself)."""
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    near = turned if not larger_only else turned.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(low, "u")
    if larger_only:
        return linked.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    return (linked.select(F.col("m").alias("a"), F.col("v").alias("b"))
            .unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .where(F.col("a") < F.col("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reachable.

    Node ids must not be null.  No edges -> no rows.
    """
    def mark(e):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where(F.col("a") < F.col("b")).distinct(), "cc-edges")
    before = mark(e)
    while before["n"]:
        e = materialize(_star(_star(e, True), False), "cc-edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct())
