"""Shared building blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import materialize


def range_cut(df: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``_ps_part``, the number of its range partition on ``keys``; written to the shared folder.

    The bounds are quantiles of a sample of the rows, so the partitions are
    of about one size however the keys are spread, and each holds a run of
    the order.  Rows with equal keys stay together.  A number read twice
    must not change between the reads: hence the written table.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    return materialize(df.repartitionByRange(n, *order).withColumn("_ps_part", F.spark_partition_id()), "range-cut")


def prefix_sum(df: DataFrame, group_cols: list[str], order_col: str, value_col: str,
               out: str, *, num_partitions: int | None = None, inclusive: bool = False) -> DataFrame:
    """Running sum of ``value_col`` within each group, ordered by
    ``order_col`` (any ordered type; ties must not occur within a group),
    without putting a whole group into one task.

    Rows are range-partitioned on (group, order), so a large group lies on
    consecutive partitions of about equal size.  The totals of its earlier
    partitions are the offset of each one; a window over (group, partition)
    adds the running sum inside.  Only a group that began on an earlier
    partition has an offset, and a partition holds the end of at most one such
    group: the offsets are at most one row per partition, and are broadcast.
    """
    g = list(group_cols)
    cut = range_cut(df, [*g, order_col], num_partitions)
    totals = cut.groupBy(*g, "_ps_part").agg(F.sum(value_col).alias("_ps_total"))
    earlier = Window.partitionBy(*g).orderBy("_ps_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumns({"_ps_off": F.coalesce(F.sum("_ps_total").over(earlier), F.lit(0)), "_n": F.count(F.lit(1)).over(earlier)})
               .where("_n > 0").drop("_ps_total", "_n"))
    inside = (Window.partitionBy(*g, "_ps_part").orderBy(F.col(order_col).asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    res = (join_null_safe(cut, F.broadcast(offsets), [*g, "_ps_part"], "left")
           .withColumn(out, F.coalesce("_ps_off", F.lit(0)) + F.coalesce(F.sum(value_col).over(inside), F.lit(0))))
    return res.drop("_ps_part", "_ps_off")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_ns_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_ns_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_ns_{k}" for k in keys])


def spread(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Deal rows over ``num_partitions`` before a CPU-heavy stage, if asked.

    The caller knows its input: a single small file scans as one partition,
    and a row-local stage after it would run on one core.  Round-robin
    repartitioning sorts rows first, so a retried task rebuilds the same
    partitions.
    """
    return df.repartition(num_partitions) if num_partitions else df


def _folder(spark: SparkSession, path: str):
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root, fs_path


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below ``path``."""
    fs, root, _ = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(root))


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path`` (none if it is not there)."""
    fs, root, _ = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, root, _ = _folder(spark, path)
    fs.delete(root, True)


def mark_complete(spark: SparkSession, path: str) -> None:
    """Put the success mark into a folder made of several writes."""
    fs, _, fs_path = _folder(spark, path)
    fs.create(fs_path(f"{path}/_SUCCESS"), True).close()


def last_complete(spark: SparkSession, path: str, prefix: str) -> str | None:
    """Greatest name of a folder below ``path`` that starts with ``prefix`` and was written to its end."""
    fs, _, fs_path = _folder(spark, path)
    return max((n for n in subfolders(spark, path) if n.startswith(prefix) and fs.exists(fs_path(f"{path}/{n}/_SUCCESS"))), default=None)
