"""Writers: partitioned Parquet, JSON landing folders, CSV, JDBC, and the
insert-if-absent (first write wins) table sink."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import materialize


def append_partitioned_parquet(df: DataFrame, path: str, partition_col: str, *,
                               mode: str = "append") -> None:
    """Append ``df`` below ``path`` partitioned by ``partition_col``.

    Rows are clustered on the partition column first so every task writes to
    few partition folders; the rebalance hint lets adaptive execution cut a
    value that holds more than one advisory size over several tasks.  A null value lands in
    ``__HIVE_DEFAULT_PARTITION__``.  For a rerun-safe job use
    ``mode="overwrite"`` with ``partitionOverwriteMode=dynamic``: only the
    partitions present in ``df`` are replaced.
    """
    w = df.hint("rebalance", partition_col).write.mode(mode).partitionBy(partition_col)
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


# Lossless timestamp text for JSON/CSV files (Spark's default keeps millis).
TS_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def landing_partitions(ts: Column) -> list[Column]:
    """year/month/day partition strings of a timestamp (UTC, zero padded)."""
    return [F.date_format(ts, "yyyy").alias("year"), F.date_format(ts, "MM").alias("month"),
            F.date_format(ts, "dd").alias("day")]


def write_json_landing(df: DataFrame, path: str, ts_col: str, topic_col: str | None = None,
                       mode: str = "append") -> None:
    """Batch JSON-lines landing under ``[topic=…/]year=/month=/day=``; a large day is written by several tasks."""
    parts = ([topic_col] if topic_col else []) + ["year", "month", "day"]
    out = df.select("*", *landing_partitions(F.col(ts_col)))
    out.hint("rebalance", *parts).write.mode(mode).options(**TS_OPTIONS).partitionBy(*parts).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    df.write.mode(mode).option("header", True).options(**options).csv(path)


def write_jdbc_overwrite(df: DataFrame, url: str, table: str, *, user: str | None = None,
                         password: str | None = None, driver: str | None = None,
                         batchsize: int = 10000, num_partitions: int = 8) -> None:
    """Overwrite a database table keeping its definition (``truncate``).

    Credentials come from the caller (options or environment), never from
    code.  ``numPartitions`` bounds concurrent connections.
    """
    opts = {"truncate": "true", "batchsize": str(batchsize), "numPartitions": str(num_partitions)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    df.write.mode("overwrite").options(**opts).jdbc(url, table)


def first_per_key(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row per ``key``: the one with the smallest ``order`` value.

    ``min_by`` over a struct is a hash aggregate with a map-side partial
    step, so a key repeated a million times costs one partial row per task,
    not a sort of all its rows.  Null or empty keys are dropped here; use
    ``quality.split_missing_id`` to keep them as rejects.
    """
    order = F.col(order) if isinstance(order, str) else order
    cols = df.columns
    picked = (df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
              .groupBy(key)
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r")))
    return picked.select("_r.*")


# ------------------------------------------------ tables with a declared schema and hashed buckets

BUCKETS = 256  # fixed when a table is made


def _declared(spark: SparkSession, path: str) -> dict | None:
    """Declaration of the table at ``path`` (kept beside it): schema, key, number of buckets."""
    try:
        return json.loads(spark.read.text(f"{path}.declared", wholetext=True).first()[0])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        return None


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, *, key: str, n_buckets: int = BUCKETS) -> dict:
    """Create the table unless it is there; an existing one must have this schema (names and types) and key.

    The table is Parquet, partitioned by a hash of ``key`` into ``n_buckets``
    buckets, so that a lookup of some keys reads their buckets only.
    """
    known = _declared(spark, path)
    shape = {f.name: f.dataType.simpleString() for f in schema.fields}
    if known is None:
        known = {"schema": schema.jsonValue(), "key": key, "n_buckets": n_buckets}
        spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.declared")
    there = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(known["schema"]).fields}
    if there != shape or known["key"] != key:
        raise ValueError(f"table {path} is declared with {there} and key {known['key']}, not with {shape} and key {key}")
    return known


def _bucket(key: str, known: dict) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(known["n_buckets"])).cast("int")


def _stored(spark: SparkSession, path: str, known: dict) -> DataFrame:
    schema = T.StructType([*T.StructType.fromJson(known["schema"]).fields, T.StructField("_bucket", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table made by ``ensure_table`` (none yet: an empty frame)."""
    known = _declared(spark, path)
    if known is None:
        raise ValueError(f"no declared table at {path}")
    return _stored(spark, path, known).drop("_bucket")


def insert_if_absent(spark: SparkSession, new_rows: DataFrame, target_path: str, key: str,
                     order: Column | str, *, n_buckets: int = BUCKETS) -> DataFrame:
    """Append rows whose ``key`` is not yet in the table (first write wins).

    The table is made on first use (``ensure_table``).  Within the batch the
    first row per key by ``order`` wins (``min_by``); keys already in the
    table are removed with a left-anti join that reads only the key column of
    the buckets that the batch touches: at most ``n_buckets`` numbers go
    through the driver and become partition filters of the scan.  Replaying
    the same batch appends nothing, so micro-batch replays are idempotent.
    A second concurrent writer is out of scope.  Returns the rows that were
    appended.
    """
    known = ensure_table(spark, target_path, T.StructType([T.StructField(f.name, f.dataType) for f in new_rows.schema.fields]),
                         key=key, n_buckets=n_buckets)
    columns = T.StructType.fromJson(known["schema"]).names
    batch = materialize(first_per_key(new_rows, key, order).withColumn("_bucket", _bucket(key, known)), "insert-batch")
    touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())
    existing = _stored(spark, target_path, known).where(F.col("_bucket").isin(touched)).select(key)
    # the delta is written before the table is touched (reading and writing one table in one job would race)
    fresh = materialize(batch.join(existing, key, "left_anti"), "insert-delta")
    fresh.select(*columns, "_bucket").hint("rebalance", "_bucket").write.mode("append").partitionBy("_bucket").parquet(target_path)
    return fresh.select(*columns)
