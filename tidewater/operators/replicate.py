"""Whole-database copy: extract every table, load each to a target,
per-table manifest, and count + checksum reconciliation.

Source and target are catalogs: a base folder of Parquet tables (one
sub-folder or file per table) or a JDBC URL.  A failed table stops the
copy (later tables are not attempted), matching a stop-on-error restore.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.common import entries
from tidewater.operators.quality import fingerprint_columns


def discover_tables(spark: SparkSession, base: str, suffix: str = ".parquet") -> list[str]:
    """Names of the tables of a file catalog: files and folders of ``base`` that end in ``suffix``, hidden ones aside."""
    return sorted(n.removesuffix(suffix) for n in entries(spark, base) if n.endswith(suffix) and n[:1] not in "._" and n != suffix)


def extract_files(spark: SparkSession, base: str, tables: Iterable[str], fmt: str = "parquet",
                  suffix: str = ".parquet") -> dict[str, DataFrame]:
    """Every named table of a file catalog, as lazily read frames."""
    return {t: spark.read.format(fmt).load(f"{base.rstrip('/')}/{t}{suffix}") for t in tables}


def extract_jdbc(spark: SparkSession, url: str, tables: Iterable[str], *, properties: dict | None = None,
                 partitioning: dict[str, tuple[str, int, int, int]] | None = None) -> dict[str, DataFrame]:
    """Tables of a database; a table with an entry in ``partitioning``
    (column, lower, upper, numPartitions) is read by parallel range scans."""
    out = {}
    for t in tables:
        r = spark.read.format("jdbc").option("url", url).option("dbtable", t).options(**(properties or {}))
        if partitioning and t in partitioning:
            col, lo, hi, n = partitioning[t]
            r = (r.option("partitionColumn", col).option("lowerBound", lo)
                 .option("upperBound", hi).option("numPartitions", n))
        out[t] = r.load()
    return out


def load_files(spark: SparkSession, tables: dict[str, DataFrame], target: str,
               fmt: str = "parquet", *, at_once: int = 4) -> DataFrame:
    """Overwrite each table below ``target`` (drop-and-recreate) and return
    the manifest: table_name, n_rows, path, and the schema and checksums of
    the rows as they were read.

    Rows are counted and hashed while they are written (no extra pass over
    the source).  ``at_once`` tables are written side by side, so small ones
    do not wait for each other; after a failure no further table begins.
    """
    def load(name: str) -> tuple:
        df, path = tables[name], f"{target.rstrip('/')}/{name}"
        seen = Observation(f"load_{name}")
        df.observe(seen, *fingerprint_columns(df)).write.mode("overwrite").format(fmt).save(path)
        got = seen.get
        return name, int(got["rows"]), path, str(df.dtypes), got["xor_hash"], got["sum_hash"]

    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(load, name) for name in tables}
        try:
            rows = [running[name].result() for name in tables]
        except Exception:
            for f in running.values():
                f.cancel()
            raise
    return spark.createDataFrame(rows, "table_name string, n_rows long, path string, types string, xor_hash long, sum_hash decimal(38,0)")


def reconcile_loaded(spark: SparkSession, manifest: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Per table of a manifest: source rows, target rows, and whether names, types and checksums of what was stored are
    those of what was read.  One aggregate over each stored table; the manifest has a row per table."""
    stored = []
    for r in manifest.collect():
        df = spark.read.format(fmt).load(r["path"])
        stored.append(df.agg(*fingerprint_columns(df)).select(
            F.lit(r["table_name"]).alias("table_name"), F.lit(r["n_rows"]).cast("long").alias("source_rows"), F.col("rows").alias("target_rows"),
            (F.lit(str(df.dtypes) == r["types"]) & (F.col("rows") == r["n_rows"]) & F.col("xor_hash").eqNullSafe(F.lit(r["xor_hash"]))
             & F.col("sum_hash").eqNullSafe(F.lit(r["sum_hash"]))).alias("matches")))
    return reduce(DataFrame.unionByName, stored)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of every table, as one union of aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
