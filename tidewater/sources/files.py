"""File readers: JSON lines, time-partitioned lake folders, CSV, extracts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A typed frame with no rows (no job is run to build it)."""
    return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path, schema: T.StructType, *,
               keep_corrupt: bool = False, base_path: str | None = None) -> DataFrame:
    """JSON lines with an explicit all-nullable schema.

    PERMISSIVE mode: a malformed line becomes a row of nulls; with
    ``keep_corrupt`` its raw text is kept in ``_corrupt_record`` so callers
    can route it to a dead-letter table instead of losing it silently.
    """
    s = schema
    if keep_corrupt and CORRUPT not in schema.fieldNames():
        s = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    r = spark.read.schema(s).option("mode", "PERMISSIVE")
    if keep_corrupt:
        r = r.option("columnNameOfCorruptRecord", CORRUPT)
    if base_path:
        r = r.option("basePath", base_path)
    return r.json(path)


def read_or_empty(spark: SparkSession, path, schema: T.StructType, fmt: str = "json",
                  **options) -> DataFrame:
    """Read ``path``; a missing path gives a typed empty frame.

    Only "path does not exist" is turned into "nothing to do"; every other
    error propagates.  Emptiness is checked by callers with ``isEmpty()``
    (a LIMIT 1 job), never with ``count()``.
    """
    try:
        # File sources resolve their paths in load(): a missing path raises here.
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return empty_frame(spark, schema)
        raise


def read_lake(spark: SparkSession, base: str, schema: T.StructType, *,
              fmt: str = "json", partition_filter: Column | None = None) -> DataFrame:
    """Scan a ``<base>/year=YYYY/month=MM/day=DD/`` lake folder.

    Reading the base directory (not a file glob) keeps the partition columns;
    a filter on them is applied at planning time (directory pruning), so only
    the matching days are listed and read.
    """
    part = T.StructType(schema.fields + [
        T.StructField("year", T.IntegerType(), True),
        T.StructField("month", T.IntegerType(), True),
        T.StructField("day", T.IntegerType(), True),
    ])
    df = spark.read.schema(part).format(fmt).load(base)
    return df.where(partition_filter) if partition_filter is not None else df


def read_lake_days(spark: SparkSession, base: str, schema: T.StructType, days: DataFrame, *, fmt: str = "json") -> DataFrame:
    """Rows of the days in ``days`` (year, month, day as integers, each once), known only when the query runs.

    The join on the partition columns lets Spark take the days it finds there
    as a filter on the folders (dynamic partition pruning), so the other
    days are not read; for days known beforehand give ``read_lake`` a filter.
    """
    lake = read_lake(spark, base, schema, fmt=fmt)
    return lake.join(days.select("year", "month", "day"), ["year", "month", "day"]).select(lake.columns)


def read_csv(spark: SparkSession, path, schema: T.StructType, *, header: bool = True,
             encoding: str = "ISO-8859-1", **options) -> DataFrame:
    """CSV with a declared schema (latin-1 by default).  A missing path raises."""
    return (spark.read.schema(schema).option("header", header)
            .option("encoding", encoding).options(**options).csv(path))


def _text_bool(c: Column) -> Column:
    """Extract booleans written as t/f (or true/false); anything else -> null."""
    lc = F.lower(F.trim(c))
    return (F.when(lc.isin("t", "true", "1"), F.lit(True))
            .when(lc.isin("f", "false", "0"), F.lit(False)))


def read_bi_extracts(spark: SparkSession, scores_path=None, models_path=None,
                     metrics_path=None) -> dict[str, DataFrame]:
    """Typed reads of the three dashboard extracts.

    ``t``/``f`` become booleans, epoch-ms columns become timestamps, the text
    ``None`` in ``current_stage`` stays a value (it is a stage name there).
    """
    out: dict[str, DataFrame] = {}
    if scores_path:
        raw = spark.read.option("header", True).csv(scores_path)
        out["scores"] = raw.select(
            F.col("id").cast("long").alias("id"), "transaction_id", "user_id",
            F.col("amount").cast("double").alias("amount"), "location",
            _text_bool(F.col("is_simulated_fraud")).alias("is_simulated_fraud"),
            F.col("prediction").cast("int").alias("prediction"),
            F.col("fraud_probability").cast("double").alias("fraud_probability"),
            _text_bool(F.col("is_fraud")).alias("is_fraud"), "model_version",
            F.try_to_timestamp(F.col("scored_at")).cast("timestamp_ntz").alias("scored_at"))
    if models_path:
        raw = spark.read.option("header", True).csv(models_path)
        out["models"] = raw.select(
            "model_name", F.col("version").cast("int").alias("version"), "current_stage",
            F.timestamp_millis(F.col("creation_time").cast("long")).alias("creation_time"),
            F.timestamp_millis(F.col("last_updated_time").cast("long")).alias("last_updated_time"),
            "run_id", "status")
    if metrics_path:
        raw = spark.read.option("header", True).csv(metrics_path)
        out["metrics"] = raw.select(
            "run_id", F.col("experiment_id").cast("int").alias("experiment_id"),
            F.timestamp_millis(F.col("start_time").cast("long")).alias("start_time"),
            F.timestamp_millis(F.col("end_time").cast("long")).alias("end_time"),
            "status", "metric_name", F.col("metric_value").cast("double").alias("metric_value"))
    return out


def read_pages(spark: SparkSession, path: str, *, fmt: str = "parquet",
               source_col: str = "source_id", default_source: str | None = None) -> DataFrame:
    """Page table (source_id, page_no, text), dropping empty pages.

    A missing source id falls back to ``default_source`` (the path), which is
    how an ingest without an explicit id is named.
    """
    df = spark.read.format(fmt).load(path)
    src = F.col(source_col)
    if default_source is not None:
        src = F.coalesce(src, F.lit(default_source))
    return (df.select(src.alias("source_id"), F.col("page_no").cast("int").alias("page_no"),
                      F.col("text"))
            .where(F.length("text") > 0))
