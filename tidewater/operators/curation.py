"""Log curation, column mapping, feature derivation, scored-record shapes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import (
    anon_ipv4,
    day_of_week_from_offset,
    epoch_ms_to_ts,
    hour_of_day_from_offset,
    is_night,
    is_weekend,
    iso_to_ts,
    redact,
    seeded_bucket,
)


def _processed_at(processed_at) -> Column:
    if processed_at is None:
        return F.current_timestamp()
    return processed_at if isinstance(processed_at, Column) else F.lit(processed_at).cast("timestamp")


def curate_firewall(raw: DataFrame, processed_at=None, *, mask_dest: bool = False) -> DataFrame:
    """Raw firewall lines -> curated rows.

    event time from epoch ms (second resolution), source IPv4 last octet
    masked, destination kept (masked only with ``mask_dest``), ``act``
    renamed to ``action``, processing time and ``log_type`` tag added.
    """
    dest = anon_ipv4("dest_ip") if mask_dest else F.col("dest_ip")
    return raw.select(
        epoch_ms_to_ts("ts_unix").alias("event_time"),
        anon_ipv4("src_ip").alias("source_ip_anon"),
        dest.alias("destination_ip"),
        "src_port", "dest_port", "protocol",
        F.col("act").alias("action"),
        "bytes_sent",
        _processed_at(processed_at).alias("processed_at"),
        F.lit("firewall").alias("log_type"),
    )


def curate_cloud(raw: DataFrame, processed_at=None) -> DataFrame:
    """Raw cloud-audit lines -> curated rows (user id redacted, ISO time parsed)."""
    return raw.select(
        iso_to_ts("event_time_iso").alias("event_time"),
        redact("user_id").alias("user_id_anon"),
        "resource_name", "operation", "success", "source_service",
        _processed_at(processed_at).alias("processed_at"),
        F.lit("cloud_audit").alias("log_type"),
    )


def log_timeline(*curated: DataFrame) -> DataFrame:
    """Union curated logs of different kinds into one timeline.

    Columns missing from one kind are null; ``log_type`` tells rows apart.
    """
    out = curated[0]
    for df in curated[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


# The training CSV's column names and their pipeline names.
TRAINING_RENAMES = {"Class": "is_fraud", "Amount": "transaction_amount"}


def map_columns(df: DataFrame, mapping: Mapping[str, str] = TRAINING_RENAMES) -> DataFrame:
    """Rename columns that are present; absent names are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def add_time_parts(df: DataFrame, seconds_col: str = "Time") -> DataFrame:
    """hour_of_day / day_of_week from a seconds offset (only if present)."""
    if seconds_col not in df.columns:
        return df
    return df.withColumns({
        "hour_of_day": hour_of_day_from_offset(seconds_col),
        "day_of_week": day_of_week_from_offset(seconds_col),
    })


# Surrogate ranges of the training pipeline (inclusive bounds).
MERCHANT_RANGE = (1, 19)
AGE_RANGE = (18, 89)


def add_surrogates(df: DataFrame, key_cols: Iterable[str], seed: int = 42) -> DataFrame:
    """Seeded surrogate columns merchant_category in 1..19 and customer_age
    in 18..89, derived from the row key so they do not depend on
    partitioning or row order."""
    keys = list(key_cols)
    m_lo, m_hi = MERCHANT_RANGE
    a_lo, a_hi = AGE_RANGE
    return df.withColumns({
        "merchant_category": (seeded_bucket(keys, seed, m_hi - m_lo + 1) + m_lo).cast("int"),
        "customer_age": (seeded_bucket(keys, seed + 1, a_hi - a_lo + 1) + a_lo).cast("int"),
    })


def add_amount_log(df: DataFrame, amount_col: str = "transaction_amount") -> DataFrame:
    return df.withColumn("amount_log", F.log1p(F.col(amount_col)))


def add_flags(df: DataFrame, hour_col: str = "hour_of_day", day_col: str = "day_of_week") -> DataFrame:
    return df.withColumns({"is_night": is_night(hour_col), "is_weekend": is_weekend(day_col)})


def drop_any_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in any (or the given) column."""
    return df.na.drop(how="any", subset=subset)


def align_features(df: DataFrame, feature_columns: list[str], keep: Iterable[str] = (),
                   fill=0) -> DataFrame:
    """Project onto a model's feature list.

    Absent columns become ``fill`` (a present null stays null), extra columns
    are dropped, order follows ``feature_columns``.  ``keep`` columns (ids,
    raw payload) are carried in front.
    """
    present = set(df.columns)
    cols = [F.col(c) for c in keep if c in present]
    for c in feature_columns:
        cols.append(F.col(c).cast("double").alias(c) if c in present
                    else F.lit(fill).cast("double").alias(c))
    return df.select(*cols)


def score_envelope(scored: DataFrame, original_cols: list[str], *, id_col: str = "transaction_id",
                   model_version: Column | str = "model_version",
                   scored_at: Column | None = None) -> DataFrame:
    """Build the scored record: id (default 'unknown'), the original message
    as a struct, prediction, probability, is_fraud, version, ISO time."""
    ver = F.col(model_version) if isinstance(model_version, str) else model_version
    ts = scored_at if scored_at is not None else F.current_timestamp()
    return scored.select(
        F.coalesce(F.col(id_col), F.lit("unknown")).alias("transaction_id"),
        F.struct(*[F.col(c) for c in original_cols]).alias("original_data"),
        F.col("prediction").cast("int").alias("prediction"),
        F.col("fraud_probability").cast("double").alias("fraud_probability"),
        (F.col("prediction") == 1).alias("is_fraud"),
        ver.cast("string").alias("model_version"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scored_at"),
        F.lit(0).alias("scoring_time_ms"),
    )


def flatten_scores(scored: DataFrame) -> DataFrame:
    """Scored record -> sink row: original fields lifted, ISO time parsed."""
    return scored.select(
        "transaction_id",
        F.col("original_data.user_id").alias("user_id"),
        F.col("original_data.amount").alias("amount"),
        F.col("original_data.location").alias("location"),
        F.col("original_data.is_simulated_fraud").alias("is_simulated_fraud"),
        "prediction", "fraud_probability", "is_fraud", "model_version",
        F.try_to_timestamp(F.col("scored_at")).cast("timestamp_ntz").alias("scored_at"),
    )


def to_json_messages(df: DataFrame, key_col: str) -> DataFrame:
    """(key, value) message frame: value is the whole row as JSON text."""
    return df.select(F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
