"""Curation, projection, source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.operators import curation, quality
from tidewater.plans import views as V
from tidewater.plans.oracles import (CURATED_CLOUD, CURATED_FIREWALL, EPOCH_TS, IPV4_RE,
                                     seeded_bucket_sql, with_views)
from tidewater.plans.registry import query

FIXED_TS = "2025-01-01 00:00:00"


def fixed_ts():
    return F.lit(FIXED_TS).cast("timestamp")


def curated_firewall(spark, sf):
    return curation.curate_firewall(V.firewall_v(spark, sf), processed_at=fixed_ts())


def curated_cloud(spark, sf):
    return curation.curate_cloud(V.cloud_v(spark, sf), processed_at=fixed_ts())


@query("curate_firewall", with_views(CURATED_FIREWALL, "firewall_v"))
def q_curate_firewall(spark, sf):
    return curated_firewall(spark, sf)


@query("curate_cloud", with_views(CURATED_CLOUD, "cloud_v"))
def q_curate_cloud(spark, sf):
    return curated_cloud(spark, sf)


@query("proj_epoch_ms", with_views(f"SELECT ts_unix, {EPOCH_TS} AS event_time FROM firewall_v", "firewall_v"))
def q_proj_epoch_ms(spark, sf):
    from tidewater.functions import epoch_ms_to_ts
    return V.firewall_v(spark, sf).select("ts_unix", epoch_ms_to_ts("ts_unix").alias("event_time"))


@query("anon_ipv4", with_views(
    f"SELECT src_ip, regexp_replace(src_ip, '{IPV4_RE}', '\\1XXX', 'g') AS source_ip_anon FROM firewall_v",
    "firewall_v"))
def q_anon_ipv4(spark, sf):
    from tidewater.functions import anon_ipv4
    return V.firewall_v(spark, sf).select("src_ip", anon_ipv4("src_ip").alias("source_ip_anon"))


@query("redact_user", with_views(
    "SELECT user_id, regexp_replace(user_id, '.+', 'REDACTED', 'g') AS user_id_anon FROM cloud_v", "cloud_v"))
def q_redact_user(spark, sf):
    from tidewater.functions import redact
    return V.cloud_v(spark, sf).select("user_id", redact("user_id").alias("user_id_anon"))


@query("proj_iso_ts", with_views(
    "SELECT event_time_iso, TRY_CAST(event_time_iso AS TIMESTAMP) AS event_time FROM cloud_v", "cloud_v"))
def q_proj_iso_ts(spark, sf):
    from tidewater.functions import iso_to_ts
    return V.cloud_v(spark, sf).select("event_time_iso", iso_to_ts("event_time_iso").alias("event_time"))


@query("log_timeline", with_views(
    f"SELECT * FROM ({CURATED_FIREWALL}) UNION ALL BY NAME SELECT * FROM ({CURATED_CLOUD})",
    "firewall_v", "cloud_v"))
def q_log_timeline(spark, sf):
    return curation.log_timeline(curated_firewall(spark, sf), curated_cloud(spark, sf))


MAPPED_SQL = ('SELECT id, "Time", V1, V2, V3, V4, Amount AS transaction_amount, "Class" AS is_fraud '
              "FROM tx_v")


def mapped(spark, sf):
    return curation.map_columns(V.tx_v(spark, sf))


@query("map_columns", with_views(MAPPED_SQL, "tx_v"))
def q_map_columns(spark, sf):
    return mapped(spark, sf)


TIME_PARTS_SQL = (
    "SELECT *, CAST(((floor(\"Time\" / 3600) % 24) + 24) % 24 AS INTEGER) AS hour_of_day, "
    "CAST(((floor(\"Time\" / 86400) % 7) + 7) % 7 AS INTEGER) AS day_of_week "
    f"FROM ({MAPPED_SQL})")


@query("feat_time_parts", with_views(TIME_PARTS_SQL, "tx_v"))
def q_feat_time_parts(spark, sf):
    return curation.add_time_parts(mapped(spark, sf))


SURROGATE_SQL = (
    f"SELECT id, CAST({seeded_bucket_sql('CAST(id AS VARCHAR)', 42, 19)} + 1 AS INTEGER) AS merchant_category, "
    f"CAST({seeded_bucket_sql('CAST(id AS VARCHAR)', 43, 72)} + 18 AS INTEGER) AS customer_age FROM tx_v")


@query("feat_surrogate", with_views(SURROGATE_SQL, "tx_v"))
def q_feat_surrogate(spark, sf):
    return curation.add_surrogates(V.tx_v(spark, sf).select("id"), ["id"], seed=42)


@query("feat_amount_log", with_views(
    f"SELECT id, transaction_amount, round(ln(1 + transaction_amount), 6) AS amount_log FROM ({MAPPED_SQL})",
    "tx_v"))
def q_feat_amount_log(spark, sf):
    # log1p and ln(1 + x) agree to ~1e-16, not bit for bit: compared at 6 places
    out = curation.add_amount_log(mapped(spark, sf).select("id", "transaction_amount"))
    return out.withColumn("amount_log", F.round("amount_log", 6))


@query("feat_flags", with_views(
    "SELECT id, hour_of_day, day_of_week, "
    "CASE WHEN hour_of_day < 6 OR hour_of_day > 22 THEN 1 ELSE 0 END AS is_night, "
    f"CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend FROM ({TIME_PARTS_SQL})", "tx_v"))
def q_feat_flags(spark, sf):
    return curation.add_flags(curation.add_time_parts(mapped(spark, sf))).select(
        "id", "hour_of_day", "day_of_week", "is_night", "is_weekend")


@query("drop_any_null", with_views(
    "SELECT * FROM firewall_v WHERE ts_unix IS NOT NULL AND src_ip IS NOT NULL AND dest_ip IS NOT NULL "
    "AND src_port IS NOT NULL AND dest_port IS NOT NULL AND protocol IS NOT NULL AND act IS NOT NULL "
    "AND bytes_sent IS NOT NULL", "firewall_v"))
def q_drop_any_null(spark, sf):
    return curation.drop_any_null(V.firewall_v(spark, sf))


@query("filter_missing_id", with_views(
    "SELECT * FROM cloud_v WHERE user_id IS NOT NULL AND user_id <> ''", "cloud_v"))
def q_filter_missing_id(spark, sf):
    ok, _rejects = quality.split_missing_id(V.cloud_v(spark, sf), "user_id")
    return ok


def _schema_tx_sql() -> str:
    cols = ["id", '"Time"'] + [f"V{i}" if i <= 4 else f"CAST(NULL AS DOUBLE) AS V{i}" for i in range(1, 29)]
    return "SELECT " + ", ".join(cols) + ', Amount, "Class" FROM tx_v'


@query("schema_transactions", with_views(_schema_tx_sql(), "tx_v"))
def q_schema_transactions(spark, sf):
    tx = V.tx_v(spark, sf)
    return tx.select(*[(F.col(f.name) if f.name in tx.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schemas.TRANSACTIONS.fields])


ALIGN_FEATURES = ["V1", "V2", "V3", "V4", "V5", "hour_of_day"]


@query("align_features", with_views(
    "SELECT id, V1, V2, V3, V4, CAST(0 AS DOUBLE) AS V5, CAST(0 AS DOUBLE) AS hour_of_day FROM tx_v", "tx_v"))
def q_align_features(spark, sf):
    return curation.align_features(V.tx_v(spark, sf), ALIGN_FEATURES, keep=["id"])


ORIGINAL_COLS = ["transaction_id", "user_id", "amount", "location", "is_simulated_fraud"]


def envelope(spark, sf):
    s = V.scores_v(spark, sf)
    return curation.score_envelope(s, ORIGINAL_COLS, scored_at=F.col("scored_at"))


ENVELOPE_SQL = (
    "SELECT transaction_id, prediction, fraud_probability, prediction = 1 AS is_fraud, model_version, "
    "strftime(scored_at, '%Y-%m-%dT%H:%M:%S.%f') AS scored_at, 0 AS scoring_time_ms, "
    "user_id AS original_user_id, amount AS original_amount FROM scores_v")


@query("score_envelope", with_views(ENVELOPE_SQL, "scores_v"))
def q_score_envelope(spark, sf):
    return envelope(spark, sf).select(
        "transaction_id", "prediction", "fraud_probability", "is_fraud", "model_version", "scored_at",
        "scoring_time_ms", F.col("original_data.user_id").alias("original_user_id"),
        F.col("original_data.amount").alias("original_amount"))


@query("flatten_scores", with_views(
    "SELECT transaction_id, user_id, amount, location, is_simulated_fraud, prediction, fraud_probability, "
    "prediction = 1 AS is_fraud, model_version, scored_at FROM scores_v", "scores_v"))
def q_flatten_scores(spark, sf):
    return curation.flatten_scores(envelope(spark, sf))
