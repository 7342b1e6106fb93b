"""Source and sink queries: each writes data derived from the test tables
in the pipeline's format to the shared folder and reads it back through
the library reader, so the result can be compared with the source rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import schemas
from tidewater.operators import curation
from tidewater.plans import views as V
from tidewater.plans.oracles import CURATED_CLOUD, CURATED_FIREWALL, with_views
from tidewater.plans.q_curation import envelope, fixed_ts
from tidewater.plans.registry import query
from tidewater.session import scratch_path
from tidewater.sources import files, sinks


def firewall_jsonl(spark, sf) -> str:
    path = scratch_path(spark, "firewall_jsonl")
    V.firewall_v(spark, sf).write.json(path)
    return path


@query("src_jsonl_firewall", with_views("SELECT * FROM firewall_v", "firewall_v"))
def q_src_jsonl_firewall(spark, sf):
    return files.read_jsonl(spark, firewall_jsonl(spark, sf), schemas.FIREWALL)


@query("src_jsonl_cloud", with_views("SELECT * FROM cloud_v", "cloud_v"))
def q_src_jsonl_cloud(spark, sf):
    path = scratch_path(spark, "cloud_jsonl")
    V.cloud_v(spark, sf).write.json(path)
    return files.read_jsonl(spark, path, schemas.CLOUD)


def write_firewall_lake(spark, sf, base: str) -> None:
    from tidewater.functions import epoch_ms_to_ts
    sinks.write_json_landing(V.firewall_v(spark, sf).withColumn("_t", epoch_ms_to_ts("ts_unix")), base, "_t")


LAKE_SQL = with_views("""
SELECT *, CAST(strftime(t, '%Y') AS INTEGER) AS year, CAST(strftime(t, '%m') AS INTEGER) AS month,
       CAST(strftime(t, '%d') AS INTEGER) AS day
FROM (SELECT *, make_timestamp(CAST(trunc(ts_unix / 1000) AS BIGINT) * 1000000) AS t FROM firewall_v)""",
                      "firewall_v")


@query("src_lake_partitioned", LAKE_SQL.replace("SELECT *, CAST(strftime", "SELECT * EXCLUDE (t), CAST(strftime"))
def q_src_lake_partitioned(spark, sf):
    base = scratch_path(spark, "lake_firewall")
    write_firewall_lake(spark, sf, base)
    return files.read_lake(spark, base, schemas.FIREWALL)


@query("src_lake_days", with_views("""
WITH t AS (SELECT *, make_timestamp(CAST(trunc(ts_unix / 1000) AS BIGINT) * 1000000) AS t FROM firewall_v),
d AS (SELECT *, CAST(strftime(t, '%Y') AS INTEGER) AS year, CAST(strftime(t, '%m') AS INTEGER) AS month, CAST(strftime(t, '%d') AS INTEGER) AS day FROM t),
busy AS (SELECT year, month, day FROM d WHERE year IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (act = 'DROP') * 5 > count(*))
SELECT d.* EXCLUDE (t) FROM d JOIN busy USING (year, month, day)""", "firewall_v"))
def q_src_lake_days(spark, sf):
    """Rows of the days on which over a fifth of the traffic was dropped: the days come from a summary table, the lake is read pruned."""
    base, summary = scratch_path(spark, "lake_days"), scratch_path(spark, "day_summary")
    write_firewall_lake(spark, sf, base)
    lake = files.read_lake(spark, base, schemas.FIREWALL)
    (lake.where("year is not null").groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("act") == "DROP").alias("dropped"))
     .coalesce(1).write.parquet(summary))
    busy = spark.read.parquet(summary).where(F.col("dropped") * 5 > F.col("n"))
    return files.read_lake_days(spark, base, schemas.FIREWALL, busy)


@query("src_lake_pruned", LAKE_SQL.replace("SELECT *, CAST(strftime", "SELECT * EXCLUDE (t), CAST(strftime") + " WHERE strftime(t, '%d') IN ('05', '06')")
def q_src_lake_pruned(spark, sf):
    """Two days of every month, by a filter that is applied to the folders."""
    base = scratch_path(spark, "lake_pruned")
    write_firewall_lake(spark, sf, base)
    return files.read_lake(spark, base, schemas.FIREWALL, partition_filter=F.col("day").isin(5, 6))


@query("src_guard_empty", with_views("SELECT * FROM firewall_v", "firewall_v"))
def q_src_guard_empty(spark, sf):
    present = files.read_or_empty(spark, firewall_jsonl(spark, sf), schemas.FIREWALL)
    missing = files.read_or_empty(spark, scratch_path(spark, "never_written"), schemas.FIREWALL)
    assert missing.isEmpty()
    return present.unionByName(missing)


@query("src_csv_transactions", with_views(
    'SELECT id, "Time", V1, V2, V3, V4, Amount AS transaction_amount, "Class" AS is_fraud FROM tx_v', "tx_v"))
def q_src_csv_transactions(spark, sf):
    path = scratch_path(spark, "tx_csv")
    sinks.write_csv(V.tx_v(spark, sf), path, encoding="ISO-8859-1")
    tx = files.read_csv(spark, path, V.tx_v(spark, sf).schema)
    return curation.map_columns(tx)


@query("src_bi_extracts", with_views("""
SELECT id, transaction_id, user_id, amount, location, is_simulated_fraud, prediction, fraud_probability,
       is_fraud, model_version, scored_at FROM scores_v""", "scores_v"))
def q_src_bi_extracts(spark, sf):
    path = scratch_path(spark, "bi_scores_csv")
    s = V.scores_v(spark, sf)
    tf = lambda c: F.when(F.col(c), F.lit("t")).when(~F.col(c), F.lit("f"))
    s.select("id", "transaction_id", "user_id", "amount", "location",
             tf("is_simulated_fraud").alias("is_simulated_fraud"), "prediction", "fraud_probability",
             tf("is_fraud").alias("is_fraud"), "model_version",
             F.date_format("scored_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("scored_at")) \
        .write.option("header", True).csv(path)
    return files.read_bi_extracts(spark, scores_path=path)["scores"]


@query("src_bi_models", with_views("""
SELECT model_name, version, current_stage, make_timestamp(creation_time * 1000) AS creation_time,
       make_timestamp(last_updated_time * 1000) AS last_updated_time, run_id, status FROM registry_v""", "scores_v", "registry_v"))
def q_src_bi_models(spark, sf):
    """The model extract: epoch milliseconds become timestamps, the stage name None stays text."""
    path = scratch_path(spark, "bi_models_csv")
    V.registry_v(spark, sf).write.option("header", True).csv(path)
    m = files.read_bi_extracts(spark, models_path=path)["models"]
    return m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("creation_time", "last_updated_time")})


@query("src_bi_metrics", with_views("""
SELECT run_id, experiment_id, make_timestamp(start_time * 1000) AS start_time, make_timestamp(end_time * 1000) AS end_time, status, metric_name,
       round(metric_value, 6) AS metric_value FROM metrics_v""", "scores_v", "registry_v", "model_scores_v", "metrics_v"))
def q_src_bi_metrics(spark, sf):
    path = scratch_path(spark, "bi_metrics_csv")
    V.metrics_v(spark, sf).write.option("header", True).csv(path)
    m = files.read_bi_extracts(spark, metrics_path=path)["metrics"]
    return m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")}).withColumn("metric_value", F.round("metric_value", 6))


@query("doc_load", """
SELECT source AS source_id, CAST(doc_id AS INTEGER) AS page_no, text FROM documents WHERE length(text) > 0""")
def q_doc_load(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("source").alias("source_id"),
                                               F.col("doc_id").alias("page_no"), "text")
    path = scratch_path(spark, "pages")
    d.write.parquet(path)
    return files.read_pages(spark, path, default_source=path)


@query("sink_parquet_partitioned", with_views(CURATED_CLOUD, "cloud_v"))
def q_sink_parquet_partitioned(spark, sf):
    path = scratch_path(spark, "cloud_curated")
    cur = curation.curate_cloud(V.cloud_v(spark, sf), processed_at=fixed_ts())
    sinks.append_partitioned_parquet(cur, path, "source_service")
    back = spark.read.schema(schemas.CURATED_CLOUD).parquet(path)
    return back.select(*schemas.CURATED_CLOUD.fieldNames())


@query("sink_json_landing", with_views("""
SELECT *, strftime(scored_at, '%Y') AS year, strftime(scored_at, '%m') AS month, strftime(scored_at, '%d') AS day
FROM scores_v""", "scores_v"))
def q_sink_json_landing(spark, sf):
    path = scratch_path(spark, "scores_landing")
    s = V.scores_v(spark, sf)
    sinks.write_json_landing(s, path, "scored_at", topic_col="location")
    schema = T.StructType(s.schema.fields + [T.StructField(c, T.StringType()) for c in ("year", "month", "day")])
    back = spark.read.schema(schema).options(**sinks.TS_OPTIONS).json(path)
    return back.select(*s.columns, "year", "month", "day")


@query("sink_scored_json", with_views(
    "SELECT transaction_id, user_id, amount, location, is_simulated_fraud, prediction, fraud_probability, "
    "prediction = 1 AS is_fraud, model_version, scored_at FROM scores_v", "scores_v"))
def q_sink_scored_json(spark, sf):
    path = scratch_path(spark, "scored_messages")
    curation.to_json_messages(envelope(spark, sf), "transaction_id").write.json(path)
    msgs = spark.read.schema("key string, value string").json(path)
    scored_schema = envelope(spark, sf).schema
    parsed = msgs.select(F.from_json("value", scored_schema).alias("m")).select("m.*")
    return curation.flatten_scores(parsed)


@query("sink_csv", with_views(CURATED_FIREWALL, "firewall_v"))
def q_sink_csv(spark, sf):
    path = scratch_path(spark, "firewall_csv")
    # CSV has no null: a marker keeps null and '' apart in the round trip
    sinks.write_csv(curation.curate_firewall(V.firewall_v(spark, sf), processed_at=fixed_ts()), path,
                    nullValue=NULL_MARK)
    return files.read_csv(spark, path, schemas.CURATED_FIREWALL, encoding="UTF-8", nullValue=NULL_MARK)


NULL_MARK = "\\N"

