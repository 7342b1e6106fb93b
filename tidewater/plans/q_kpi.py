"""Dashboard, drift, registry and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import kpi, ml
from tidewater.operators import registry as R
from tidewater.plans import views as V
from tidewater.plans.oracles import auc_sql, cls_sql, with_views
from tidewater.plans.registry import query


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


SPLIT_TS = "2024-01-16 00:00:00"


@query("kpi_summary", with_views("""
SELECT count(*) AS total_transactions,
       count(*) FILTER (WHERE is_fraud) AS fraud_count,
       count(*) FILTER (WHERE is_fraud) / NULLIF(count(*), 0) AS fraud_rate,
       round(avg(fraud_probability), 6) AS avg_confidence,
       string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS model_versions
FROM scores_v""", "scores_v"))
def q_kpi_summary(spark, sf):
    k = kpi.kpi_summary(V.scores_v(spark, sf))
    return k.select("total_transactions", "fraud_count", "fraud_rate", r6("avg_confidence").alias("avg_confidence"),
                    F.array_join("model_versions", ",").alias("model_versions"))


@query("kpi_by_location", with_views("""
SELECT location, count(*) AS total_transactions, count(*) FILTER (WHERE is_fraud) AS fraud_count,
       count(*) FILTER (WHERE is_fraud) / count(*) AS fraud_rate, round(sum(amount), 4) AS total_amount
FROM scores_v GROUP BY location""", "scores_v"))
def q_kpi_by_location(spark, sf):
    k = kpi.kpi_by(V.scores_v(spark, sf), "location")
    return k.withColumn("total_amount", F.round("total_amount", 4))


@query("volume_trend", with_views("""
SELECT time_bucket(INTERVAL 1 HOUR, scored_at) AS window_start,
       time_bucket(INTERVAL 1 HOUR, scored_at) + INTERVAL 1 HOUR AS window_end,
       count(*) AS total_transactions
FROM scores_v GROUP BY ALL""", "scores_v"))
def q_volume_trend(spark, sf):
    return kpi.volume_trend(V.scores_v(spark, sf), "scored_at", "1 hour")


@query("confidence_trend", with_views("""
SELECT time_bucket(INTERVAL 1 DAY, scored_at) AS window_start,
       time_bucket(INTERVAL 1 DAY, scored_at) + INTERVAL 1 DAY AS window_end,
       count(*) AS total_transactions, round(avg(fraud_probability), 6) AS avg_confidence
FROM scores_v GROUP BY ALL""", "scores_v"))
def q_confidence_trend(spark, sf):
    t = kpi.confidence_trend(V.scores_v(spark, sf), "scored_at", "1 day")
    return t.withColumn("avg_confidence", r6("avg_confidence"))


@query("hist_amount", with_views("""
SELECT CAST(floor(amount / 25.0) AS BIGINT) AS bin, CAST(CAST(floor(amount / 25.0) AS BIGINT) * 25.0 AS DOUBLE) AS bin_lo,
       count(*) AS n_rows,
       round(count(*) / (SELECT count(*) FROM scores_v WHERE amount IS NOT NULL), 6) AS share
FROM scores_v WHERE amount IS NOT NULL GROUP BY ALL""", "scores_v"))
def q_hist_amount(spark, sf):
    h = kpi.histogram(V.scores_v(spark, sf), "amount", 25.0)
    return h.withColumn("share", r6("share"))


@query("share_by_category", with_views("""
SELECT location, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM scores_v), 6) AS share
FROM scores_v GROUP BY location""", "scores_v"))
def q_share_by_category(spark, sf):
    return kpi.share_by(V.scores_v(spark, sf), "location").withColumn("share", r6("share"))


@query("alerts_high_conf", with_views("""
SELECT transaction_id, amount, fraud_probability FROM scores_v WHERE fraud_probability >= 0.85
ORDER BY fraud_probability DESC, transaction_id""", "scores_v"))
def q_alerts_high_conf(spark, sf):
    return kpi.alerts(V.scores_v(spark, sf)).select("transaction_id", "amount", "fraud_probability")


def _periods(spark, sf):
    s = V.scores_v(spark, sf)
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    return s.where(F.col("scored_at") < cut), s.where(F.col("scored_at") >= cut)


DRIFT_AMOUNT_SQL = f"""
WITH ref AS (SELECT amount FROM scores_v WHERE scored_at < TIMESTAMP '{SPLIT_TS}' AND amount IS NOT NULL),
     live AS (SELECT amount FROM scores_v WHERE scored_at >= TIMESTAMP '{SPLIT_TS}' AND amount IS NOT NULL),
     st AS (SELECT min(amount) AS lo, max(amount) AS hi FROM ref),
     w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1.0 END AS width FROM st),
     rb AS (SELECT CAST(least(greatest(floor((amount - lo) / width), 0), 9) AS INTEGER) AS bin FROM ref, w),
     lb AS (SELECT CAST(least(greatest(floor((amount - lo) / width), 0), 9) AS INTEGER) AS bin FROM live, w),
     r AS (SELECT bin, count(*) AS ref_rows FROM rb GROUP BY bin),
     l AS (SELECT bin, count(*) AS live_rows FROM lb GROUP BY bin),
     cmp AS (
       SELECT coalesce(r.bin, l.bin) AS bin, coalesce(ref_rows, 0) AS ref_rows, coalesce(live_rows, 0) AS live_rows,
              coalesce(ref_rows / (SELECT count(*) FROM rb), 0.0) AS ref_share,
              coalesce(live_rows / (SELECT count(*) FROM lb), 0.0) AS live_share
       FROM r FULL OUTER JOIN l ON r.bin = l.bin)
"""


@query("drift_amount", with_views(DRIFT_AMOUNT_SQL + """
SELECT bin, ref_rows, live_rows, round(ref_share, 6) AS ref_share, round(live_share, 6) AS live_share FROM cmp""",
                                  "scores_v"))
def q_drift_amount(spark, sf):
    ref, live = _periods(spark, sf)
    d = kpi.drift_numeric(ref, live, "amount", 10)
    return d.withColumns({"ref_share": r6("ref_share"), "live_share": r6("live_share")})


@query("drift_location", with_views(f"""
WITH ref AS (SELECT location FROM scores_v WHERE scored_at < TIMESTAMP '{SPLIT_TS}'),
     live AS (SELECT location FROM scores_v WHERE scored_at >= TIMESTAMP '{SPLIT_TS}'),
     r AS (SELECT location, count(*) AS ref_rows FROM ref GROUP BY location),
     l AS (SELECT location, count(*) AS live_rows FROM live GROUP BY location)
SELECT coalesce(r.location, l.location) AS location, coalesce(ref_rows, 0) AS ref_rows,
       coalesce(live_rows, 0) AS live_rows,
       round(coalesce(ref_rows / (SELECT count(*) FROM ref), 0.0), 6) AS ref_share,
       round(coalesce(live_rows / (SELECT count(*) FROM live), 0.0), 6) AS live_share
FROM r FULL OUTER JOIN l ON r.location = l.location""", "scores_v"))
def q_drift_location(spark, sf):
    ref, live = _periods(spark, sf)
    d = kpi.drift_categorical(ref, live, "location")
    return d.withColumns({"ref_share": r6("ref_share"), "live_share": r6("live_share")})


@query("drift_psi", with_views(DRIFT_AMOUNT_SQL + """
SELECT round(sum((greatest(live_share, 1e-6) - greatest(ref_share, 1e-6))
                 * ln(greatest(live_share, 1e-6) / greatest(ref_share, 1e-6))), 6) AS psi,
       count(*) AS n_bins FROM cmp""", "scores_v"))
def q_drift_psi(spark, sf):
    ref, live = _periods(spark, sf)
    return kpi.psi(kpi.drift_numeric(ref, live, "amount", 10)).withColumn("psi", r6("psi"))


@query("star_scores_model", with_views("""
SELECT s.transaction_id, s.model_version, r.version, r.current_stage, r.run_id
FROM model_scores_v s LEFT JOIN registry_v r ON s.model_name = r.model_name AND s.version = r.version""",
                                       "scores_v", "registry_v", "model_scores_v"))
def q_star_scores_model(spark, sf):
    s = V.scores_v(spark, sf).withColumn("model_name", F.concat(F.lit("fraud_"), F.col("location")))
    j = kpi.join_model_dimension(s, V.registry_v(spark, sf), fact_version="model_version",
                                 dim_version="version", on=["model_name"])
    return j.select("transaction_id", "model_version", "version", "current_stage", "run_id")


HISTORY_SQL = """
SELECT r.model_name, r.version, r.current_stage, r.run_id,
       round(max(CASE WHEN metric_name = 'roc_auc' THEN metric_value END), 6) AS roc_auc,
       round(max(CASE WHEN metric_name = 'precision' THEN metric_value END), 6) AS precision,
       round(max(CASE WHEN metric_name = 'recall' THEN metric_value END), 6) AS recall,
       round(max(CASE WHEN metric_name = 'f1' THEN metric_value END), 6) AS f1
FROM registry_v r LEFT JOIN metrics_v m ON r.run_id = m.run_id
GROUP BY r.model_name, r.version, r.current_stage, r.run_id"""

HISTORY_VIEWS = ("scores_v", "registry_v", "model_scores_v", "metrics_v")


def history(spark, sf):
    h = R.metric_history(V.registry_v(spark, sf), V.metrics_v(spark, sf), V.METRIC_NAMES)
    return h.select("model_name", "version", "current_stage", "run_id",
                    *[r6(m).alias(m) for m in V.METRIC_NAMES])


@query("model_metric_history", with_views(HISTORY_SQL, *HISTORY_VIEWS))
def q_model_metric_history(spark, sf):
    return history(spark, sf)


@query("metric_trend", with_views(f"""
SELECT model_name, version, roc_auc,
       lag(roc_auc) OVER (PARTITION BY model_name ORDER BY version) AS prev_roc_auc,
       round(roc_auc - lag(roc_auc) OVER (PARTITION BY model_name ORDER BY version), 6) AS delta_roc_auc
FROM ({HISTORY_SQL})""", *HISTORY_VIEWS))
def q_metric_trend(spark, sf):
    return R.metric_trend(history(spark, sf), "roc_auc").withColumn("delta_roc_auc", r6("delta_roc_auc"))


@query("model_gate", with_views("""
SELECT run_id, round(metric_value, 6) AS roc_auc,
       CASE WHEN metric_value >= 0.75 THEN 'Staging' ELSE 'Rejected' END AS decision
FROM metrics_v WHERE metric_name = 'roc_auc'""", *HISTORY_VIEWS))
def q_model_gate(spark, sf):
    m = R.pivot_metrics(V.metrics_v(spark, sf), ["roc_auc"])
    return ml.gate(m, "roc_auc").select("run_id", r6("roc_auc").alias("roc_auc"), "decision")


@query("current_model_version", with_views("""
SELECT model_name, max(version) AS current_version FROM registry_v WHERE current_stage = 'Production'
GROUP BY model_name""", "scores_v", "registry_v"))
def q_current_model_version(spark, sf):
    return R.current_version(V.registry_v(spark, sf), "Production")


@query("latest_model_by_stage", with_views("""
SELECT * FROM registry_v QUALIFY row_number() OVER (PARTITION BY model_name, current_stage ORDER BY version DESC) = 1
""", "scores_v", "registry_v"))
def q_latest_model_by_stage(spark, sf):
    return R.latest_by_stage(V.registry_v(spark, sf))


TRANSITION_AT = 1767225600000  # 2026-01-01T00:00:00Z in epoch ms


@query("registry_transition", with_views(f"""
SELECT model_name, version,
       CASE WHEN model_name = 'fraud_click' AND version = 3 THEN 'Production'
            WHEN model_name = 'fraud_click' AND current_stage = 'Production' THEN 'Archived'
            ELSE current_stage END AS current_stage,
       creation_time,
       CASE WHEN model_name = 'fraud_click' AND (version = 3 OR current_stage = 'Production')
            THEN {TRANSITION_AT} ELSE last_updated_time END AS last_updated_time,
       run_id, status
FROM registry_v""", "scores_v", "registry_v"))
def q_registry_transition(spark, sf):
    return R.transition(V.registry_v(spark, sf), "fraud_click", 3, "Production", archive_existing=True,
                        at_ms=TRANSITION_AT)


def candidates(spark, sf):
    s = V.scores_v(spark, sf)
    auc = ml.roc_auc(s, "fraud_probability", "is_simulated_fraud", group_by=["location"])
    c = s.groupBy("location").agg(F.max("scored_at").alias("_last"))
    return c.join(auc, "location", "inner").select(
        F.concat(F.lit("fraud_"), F.col("location")).alias("model_name"),
        F.md5(F.concat(F.lit("cand:"), F.col("location"))).alias("run_id"),
        (F.expr("unix_micros(cast(_last as timestamp)) div 1000") + 1).alias("creation_time"),
        "roc_auc")


@query("registry_register", with_views(f"""
WITH auc AS ({auc_sql('scores_v', ['location'], 'fraud_probability', 'is_simulated_fraud')}),
cand AS (SELECT 'fraud_' || s.location AS model_name, md5('cand:' || s.location) AS run_id,
                epoch_us(max(scored_at)) // 1000 + 1 AS creation_time, any_value(a.roc_auc) AS roc_auc
         FROM scores_v s JOIN auc a ON s.location = a.location GROUP BY s.location),
top AS (SELECT model_name, max(version) AS mx FROM registry_v GROUP BY model_name),
new AS (SELECT c.model_name,
               CAST(coalesce(t.mx, 0) + row_number() OVER (PARTITION BY c.model_name ORDER BY creation_time, run_id)
                    AS INTEGER) AS version,
               'Staging' AS current_stage, creation_time, creation_time AS last_updated_time, run_id,
               'READY' AS status
        FROM cand c LEFT JOIN top t ON c.model_name = t.model_name WHERE c.roc_auc >= 0.75),
allv AS (SELECT * FROM registry_v UNION ALL SELECT * FROM new)
SELECT model_name, version,
       CASE WHEN current_stage = 'Staging'
             AND version < max(CASE WHEN current_stage = 'Staging' THEN version END) OVER (PARTITION BY model_name)
            THEN 'Archived' ELSE current_stage END AS current_stage,
       creation_time, last_updated_time, run_id, status
FROM allv""", "scores_v", "registry_v"))
def q_registry_register(spark, sf):
    return R.register(V.registry_v(spark, sf), candidates(spark, sf))


@query("preview_topn", with_views("""
SELECT transaction_id, fraud_probability FROM scores_v
ORDER BY fraud_probability DESC NULLS LAST, transaction_id LIMIT 5""", "scores_v"))
def q_preview_topn(spark, sf):
    return kpi.preview(V.scores_v(spark, sf), 5, F.desc_nulls_last("fraud_probability"),
                       F.asc("transaction_id")).select("transaction_id", "fraud_probability")


@query("bridge_join", """
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_bridge_join(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = V.table(spark, sf, "region").select("r_regionkey", "r_name")
    # nation and region are tiny fixed dimensions; the planner broadcasts them
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("bridge_many_to_many", """
SELECT p_brand, o_orderpriority, count(*) AS n_links, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT p_partkey) AS n_parts
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def q_bridge_many_to_many(spark, sf):
    """Orders and parts are linked many to many by the order lines: links, orders and parts per brand and priority.

    Each side is joined to the bridge on its own key; distinct members are
    counted from partial aggregates, not from lists.
    """
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    p = V.table(spark, sf, "part").select("p_partkey", "p_brand")
    links = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    j = links.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("o_orderkey").alias("n_orders"),
                                                       F.count_distinct("p_partkey").alias("n_parts"))


@query("roc_auc", with_views(f"""
SELECT positives, negatives, round(roc_auc, 6) AS roc_auc
FROM ({auc_sql('scores_v', [], 'fraud_probability', 'is_simulated_fraud')})""", "scores_v"))
def q_roc_auc(spark, sf):
    a = ml.roc_auc(V.scores_v(spark, sf), "fraud_probability", "is_simulated_fraud")
    return a.withColumn("roc_auc", r6("roc_auc"))


@query("classification_metrics", with_views(f"""
SELECT tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(accuracy, 6) AS accuracy
FROM ({cls_sql('scores_v', [], 'prediction', 'is_simulated_fraud')})""", "scores_v"))
def q_classification_metrics(spark, sf):
    m = ml.classification_metrics(V.scores_v(spark, sf), "prediction", "is_simulated_fraud")
    return m.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "accuracy")})
