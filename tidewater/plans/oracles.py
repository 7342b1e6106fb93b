"""The test views and queries written as plain SQL (DuckDB dialect) over
the same Parquet tables.  Used as the independent oracle of every query."""

from __future__ import annotations

# ----------------------------------------------------------------- views

VIEWS: dict[str, str] = {}

VIEWS["scores_v"] = """
SELECT 'txn_' || CAST(event_id AS VARCHAR) AS transaction_id,
       'user_' || CAST(user_id AS VARCHAR) AS user_id,
       value AS amount,
       event_type AS location,
       (k >= 75) OR (value >= 250) AS is_simulated_fraud,
       CASE WHEN k >= 50 THEN 1 ELSE 0 END AS prediction,
       CAST(k AS DOUBLE) / 100.0 AS fraud_probability,
       k >= 50 AS is_fraud,
       'v' || CAST(event_id % 3 + 1 AS VARCHAR) AS model_version,
       ts AS scored_at,
       event_id AS id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""

VIEWS["firewall_v"] = """
SELECT CASE WHEN event_id % 997 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS ts_unix,
       CASE WHEN event_id % 101 = 0 THEN '2001:db8::' || CAST(event_id AS VARCHAR)
            WHEN event_id % 103 = 0 THEN ''
            ELSE CAST(event_id % 200 + 10 AS VARCHAR) || '.' || CAST((event_id // 200) % 256 AS VARCHAR)
                 || '.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 251 AS VARCHAR)
       END AS src_ip,
       '192.168.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS dest_ip,
       CAST(event_id % 64512 + 1024 AS INTEGER) AS src_port,
       CAST((event_id * 7) % 65535 + 1 AS INTEGER) AS dest_port,
       CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
       CASE event_type WHEN 'error' THEN 'DROP' WHEN 'signup' THEN 'DENY'
                       WHEN 'purchase' THEN 'RESET' ELSE 'ALLOW' END AS act,
       CAST(event_id % 1461 + 40 AS INTEGER) AS bytes_sent
FROM events
"""

VIEWS["cloud_v"] = """
SELECT CASE WHEN c_custkey % 89 = 0 THEN 'not-a-time'
            ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey * 420), '%Y-%m-%dT%H:%M:%S')
       END AS event_time_iso,
       CASE WHEN c_custkey % 97 = 0 THEN NULL
            WHEN c_custkey % 101 = 0 THEN ''
            WHEN c_custkey % 103 = 0 THEN c_name || chr(10) || 'second line'
            ELSE c_name END AS user_id,
       c_mktsegment AS resource_name,
       CASE c_nationkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'delete' ELSE 'list' END AS operation,
       c_acctbal > 0 AS success,
       CASE WHEN c_custkey % 113 = 0 THEN NULL
            WHEN c_nationkey % 3 = 0 THEN 'iam' WHEN c_nationkey % 3 = 1 THEN 'storage'
            ELSE 'compute' END AS source_service
FROM customer
"""

VIEWS["tx_v"] = """
SELECT l_orderkey * 10 + l_linenumber AS id,
       CAST(epoch(l_shipdate) - (SELECT min(epoch(l_shipdate)) FROM lineitem)
            + (l_orderkey * 37 + l_linenumber * 1013) % 86400 AS DOUBLE) AS "Time",
       l_quantity AS V1, l_discount AS V2, l_tax AS V3,
       l_extendedprice / l_quantity AS V4,
       l_extendedprice AS Amount,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "Class"
FROM lineitem
"""

VIEWS["tx_signal_v"] = f"""
SELECT id, "Time", V1, V2, V3, V4, Amount,
       CASE WHEN (V1 * V2 >= 3.5) <> (id % 25 = 0) THEN 1 ELSE 0 END AS "Class"
FROM ({VIEWS["tx_v"]}) t
"""

VIEWS["spine_v"] = """
SELECT user_id, ts AS event_timestamp, event_id AS spine_event,
       CASE WHEN value > 100 THEN 1 ELSE 0 END AS label_is_churn
FROM events WHERE event_type = 'purchase'
"""

VIEWS["feat_v"] = """
SELECT user_id, ts AS event_timestamp, value AS last_view_value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS view_score,
       event_id AS view_event_id
FROM events WHERE event_type = 'view'
"""

VIEWS["feat_created_v"] = """
SELECT *, event_timestamp AS created_timestamp FROM feat_v
UNION ALL
SELECT user_id, event_timestamp, last_view_value * 2 AS last_view_value, view_score, view_event_id,
       event_timestamp + INTERVAL 1 HOUR AS created_timestamp FROM feat_v
"""

VIEWS["registry_v"] = """
SELECT 'fraud_' || location AS model_name,
       CAST(substr(model_version, 2) AS INTEGER) AS version,
       CASE CAST(substr(model_version, 2) AS INTEGER) WHEN 3 THEN 'Staging' WHEN 2 THEN 'Production'
            ELSE 'None' END AS current_stage,
       epoch_us(min(scored_at)) // 1000 AS creation_time,
       epoch_us(max(scored_at)) // 1000 AS last_updated_time,
       md5('fraud_' || location || ':' || substr(model_version, 2)) AS run_id,
       'READY' AS status
FROM scores_v GROUP BY location, model_version
"""

VIEWS["model_scores_v"] = """
SELECT *, 'fraud_' || location AS model_name, CAST(substr(model_version, 2) AS INTEGER) AS version
FROM scores_v
"""


def auc_sql(src: str, keys: list[str], score: str, label: str) -> str:
    """Exact tie-aware ROC-AUC per group, by ordered cumulative negatives."""
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    return f"""
SELECT {kk}CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
       sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + CAST(neg AS DOUBLE) / 2))
         / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {kk}CAST({score} AS DOUBLE) AS score, sum(CAST({label} AS INTEGER)) AS pos,
                   sum(1 - CAST({label} AS INTEGER)) AS neg
            FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL
            GROUP BY {kk}CAST({score} AS DOUBLE)))
{grp}
"""


def cls_sql(src: str, keys: list[str], pred: str, label: str) -> str:
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    p, y = f"(CAST({pred} AS INTEGER) = 1)", f"(CAST({label} AS INTEGER) = 1)"
    return f"""
SELECT {kk}tp, fp, tn, fn,
       coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS precision,
       coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS recall,
       coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1,
       (tp + tn) / NULLIF(tp + tn + fp + fn, 0) AS accuracy
FROM (SELECT {kk}count(*) FILTER (WHERE {p} AND {y}) AS tp, count(*) FILTER (WHERE {p} AND NOT {y}) AS fp,
             count(*) FILTER (WHERE NOT {p} AND NOT {y}) AS tn, count(*) FILTER (WHERE NOT {p} AND {y}) AS fn
      FROM {src} {grp})
"""


VIEWS["metrics_v"] = f"""
SELECT r.run_id, 1 AS experiment_id, r.creation_time AS start_time, r.last_updated_time AS end_time,
       'FINISHED' AS status, m.metric_name, m.metric_value
FROM registry_v r JOIN (
  SELECT model_name, version, 'roc_auc' AS metric_name, roc_auc AS metric_value
  FROM ({auc_sql('model_scores_v', ['model_name', 'version'], 'fraud_probability', 'is_simulated_fraud')})
  UNION ALL
  SELECT model_name, version, unnest(['precision', 'recall', 'f1']) AS metric_name,
         unnest([precision, recall, f1]) AS metric_value
  FROM ({cls_sql('model_scores_v', ['model_name', 'version'], 'prediction', 'is_simulated_fraud')})
) m USING (model_name, version)
"""

# ----------------------------------------------------------------- helpers

FIXED_TS = "TIMESTAMP '2025-01-01 00:00:00'"
IPV4_RE = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.)\d{1,3}"


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views (dependencies first)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"


def seeded_bucket_sql(key_text: str, seed: int, n: int) -> str:
    return f"(('0x' || substr(md5({key_text} || ':{seed}'), 1, 8))::UBIGINT % {n})"


EPOCH_TS = "make_timestamp(CAST(trunc(ts_unix / 1000) AS BIGINT) * 1000000)"

CURATED_FIREWALL = f"""
SELECT {EPOCH_TS} AS event_time,
       regexp_replace(src_ip, '{IPV4_RE}', '\\1XXX', 'g') AS source_ip_anon,
       dest_ip AS destination_ip, src_port, dest_port, protocol, act AS action, bytes_sent,
       {FIXED_TS} AS processed_at, 'firewall' AS log_type
FROM firewall_v
"""

CURATED_CLOUD = f"""
SELECT TRY_CAST(event_time_iso AS TIMESTAMP) AS event_time,
       regexp_replace(user_id, '.+', 'REDACTED', 'g') AS user_id_anon,
       resource_name, operation, success, source_service,
       {FIXED_TS} AS processed_at, 'cloud_audit' AS log_type
FROM cloud_v
"""

ORACLES: dict[str, str] = {}
