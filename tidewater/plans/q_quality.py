"""Data-quality, contract-validation, step-count and copy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import curation, quality, replicate
from tidewater.operators.common import spread
from tidewater.plans import views as V
from tidewater.plans.oracles import with_views
from tidewater.plans.registry import query
from tidewater.session import scratch_path


@query("dq_not_null", with_views("""
SELECT 'not_null:user_id' AS rule, count(*) FILTER (WHERE user_id IS NULL) AS violations FROM cloud_v
UNION ALL SELECT 'not_null:source_service', count(*) FILTER (WHERE source_service IS NULL) FROM cloud_v
UNION ALL SELECT 'not_null:event_time_iso', count(*) FILTER (WHERE event_time_iso IS NULL) FROM cloud_v""",
                                 "cloud_v"))
def q_dq_not_null(spark, sf):
    rules = [quality.not_null("user_id"), quality.not_null("source_service"), quality.not_null("event_time_iso")]
    return quality.rule_summary(V.cloud_v(spark, sf), rules)


@query("dq_check", """
SELECT c_custkey, concat_ws(',', CASE WHEN NOT (c_acctbal >= 0) THEN 'check:acctbal_non_negative' END,
                                 CASE WHEN NOT (c_nationkey BETWEEN 0 AND 24) THEN 'check:nation_in_range' END
                           ) AS violations
FROM customer WHERE NOT (c_acctbal >= 0) OR NOT (c_nationkey BETWEEN 0 AND 24)""")
def q_dq_check(spark, sf):
    c = V.table(spark, sf, "customer")
    rules = [quality.check("acctbal_non_negative", F.col("c_acctbal") >= 0),
             quality.check("nation_in_range", F.col("c_nationkey").between(0, 24))]
    v = quality.with_violations(c, rules)
    return v.where(F.size("violations") > 0).select("c_custkey", F.array_join("violations", ",").alias("violations"))


@query("dq_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_dq_unique(spark, sf):
    return quality.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_unique_text", """
SELECT md5(text) AS text_md5, count(*) AS n_rows FROM documents WHERE text IS NOT NULL
GROUP BY md5(text) HAVING count(*) > 1""")
def q_dq_unique_text(spark, sf):
    d = V.table(spark, sf, "documents").select(F.md5("text").alias("text_md5"))
    return quality.duplicate_keys(d, ["text_md5"])


@query("dq_foreign_key", """
SELECT 'lineitem.l_orderkey->orders' AS rule, count(*) AS orphans FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT 'lineitem.l_partkey->part', count(*) FROM lineitem
  WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)
UNION ALL SELECT 'orders.o_custkey->customer', count(*) FROM orders
  WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
UNION ALL SELECT 'labels.doc_id->documents', count(*) FROM labels
  WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)""")
def q_dq_foreign_key(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    checks = [("lineitem.l_orderkey->orders", t("lineitem"), t("orders"), ["l_orderkey"], ["o_orderkey"]),
              ("lineitem.l_partkey->part", t("lineitem"), t("part"), ["l_partkey"], ["p_partkey"]),
              ("orders.o_custkey->customer", t("orders"), t("customer"), ["o_custkey"], ["c_custkey"]),
              ("labels.doc_id->documents", t("labels"), t("documents"), ["doc_id"], ["doc_id"])]
    out = None
    for name, child, parent, ck, pk in checks:
        o = quality.orphans(child.select(*ck), parent, ck, pk).agg(F.count(F.lit(1)).alias("orphans"))
        o = o.select(F.lit(name).alias("rule"), "orphans")
        out = o if out is None else out.unionByName(o)
    return out


@query("dq_length", """
SELECT c_custkey, c_mktsegment FROM customer WHERE char_length(c_mktsegment) > 9""")
def q_dq_length(spark, sf):
    c = V.table(spark, sf, "customer")
    r = quality.max_length("c_mktsegment", 9)
    return c.where(r.fails).select("c_custkey", "c_mktsegment")


def broken_envelopes(spark, sf):
    """Scored records with contract violations planted by rule on the id."""
    from tidewater.plans.q_curation import envelope
    e = envelope(spark, sf)
    i = F.substring(F.col("transaction_id"), 5, 20).cast("long")
    return e.withColumns({
        "prediction": F.when(i % 50 == 0, F.lit(2)).otherwise(F.col("prediction")),
        "fraud_probability": F.when(i % 51 == 0, F.lit(1.2)).otherwise(F.col("fraud_probability")),
        "is_fraud": F.when(i % 53 == 0, ~F.col("is_fraud")).otherwise(F.col("is_fraud")),
        "scored_at": F.when(i % 59 == 0, F.lit("yesterday")).otherwise(F.col("scored_at")),
        "model_version": F.when(i % 61 == 0, F.lit(None).cast("string")).otherwise(F.col("model_version")),
    })


@query("validate_scored", with_views("""
WITH e AS (
  SELECT transaction_id,
         CASE WHEN id % 50 = 0 THEN 2 ELSE prediction END AS prediction,
         CASE WHEN id % 51 = 0 THEN 1.2 ELSE fraud_probability END AS fraud_probability,
         CASE WHEN id % 53 = 0 THEN NOT (prediction = 1) ELSE prediction = 1 END AS is_fraud,
         CASE WHEN id % 61 = 0 THEN NULL ELSE model_version END AS model_version,
         CASE WHEN id % 59 = 0 THEN 'yesterday' ELSE strftime(scored_at, '%Y-%m-%dT%H:%M:%S.%f') END AS scored_at
  FROM scores_v)
SELECT transaction_id,
       concat_ws(',',
         CASE WHEN transaction_id IS NULL THEN 'missing:transaction_id' END,
         CASE WHEN prediction IS NULL THEN 'missing:prediction' END,
         CASE WHEN fraud_probability IS NULL THEN 'missing:fraud_probability' END,
         CASE WHEN is_fraud IS NULL THEN 'missing:is_fraud' END,
         CASE WHEN model_version IS NULL THEN 'missing:model_version' END,
         CASE WHEN scored_at IS NULL THEN 'missing:scored_at' END,
         CASE WHEN prediction NOT IN (0, 1) THEN 'prediction_in_0_1' END,
         CASE WHEN fraud_probability < 0 OR fraud_probability > 1 OR isnan(fraud_probability)
              THEN 'probability_in_0_1' END,
         CASE WHEN is_fraud <> (prediction = 1) THEN 'is_fraud_matches_prediction' END,
         CASE WHEN scored_at IS NOT NULL AND TRY_CAST(scored_at AS TIMESTAMP) IS NULL
              THEN 'scored_at_iso' END) AS violations,
       CASE WHEN transaction_id IS NULL OR prediction IS NULL OR fraud_probability IS NULL OR is_fraud IS NULL
              OR model_version IS NULL OR scored_at IS NULL OR prediction NOT IN (0, 1)
              OR fraud_probability < 0 OR fraud_probability > 1 OR is_fraud <> (prediction = 1)
              OR (scored_at IS NOT NULL AND TRY_CAST(scored_at AS TIMESTAMP) IS NULL)
            THEN false ELSE true END AS is_valid
FROM e""", "scores_v"))
def q_validate_scored(spark, sf):
    v = quality.validate_scored(broken_envelopes(spark, sf))
    return v.select("transaction_id", F.array_join("violations", ",").alias("violations"), "is_valid")


#: one scored message per row, written the same in both dialects; every 17th of each kind breaks one rule
MESSAGE = """concat('{"transaction_id": "', transaction_id, '", "original_data": {"amount": 1.5}, ',
  CASE WHEN id % 17 = 1 THEN '' ELSE concat('"prediction": ', CASE id % 17 WHEN 2 THEN '"1"' WHEN 3 THEN '1.0' WHEN 4 THEN '2' WHEN 5 THEN 'null'
    WHEN 6 THEN CASE WHEN prediction = 1 THEN 'true' ELSE 'false' END ELSE CAST(prediction AS STRING) END, ', ') END,
  '"fraud_probability": ', CASE id % 17 WHEN 7 THEN '"0.5"' WHEN 8 THEN '1.25' WHEN 9 THEN '1' ELSE '0.5' END,
  ', "is_fraud": ', CASE id % 17 WHEN 10 THEN '1' WHEN 11 THEN CASE WHEN prediction = 1 THEN 'false' ELSE 'true' END
    ELSE CASE WHEN prediction = 1 THEN 'true' ELSE 'false' END END,
  ', "model_version": ', CASE id % 17 WHEN 12 THEN '1.5' WHEN 13 THEN '7' ELSE '"v1"' END,
  ', "scored_at": ', CASE id % 17 WHEN 14 THEN '"yesterday"' WHEN 15 THEN '20250101' ELSE '"2025-11-22T19:14:40.745435Z"' END,
  CASE WHEN id % 17 = 16 THEN '' ELSE '}' END)"""


@query("validate_messages", with_views(f"""
WITH m AS (SELECT transaction_id, {MESSAGE} AS m FROM scores_v),
j AS (SELECT transaction_id, json_valid(m) AS ok, CASE WHEN json_valid(m) THEN m::JSON END AS j FROM m),
t AS (SELECT *, json_type(j, '$.prediction') AS tp, json_type(j, '$.fraud_probability') AS tf, json_type(j, '$.is_fraud') AS ti,
             json_type(j, '$.model_version') AS tm, json_type(j, '$.scored_at') AS ts, json_extract_string(j, '$.prediction') AS p,
             TRY_CAST(json_extract_string(j, '$.fraud_probability') AS DOUBLE) AS f, json_extract_string(j, '$.is_fraud') AS i,
             json_extract_string(j, '$.scored_at') AS s FROM j),
r AS (SELECT *, tp IN ('BIGINT', 'UBIGINT', 'BOOLEAN') AS whole, p IN ('0', '1', 'true', 'false') AS bit FROM t)
SELECT transaction_id, CASE WHEN NOT ok THEN 'unparseable' WHEN tp IS NULL THEN 'missing:prediction' ELSE concat_ws(',',
  CASE WHEN NOT whole THEN 'prediction_int' END,
  CASE WHEN whole AND NOT bit THEN 'prediction_in_0_1' END,
  CASE WHEN tf NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') THEN 'probability_number' WHEN NOT f BETWEEN 0 AND 1 THEN 'probability_in_0_1' END,
  CASE WHEN ti <> 'BOOLEAN' THEN 'is_fraud_boolean' WHEN whole AND bit AND (i = 'true') <> (p IN ('1', 'true')) THEN 'is_fraud_matches_prediction' END,
  CASE WHEN tm NOT IN ('BIGINT', 'UBIGINT', 'BOOLEAN', 'VARCHAR') THEN 'model_version_int_or_text' END,
  CASE WHEN ts <> 'VARCHAR' OR TRY_CAST(s AS TIMESTAMP) IS NULL THEN 'scored_at_iso' END) END AS violations
FROM r""", "scores_v"))
def q_validate_messages(spark, sf):
    """Types and values of raw scored messages: numbers as text, decimals, truth values, nulls, broken JSON."""
    # one file may scan as one task: its narrow rows are dealt before messages are written and parsed
    rows = spread(V.scores_v(spark, sf).select("transaction_id", "id", "prediction"), V.wide(spark, sf, "events"))
    m = rows.select("transaction_id", F.expr(MESSAGE).alias("value"))
    return quality.validate_messages(m).select("transaction_id", F.array_join("violations", ",").alias("violations"))


@query("step_counts", with_views("""
SELECT 'raw_firewall' AS step, count(*) AS n_rows FROM firewall_v
UNION ALL SELECT 'curated_firewall', count(*) FROM firewall_v
UNION ALL SELECT 'denied_or_dropped', count(*) FILTER (WHERE act IN ('DENY', 'DROP')) FROM firewall_v""",
                                 "firewall_v"))
def q_step_counts(spark, sf):
    """Counts of each step, gathered by observers during the single write
    action (no separate count jobs)."""
    raw, o_raw = quality.observe_counts(V.firewall_v(spark, sf), "raw_firewall")
    cur = curation.curate_firewall(raw, processed_at=F.lit(FIXED_TS_TEXT).cast("timestamp"))
    cur, o_cur = quality.observe_counts(cur, "curated_firewall", {
        "denied_or_dropped": F.count_if(F.col("action").isin("DENY", "DROP"))})
    cur.write.parquet(scratch_path(spark, "step_counts"))
    rows = [("raw_firewall", int(o_raw.get["rows"])), ("curated_firewall", int(o_cur.get["rows"])),
            ("denied_or_dropped", int(o_cur.get["denied_or_dropped"]))]
    return spark.createDataFrame(rows, "step string, n_rows long")


FIXED_TS_TEXT = "2025-01-01 00:00:00"

COPY_TABLES = V.TABLES


def _counts_sql() -> str:
    return "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in COPY_TABLES)


@query("elt_extract", _counts_sql())
def q_elt_extract(spark, sf):
    return replicate.row_counts(replicate.extract_files(spark, sf, COPY_TABLES))


@query("elt_discover", _counts_sql())
def q_elt_discover(spark, sf):
    """The tables that the catalog itself lists, with their rows."""
    return replicate.row_counts(replicate.extract_files(spark, sf, replicate.discover_tables(spark, sf)))


@query("elt_load", _counts_sql())
def q_elt_load(spark, sf):
    src = replicate.extract_files(spark, sf, COPY_TABLES)
    manifest = replicate.load_files(spark, src, scratch_path(spark, "elt_target"))
    return manifest.select("table_name", "n_rows")


@query("elt_reconcile", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS matches FROM {t}"
    for t in COPY_TABLES))
def q_elt_reconcile(spark, sf):
    src = replicate.extract_files(spark, sf, COPY_TABLES)
    return replicate.reconcile_loaded(spark, replicate.load_files(spark, src, scratch_path(spark, "elt_target")))


@query("elt_reconcile_differences", """
SELECT * FROM (SELECT count(*) AS source_rows, max(o_orderkey) AS k FROM orders) n,
  (VALUES ('same', 0, true), ('one_value', 0, false), ('one_row_twice_for_another', 0, false), ('two_rows_more', 2, false),
          ('column_renamed', 0, false), ('column_retyped', 0, false)) v(table_name, more, matches)""".replace(
    "SELECT * FROM", "SELECT table_name, source_rows, source_rows + more AS target_rows, matches FROM", 1))
def q_elt_reconcile_differences(spark, sf):
    """Copies of a table with one planted difference each; all but the first must be told apart."""
    o = V.table(spark, sf, "orders")
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    pick = lambda k: o.where(F.col("o_orderkey") == k)
    rest = o.where(F.col("o_orderkey") != high)
    return quality.reconcile({
        "same": (o, o.repartition(7)),
        "one_value": (o, rest.unionByName(pick(high).withColumn("o_totalprice", F.col("o_totalprice") + F.lit(0.01)))),
        "one_row_twice_for_another": (o, rest.unionByName(pick(low))),
        "two_rows_more": (o, o.unionByName(pick(low)).unionByName(pick(low))),
        "column_renamed": (o, o.withColumnRenamed("o_custkey", "custkey")),
        "column_retyped": (o, o.withColumn("o_custkey", F.col("o_custkey").cast("int")))})
