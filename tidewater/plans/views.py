"""Domain views derived from the generated test tables.

Each view maps a generic table onto the record shape one of the pipelines
consumes (scored transactions, firewall and cloud-audit logs, training
transactions, feature rows, a model registry).  The same definitions are
written in SQL in ``tidewater.plans.oracles`` so every query can be checked
against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import materialize, pin_utc

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """As many partitions as cores for a table of few files (each scans as one task); None where there are enough files."""
    cores = spark.sparkContext.defaultParallelism
    return cores if len(table(spark, sf_dir, name).inputFiles()) < cores else None


def _k() -> F.Column:
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def scores_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transactions (sink-table shape) from ``events``."""
    ev = table(spark, sf_dir, "events")
    k = _k()
    return ev.select(
        F.concat(F.lit("txn_"), _s("event_id")).alias("transaction_id"),
        F.concat(F.lit("user_"), _s("user_id")).alias("user_id"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("location"),
        ((k >= 75) | (F.col("value") >= 250)).alias("is_simulated_fraud"),
        F.when(k >= 50, F.lit(1)).otherwise(F.lit(0)).alias("prediction"),
        (k.cast("double") / F.lit(100.0)).alias("fraud_probability"),
        (k >= 50).alias("is_fraud"),
        F.concat(F.lit("v"), _s(F.col("event_id") % 3 + 1)).alias("model_version"),
        F.col("ts").alias("scored_at"),
        F.col("event_id").alias("id"),
    )


def firewall_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw firewall log lines from ``events`` (with edge rows by rule)."""
    ev = table(spark, sf_dir, "events")
    e, u = F.col("event_id"), F.col("user_id")
    ipv4 = F.concat_ws(".", _s(e % 200 + 10), _s(F.expr("event_id div 200") % 256),
                       _s(u % 256), _s(e % 251))
    src_ip = (F.when(e % 101 == 0, F.concat(F.lit("2001:db8::"), _s(e)))
              .when(e % 103 == 0, F.lit("")).otherwise(ipv4))
    act = (F.when(F.col("event_type") == "error", F.lit("DROP"))
           .when(F.col("event_type") == "signup", F.lit("DENY"))
           .when(F.col("event_type") == "purchase", F.lit("RESET")).otherwise(F.lit("ALLOW")))
    proto = F.when(e % 3 == 0, F.lit("TCP")).when(e % 3 == 1, F.lit("UDP")).otherwise(F.lit("ICMP"))
    ts_ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return ev.select(
        F.when(e % 997 == 0, F.lit(None).cast("long")).otherwise(ts_ms).alias("ts_unix"),
        src_ip.alias("src_ip"),
        F.concat_ws(".", F.lit("192"), F.lit("168"), _s(u % 256), _s(e % 256)).alias("dest_ip"),
        (e % 64512 + 1024).cast("int").alias("src_port"),
        ((e * 7) % 65535 + 1).cast("int").alias("dest_port"),
        proto.alias("protocol"),
        act.alias("act"),
        (e % 1461 + 40).cast("int").alias("bytes_sent"),
    )


def cloud_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cloud-audit lines from ``customer`` (with edge rows by rule)."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    iso = F.date_format(F.timestamp_seconds(F.lit(1704067200) + key * 420), "yyyy-MM-dd'T'HH:mm:ss")
    user = (F.when(key % 97 == 0, F.lit(None).cast("string"))
            .when(key % 101 == 0, F.lit(""))
            .when(key % 103 == 0, F.concat(F.col("c_name"), F.lit("\nsecond line")))
            .otherwise(F.col("c_name")))
    n = F.col("c_nationkey")
    op = (F.when(n % 4 == 0, F.lit("read")).when(n % 4 == 1, F.lit("write"))
          .when(n % 4 == 2, F.lit("delete")).otherwise(F.lit("list")))
    svc = (F.when(key % 113 == 0, F.lit(None).cast("string"))
           .when(n % 3 == 0, F.lit("iam")).when(n % 3 == 1, F.lit("storage")).otherwise(F.lit("compute")))
    return c.select(
        F.when(key % 89 == 0, F.lit("not-a-time")).otherwise(iso).alias("event_time_iso"),
        user.alias("user_id"),
        F.col("c_mktsegment").alias("resource_name"),
        op.alias("operation"),
        (F.col("c_acctbal") > 0).alias("success"),
        svc.alias("source_service"),
    )


def tx_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training transactions (Time, V1..V4, Amount, Class) from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    secs = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    first = li.agg(F.min(secs)).scalar()
    intra = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 1013) % 86400
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (secs - first + intra).cast("double").alias("Time"),
        F.col("l_quantity").alias("V1"),
        F.col("l_discount").alias("V2"),
        F.col("l_tax").alias("V3"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("V4"),
        F.col("l_extendedprice").alias("Amount"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).alias("Class"),
    )


def tx_signal_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx_v`` with a label that its columns predict, but for one flipped row in 25."""
    rule = (F.col("V1") * F.col("V2") >= 3.5) != (F.col("id") % 25 == 0)
    return tx_v(spark, sf_dir).withColumn("Class", F.when(rule, F.lit(1)).otherwise(F.lit(0)))


def spine_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity spine: purchases with a churn-like label."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select("user_id", F.col("ts").alias("event_timestamp"),
                     F.col("event_id").alias("spine_event"),
                     F.when(F.col("value") > 100, F.lit(1)).otherwise(F.lit(0)).alias("label_is_churn"))


def feat_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows: views with their value and score."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return ev.select("user_id", F.col("ts").alias("event_timestamp"),
                     F.col("value").alias("last_view_value"), _k().alias("view_score"),
                     F.col("event_id").alias("view_event_id"))


def feat_created_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with a creation time; every view is also re-stated at the
    same event time with a later creation time and a changed value, so the
    tie-break on creation time decides the result."""
    f = feat_v(spark, sf_dir)
    first = f.select("*", F.col("event_timestamp").alias("created_timestamp"))
    second = f.select("user_id", "event_timestamp", (F.col("last_view_value") * 2).alias("last_view_value"),
                      "view_score", "view_event_id",
                      (F.col("event_timestamp") + F.expr("INTERVAL 1 HOUR")).alias("created_timestamp"))
    return first.unionByName(second)


def _epoch_ms(c) -> F.Column:
    return F.expr(f"unix_micros(cast({c} as timestamp)) div 1000")


def registry_v(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> DataFrame:
    """Model registry: one model per location, versions v1..v3 of the scores (or of a summary with first and last)."""
    s = scores if scores is not None else scores_v(spark, sf_dir).select("*", F.col("scored_at").alias("first"), F.col("scored_at").alias("last"))
    g = s.groupBy("location", "model_version").agg(F.min("first").alias("_first"), F.max("last").alias("_last"))
    version = F.substring(F.col("model_version"), 2, 10).cast("int")
    name = F.concat(F.lit("fraud_"), F.col("location"))
    return g.select(
        name.alias("model_name"), version.alias("version"),
        F.when(version == 3, F.lit("Staging")).when(version == 2, F.lit("Production"))
         .otherwise(F.lit("None")).alias("current_stage"),
        _epoch_ms("_first").alias("creation_time"), _epoch_ms("_last").alias("last_updated_time"),
        F.md5(F.concat(name, F.lit(":"), version.cast("string"))).alias("run_id"),
        F.lit("READY").alias("status"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores_v(spark, sf_dir)
    return s.withColumns({"model_name": F.concat(F.lit("fraud_"), F.col("location")),
                          "version": F.substring(F.col("model_version"), 2, 10).cast("int")})


METRIC_NAMES = ["roc_auc", "precision", "recall", "f1"]


def metrics_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics in long (EAV) form, computed from the scores of each
    (model, version): exact ROC-AUC and precision / recall / F1."""
    from tidewater.operators import ml
    # the facts are read once: rows per model, version, score and outcome, and when they were scored
    ms = materialize(model_scores(spark, sf_dir)
                     .groupBy("location", "model_version", "model_name", "version", "fraud_probability", "prediction", "is_simulated_fraud")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("scored_at").alias("first"), F.max("scored_at").alias("last")), "score-counts")
    keys = ["model_name", "version"]
    auc = ml.roc_auc(ms, "fraud_probability", "is_simulated_fraud", group_by=keys, count="n").select(*keys, "roc_auc")
    cls = ml.classification_metrics(ms, "prediction", "is_simulated_fraud", group_by=keys, count="n")
    wide = auc.join(cls.select(*keys, "precision", "recall", "f1"), keys, "inner")
    stack = ", ".join(f"'{m}', {m}" for m in METRIC_NAMES)
    long = wide.selectExpr(*keys, f"stack({len(METRIC_NAMES)}, {stack}) as (metric_name, metric_value)")
    reg = registry_v(spark, sf_dir, ms)
    return long.join(reg, keys, "inner").select(
        "run_id", F.lit(1).alias("experiment_id"), F.col("creation_time").alias("start_time"),
        F.col("last_updated_time").alias("end_time"), F.lit("FINISHED").alias("status"),
        "metric_name", "metric_value")
