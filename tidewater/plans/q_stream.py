"""Streaming and idempotent-sink queries.

Each streaming query writes messages derived from the test tables to the
shared folder, runs the streaming job over them with ``availableNow``
(drain and stop) and returns what the job's sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import schemas
from tidewater.operators import curation
from tidewater.plans import views as V
from tidewater.plans.oracles import with_views
from tidewater.plans.q_curation import envelope
from tidewater.plans.registry import query
from tidewater.session import scratch_path
from tidewater.sources import sinks
from tidewater.streaming import jobs

SPLIT_TS = "2024-01-16 00:00:00"


def write_messages(df, path: str) -> None:
    """One JSON message per line (the file stand-in for a topic)."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), sinks.TS_OPTIONS).alias("value")) \
      .write.text(path)


def _with_parts(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(n, T.StringType()) for n in names])


@query("stream_ingest_json", """
SELECT *, 'events' AS topic, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day
FROM events""")
def q_stream_ingest_json(spark, sf):
    ev = V.table(spark, sf, "events")
    src, landing = scratch_path(spark, "events_in"), scratch_path(spark, "events_landing")
    ev.write.options(**sinks.TS_OPTIONS).json(src)
    stream = jobs.file_json_stream(spark, src, ev.schema)
    jobs.ingest_json_landing(stream, landing, scratch_path(spark, "ckpt"), topic="events",
                             ts=F.col("ts")).awaitTermination()
    back = spark.read.schema(_with_parts(ev.schema, "topic", "year", "month", "day")) \
        .options(**sinks.TS_OPTIONS).json(landing)
    return back.select(*ev.columns, "topic", "year", "month", "day")


@query("stream_scored_json", with_views(
    "SELECT transaction_id, user_id, amount, location, is_simulated_fraud, prediction, fraud_probability, "
    "prediction = 1 AS is_fraud, model_version, scored_at FROM scores_v", "scores_v"))
def q_stream_scored_json(spark, sf):
    env = envelope(spark, sf)
    src, out = scratch_path(spark, "scored_in"), scratch_path(spark, "scored_out")
    write_messages(env, src)
    parsed, _dead = jobs.parse_messages(jobs.text_stream(spark, src), env.schema)
    flat = curation.flatten_scores(parsed)
    (flat.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "ckpt"))
     .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out)


@query("stream_dead_letter", with_views("""
SELECT 'parsed' AS kind, count(*) AS n_rows, round(sum(amount), 4) AS total_amount FROM scores_v WHERE id % 89 <> 0
UNION ALL
SELECT 'dead_letter', count(*), CAST(NULL AS DOUBLE) FROM scores_v WHERE id % 89 = 0""", "scores_v"))
def q_stream_dead_letter(spark, sf):
    s = V.scores_v(spark, sf)
    src = scratch_path(spark, "dl_in")
    good, dead_out = scratch_path(spark, "dl_good"), scratch_path(spark, "dl_dead")
    msgs = s.select(F.col("id"), F.to_json(F.struct(*[F.col(c) for c in s.columns]), sinks.TS_OPTIONS).alias("v"))
    # planted damage: every 89th message is cut short
    msgs.select(F.when(F.col("id") % 89 == 0, F.substring("v", 1, 10)).otherwise(F.col("v")).alias("value")) \
        .write.text(src)
    def each(batch, epoch):
        p, d = jobs.parse_messages(batch, s.schema)
        jobs.write_batch(p, good, epoch)
        jobs.write_batch(d, dead_out, epoch)

    jobs.write_each_batch(jobs.text_stream(spark, src), each, scratch_path(spark, "ckpt")).awaitTermination()
    g = spark.read.parquet(good).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.round(F.sum("amount"), 4).alias("total_amount"))
    d = spark.read.parquet(dead_out).agg(F.count(F.lit(1)).alias("n_rows"))
    return (g.select(F.lit("parsed").alias("kind"), "n_rows", "total_amount")
            .unionByName(d.select(F.lit("dead_letter").alias("kind"), "n_rows",
                                  F.lit(None).cast("double").alias("total_amount"))))


@query("stream_volume_trend", with_views("""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, scored_at) AS window_start,
         time_bucket(INTERVAL 1 HOUR, scored_at) + INTERVAL 1 HOUR AS window_end, count(*) AS total_transactions
  FROM scores_v GROUP BY 1, 2)
WHERE window_end <= (SELECT max(scored_at) FROM scores_v) - INTERVAL 10 MINUTE""", "scores_v"))
def q_stream_volume_trend(spark, sf):
    s = V.scores_v(spark, sf)
    src, out = scratch_path(spark, "vol_in"), scratch_path(spark, "vol_out")
    s.write.options(**sinks.TS_OPTIONS).json(src)
    agg = jobs.windowed_volume(jobs.file_json_stream(spark, src, s.schema), "scored_at",
                               every="1 hour", watermark="10 minutes")
    (agg.writeStream.outputMode("append").format("parquet").option("checkpointLocation", scratch_path(spark, "ckpt"))
     .trigger(availableNow=True).start(out).awaitTermination())
    back = spark.read.parquet(out)
    return back.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                       F.col("window_end").cast("timestamp_ntz").alias("window_end"), "total_transactions")


@query("stream_fraud_rate", with_views("""
SELECT count(*) AS total_transactions, count(*) FILTER (WHERE is_fraud) AS fraud_count,
       count(*) FILTER (WHERE is_fraud) / count(*) AS fraud_rate FROM scores_v""", "scores_v"))
def q_stream_fraud_rate(spark, sf):
    s = V.scores_v(spark, sf)
    src, out = scratch_path(spark, "rate_in"), scratch_path(spark, "rate_out")
    s.write.options(**sinks.TS_OPTIONS).json(src)
    agg = jobs.running_fraud_rate(jobs.file_json_stream(spark, src, s.schema, max_files_per_trigger=2))
    jobs.write_each_batch(agg, lambda b, _e: b.write.mode("overwrite").parquet(out),
                          scratch_path(spark, "ckpt"), output_mode="complete").awaitTermination()
    return spark.read.parquet(out)


def _two_versions(spark, sf):
    """Every scored row twice: the original and a changed copy (probability
    1 - p).  Which copy comes first alternates with the id."""
    s = V.scores_v(spark, sf).select("id", "transaction_id", "amount", "fraud_probability", "scored_at")
    even = F.col("id") % 2 == 0
    orig = s.withColumn("seq", F.when(even, F.lit(0)).otherwise(F.lit(1)))
    changed = s.withColumns({"fraud_probability": 1 - F.col("fraud_probability"),
                             "seq": F.when(even, F.lit(1)).otherwise(F.lit(0))})
    return orig, changed


FIRST_WINS_SQL = """
SELECT id, transaction_id, amount,
       CASE WHEN id % 2 = 0 THEN fraud_probability ELSE 1 - fraud_probability END AS fraud_probability, scored_at
FROM scores_v"""


@query("dedup_first", with_views(FIRST_WINS_SQL, "scores_v"))
def q_dedup_first(spark, sf):
    orig, changed = _two_versions(spark, sf)
    return sinks.first_per_key(orig.unionByName(changed), "transaction_id", "seq").drop("seq")


@query("insert_if_absent", with_views(f"""
SELECT id, transaction_id,
       CASE WHEN scored_at < TIMESTAMP '{SPLIT_TS}' THEN amount * 10 ELSE amount END AS amount,
       CASE WHEN scored_at < TIMESTAMP '{SPLIT_TS}' OR id % 2 = 0 THEN fraud_probability
            ELSE 1 - fraud_probability END AS fraud_probability,
       scored_at
FROM scores_v""", "scores_v"))
def q_insert_if_absent(spark, sf):
    """The target already holds the early rows (with a different amount);
    a batch with every row twice is inserted: early ids are skipped, new
    ids get their first copy, and a replay of the batch adds nothing."""
    orig, changed = _two_versions(spark, sf)
    target = scratch_path(spark, "sink_table")
    early = orig.where(F.col("scored_at") < F.lit(SPLIT_TS).cast("timestamp_ntz"))
    sinks.insert_if_absent(spark, early.withColumn("amount", F.col("amount") * 10), target, "transaction_id", "seq", n_buckets=32)
    batch = orig.unionByName(changed)
    sinks.insert_if_absent(spark, batch, target, "transaction_id", "seq")
    sinks.insert_if_absent(spark, batch, target, "transaction_id", "seq")  # replay: no-op
    return sinks.read_table(spark, target).drop("seq")


@query("stream_dedup", with_views(FIRST_WINS_SQL, "scores_v"))
def q_stream_dedup(spark, sf):
    """Duplicates arrive in separate files (separate micro-batches); the
    idempotent sink keeps the first copy of each id."""
    orig, changed = _two_versions(spark, sf)
    src, target = scratch_path(spark, "dedup_in"), scratch_path(spark, "dedup_table")
    first = orig.where(F.col("seq") == 0).unionByName(changed.where(F.col("seq") == 0))
    second = orig.where(F.col("seq") == 1).unionByName(changed.where(F.col("seq") == 1))
    ckpt = scratch_path(spark, "ckpt")
    # two arrivals, two drains on one checkpoint: the second copies meet a table that holds the first
    for n, arrived in enumerate((first, second)):
        arrived.write.options(**sinks.TS_OPTIONS).json(f"{src}/part={n}")
        stream = jobs.file_json_stream(spark, f"{src}/*", orig.schema)
        jobs.dedup_into_table(stream, target, "transaction_id", "seq", ckpt, n_buckets=32).awaitTermination()
    return sinks.read_table(spark, target).drop("seq")


@query("stream_score", with_views("""
SELECT CAST(id AS VARCHAR) AS transaction_id, true AS prediction_ok, "Class" = 1 AS was_fraud,
       CASE WHEN id % 2 = 0 THEN '1' ELSE '2' END AS model_version
FROM tx_signal_v""", "tx_signal_v"))
def q_stream_score(spark, sf):
    """Transactions arrive as JSON messages and are scored with the model
    that the registry names.  Between two arrivals of one running query a
    second version goes to production, and the rest is scored with it."""
    from tidewater.operators import ml, registry
    from tidewater.plans import q_ml
    frame = q_ml.training_frame(spark, sf).withColumn("transaction_id", F.col("id").cast("string"))
    src, out, models = (scratch_path(spark, n) for n in ("tx_in", "tx_scored", "model_registry"))
    artifact = q_ml.train(spark, sf)[0]
    one = spark.createDataFrame([("fraud", 1, "Production", 1, 1, artifact, "READY"), ("fraud", 2, "Staging", 2, 2, artifact, "READY")],
                                schemas.MODEL_REGISTRY)
    registry.save_registry(one, models)

    def current() -> str:
        return str(registry.current_version(registry.read_registry(spark, models)).first()["current_version"])

    def load(version: str):
        run = registry.read_registry(spark, models).where(F.col("version") == int(version)).first()["run_id"]
        model, feats, params = ml.load_model(spark, run)

        def scorer(batch):
            aligned = curation.align_features(batch, feats, keep=["transaction_id", "is_fraud"])
            return ml.score(model, ml.apply_scaler(aligned, params)).select(
                "transaction_id", q_ml.consistent_columns().alias("prediction_ok"), (F.col("is_fraud") == 1).alias("was_fraud"))
        return scorer

    arrive = lambda n: frame.where(F.col("id") % 2 == n).write.json(f"{src}/part={n}")
    arrive(0)
    stream = jobs.file_json_stream(spark, f"{src}/*", frame.schema)
    running = jobs.score_stream(stream, current, load, lambda b, e: jobs.write_batch(b, out, e), scratch_path(spark, "ckpt"),
                                refresh_seconds=0, trigger="1 second")
    try:
        running.processAllAvailable()
        registry.save_registry(registry.transition(registry.read_registry(spark, models), "fraud", 2, "Production"), models)
        arrive(1)
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(out).drop("batch_id")


@query("stream_counters", with_views("""
SELECT count(*) FILTER (WHERE id % 89 <> 0) AS processed, count(*) FILTER (WHERE id % 89 = 0) AS errors,
       count(*) AS messages
FROM scores_v""", "scores_v"))
def q_stream_counters(spark, sf):
    """Processed / error counters per micro-batch (observed while it is
    written, stored by batch id), summed over all batches."""
    s = V.scores_v(spark, sf)
    src, out = scratch_path(spark, "cnt_in"), scratch_path(spark, "cnt_out")
    msgs = s.select(F.col("id"), F.to_json(F.struct(*[F.col(c) for c in s.columns]), sinks.TS_OPTIONS).alias("v"))
    msgs.select(F.when(F.col("id") % 89 == 0, F.substring("v", 1, 10)).otherwise(F.col("v"))
                               .alias("value")).write.text(src)
    raw = jobs.text_stream(spark, src, max_files_per_trigger=1)
    schema = T.StructType(s.schema.fields + [T.StructField(jobs.CORRUPT, T.StringType(), True)])
    parsed = raw.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": jobs.CORRUPT,
                                                      **sinks.TS_OPTIONS}).alias("m"))
    bad = F.col(f"m.{jobs.CORRUPT}").isNotNull()
    counters = scratch_path(spark, "cnt_rows")
    metrics = {"processed": F.count_if(~bad), "errors": F.count_if(bad), "messages": F.count(F.lit(1))}
    jobs.write_counted(parsed, lambda b, e: jobs.write_batch(b.where(~bad).select("m.id"), out, e), counters,
                       scratch_path(spark, "ckpt"), metrics=metrics).awaitTermination()
    return jobs.batch_counters(spark, counters).agg(*[F.sum(k).alias(k) for k in metrics])


@query("stream_dedup_watermark", with_views("""
SELECT transaction_id, CASE WHEN id % 3 = 0 AND scored_at <= (SELECT max(scored_at) FROM scores_v) - INTERVAL 20 MINUTE
                            THEN 2 ELSE 1 END::BIGINT AS n_rows FROM scores_v""", "scores_v"))
def q_stream_dedup_watermark(spark, sf):
    """Every row arrives twice: the second time as it was (dropped: remembered,
    or older than the watermark), and every third also with an event time 30 days
    on (dropped while its first row is remembered, a new row beyond that)."""
    s = V.scores_v(spark, sf).select("id", "transaction_id", "scored_at")
    src, out, ckpt = scratch_path(spark, "wm_in"), scratch_path(spark, "wm_out"), scratch_path(spark, "ckpt")
    late = s.where(F.col("id") % 3 == 0).withColumn("scored_at", F.col("scored_at") + F.expr("INTERVAL 30 DAYS"))
    for n, arrived in enumerate((s, s.unionByName(late))):
        arrived.write.options(**sinks.TS_OPTIONS).json(f"{src}/part={n}")
        once = jobs.dedup_within_watermark(jobs.file_json_stream(spark, f"{src}/*", s.schema), ["transaction_id"], "scored_at", watermark="10 minutes")
        (once.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_listener_counters", with_views("""
SELECT count(*) FILTER (WHERE id % 89 <> 0) AS processed, count(*) FILTER (WHERE id % 89 = 0) AS errors, count(*) AS messages, count(*) AS input_rows,
       true AS same_as_counted
FROM scores_v""", "scores_v"))
def q_stream_listener_counters(spark, sf):
    """Counters per micro-batch by a listener, over two runs of one query on one
    checkpoint, against those that the batches wrote themselves."""
    s = V.scores_v(spark, sf)
    src, out, ckpt = scratch_path(spark, "ls_in"), scratch_path(spark, "ls_out"), scratch_path(spark, "ckpt")
    msgs = s.select(F.col("id"), F.to_json(F.struct(*[F.col(c) for c in s.columns]), sinks.TS_OPTIONS).alias("v"))
    msgs = msgs.select("id", F.when(F.col("id") % 89 == 0, F.substring("v", 1, 10)).otherwise(F.col("v")).alias("value"))
    schema = T.StructType(s.schema.fields + [T.StructField(jobs.CORRUPT, T.StringType(), True)])
    bad = F.col(f"m.{jobs.CORRUPT}").isNotNull()
    metrics = {"processed": F.count_if(~bad), "errors": F.count_if(bad), "messages": F.count(F.lit(1))}
    seen, counted = scratch_path(spark, "ls_seen"), scratch_path(spark, "ls_counted")
    listener = jobs.ProgressTable(spark, seen, "counters", list(metrics))
    try:
        for n in range(2):  # the second run starts from the checkpoint of the first
            msgs.where(F.col("id") % 2 == n).select("value").repartition(3).write.text(f"{src}/part={n}")
            parsed = jobs.text_stream(spark, f"{src}/*", max_files_per_trigger=1).select(
                F.from_json("value", schema, {"columnNameOfCorruptRecord": jobs.CORRUPT, **sinks.TS_OPTIONS}).alias("m"))
            watched = parsed.observe("counters", *[v.alias(k) for k, v in metrics.items()])
            (watched.where(~bad).select("m.id").writeStream.queryName("scored").format("parquet").option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start(out).awaitTermination())
            jobs.write_counted(parsed, lambda b, e: b.write.format("noop").mode("overwrite").save(), counted,
                               f"{ckpt}-counted", metrics=metrics).awaitTermination()
    finally:
        listener.close()
    mine = spark.read.parquet(f"{seen}/query=scored").where("messages > 0")
    theirs = jobs.batch_counters(spark, counted)
    same = mine.select("batch_id", *metrics).exceptAll(theirs.select("batch_id", *metrics)).count() == 0 and mine.count() == theirs.count()
    return mine.agg(*[F.sum(k).alias(k) for k in [*metrics, "input_rows"]]).withColumn("same_as_counted", F.lit(same))


@query("stream_scored_messages", with_views(
    "SELECT transaction_id AS key, transaction_id, user_id, amount, location, is_simulated_fraud, prediction, fraud_probability, "
    "prediction = 1 AS is_fraud, model_version, scored_at FROM scores_v", "scores_v"))
def q_stream_scored_messages(spark, sf):
    """Scored envelopes as keyed JSON messages through the streaming file sink, read back and flattened."""
    env = envelope(spark, sf)
    src, out = scratch_path(spark, "env_in"), scratch_path(spark, "env_out")
    write_messages(env, src)
    parsed, _ = jobs.parse_messages(jobs.text_stream(spark, src), env.schema)
    jobs.file_json_sink(parsed, out, scratch_path(spark, "ckpt"), key_col="transaction_id").awaitTermination()
    back = spark.read.schema("key string, value string").json(out)
    m = back.select("key", F.from_json("value", env.schema, sinks.TS_OPTIONS).alias("m")).select("key", "m.*")
    flat = curation.flatten_scores(m.drop("key"))
    return m.select("key").join(flat, F.col("key") == F.col("transaction_id"))


@query("stream_ingest_capped", """
SELECT count(*) AS n_rows, true AS every_batch_within_cap, true AS several_batches FROM events""")
def q_stream_ingest_capped(spark, sf):
    """Ingest with a size cap per batch under a ``processingTime`` trigger: rows, and whether each batch held at most one file."""
    ev = V.table(spark, sf, "events")
    src, landing, cnt = (scratch_path(spark, n) for n in ("cap_in", "cap_out", "cap_counts"))
    ev.repartition(4).write.options(**sinks.TS_OPTIONS).json(src)
    largest = spark.read.schema(ev.schema).json(src).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    stream = jobs.file_json_stream(spark, src, ev.schema, max_files_per_trigger=1)
    running = jobs.write_counted(stream, lambda b, e: jobs.write_batch(b, landing, e), cnt, scratch_path(spark, "ckpt"), trigger="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    batches = jobs.batch_counters(spark, cnt)
    return batches.agg(F.sum("rows").alias("n_rows"), (F.max("rows") <= largest).alias("every_batch_within_cap"),
                       (F.count(F.lit(1)) > 1).alias("several_batches"))


@query("predictions_table", with_views("""
SELECT id, id AS transaction_id, prediction AS predicted_class, fraud_probability, model_version, scored_at AS predicted_at,
       (prediction = 1) = is_simulated_fraud AS is_correct FROM scores_v""", "scores_v"))
def q_predictions_table(spark, sf):
    """The stored predictions, made if absent with their declared schema and filled first-write-wins, twice."""
    target = scratch_path(spark, "predictions")
    sinks.ensure_table(spark, target, schemas.PREDICTIONS, key="transaction_id", n_buckets=16)
    s = V.scores_v(spark, sf)
    rows = s.select("id", F.col("id").alias("transaction_id"), F.col("prediction").alias("predicted_class"), "fraud_probability", "model_version",
                    F.col("scored_at").alias("predicted_at"), ((F.col("prediction") == 1) == F.col("is_simulated_fraud")).alias("is_correct"))
    for _ in range(2):
        sinks.insert_if_absent(spark, rows, target, "transaction_id", "id")
    return sinks.read_table(spark, target)
