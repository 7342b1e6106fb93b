import datetime as dt

from pyspark.sql import functions as F

from tidewater import scratch_path
from tidewater.sources import sinks
from tidewater.streaming import jobs


def test_dead_letters_and_windows(spark):
    src = scratch_path(spark, "s_in")
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=17 * i), float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, amount double")
    msgs = df.select(F.to_json(F.struct("id", "ts", "amount"), sinks.TS_OPTIONS).alias("value"))
    msgs.unionByName(spark.createDataFrame([("{broken",)], "value string")).coalesce(1).write.text(src)
    parsed, dead = jobs.parse_messages(jobs.text_stream(spark, src), df.schema)
    out_p, out_d = scratch_path(spark, "s_p"), scratch_path(spark, "s_d")
    qs = [parsed.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "c1"))
          .trigger(availableNow=True).start(out_p),
          dead.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "c2"))
          .trigger(availableNow=True).start(out_d)]
    for q in qs:
        q.awaitTermination()
    assert spark.read.parquet(out_p).count() == 50
    assert [r.value for r in spark.read.parquet(out_d).collect()] == ["{broken"]

    win = jobs.windowed_volume(spark.readStream.schema(df.schema).parquet(out_p),
                               "ts", every="1 hour", watermark="10 minutes")
    out_w = scratch_path(spark, "s_w")
    (win.writeStream.outputMode("append").format("parquet").option("checkpointLocation", scratch_path(spark, "c3"))
     .trigger(availableNow=True).start(out_w).awaitTermination())
    got = {r.window_start.replace(tzinfo=None): r.total_transactions for r in spark.read.parquet(out_w).collect()}
    last = max(t for _, t, _ in rows)
    exp = {}
    for _, t, _ in rows:
        start = t.replace(minute=0, second=0, microsecond=0)
        if start + dt.timedelta(hours=1) <= last - dt.timedelta(minutes=10):
            exp[start] = exp.get(start, 0) + 1
    assert got == exp


def test_stream_dedup_replay_safe(spark):
    src, target = scratch_path(spark, "d_in"), scratch_path(spark, "d_t")
    a = spark.createDataFrame([("t1", 1.0, 0), ("t2", 2.0, 0)], "transaction_id string, amount double, seq int")
    b = spark.createDataFrame([("t1", 9.0, 1), ("t3", 3.0, 1)], "transaction_id string, amount double, seq int")
    a.coalesce(1).write.json(f"{src}/p=0")
    b.coalesce(1).write.json(f"{src}/p=1")
    stream = jobs.file_json_stream(spark, f"{src}/*", a.schema, max_files_per_trigger=1)
    ck = scratch_path(spark, "d_ck")
    jobs.dedup_into_table(stream, target, "transaction_id", "seq", ck).awaitTermination()
    jobs.dedup_into_table(stream, target, "transaction_id", "seq", ck).awaitTermination()  # restart: no dupes
    got = sorted((r.transaction_id, r.amount) for r in sinks.read_table(spark, target).collect())
    assert got == [("t1", 1.0), ("t2", 2.0), ("t3", 3.0)]


def test_running_rate_complete_mode(spark):
    src, out = scratch_path(spark, "r_in"), scratch_path(spark, "r_out")
    df = spark.createDataFrame([(True,), (False,), (False,), (True,)], "is_fraud boolean")
    df.repartition(2).write.json(src)
    agg = jobs.running_fraud_rate(jobs.file_json_stream(spark, src, df.schema, max_files_per_trigger=1))
    jobs.write_each_batch(agg, lambda b, _e: b.write.mode("overwrite").parquet(out), scratch_path(spark, "r_ck"),
                          output_mode="complete").awaitTermination()
    r = spark.read.parquet(out).first()
    assert (r.total_transactions, r.fraud_count, r.fraud_rate) == (4, 2, 0.5)
