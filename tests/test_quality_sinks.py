import datetime as dt

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import schemas, scratch_path, session
from tidewater.operators import kpi, quality, replicate
from tidewater.sources import files, sinks

# Five seed rows of the score sink (FIXTURES 7).
SEED = [
    (1, "txn_001", "user_alice", 125.5, "US", False, 0, 0.05, False, "v1"),
    (2, "txn_002", "user_bob", 8500.0, "NG", True, 1, 0.98, True, "v1"),
    (3, "txn_003", "user_charlie", 45.2, "UK", False, 0, 0.12, False, "v1"),
    (4, "txn_004", "user_david", 2300.75, "RU", True, 1, 0.87, True, "v1"),
    (5, "txn_005", "user_eve", 67.3, "CA", False, 0, 0.08, False, "v1"),
]
SEED_SCHEMA = ("id long, transaction_id string, user_id string, amount double, location string, "
               "is_simulated_fraud boolean, prediction int, fraud_probability double, is_fraud boolean, "
               "model_version string")


def seed(spark):
    ts = dt.datetime(2025, 11, 22, 19, 14, 40, 745435)
    return spark.createDataFrame(SEED, SEED_SCHEMA).withColumn("scored_at", F.lit(ts).cast("timestamp_ntz"))


def test_kpi_seed_rows(spark):
    r = kpi.kpi_summary(seed(spark)).first()
    assert (r.total_transactions, r.fraud_count) == (5, 2)
    assert abs(r.fraud_rate - 0.4) < 1e-12 and abs(r.avg_confidence - 0.42) < 1e-12
    assert r.model_versions == ["v1"]
    ids = [x.transaction_id for x in kpi.alerts(seed(spark)).collect()]
    assert ids == ["txn_002", "txn_004"]


def test_kpi_rate_null_on_empty(spark):
    r = kpi.kpi_summary(seed(spark).where("false")).first()
    assert r.total_transactions == 0 and r.fraud_rate is None


def test_insert_if_absent_first_wins_and_idempotent(spark):
    target = scratch_path(spark, "t_sink")
    s = seed(spark)
    first = s.where(F.col("id") <= 2)
    sinks.insert_if_absent(spark, first, target, "transaction_id", "id")
    dup = s.unionByName(s.withColumn("amount", F.lit(-1.0)).withColumn("id", F.col("id") + 100))
    dup = dup.unionByName(s.limit(1).withColumn("transaction_id", F.lit("")))  # empty id: skipped
    sinks.insert_if_absent(spark, dup, target, "transaction_id", "id")
    once = sorted((r.transaction_id, r.amount) for r in sinks.read_table(spark, target).collect())
    sinks.insert_if_absent(spark, dup, target, "transaction_id", "id")  # replay
    twice = sorted((r.transaction_id, r.amount) for r in sinks.read_table(spark, target).collect())
    assert once == twice
    assert once == sorted((r[1], r[3]) for r in SEED)


def test_insert_reads_touched_buckets_only(spark):
    """The scan of the target is filtered to the batch's buckets; a replay reads and adds nothing new; one bucket may hold all rows."""
    rows = spark.range(400).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("key"), F.col("id").alias("seq"))
    for n_buckets in (64, 1):
        target = scratch_path(spark, "buckets")
        sinks.insert_if_absent(spark, rows, target, "key", "seq", n_buckets=n_buckets)
        plans = []

        def observe(name, df):
            if name == "insert-delta":
                plans.append(df._jdf.queryExecution().executedPlan().toString())

        session.stage_observers.append(observe)
        try:
            few = rows.where("seq < 3").unionByName(spark.createDataFrame([("new", 1000)], "key string, seq long"))
            assert [r.key for r in sinks.insert_if_absent(spark, few, target, "key", "seq").collect()] == ["new"]
            assert sinks.insert_if_absent(spark, few, target, "key", "seq").count() == 0
        finally:
            session.stage_observers.pop()
        assert len(plans) == 2 and all("PartitionFilters: [isnotnull(_bucket" in p or "PartitionFilters: [_bucket" in p for p in plans)
        assert sinks.read_table(spark, target).count() == 401
        touched = {r[0] for r in few.select(F.pmod(F.xxhash64("key"), F.lit(n_buckets))).collect()}
        assert n_buckets == 1 or len(touched) <= 4 < 64


def test_declared_table(spark):
    target = scratch_path(spark, "declared")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.DoubleType())])
    sinks.ensure_table(spark, target, schema, key="id", n_buckets=4)
    sinks.ensure_table(spark, target, schema, key="id")  # there already
    empty = sinks.read_table(spark, target)
    assert empty.dtypes == [("id", "string"), ("x", "double")] and empty.count() == 0
    sinks.insert_if_absent(spark, spark.createDataFrame([(1.5, "a")], "x double, id string"), target, "id", "x")
    assert [tuple(r) for r in sinks.read_table(spark, target).collect()] == [("a", 1.5)]
    for bad, key in (("id string, x int", "id"), ("id string", "id"), ("id string, x double, y int", "id"), ("id string, x double", "x")):
        with pytest.raises(ValueError, match="declared"):
            sinks.insert_if_absent(spark, spark.createDataFrame([], bad), target, key, "id")
    with pytest.raises(ValueError, match="no declared table"):
        sinks.read_table(spark, scratch_path(spark, "nowhere"))


def test_read_or_empty(spark):
    df = files.read_or_empty(spark, scratch_path(spark, "missing"), schemas.FIREWALL)
    assert df.isEmpty() and df.schema == schemas.FIREWALL


def test_jsonl_corrupt_lines_kept(spark):
    path = scratch_path(spark, "bad_json")
    spark.createDataFrame([('{"ts_unix": 1, "src_ip": "1.2.3.4"}',), ('{"ts_unix": 2, ',)], "value string") \
        .write.text(path)
    df = files.read_jsonl(spark, path, schemas.FIREWALL, keep_corrupt=True).cache()
    rows = sorted(df.collect(), key=lambda r: (r.ts_unix is None, r.ts_unix))
    assert rows[0].ts_unix == 1 and rows[0]._corrupt_record is None
    assert rows[1].ts_unix is None and rows[1]._corrupt_record.startswith('{"ts_unix": 2')


def test_validate_scored_contract(spark):
    schema = "transaction_id string, prediction int, fraud_probability double, is_fraud boolean, " \
             "model_version string, scored_at string, original_data string"
    rows = [("ok", 1, 0.9, True, "1", "2025-11-22T19:14:40.745435", "{}"),
            ("p2", 2, 0.9, True, "1", "2025-11-22T19:14:40", "{}"),
            ("p12", 0, 1.2, False, "1", "2025-11-22T19:14:40", "{}"),
            ("flip", 1, 0.9, False, "1", "2025-11-22T19:14:40Z", "{}"),
            ("badts", 0, 0.1, False, "1", "yesterday", "{}"),
            (None, 0, 0.1, False, None, "2025-11-22T19:14:40", "{}")]
    out = {r.transaction_id: r.violations for r in quality.validate_scored(spark.createDataFrame(rows, schema)).collect()}
    assert out["ok"] == []
    assert out["p2"] == ["prediction_in_0_1", "is_fraud_matches_prediction"]
    assert out["p12"] == ["probability_in_0_1"]
    assert out["flip"] == ["is_fraud_matches_prediction"]
    assert out["badts"] == ["scored_at_iso"]
    assert set(out[None]) == {"missing:transaction_id", "missing:model_version"}


def test_rules(spark):
    df = spark.createDataFrame([(1, 1, 4.5, "x"), (1, 1, 5.5, "y" * 60), (2, None, None, None)],
                               "film_id int, actor_id int, rating double, name string")
    summary = {r.rule: r.violations for r in quality.rule_summary(df, [
        quality.not_null("name"), quality.check("rating_1_5", F.col("rating").between(1, 5)),
        quality.max_length("name", 50)]).collect()}
    assert summary == {"not_null:name": 1, "check:rating_1_5": 1, "length:name<=50": 1}
    dups = quality.duplicate_keys(df, ["film_id", "actor_id"]).collect()
    assert [(r.film_id, r.actor_id, r.n_rows) for r in dups] == [(1, 1, 2)]
    parent = spark.createDataFrame([(1,)], "film_id int")
    orph = quality.orphans(df.select("film_id", "actor_id"), parent, ["film_id"]).collect()
    assert [r.film_id for r in orph] == [2]
    nullfk = spark.createDataFrame([(None,)], "film_id int")
    assert quality.orphans(nullfk, parent, ["film_id"]).count() == 0


def test_reconcile(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    b = a.repartition(5)
    c = a.where("id <> 7").unionByName(a.where("id = 7").withColumn("x", F.lit(0)))
    out = {r.table_name: (r.source_rows, r.target_rows, r.matches)
           for r in quality.reconcile({"same": (a, b), "changed": (a, c)}).collect()}
    assert out == {"same": (100, 100, True), "changed": (100, 100, False)}


def test_observe_counts(spark):
    df, obs = quality.observe_counts(spark.range(10), "n", {"odd": F.count_if(F.col("id") % 2 == 1)})
    df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 10, "odd": 5}


def test_drift_and_psi(spark):
    ref = spark.createDataFrame([(float(x),) for x in range(100)], "amount double")
    same = kpi.psi(kpi.drift_numeric(ref, ref, "amount", 10)).first()
    assert abs(same.psi) < 1e-12 and same.n_bins == 10
    live = spark.createDataFrame([(500.0,)] * 10 + [(-5.0,)] * 10, "amount double")
    cmp = {r.bin: (r.ref_rows, r.live_rows) for r in kpi.drift_numeric(ref, live, "amount", 10).collect()}
    assert cmp[9] == (10, 10) and cmp[0] == (10, 10)  # out-of-range live values clamp to the end bins
    assert kpi.psi(kpi.drift_numeric(ref, live, "amount", 10)).first().psi > 1


def test_message_types(spark):
    """How a value is written decides: text, whole number, decimal, truth value, null, absent."""
    def message(**change):
        m = {"transaction_id": '"t"', "original_data": "{}", "prediction": "1", "fraud_probability": "0.9", "is_fraud": "true",
             "model_version": '"v1"', "scored_at": '"2025-11-22T19:14:40Z"'} | change
        return "{" + ", ".join(f'"{k}": {v}' for k, v in m.items() if v is not None) + "}"

    cases = [
        (message(), []), (message(prediction="true"), []), (message(fraud_probability="1"), []), (message(model_version="3"), []),
        (message(prediction='"1"'), ["prediction_int"]), (message(prediction="1.0"), ["prediction_int"]), (message(prediction="null"), ["prediction_int"]),
        (message(prediction="2"), ["prediction_in_0_1"]), (message(prediction="0"), ["is_fraud_matches_prediction"]),
        (message(fraud_probability='"0.9"'), ["probability_number"]), (message(fraud_probability="1e2"), ["probability_in_0_1"]),
        (message(fraud_probability="-0.5"), ["probability_in_0_1"]), (message(is_fraud="1"), ["is_fraud_boolean"]),
        (message(is_fraud='"true"'), ["is_fraud_boolean"]), (message(model_version="1.5"), ["model_version_int_or_text"]),
        (message(model_version="[1]"), ["model_version_int_or_text"]), (message(scored_at='"soon"'), ["scored_at_iso"]),
        (message(scored_at="1732302880"), ["scored_at_iso"]), (message(original_data=None, is_fraud=None), ["missing:original_data", "missing:is_fraud"]),
        ("[1]", ["unparseable"]), ("{", ["unparseable"]), ('{"a": 1, "a": 2}', ["unparseable"]), (None, ["unparseable"])]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, value string")
    got = {r.i: (r.violations, r.is_valid) for r in quality.validate_messages(df).collect()}
    assert got == {i: (v, not v) for i, (_, v) in enumerate(cases)}


def test_load_and_reconcile_stored_tables(spark, tmp_path):
    """The manifest's checksums tell a stored table that was changed afterwards; a failing table fails the load."""
    tables = {n: spark.range(k).select("id", F.concat(F.lit(n), F.col("id").cast("string")).alias("x")) for n, k in (("a", 5), ("b", 0), ("c", 30))}
    manifest = replicate.load_files(spark, tables, str(tmp_path))
    assert [(r.table_name, r.n_rows) for r in manifest.collect()] == [("a", 5), ("b", 0), ("c", 30)]
    same = lambda: {r.table_name: (r.source_rows, r.target_rows, r.matches) for r in replicate.reconcile_loaded(spark, manifest).collect()}
    assert same() == {"a": (5, 5, True), "b": (0, 0, True), "c": (30, 30, True)}
    tables["a"].where("id < 4").unionByName(tables["a"].where("id = 0")).write.mode("overwrite").parquet(f"{tmp_path}/a")
    tables["c"].withColumn("id", F.col("id").cast("int")).write.mode("overwrite").parquet(f"{tmp_path}/c")
    assert same() == {"a": (5, 5, False), "b": (0, 0, True), "c": (30, 30, False)}
    broken = tables | {"d": spark.range(3).select(F.raise_error(F.lit("no such table")).alias("x"))}
    with pytest.raises(Exception, match="no such table"):
        replicate.load_files(spark, broken, f"{tmp_path}/again")


def test_discovered_tables(spark, tmp_path):
    for name in ("b.parquet", "a.parquet", "_hidden.parquet", "c.csv"):
        spark.range(2).write.parquet(f"{tmp_path}/{name}")
    assert replicate.discover_tables(spark, str(tmp_path)) == ["a", "b"]


def test_messages_of_one_file_are_parsed_by_all_cores(spark, tmp_path):
    """One file of one row group: messages are made and parsed in as many tasks as there are cores."""
    from tidewater.plans import q_quality
    spark.range(200).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value",
                                "TIMESTAMP_NTZ '2025-01-01 00:00:00' AS ts", "concat('{\"k\": ', id % 100, '}') AS props"
                                ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = q_quality.q_validate_messages(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 200


def test_message_is_parsed_once(spark):
    df = quality.validate_messages(spark.createDataFrame([("{}",)], "value string"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("parse_json") == 1
