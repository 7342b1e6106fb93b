"""No rows lost or doubled: null keys, duplicate ids, replays, many batches, hot partition values."""

import glob
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import docs, features, kpi, ml, vectors
from tidewater.sources import sinks
from tidewater.streaming import jobs


def test_null_category_is_one_row(spark):
    a = spark.createDataFrame([("x",), (None,), (None,)], "c string")
    b = spark.createDataFrame([("x",), (None,), ("y",), ("y",)], "c string")
    got = {r["c"]: (r["ref_rows"], r["live_rows"], r["ref_share"], r["live_share"]) for r in kpi.drift_categorical(a, b, "c").collect()}
    assert got == {"x": (1, 1, 1 / 3, 0.25), None: (2, 1, 2 / 3, 0.25), "y": (0, 2, 0.0, 0.5)}
    assert {(r["live_rows"], r["live_share"]) for r in kpi.drift_categorical(a, b.limit(0), "c").collect()} == {(0, 0.0)}


def test_null_source_keeps_its_chunks(spark):
    pages = spark.createDataFrame([(None, 1, "a b c"), (None, 2, "d"), ("s", 1, "e")], "source string, page_no int, text string")
    got = sorted((r["source"] or "", r["chunk_index"], r["text"]) for r in docs.chunk_and_number(pages).collect())
    assert got == [("", 0, "a b c"), ("", 1, "d"), ("s", 0, "e")]


def test_auc_keeps_the_null_group_and_crowded_scores(spark):
    rows = [("g" if i % 2 else None, 1e-6 * i if i < 998 else 1.0, int(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, s double, y int")

    def auc(part):
        pos, neg = [s for _, s, y in part if y], [s for _, s, y in part if not y]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)

    got = {r["g"]: r["roc_auc"] for r in ml.roc_auc(df, "s", "y", ["g"]).collect()}
    assert got == pytest.approx({g: auc([r for r in rows if r[0] == g]) for g in ("g", None)})


def test_contexts_of_empty_hits_and_one_row_per_id(spark):
    hits = spark.createDataFrame([(1, 1, "", "a"), (1, 2, None, "b"), (2, 1, "t", "a")], "query_id int, rank int, text string, source string")
    got = {r["query_id"]: (r["n_hits"], r["contexts"], r["sources"]) for r in vectors.search_context(hits).collect()}
    assert got == {1: (2, [], []), 2: (1, ["t"], ["a"])}
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<double>")
    new = spark.createDataFrame([("a", [3.0]), ("a", [4.0])], "id string, vector array<double>")
    assert sorted((r["id"], r["vector"]) for r in vectors.upsert(old, new).collect()) == [("a", [4.0]), ("b", [2.0])]


def test_repeated_query_ids_end(spark):
    pts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])] * 3, "query_id long, vector array<double>")
    assert vectors.vector_topk(pts, q, k=2, query_blocks=3, point_blocks=2).count() == 2


def test_counters_of_many_batches_and_replays(spark, tmp_path):
    src, out, cnt = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cnt"
    spark.range(60).repartition(12).write.json(src)
    keep = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        stream = jobs.file_json_stream(spark, src, "id long", max_files_per_trigger=1)
        jobs.write_counted(stream, lambda b, e: jobs.write_batch(b, out, e), cnt, f"{tmp_path}/ck").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", keep)
    total = jobs.batch_counters(spark, cnt)
    assert total.count() == 12 and total.agg(F.sum("rows")).first()[0] == 60
    jobs.write_batch(spark.read.parquet(f"{out}/batch_id=0"), f"{tmp_path}/again", 0)
    jobs.write_batch(spark.read.parquet(f"{out}/batch_id=0"), f"{tmp_path}/again", 0)
    assert spark.read.parquet(f"{tmp_path}/again").count() == spark.read.parquet(f"{out}/batch_id=0").count()


def test_hot_partition_value_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("v"), F.lit("hot").alias("service"))
    keep = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.append_partitioned_parquet(df.repartition(8), f"{tmp_path}/p", "service")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", keep)
    assert len(glob.glob(f"{tmp_path}/p/service=hot/*.parquet")) > 1
    assert spark.read.parquet(f"{tmp_path}/p").count() == 200_000


def test_ttl_by_group_needs_groups(spark):
    import datetime as dt
    spine = spark.createDataFrame([(1, dt.datetime(2025, 1, 10))], "k long, event_timestamp timestamp")
    feat = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), 5)], "k long, event_timestamp timestamp, f int")
    with pytest.raises(ValueError):
        features.pit_join(spine, feat, ["k"], ttl={"g": dt.timedelta(days=1)})


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))
