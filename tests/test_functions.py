import uuid

from pyspark.sql import functions as F

from tidewater.functions import (anon_ipv4, cosine_similarity, epoch_ms_to_ts, hour_of_day_from_offset,
                                 day_of_week_from_offset, iso_to_ts, normalize_vector, redact, seeded_bucket,
                                 strip_version_prefix, uuid5)


def test_epoch_ms_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-1500,), (1500,), (None,), (1704067207999,)], "ms long")
    got = [r[0] for r in df.select(F.unix_seconds(epoch_ms_to_ts("ms"))).collect()]
    assert got == [-1, 1, None, 1704067207]


def test_anon_ipv4_unanchored(spark):
    rows = [("192.168.1.100",), ("2001:db8::1",), ("1.2.3.4.5.6.7.8",), ("",), (None,)]
    df = spark.createDataFrame(rows, "ip string")
    got = [r[0] for r in df.select(anon_ipv4("ip")).collect()]
    assert got == ["192.168.1.XXX", "2001:db8::1", "1.2.3.XXX.5.6.7.XXX", "", None]


def test_redact_lines(spark):
    df = spark.createDataFrame([(None,), ("",), ("alice",), ("a\nb",)], "u string")
    got = [r[0] for r in df.select(redact("u")).collect()]
    assert got == [None, "", "REDACTED", "REDACTED\nREDACTED"]


def test_iso_to_ts_bad_text_is_null(spark):
    df = spark.createDataFrame([("2024-01-01T00:07:00",), ("not-a-time",), (None,)], "t string")
    got = [r[0] for r in df.select(iso_to_ts("t").isNull()).collect()]
    assert got == [False, True, True]


def test_uuid5_equals_python(spark):
    names = ["src0: 0", "doc.pdf: 17", "été: 3", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(uuid5("n")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_seeded_bucket_independent_of_partitioning(spark):
    df = spark.range(0, 2000).withColumn("b", seeded_bucket("id", 42, 1000))
    a = {r.id: r.b for r in df.collect()}
    b = {r.id: r.b for r in df.repartition(7).collect()}
    assert a == b
    assert all(0 <= v < 1000 for v in a.values())
    assert 340 < sum(1 for v in a.values() if v < 200) < 460  # 20 % of 2000 rows


def test_time_parts_floor(spark):
    df = spark.createDataFrame([(0.0,), (3599.0,), (3600.0,), (86400.0 * 6 + 7200,), (-1.0,)], "t double")
    got = [(r[0], r[1]) for r in df.select(hour_of_day_from_offset("t"), day_of_week_from_offset("t")).collect()]
    assert got == [(0, 0), (0, 0), (1, 0), (2, 6), (23, 6)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(normalize_vector("a").alias("n"), cosine_similarity("a", "b").alias("c")).collect()
    assert r[0].n == [0.6, 0.8] and abs(r[0].c - 0.96) < 1e-12
    assert r[1].n is None and r[1].c is None


def test_strip_version_prefix(spark):
    df = spark.createDataFrame([("v2",), ("2",), ("V10",)], "v string")
    assert [r[0] for r in df.select(strip_version_prefix("v")).collect()] == ["2", "2", "10"]


def test_scratch_folders_have_an_owner(spark, monkeypatch):
    from tidewater import session
    monkeypatch.setattr(session, "_scratch", [])
    kept = session.scratch_path(spark, "kept")
    session._scratch.clear()  # another process's
    spark.range(3).write.parquet(kept)
    mine = session.materialize(spark.range(5), "mine")
    assert mine.count() == 5 and session.remove_scratch(spark) == 1 and session.remove_scratch(spark) == 0
    assert spark.read.parquet(kept).count() == 3
    import pytest
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(mine.inputFiles()[0]).count()
