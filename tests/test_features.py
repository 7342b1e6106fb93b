import datetime as dt
import random

import pytest

from tidewater import session
from tidewater.operators import features as FS

T0 = dt.datetime(2025, 11, 20, 12, 0, 0)
SPINE = "user_id long, event_timestamp timestamp_ntz, label_is_churn int"
FEAT = "user_id long, event_timestamp timestamp_ntz, created timestamp_ntz, total_logins long"


def _run(spark, spine, feats, ttl, **kw):
    s = spark.createDataFrame(spine, SPINE)
    f = spark.createDataFrame(feats, FEAT)
    out = FS.pit_join(s, f, ["user_id"], feature_cols=["total_logins"], ttl=ttl, created_ts="created", **kw)
    return sorted(((r.user_id, r.event_timestamp, r.total_logins) for r in out.collect()),
                  key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_pit_edge_rows(spark):
    ttl = dt.timedelta(days=1)
    us = dt.timedelta(microseconds=1)
    feats = [
        (1, T0, T0, 10),                                   # exactly at spine time -> matches
        (2, T0 - ttl, T0, 20),                             # exactly TTL old -> matches
        (3, T0 - ttl - us, T0, 30),                        # one microsecond too old -> null
        (4, T0 + us, T0, 40),                              # only a future row -> null
        (6, T0 - dt.timedelta(hours=1), T0, 60),           # two creation times for one event time:
        (6, T0 - dt.timedelta(hours=1), T0 + us, 61),      # the later creation wins
        (None, T0, T0, 99),                                # null key never matches
    ]
    spine = [(1, T0, 0), (2, T0, 0), (3, T0, 0), (4, T0, 0), (5, T0, 0), (6, T0, 1), (6, T0, 1), (None, T0, 0)]
    got = _run(spark, spine, feats, ttl)
    assert got == [(1, T0, 10), (2, T0, 20), (3, T0, None), (4, T0, None), (5, T0, None),
                   (6, T0, 61), (6, T0, 61), (None, T0, None)]


def _brute(spine, feats, ttl):
    out = []
    for (u, t, _lab) in spine:
        cands = [f for f in feats if f[0] == u and u is not None and f[1] <= t]
        if not cands:
            out.append((u, t, None))
            continue
        best = max(cands, key=lambda f: (f[1], f[2]))
        out.append((u, t, best[3] if ttl is None or best[1] >= t - ttl else None))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


@pytest.mark.parametrize("num_partitions", [1, 5, 40])
def test_pit_matches_brute_force(spark, num_partitions):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    feats, spine, seen = [], [], set()
    for i in range(400):
        u = rnd.choice([1, 1, 1, 2, 3, 4, None])  # user 1 is hot
        t = base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 6))
        if (u, t) in seen:
            continue
        seen.add((u, t))
        feats.append((u, t, t + dt.timedelta(seconds=rnd.randrange(0, 5)), i))
    for i in range(300):
        u = rnd.choice([1, 1, 2, 3, 5, None])
        spine.append((u, base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 7)), 0))
    ttl = dt.timedelta(hours=30)
    assert _run(spark, spine, feats, ttl, num_partitions=num_partitions) == _brute(spine, feats, ttl)
    assert _run(spark, spine, feats, None, num_partitions=num_partitions) == _brute(spine, feats, None)


def test_hot_entity_of_one_day_is_spread(spark):
    """An entity with a third of all rows, all of one day: no partition holds over twice its share, and the join stays right."""
    rnd = random.Random(12)
    day = dt.datetime(2024, 1, 1)
    at = lambda: day + dt.timedelta(microseconds=rnd.randrange(86_400_000_000))
    feats = [(7 if i % 3 == 0 else i, at(), day, i) for i in range(3000)]
    spine = [(7 if i % 3 == 0 else i, at(), 0) for i in range(3000)]
    seen = []
    session.stage_observers.append(lambda name, df: seen.append(df))
    try:
        got = _run(spark, spine, feats, None, num_partitions=12)
    finally:
        session.stage_observers.pop()
    sizes = [r["count"] for r in seen[0].groupBy("_ps_part").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 6000 / 12
    assert len({r["_ps_part"] for r in seen[0].where("user_id = 7").select("_ps_part").collect()}) >= 4
    assert got == _brute(spine, feats, None)


def test_ties_do_not_follow_row_order(spark):
    """Feature rows of one time: the greatest row, under any layout; repeated spine rows all keep it."""
    feats = [(1, T0, None, n) for n in (5, 9, 1)] + [(2, T0, T0, n) for n in (3, 4)] + [(2, T0, None, 8)]
    spine = [(1, T0, 0)] * 40 + [(2, T0, 0)]
    for parts in (1, 4, 7):
        s = spark.createDataFrame(spine, SPINE).repartition(parts)
        f = spark.createDataFrame(feats, FEAT).repartition(parts)
        out = FS.pit_join(s, f, ["user_id"], feature_cols=["total_logins"], created_ts="created", num_partitions=parts).collect()
        assert sorted((r.user_id, r.total_logins) for r in out) == [(1, 9)] * 40 + [(2, 4)]
        latest = {r.user_id: r.total_logins for r in FS.latest_features(f, ["user_id"], "event_timestamp").collect()}
        assert latest == {1: 9, 2: 4}


def test_entity_type_is_checked(spark):
    v = FS.FeatureView("v", (FS.Entity("user_id"),), None, FS.FeatureSource("mem", "event_timestamp"), (("total_logins", "bigint"),))
    f, s = spark.createDataFrame([(1, T0, T0, 5)], FEAT), spark.createDataFrame([(1, T0, 1)], SPINE)
    for bad in ({"spine": s.withColumn("user_id", s.user_id.cast("string")), "f": f}, {"spine": s, "f": f.drop("user_id")}):
        with pytest.raises(TypeError, match="declared bigint"):
            FS.get_historical_features(spark, bad["spine"], FS.FeatureService("s", (v,)), frames={"mem": bad["f"]})


def test_pit_result_independent_of_shuffle_partitions(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    feats = [(rnd.randrange(5), base + dt.timedelta(minutes=i * 7), base, i) for i in range(200)]
    spine = [(rnd.randrange(6), base + dt.timedelta(minutes=rnd.randrange(1500)), 0) for _ in range(100)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _run(spark, spine, feats, dt.timedelta(hours=2))
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = _run(spark, spine, feats, dt.timedelta(hours=2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_feature_service_and_registry(spark):
    user = FS.Entity("user_id")
    src = FS.FeatureSource("mem", "event_timestamp")
    v1 = FS.FeatureView("a", (user,), dt.timedelta(hours=1), src, (("total_logins", "bigint"),))
    v2 = FS.FeatureView("b", (user,), dt.timedelta(days=3), src, (("total_logins", "bigint"),))
    reg = FS.Registry([FS.FeatureService("svc", (v1, v2))])
    with pytest.raises(KeyError):
        reg.get_feature_service("user_feature_service")
    f = spark.createDataFrame([(1, T0 - dt.timedelta(hours=2), T0, 5)], FEAT)
    s = spark.createDataFrame([(1, T0, 1), (9, T0, 0)], SPINE)
    out = FS.get_historical_features(spark, s, reg.get_feature_service("svc"), frames={"mem": f})
    rows = sorted(out.collect(), key=lambda r: r.user_id)
    assert out.columns[-2:] == ["a__total_logins", "b__total_logins"]  # clash -> view-qualified names
    assert (rows[0]["a__total_logins"], rows[0]["b__total_logins"]) == (None, 5)
    assert (rows[1]["a__total_logins"], rows[1]["b__total_logins"]) == (None, None)


def test_latest_features(spark):
    f = spark.createDataFrame([(1, T0, T0, 1), (1, T0 + dt.timedelta(hours=1), T0, 2), (2, T0, T0, 3)], FEAT)
    got = {r.user_id: r.total_logins for r in FS.latest_features(f, ["user_id"], "event_timestamp").collect()}
    assert got == {1: 2, 2: 3}


def test_feature_view_select_types(spark):
    src = FS.FeatureSource("x", "event_timestamp")
    v = FS.FeatureView("v", (FS.Entity("user_id"),), None, src, (("total_logins", "double"),))
    f = spark.createDataFrame([(1, T0, T0, 5)], FEAT)
    out = v.select(spark, f)
    assert out.columns == ["user_id", "event_timestamp", "total_logins"]
    assert dict(out.dtypes)["total_logins"] == "double"
