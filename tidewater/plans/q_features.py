"""Point-in-time feature queries."""

from __future__ import annotations

import datetime as dt

from tidewater.operators import features as FS
from tidewater.plans import views as V
from tidewater.plans.oracles import with_views
from tidewater.plans.registry import query

TTL = dt.timedelta(days=3)
FEATURES = ["last_view_value", "view_score", "view_event_id"]

PIT_SQL = """
SELECT s.user_id, s.event_timestamp, s.spine_event, s.label_is_churn,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 3 DAY THEN f.last_view_value END AS last_view_value,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 3 DAY THEN f.view_score END AS view_score,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 3 DAY THEN f.view_event_id END AS view_event_id
FROM spine_v s ASOF LEFT JOIN {feat} f
  ON s.user_id = f.user_id AND s.event_timestamp >= f.event_timestamp
"""


@query("pit_join", with_views(PIT_SQL.format(feat="feat_v"), "spine_v", "feat_v"))
def q_pit_join(spark, sf):
    return FS.pit_join(V.spine_v(spark, sf), V.feat_v(spark, sf), ["user_id"],
                       spine_ts="event_timestamp", feature_ts="event_timestamp",
                       feature_cols=FEATURES, ttl=TTL)


@query("pit_join_created", with_views(PIT_SQL.format(
    feat="(SELECT * FROM feat_created_v QUALIFY row_number() OVER "
         "(PARTITION BY user_id, event_timestamp ORDER BY created_timestamp DESC) = 1)"),
    "spine_v", "feat_v", "feat_created_v"))
def q_pit_join_created(spark, sf):
    return FS.pit_join(V.spine_v(spark, sf), V.feat_created_v(spark, sf), ["user_id"],
                       spine_ts="event_timestamp", feature_ts="event_timestamp",
                       created_ts="created_timestamp", feature_cols=FEATURES, ttl=TTL)


USER = FS.Entity("user_id", "bigint")
VIEW_SOURCE = FS.FeatureSource("feat_v", "event_timestamp")
ACTIVITY = FS.FeatureView("user_activity", (USER,), dt.timedelta(days=1), VIEW_SOURCE,
                          (("last_view_value", "double"), ("view_score", "bigint")))
PROFILE = FS.FeatureView("user_profile", (USER,), dt.timedelta(days=3), VIEW_SOURCE,
                         (("view_event_id", "bigint"),))
SERVICE = FS.FeatureService("user_service", (ACTIVITY, PROFILE))
REGISTRY = FS.Registry([SERVICE])


@query("feature_service", with_views("""
SELECT s.user_id, s.event_timestamp, s.spine_event, s.label_is_churn,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 1 DAY THEN f.last_view_value END AS last_view_value,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 1 DAY THEN CAST(f.view_score AS BIGINT) END AS view_score,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 3 DAY THEN f.view_event_id END AS view_event_id
FROM spine_v s ASOF LEFT JOIN feat_v f
  ON s.user_id = f.user_id AND s.event_timestamp >= f.event_timestamp
""", "spine_v", "feat_v"))
def q_feature_service(spark, sf):
    svc = REGISTRY.get_feature_service("user_service")
    return FS.get_historical_features(spark, V.spine_v(spark, sf), svc,
                                      frames={"feat_v": V.feat_v(spark, sf)})


CREATED_SOURCE = FS.FeatureSource("feat_created_v", "event_timestamp", "created_timestamp")
RECENT = FS.FeatureView("user_recent", (USER,), dt.timedelta(days=3), CREATED_SOURCE, (("view_event_id", "bigint"),))


@query("feature_service_two_sources", with_views("""
SELECT s.user_id, s.event_timestamp, s.spine_event, s.label_is_churn,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 1 DAY THEN f.last_view_value END AS last_view_value,
       CASE WHEN f.event_timestamp >= s.event_timestamp - INTERVAL 1 DAY THEN CAST(f.view_score AS BIGINT) END AS view_score,
       CASE WHEN c.event_timestamp >= s.event_timestamp - INTERVAL 3 DAY THEN c.view_event_id END AS view_event_id
FROM spine_v s ASOF LEFT JOIN feat_v f
  ON s.user_id = f.user_id AND s.event_timestamp >= f.event_timestamp
ASOF LEFT JOIN (SELECT * FROM feat_created_v QUALIFY row_number() OVER
                (PARTITION BY user_id, event_timestamp ORDER BY created_timestamp DESC) = 1) c
  ON s.user_id = c.user_id AND s.event_timestamp >= c.event_timestamp
""", "spine_v", "feat_v", "feat_created_v"))
def q_feature_service_two_sources(spark, sf):
    """Views of two sources, one with creation times, chained onto one spine."""
    return FS.get_historical_features(spark, V.spine_v(spark, sf), FS.FeatureService("two_sources", (ACTIVITY, RECENT)),
                                      frames={"feat_v": V.feat_v(spark, sf), "feat_created_v": V.feat_created_v(spark, sf)})


@query("feature_view_select", with_views(
    "SELECT user_id, event_timestamp, last_view_value, CAST(view_score AS BIGINT) AS view_score FROM feat_v",
    "feat_v"))
def q_feature_view_select(spark, sf):
    return ACTIVITY.select(spark, V.feat_v(spark, sf))


@query("latest_features", with_views(
    "SELECT * FROM feat_v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1",
    "feat_v"))
def q_latest_features(spark, sf):
    return FS.latest_features(V.feat_v(spark, sf), ["user_id"], "event_timestamp")


@query("src_feature_parquet", with_views("SELECT * FROM feat_v", "feat_v"))
def q_src_feature_parquet(spark, sf):
    """Write the feature rows as a Parquet source and read them through a
    ``FeatureSource`` (the offline store of the feature views)."""
    from tidewater.session import scratch_path
    path = scratch_path(spark, "feature_source")
    V.feat_v(spark, sf).write.parquet(path)
    return FS.FeatureSource(path, "event_timestamp").read(spark)

