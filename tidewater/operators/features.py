"""Feature-store surface: entities, sources, views, services, and the
point-in-time (as-of, backward, inclusive, TTL-bounded) feature join.

The as-of join is a union + window, never a pairwise join:

1.  Spine and feature rows are stacked, range-partitioned on (entity, time)
    and written once.  The bounds are quantiles of the rows, so an entity
    with most rows of one day is cut by time into several partitions of the
    usual size.  Inside (entity, partition) a running ``last(feature,
    ignorenulls)`` ordered by (time, side, created, row) gives every spine row
    the newest feature row at or before it.
2.  Where an entity began on an earlier partition, its first rows take the
    newest feature row from there.  A partition continues at most one
    entity, so that carry is at most one row per partition, and broadcast.
3.  The TTL nulls a feature older than ``spine_ts - ttl``.

The order is total: of feature rows with one time (and creation time) the
greatest row wins, whatever the layout of the input.
Every spine row comes out exactly once (repeated spine rows are all kept);
spine rows with a null key get null features and never match each other.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.common import range_cut

@dataclass(frozen=True)
class Entity:
    name: str
    dtype: str = "bigint"
    join_keys: tuple[str, ...] = ()

    @property
    def keys(self) -> tuple[str, ...]:
        return self.join_keys or (self.name,)

    def check(self, frame: DataFrame, where: str) -> None:
        """Every join key is there, with the declared type; a key of another type would match nothing, or by a cast."""
        for k in self.keys:
            got = frame.schema[k].dataType.simpleString() if k in frame.columns else "missing"
            if got != self.dtype:
                raise TypeError(f"entity {self.name!r}: column {k!r} of the {where} is {got}, declared {self.dtype}")


@dataclass(frozen=True)
class FeatureSource:
    """A Parquet (or other file) table with an event-time column."""
    path: str
    event_timestamp_column: str = "event_timestamp"
    created_timestamp_column: str | None = None
    fmt: str = "parquet"

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.fmt).load(self.path)


@dataclass(frozen=True)
class FeatureView:
    name: str
    entities: tuple[Entity, ...]
    ttl: dt.timedelta | None
    source: FeatureSource
    schema: tuple[tuple[str, str], ...]  # (feature name, Spark SQL type)

    @property
    def features(self) -> list[str]:
        return [n for n, _ in self.schema]

    @property
    def keys(self) -> list[str]:
        return [k for e in self.entities for k in e.keys]

    def select(self, spark: SparkSession, frame: DataFrame | None = None) -> DataFrame:
        """Typed, column-pruned projection of the source (keys, time, features)."""
        src = frame if frame is not None else self.source.read(spark)
        cols = [F.col(k) for k in self.keys]
        cols.append(F.col(self.source.event_timestamp_column))
        if self.source.created_timestamp_column:
            cols.append(F.col(self.source.created_timestamp_column))
        cols += [F.col(n).cast(t).alias(n) for n, t in self.schema]
        return src.select(*cols)


@dataclass(frozen=True)
class FeatureService:
    name: str
    views: tuple[FeatureView, ...] = field(default_factory=tuple)


class Registry:
    """Name -> service lookup; an unknown name raises (no silent empty join)."""

    def __init__(self, services: list[FeatureService]):
        self._by_name = {s.name: s for s in services}

    def get_feature_service(self, name: str) -> FeatureService:
        if name not in self._by_name:
            raise KeyError(f"unknown feature service {name!r}; known: {sorted(self._by_name)}")
        return self._by_name[name]


def pit_join(spine: DataFrame, features: DataFrame, keys: list[str], *,
             spine_ts: str = "event_timestamp", feature_ts: str = "event_timestamp",
             feature_cols: list[str] | None = None,
             ttl: dt.timedelta | dict[str, dt.timedelta | None] | None = None,
             created_ts: str | None = None,
             num_partitions: int | None = None,
             ttl_groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Point-in-time join of ``features`` onto ``spine``.

    For each spine row, the feature row with the same key and the greatest
    ``feature_ts <= spine_ts`` (ties on time: greatest ``created_ts``, then
    the greatest row) is attached; it is nulled if older than ``spine_ts - ttl``.  ``ttl_groups``
    maps a group name to its feature columns and ``ttl`` may then be a dict
    of per-group TTLs (several views over one source in one pass).
    """
    feature_cols = feature_cols or [c for c in features.columns
                                    if c not in set(keys) | {feature_ts, created_ts}]
    spine_cols = spine.columns
    clash = set(feature_cols) & set(spine_cols)
    if clash:
        raise ValueError(f"feature columns clash with spine columns: {sorted(clash)}")
    key_ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fstruct_fields = [F.col(c) for c in feature_cols] + [F.col(feature_ts).cast("timestamp_ntz").alias("_fts")]
    created = F.col(created_ts).cast("timestamp_ntz") if created_ts else F.lit(None).cast("timestamp_ntz")
    feat = features.where(key_ok & F.col(feature_ts).isNotNull()).select(
        *[F.col(k) for k in keys],
        F.col(feature_ts).cast("timestamp_ntz").alias("_ts"),
        F.lit(0).alias("_side"),
        created.alias("_cts"),
        F.struct(*fstruct_fields).alias("_f"))
    spine_key_ok = key_ok & F.col(spine_ts).isNotNull()
    whole = F.struct(*[F.col(c) for c in spine_cols])
    # many spine rows of one entity and time may be cut apart: they are ordered by a hash
    sp = spine.where(spine_key_ok).select(
        *[F.col(k) for k in keys],
        F.col(spine_ts).cast("timestamp_ntz").alias("_ts"),
        F.lit(1).alias("_side"),
        whole.alias("_s"), F.xxhash64(whole).alias("_h"))
    cut = range_cut(feat.unionByName(sp, allowMissingColumns=True), [*keys, "_ts", "_side", "_cts", "_h"], num_partitions)

    # 1. as-of inside (key, partition)
    w = (Window.partitionBy(*keys, "_ps_part")
         .orderBy("_ts", "_side", F.col("_cts").asc_nulls_first(), F.col("_f").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = cut.withColumn("_m", F.last("_f", ignorenulls=True).over(w)).where(F.col("_side") == 1)

    # 2. the first key of a partition may have begun on an earlier one: its newest feature row there
    first = cut.groupBy("_ps_part").agg(F.min(F.struct(*keys)).alias("_k")).select("_ps_part", "_k.*")
    newest = (cut.where(F.col("_side") == 0).join(F.broadcast(first.select(*keys).distinct()), keys, "left_semi")
              .groupBy(*keys, "_ps_part").agg(F.max_by("_f", F.struct("_ts", "_cts", "_f")).alias("_l")))
    both = (first.withColumns({"_l": F.lit(None).cast(newest.schema["_l"].dataType), "_o": F.lit(0)})
            .unionByName(newest.withColumn("_o", F.lit(1))))
    earlier = Window.partitionBy(*keys).orderBy("_ps_part", "_o").rowsBetween(Window.unboundedPreceding, -1)
    carried = (both.withColumn("_c", F.last("_l", ignorenulls=True).over(earlier))
               .where((F.col("_o") == 0) & F.col("_c").isNotNull()).select(*keys, "_ps_part", "_c"))
    joined = inside.join(F.broadcast(carried), [*keys, "_ps_part"], "left")
    m = F.coalesce(F.col("_m"), F.col("_c"))

    # 3. TTL
    def within(t: dt.timedelta | None) -> Column:
        if t is None:
            return F.lit(True)
        secs = t.seconds + t.microseconds / 1e6
        lower = F.col("_ts") - F.make_dt_interval(F.lit(t.days), F.lit(0), F.lit(0), F.lit(secs))
        return m.getField("_fts") >= lower

    if isinstance(ttl, dict) and not ttl_groups:
        raise ValueError("ttl by group needs ttl_groups")
    if ttl_groups:
        ttl_map = ttl if isinstance(ttl, dict) else {g: ttl for g in ttl_groups}
        fcols = []
        for g, cols in ttl_groups.items():
            ok = within(ttl_map.get(g))
            fcols += [F.when(ok, m.getField(c)).alias(c) for c in cols]
    else:
        ok = within(ttl)
        fcols = [F.when(ok, m.getField(c)).alias(c) for c in feature_cols]
    matched = joined.select(*[F.col(f"_s.{c}").alias(c) for c in spine_cols], *fcols)

    # spine rows with a null key or time: kept, no features
    ftypes = {c: features.schema[c].dataType for c in feature_cols}
    unmatched = spine.where(~spine_key_ok).select(
        *[F.col(c) for c in spine_cols], *[F.lit(None).cast(ftypes[c]).alias(c) for c in feature_cols])
    return matched.unionByName(unmatched)


def get_historical_features(spark: SparkSession, spine: DataFrame, service: FeatureService, *,
                            spine_ts: str = "event_timestamp",
                            frames: dict[str, DataFrame] | None = None,
                            full_feature_names: bool = False,
                            num_partitions: int | None = None) -> DataFrame:
    """Attach every view of ``service`` to ``spine`` (row count preserved).

    Views that share a source (same path and time columns) are fused into
    one as-of pass with per-view TTLs; other views are chained.  On a name
    clash, or with ``full_feature_names``, columns are named ``view__feature``.
    """
    names = [f for v in service.views for f in v.features]
    clash = full_feature_names or len(names) != len(set(names))
    groups: dict[tuple, list[FeatureView]] = {}
    for v in service.views:
        groups.setdefault((v.source, tuple(v.keys)), []).append(v)
    out = spine
    for (src, keys), views in groups.items():
        base = (frames or {}).get(src.path)
        raw = base if base is not None else src.read(spark)
        for e in {e for v in views for e in v.entities}:
            e.check(spine, "spine")
            e.check(raw, f"source {src.path}")
        cols = [F.col(k) for k in keys] + [F.col(src.event_timestamp_column)]
        if src.created_timestamp_column:
            cols.append(F.col(src.created_timestamp_column))
        ttl_groups, ttls, seen = {}, {}, set()
        for v in views:
            outnames = []
            for n, t in v.schema:
                on = f"{v.name}__{n}" if clash else n
                if on not in seen:
                    cols.append(F.col(n).cast(t).alias(on))
                    seen.add(on)
                outnames.append(on)
            ttl_groups[v.name] = outnames
            ttls[v.name] = v.ttl
        out = pit_join(out, raw.select(*cols), list(keys), spine_ts=spine_ts,
                       feature_ts=src.event_timestamp_column,
                       created_ts=src.created_timestamp_column,
                       ttl=ttls, ttl_groups=ttl_groups, num_partitions=num_partitions)
    return out


def latest_features(features: DataFrame, keys: list[str], ts: str,
                    created_ts: str | None = None) -> DataFrame:
    """Newest row per entity (the online view).

    ``max_by`` over a struct: a hash aggregate with a map-side partial step,
    no sort and no per-key buffering, so a hot entity costs one partial row
    per task.  Ties go to the greatest row.
    """
    cols = features.columns
    order = F.struct(*[F.col(c) for c in dict.fromkeys([ts, *([created_ts] if created_ts else []), *cols])])
    return (features.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
            .groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r"))
            .select("_r.*"))
