"""Dashboard measures as Spark aggregates: KPIs, trends, histograms, shares,
distribution drift, alerts and the fact -> dimension star joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import strip_version_prefix
from tidewater.session import materialize

# Alert threshold of the live-alert table, drift floor.
ALERT_THRESHOLD = 0.85
DRIFT_EPSILON = 1e-6


def kpi_summary(scores: DataFrame, *, fraud_col: str = "is_fraud",
                prob_col: str = "fraud_probability", version_col: str = "model_version") -> DataFrame:
    """Total, fraud count, fraud rate (null on no rows), mean confidence,
    distinct model versions — one aggregate, one pass."""
    return scores.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col(fraud_col)).alias("fraud_count"),
        F.try_divide(F.count_if(F.col(fraud_col)), F.count(F.lit(1))).alias("fraud_rate"),
        F.avg(prob_col).alias("avg_confidence"),
        F.sort_array(F.collect_set(F.col(version_col).cast("string"))).alias("model_versions"),
    )


def kpi_by(scores: DataFrame, by: str, *, fraud_col: str = "is_fraud",
           amount_col: str = "amount") -> DataFrame:
    """Totals and fraud counts per ``by`` value (map visual)."""
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col(fraud_col)).alias("fraud_count"),
        F.try_divide(F.count_if(F.col(fraud_col)), F.count(F.lit(1))).alias("fraud_rate"),
        F.sum(amount_col).alias("total_amount"),
    )


def time_trend(df: DataFrame, ts_col: str, every: str = "1 hour",
               metrics: dict[str, Column] | None = None) -> DataFrame:
    """Tumbling-window aggregates over a timestamp column."""
    metrics = metrics or {"total_transactions": F.count(F.lit(1))}
    return (df.groupBy(F.window(ts_col, every).alias("w"))
            .agg(*[v.alias(k) for k, v in metrics.items()])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *metrics.keys()))


def volume_trend(scores: DataFrame, ts_col: str = "scored_at", every: str = "1 hour") -> DataFrame:
    return time_trend(scores, ts_col, every)


def confidence_trend(scores: DataFrame, ts_col: str = "scored_at", every: str = "1 day",
                     prob_col: str = "fraud_probability") -> DataFrame:
    return time_trend(scores, ts_col, every, {"total_transactions": F.count(F.lit(1)),
                                              "avg_confidence": F.avg(prob_col)})


def _total(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery (computed once)."""
    return df.agg(F.count(F.lit(1))).scalar()


def histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    """Fixed-width bins: bin number, lower edge, rows, share of all rows."""
    b = F.floor(F.col(col) / F.lit(width)).cast("long")
    h = (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin"))
         .agg(F.count(F.lit(1)).alias("n_rows")))
    total = _total(df.where(F.col(col).isNotNull()))
    return h.select("bin", (F.col("bin") * F.lit(width)).alias("bin_lo"), "n_rows",
                    (F.col("n_rows") / total).alias("share"))


def share_by(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of all rows per category (pie)."""
    total = _total(df)
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
            .select(col, "n_rows", (F.col("n_rows") / total).alias("share")))


def binned_by_reference(reference: DataFrame, live: DataFrame, col: str, n_bins: int = 10
                        ) -> tuple[DataFrame, DataFrame]:
    """Equal-width bins whose edges come from the reference side only.

    The reference range is one aggregate (a single scalar subquery holding
    min and max); live values outside it fall into the first/last bin.
    """
    rng = reference.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("r")).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    w = F.when(hi > lo, (hi - lo) / F.lit(n_bins)).otherwise(F.lit(1.0))

    def binned(df):
        raw = F.floor((F.col(col) - lo) / w)
        b = F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1)).cast("int")
        return df.where(F.col(col).isNotNull()).select(b.alias("bin"))

    return binned(reference), binned(live)


def compare_distributions(reference: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Side-by-side category/bin shares (missing = 0; null is one category).

    Both sides are counted in one aggregate over their union, which is
    written (a row per category); the totals are two scalar subqueries over
    those counts.
    """
    both = materialize(reference.select(key, F.lit(1).alias("_r")).unionByName(live.select(key, F.lit(0).alias("_r")))
                       .groupBy(key).agg(F.count_if(F.col("_r") == 1).alias("ref_rows"), F.count_if(F.col("_r") == 0).alias("live_rows")),
                       "distributions")
    share = lambda n: F.coalesce(F.try_divide(F.col(n), both.agg(F.sum(n)).scalar()), F.lit(0.0))
    return both.select(key, "ref_rows", "live_rows", share("ref_rows").alias("ref_share"), share("live_rows").alias("live_share"))


def drift_numeric(reference: DataFrame, live: DataFrame, col: str, n_bins: int = 10) -> DataFrame:
    rb, lb = binned_by_reference(reference, live, col, n_bins)
    return compare_distributions(rb, lb, "bin")


def drift_categorical(reference: DataFrame, live: DataFrame, col: str) -> DataFrame:
    return compare_distributions(reference.select(col), live.select(col), col)


def psi(compared: DataFrame, eps: float = DRIFT_EPSILON) -> DataFrame:
    """Population stability index over a ``compare_distributions`` result:
    sum((live - ref) * ln(live / ref)) with both shares floored at ``eps``."""
    p = F.greatest(F.col("live_share"), F.lit(eps))
    q = F.greatest(F.col("ref_share"), F.lit(eps))
    return compared.agg(F.sum((p - q) * F.log(p / q)).alias("psi"),
                        F.count(F.lit(1)).alias("n_bins"))


def alerts(scores: DataFrame, threshold: float = ALERT_THRESHOLD, *,
           prob_col: str = "fraud_probability", id_col: str = "transaction_id",
           top: int | None = None) -> DataFrame:
    """Rows at or above the threshold, most confident first (id breaks ties)."""
    out = scores.where(F.col(prob_col) >= threshold).orderBy(F.desc(prob_col), F.asc(id_col))
    return out.limit(top) if top else out


def join_model_dimension(scores: DataFrame, dim_model: DataFrame, *,
                         fact_version: str = "model_version", dim_version: str = "version",
                         on: list[str] | None = None) -> DataFrame:
    """Fact rows with their model's attributes (many-to-one, left).

    Versions are compared after dropping a leading ``v`` ('v2' = 2); ``on``
    adds further equal keys (e.g. the model name).  Spark chooses the join
    from measured sizes (a small dimension is broadcast at run time).
    """
    keys = list(on or []) + ["_vkey"]
    d = dim_model.withColumn("_vkey", strip_version_prefix(F.col(dim_version)))
    f = scores.withColumn("_vkey", strip_version_prefix(F.col(fact_version)))
    if dim_version in scores.columns:
        d = d.withColumnRenamed(dim_version, f"dim_{dim_version}")
    return f.join(d, keys, "left").drop("_vkey")


def preview(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Deterministic first-n preview (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(n)
