"""Model registry as a table: register, gate, stage transitions, latest /
current versions, metric pivots and version-to-version trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators.common import last_complete
from tidewater.operators.ml import GATE_THRESHOLD

# Stage names.
STAGES = ("None", "Staging", "Production", "Archived")


def latest_by_stage(registry: DataFrame) -> DataFrame:
    """Highest version per (model, stage) — ``max_by``, no sort."""
    cols = registry.columns
    return (registry.groupBy("model_name", "current_stage")
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("version")).alias("_r"))
            .select("_r.*"))


def current_version(registry: DataFrame, stage: str = "Production") -> DataFrame:
    """(model_name, current_version) of the newest version in ``stage``."""
    return (registry.where(F.col("current_stage") == stage)
            .groupBy("model_name").agg(F.max("version").alias("current_version")))


def save_registry(registry: DataFrame, path: str) -> None:
    """Write the registry as the next revision; readers take the newest complete one."""
    n = _revision(registry.sparkSession, path)
    registry.write.mode("overwrite").parquet(f"{path}/revision={n + 1:010d}")  # replaces a write that broke off


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The newest revision of the registry stored at ``path``."""
    return spark.read.parquet(f"{path}/revision={_revision(spark, path):010d}")


def _revision(spark: SparkSession, path: str) -> int:
    last = last_complete(spark, path, "revision=")
    return int(last.split("=")[1]) if last else -1


def register(registry: DataFrame, candidates: DataFrame, *, metric: str = "roc_auc",
             threshold: float = GATE_THRESHOLD) -> DataFrame:
    """Append gated candidates as new versions (version = max + 1, in order
    of creation time), then archive older versions in the same stage.

    ``candidates``: (model_name, run_id, creation_time, <metric>).  Rejected
    candidates are not registered.  Returns the whole new registry.
    """
    passed = candidates.where(F.col(metric) >= threshold)
    top = registry.groupBy("model_name").agg(F.max("version").alias("_max"))
    w = Window.partitionBy("model_name").orderBy("creation_time", "run_id")
    new = (passed.join(top, "model_name", "left")
           .select("model_name",
                   (F.coalesce(F.col("_max"), F.lit(0)) + F.row_number().over(w)).cast("int").alias("version"),
                   F.lit("Staging").alias("current_stage"),
                   F.col("creation_time").cast("long").alias("creation_time"),
                   F.col("creation_time").cast("long").alias("last_updated_time"),
                   "run_id", F.lit("READY").alias("status")))
    allv = registry.select(*new.columns).unionByName(new)
    # only the newest Staging version per model stays in Staging
    newest = F.max(F.when(F.col("current_stage") == "Staging", F.col("version"))).over(
        Window.partitionBy("model_name"))
    return allv.withColumn("current_stage", F.when(
        (F.col("current_stage") == "Staging") & (F.col("version") < newest), F.lit("Archived"))
        .otherwise(F.col("current_stage")))


def transition(registry: DataFrame, model_name: str, version: int, stage: str, *,
               archive_existing: bool = True, at_ms: int | None = None) -> DataFrame:
    """Move (model, version) to ``stage``; other versions of that model in
    the same stage become 'Archived' when ``archive_existing``."""
    target = (F.col("model_name") == model_name) & (F.col("version") == version)
    same_stage = (F.col("model_name") == model_name) & (F.col("current_stage") == stage) & ~target
    new_stage = F.when(target, F.lit(stage))
    if archive_existing:
        new_stage = new_stage.when(same_stage, F.lit("Archived"))
    new_stage = new_stage.otherwise(F.col("current_stage"))
    changed = target | (same_stage if archive_existing else F.lit(False))
    upd = F.when(changed, F.lit(at_ms) if at_ms is not None else F.col("last_updated_time")) \
           .otherwise(F.col("last_updated_time"))
    return registry.withColumns({"current_stage": new_stage, "last_updated_time": upd.cast("long")})


def pivot_metrics(metrics_long: DataFrame, names: list[str]) -> DataFrame:
    """EAV (run_id, metric_name, metric_value) -> one column per metric.

    The metric names are given, so Spark skips the distinct pass it would
    otherwise run to discover pivot values.
    """
    return metrics_long.groupBy("run_id").pivot("metric_name", names).agg(F.first("metric_value"))


def metric_history(registry: DataFrame, metrics_long: DataFrame, names: list[str]) -> DataFrame:
    """Registry versions joined with their run's metrics (left: versions
    without metrics stay)."""
    return registry.join(pivot_metrics(metrics_long, names), "run_id", "left")


def metric_trend(history: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Per model, ordered by version: the metric, its previous value and the
    change.  The window is per model (a handful of versions each)."""
    w = Window.partitionBy("model_name").orderBy("version")
    return history.select("model_name", "version", F.col(metric),
                          F.lag(metric).over(w).alias(f"prev_{metric}"),
                          (F.col(metric) - F.lag(metric).over(w)).alias(f"delta_{metric}"))


# ---------------------------------------------------------------- run record

RUN_PARTS = ("params", "metrics", "signature")


def record_run(path: str, run_id: str, *, params: dict, metrics: DataFrame, signature: StructType, start_time: int,
               end_time: int, experiment_id: int = 1, status: str = "FINISHED") -> None:
    """Keep a training run below ``path``: parameters (name, value as text),
    metrics in the long extract layout, and the input signature (column,
    type, position).

    ``metrics`` is one row of numeric columns.  Each part is stored under
    ``run_id=``, replacing an earlier record of the same run.
    """
    spark = metrics.sparkSession
    parts = {
        "params": spark.createDataFrame([(k, str(v)) for k, v in sorted(params.items())], "param_name string, param_value string"),
        "metrics": (metrics.select(*[F.col(c).cast("double") for c in metrics.columns])
                    .unpivot([], metrics.columns, "metric_name", "metric_value")
                    .select(F.lit(experiment_id).alias("experiment_id"), F.lit(start_time).cast("long").alias("start_time"),
                            F.lit(end_time).cast("long").alias("end_time"), F.lit(status).alias("status"),
                            "metric_name", "metric_value")),
        "signature": spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(signature)],
                                           "position int, column_name string, column_type string"),
    }
    for part in RUN_PARTS:
        parts[part].write.mode("overwrite").parquet(f"{path}/{part}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part (``params``, ``metrics`` or ``signature``) of every recorded run."""
    if part not in RUN_PARTS:
        raise ValueError(f"unknown part {part}")
    return spark.read.parquet(f"{path}/{part}").withColumn("run_id", F.col("run_id").cast("string"))
