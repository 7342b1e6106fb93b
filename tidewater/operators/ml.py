"""Model training and evaluation on Spark: split, scaling, class weights,
exact ROC-AUC, confusion-matrix metrics, random forest, scoring, SMOTE."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import seeded_bucket
from tidewater.operators import forest
from tidewater.operators.common import prefix_sum, spread
from tidewater.session import materialize

# Fixed values of the training job.
SEED = 42
TEST_FRACTION = 0.2
GATE_THRESHOLD = 0.75
FOREST = dict(numTrees=100, maxDepth=10, minInstancesPerNode=5, featureSubsetStrategy="sqrt")
# Node ids are not cached: that would keep several generations of four bytes
# a row and tree on disk, and a row finds its node again by walking the tree
# (the same trees).  The statistics budget is one fixed value on every
# machine: it decides how many nodes share a pass, and with that the order in
# which feature subsets are drawn.
FOREST_EXEC = dict(maxMemoryInMB=512, cacheNodeIds=False)


def feature_columns(df: DataFrame, exclude=("Time", "is_fraud", "transaction_amount")) -> list[str]:
    """Every column except the excluded ones, in frame order."""
    return [c for c in df.columns if c not in set(exclude)]


def stratified_split(df: DataFrame, key_cols: list[str], *, test_fraction: float = TEST_FRACTION,
                     seed: int = SEED, label: str | None = None) -> DataFrame:
    """Add ``split`` = 'train' | 'test' from a seeded hash of the row key.

    The hash is independent of the label and of partitioning, so each
    class is split in the same ratio in expectation, with no shuffle and
    the same answer on every re-run (``rand()`` would change with the
    partition layout).  ``label`` is mixed into the key so classes draw
    independently.
    """
    keys = list(key_cols) + ([label] if label else [])
    b = seeded_bucket(keys, seed, 1000)
    return df.withColumn("split", F.when(b < int(test_fraction * 1000), F.lit("test")).otherwise(F.lit("train")))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std of each column (std 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"{c}__mean"))
        sd = F.stddev_pop(c)
        aggs.append(F.when((sd.isNull()) | (sd == 0), F.lit(1.0)).otherwise(sd).alias(f"{c}__std"))
    return df.agg(*aggs)


def scaler_params(stats: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """The fitted scaler as plain numbers (2 per feature; a model artifact)."""
    row = stats.first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in cols}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class: one aggregate; the totals are windows over its one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    classes = Window.partitionBy()
    total, k = F.sum("n_rows").over(classes), F.count(F.lit(1)).over(classes)
    return counts.select(label, "n_rows", (total / (k * F.col("n_rows"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (one row per class, counted
    once however often the result is read, and broadcast: the rows are not shuffled)."""
    w = materialize(class_weights(df, label).select(label, F.col("weight").alias(out)), "class_weight")
    return df.join(F.broadcast(w), label, "left")


def roc_auc(df: DataFrame, score: str, label: str, group_by: list[str] | None = None,
            num_partitions: int | None = None, count: str | None = None) -> DataFrame:
    """Exact, tie-aware ROC-AUC (per group), never with an unpartitioned window.

    AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2),
    divided by P * N.  Positives and negatives are counted per (group, score)
    with a partial aggregate, so a hot score collapses to one row; the
    negatives below a score are a prefix sum over the range-partitioned
    distinct scores, balanced however crowded they are.  ``count`` names a
    column that says how many rows one stands for.
    """
    g = list(group_by or [])
    y = F.col(label).cast("int")
    n = F.col(count) if count else F.lit(1)
    per_score = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                 .groupBy(*g, F.col(score).cast("double").alias("_s"))
                 .agg(F.sum(y * n).alias("_pos"), F.sum((1 - y) * n).alias("_neg")))
    scored = prefix_sum(per_score, g, "_s", "_neg", "_below", num_partitions=num_partitions)
    agg = scored.groupBy(*g).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))).alias("_u"),
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    return agg.select(*g, "positives", "negatives",
                      F.try_divide(F.col("_u"), F.col("positives").cast("double") * F.col("negatives")).alias("roc_auc"))


def classification_metrics(df: DataFrame, prediction: str, label: str,
                           group_by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """Confusion counts and precision / recall / F1 / accuracy (zero-guarded); ``count`` as in ``roc_auc``."""
    p, y = F.col(prediction).cast("int") == 1, F.col(label).cast("int") == 1
    number = (lambda c: F.coalesce(F.sum(F.when(c, F.col(count))), F.lit(0))) if count else F.count_if
    agg = df.groupBy(*(group_by or [])).agg(
        number(p & y).alias("tp"), number(p & ~y).alias("fp"), number(~p & ~y).alias("tn"), number(~p & y).alias("fn"))
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(
        *(group_by or []), "tp", "fp", "tn", "fn",
        F.coalesce(prec, F.lit(0.0)).alias("precision"),
        F.coalesce(rec, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                   F.lit(0.0)).alias("f1"),
        F.try_divide(F.col("tp") + F.col("tn"),
                     F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))


def train_forest(train: DataFrame, features: list[str], label: str, *, weight_col: str | None = None,
                 seed: int = SEED, save_to: str | None = None, num_partitions: int | None = None,
                 **params) -> PipelineModel:
    """Random forest behind a feature assembler; returns one
    ``PipelineModel`` (features + model together).

    The trees are grown by ``operators.forest`` (Spark ML's method over packed
    blocks) and stored as a Spark ML model.  Settings that it does not know,
    as another impurity, are fitted by Spark ML itself.

    The model is written to ``save_to`` (default: a new folder in
    the shared directory) and the re-loaded copy is returned: it carries no
    training summary, whose session reference cannot be serialised into
    tasks once the session has used observations.
    """
    conf = dict(FOREST)
    conf.update(FOREST_EXEC)
    conf.update(params)
    va = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="_features", labelCol=label, seed=seed,
                                probabilityCol="_probability", rawPredictionCol="_raw",
                                predictionCol="_prediction", **conf)
    if weight_col:
        rf = rf.setWeightCol(weight_col)
    data = spread(train.withColumn(label, F.col(label).cast("double")), num_partitions)
    if not save_to:
        from tidewater.session import scratch_path
        save_to = scratch_path(train.sparkSession, "forest_model")
    if set(conf) <= forest.KNOWN:
        forest.fit(data, features, label, weight_col, va, rf, save_to)
    else:
        data = data.persist(StorageLevel.MEMORY_AND_DISK) if num_partitions else data  # dealt anew: kept, as the forest reads its rows more than once
        try:
            Pipeline(stages=[va, rf]).fit(data).write().overwrite().save(save_to)
        finally:
            if num_partitions:
                data.unpersist()
    return _loaded(train.sparkSession, save_to)


def _loaded(spark: SparkSession, path: str) -> PipelineModel:
    """The stored pipeline, with its trees as arrays for ``score``."""
    model = PipelineModel.load(path)
    model._saved_path = path
    first, last = model.stages[0], model.stages[-1]
    # what scoring by arrays stands for: an assembler that keeps nulls before a forest without thresholds
    if (len(model.stages) == 2 and isinstance(first, VectorAssembler) and first.getHandleInvalid() == "keep"
            and isinstance(last, RandomForestClassificationModel) and last.numClasses > 1 and not last.isDefined("thresholds")):
        model._scorer = forest.read_model(spark, path, first.getInputCols())
    return model


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Model output as plain columns: prediction (int) and class-1 probability
    (hard label when the model has no probabilities).  A stored forest of ours
    is scored by arrays, to the same values; any other model by itself."""
    if getattr(model, "_scorer", None) is not None:
        return forest.scored(model._scorer, df)
    out = model.transform(df)
    prob = (vector_to_array(F.col("_probability"))[1] if "_probability" in out.columns
            else F.col("_prediction"))
    return (out.withColumn("prediction", F.col("_prediction").cast("int"))
            .withColumn("fraud_probability", prob.cast("double"))
            .drop("_features", "_probability", "_raw", "_prediction"))


def save_model(model: PipelineModel, path: str, features: list[str],
               scaler: dict[str, tuple[float, float]] | None, spark: SparkSession) -> None:
    """Persist model, feature list and scaler together under one path."""
    if not _exists_model(model, f"{path}/model"):
        model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"features": features, "scaler": scaler or {}})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _exists_model(model: PipelineModel, path: str) -> bool:
    """True when ``model`` was loaded from ``path`` (nothing to write)."""
    return getattr(model, "_saved_path", None) == path


def load_model(spark: SparkSession, path: str):
    model = _loaded(spark, f"{path}/model")
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return model, meta["features"], {k: tuple(v) for k, v in meta["scaler"].items()}


def gate(metrics: DataFrame, metric: str = "roc_auc", threshold: float = GATE_THRESHOLD) -> DataFrame:
    """'Staging' when the metric reaches the threshold, else 'Rejected'."""
    return metrics.withColumn(
        "decision", F.when(F.col(metric) >= threshold, F.lit("Staging")).otherwise(F.lit("Rejected")))


# ------------------------------------------------------------------ SMOTE

def smote(df: DataFrame, features: str, label: str, key_cols: list[str], *, minority=1, k: int = 5,
          seed: int = SEED, block_rows: int | None = None, lineage: bool = False, stats: dict | None = None) -> DataFrame:
    """Synthetic minority oversampling to class parity (``features`` is an
    ARRAY<DOUBLE> column).

    * Neighbours: the ``k`` nearest other minority rows by Euclidean
      distance, exactly, by ``neighbours.nearest_neighbours``: blocks of rows
      that the triangle inequality rules out are not compared (``stats``
      receives the share; ``block_rows`` steers cost only).
    * Copies: ``need = majority - minority`` synthetic rows; each minority
      row makes ``need // minority`` of them, and the rows with the
      smallest seeded rank make one more (exact parity, repeated rows
      included).  The rank is a
      global running count over a seeded hash order, computed by
      ``prefix_sum`` (no unpartitioned window).
    * Each synthetic row is ``x + u * (nn - x)`` with neighbour index and
      ``u`` in [0, 1) from seeded hashes of (row key, copy number), so the
      result does not depend on partitioning.

    Returns the input rows (``is_synthetic`` false) plus the synthetic rows
    (key ``<row key>#<copy>``), with columns ``_key``, ``features``,
    ``label``, ``is_synthetic``; with ``lineage`` also ``_parent`` and
    ``_neighbour`` (keys, null on input rows).  Keys may repeat; equal rows are each copied,
    but are no neighbours of each other.
    """
    from tidewater.functions import seeded_unit
    from tidewater.operators.neighbours import BLOCK_ROWS, nearest_neighbours

    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    base = df.select(key.alias("_key"), F.col(features).cast("array<double>").alias(features), label)
    is_min = F.col(label) == F.lit(minority)
    counts = base.agg(F.count_if(is_min).alias("n_min"), F.count_if(~is_min).alias("n_maj")).first()
    n_min, n_maj = int(counts["n_min"]), int(counts["n_maj"])
    orig = base.withColumn("is_synthetic", F.lit(False))
    if lineage:
        orig = orig.withColumns({c: F.lit(None).cast("string") for c in ("_parent", "_neighbour")})
    need = n_maj - n_min
    if need <= 0 or n_min < 2:
        return orig
    # equal rows become one with its number of copies; a row is told by key and features, as keys may repeat
    mino = materialize(base.where(is_min).groupBy("_key", features).agg(F.count(F.lit(1)).alias("_m"))
                       .withColumn("_id", F.concat_ws("|", "_key", F.xxhash64(features).cast("string"))), "smote_rows")
    # the neighbour table is read twice below: compute it once
    nn = materialize(nearest_neighbours(mino, k=k, id_col="_id", vec_col=features, block_rows=block_rows or BLOCK_ROWS, stats=stats)
                     .select("_id", F.col("neighbour").alias("_nb"), (F.col("rank") - 1).alias("_j")), "smote_knn")
    # a row's neighbours come to it before its copies are made: what is shuffled follows the minority rows, not the copies
    nbv = mino.select(F.col("_id").alias("_nb"), F.col("_key").alias("_nb_key"), F.col(features).alias("_nv"))
    near = nn.join(nbv, "_nb").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_j", "_nb_key", "_nv"))).alias("_near"))
    per, extra = divmod(need, n_min)
    order = F.conv(F.substring(F.md5(F.concat(F.col("_id"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")
    ranked = prefix_sum(mino.select("_id", order.alias("_o"), "_m"), [], "_o", "_m", "_rank")
    one_more = F.greatest(F.least(F.col("_m"), F.lit(extra) - F.col("_rank")), F.lit(0))
    syn = (ranked.select("_id", (F.lit(per) * F.col("_m") + one_more).alias("_n")).where(F.col("_n") > 0)
           .join(mino.select("_id", "_key", features), "_id").join(near, "_id", "left")
           .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))))
    among = F.greatest(F.coalesce(F.size("_near"), F.lit(1)), F.lit(1))
    chosen = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "_id", F.col("_c").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), among)
    # exploded, as a plain column would be put into the lambda below and be hashed again for every component
    syn = (syn.withColumn("_to", F.get("_near", chosen.cast("int")))
           .withColumn("_u", F.explode(F.array(seeded_unit([F.col("_id"), F.col("_c")], seed + 1)))))
    # a row without another one is copied as it is, so that parity holds
    syn = syn.withColumns({"_nv": F.coalesce("_to._nv", features), "_nb_key": F.col("_to._nb_key")})
    lab_type = df.schema[label].dataType
    synth = syn.select(
        F.concat_ws("#", "_key", F.col("_c").cast("string")).alias("_key"),
        F.zip_with(features, "_nv", lambda x, y: x + F.col("_u") * (y - x)).alias(features),
        F.lit(minority).cast(lab_type).alias(label),
        F.lit(True).alias("is_synthetic"),
        *([F.col("_key").alias("_parent"), F.col("_nb_key").alias("_neighbour")] if lineage else []))
    return orig.unionByName(synth)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in features])))
