"""Training-set preparation, scaling, class weights, forest training and
batch scoring on the transaction view."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tidewater.operators import curation, ml, registry
from tidewater.operators.neighbours import nearest_neighbours
from tidewater.plans import views as V
from tidewater.plans.oracles import with_views
from tidewater.plans.registry import query
from tidewater.session import interim, materialize, scratch_path

SCALED = ["V1", "V2", "V3", "V4"]
SPLIT_EXPR = ("CASE WHEN ('0x' || substr(md5(CAST(id AS VARCHAR) || '|' || CAST(\"Class\" AS VARCHAR) || ':42'), 1, 8))"
              "::UBIGINT % 1000 < 200 THEN 'test' ELSE 'train' END")
SPLIT_SQL = f'SELECT id, "Class", {SPLIT_EXPR} AS split FROM tx_v'


def split_tx(spark, sf):
    return ml.stratified_split(V.tx_v(spark, sf), ["id"], label="Class")


@query("split_stratified", with_views(SPLIT_SQL, "tx_v"))
def q_split_stratified(spark, sf):
    return split_tx(spark, sf).select("id", "Class", "split")


def _std_sql(c):
    return f"CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END"


STATS_SQL = ("SELECT " + ", ".join(f"avg({c}) AS {c}__mean, {_std_sql(c)} AS {c}__std" for c in SCALED)
             + f" FROM (SELECT *, {SPLIT_EXPR} AS split FROM tx_v) WHERE split = 'train'")


@query("fit_scaler", with_views(
    "SELECT " + ", ".join(f"round({c}__mean, 6) AS {c}__mean, round({c}__std, 6) AS {c}__std" for c in SCALED)
    + f" FROM ({STATS_SQL})", "tx_v"))
def q_fit_scaler(spark, sf):
    s = split_tx(spark, sf)
    st = ml.fit_scaler(s.where(F.col("split") == "train"), SCALED)
    return st.select(*[F.round(c, 6).alias(c) for c in st.columns])


@query("apply_scaler", with_views(
    "SELECT id, split, " + ", ".join(f"round(({c} - {c}__mean) / {c}__std, 6) AS {c}" for c in SCALED)
    + f" FROM (SELECT *, {SPLIT_EXPR} AS split FROM tx_v), ({STATS_SQL})", "tx_v"))
def q_apply_scaler(spark, sf):
    s = split_tx(spark, sf)
    params = ml.scaler_params(ml.fit_scaler(s.where(F.col("split") == "train"), SCALED), SCALED)
    out = ml.apply_scaler(s, params)
    return out.select("id", "split", *[F.round(c, 6).alias(c) for c in SCALED])


@query("class_weights", with_views("""
SELECT "Class", count(*) AS n_rows,
       round((SELECT count(*) FROM tx_v) / ((SELECT count(DISTINCT "Class") FROM tx_v) * count(*)), 6) AS weight
FROM tx_v GROUP BY "Class" """, "tx_v"))
def q_class_weights(spark, sf):
    return ml.class_weights(V.tx_v(spark, sf), "Class").withColumn("weight", F.round("weight", 6))


# ------------------------------------------------------------------ training

FILE_ROWS = 65536  # rows in a file of what the forest reads: a few tasks may write them, more read them


def training_frame(spark, sf):
    """The training job's preparation, in one lineage: rename, time parts,
    seeded surrogates, drop nulls, log amount, night/weekend flags."""
    df = V.tx_signal_v(spark, sf)
    if (tasks := V.wide(spark, sf, "lineitem")):  # few files: dealt by a hash of the row, which sorts nothing
        df = df.repartition(tasks, *df.columns)
    df = curation.map_columns(df)
    df = curation.add_time_parts(df, "Time")
    df = curation.add_surrogates(df, ["id"], seed=ml.SEED)
    df = curation.drop_any_null(df)
    df = curation.add_amount_log(df, "transaction_amount")
    return curation.add_flags(df)


def train(spark, sf):
    """Train on the data folder; returns (path, hold-out AUC row, balanced training rows, split)."""
    started = int(time.time() * 1000)
    # the prepared frame feeds the scaler fit, SMOTE and the hold-out
    # scoring: write it once, with the side of the split that each row is
    # on, instead of recomputing it for each
    with interim(spark, "training_frame"):
        prepared = training_frame(spark, sf)
        split = materialize(ml.stratified_split(prepared, ["id"], label="is_fraud"), "training_frame", file_rows=FILE_ROWS)
    feats = [c for c in ml.feature_columns(prepared) if c != "id"]
    train_df = split.where(F.col("split") == "train")
    test_df = split.where(F.col("split") == "test")
    params = ml.scaler_params(ml.fit_scaler(train_df, feats), feats)
    scaled = ml.apply_scaler(train_df, params)
    # oversample the minority class on the scaled features (as the training
    # job does), then weight classes by the frame actually trained on
    # the balanced set feeds the class counts and every pass of the forest:
    # its copies are written once instead of recomputing SMOTE, whose own
    # tables and shuffles are gone before the forest is fitted; its other rows
    # are those of the prepared frame and are not stored again
    with interim(spark, "train_copies"):
        arr = scaled.select("id", F.array(*[F.col(c) for c in feats]).alias("_x"), "is_fraud")
        copies = ml.smote(arr, "_x", "is_fraud", ["id"], k=5).where("is_synthetic")
        copies = materialize(copies.select(*[F.col("_x")[i].alias(c) for i, c in enumerate(feats)], "is_fraud"), "train_copies",
                             file_rows=FILE_ROWS)
    balanced = scaled.select(*feats, "is_fraud").unionByName(copies)
    train_s = ml.with_class_weight(balanced, "is_fraud")
    path = scratch_path(spark, "forest")
    # stored tables of many files need no dealing (a shuffle and a cached copy of them)
    model = ml.train_forest(train_s, feats, "is_fraud", weight_col="weight", save_to=f"{path}/model")
    ml.save_model(model, path, feats, params, spark)
    scored = ml.score(model, ml.apply_scaler(test_df, params))
    auc = materialize(ml.roc_auc(scored, "fraud_probability", "is_fraud"), "holdout_auc")
    registry.record_run(f"{path}/runs", "train", params=ml.FOREST | {"seed": ml.SEED}, metrics=auc,
                        signature=train_df.select(*feats).schema, start_time=started, end_time=int(time.time() * 1000))
    return path, auc, balanced, split


RUN_SQL = """
WITH c AS (
  SELECT count(*) FILTER (prediction = 1 AND is_simulated_fraud) AS tp, count(*) FILTER (prediction = 1 AND NOT is_simulated_fraud) AS fp,
         count(*) FILTER (prediction <> 1 AND NOT is_simulated_fraud) AS tn, count(*) FILTER (prediction <> 1 AND is_simulated_fraud) AS fn
  FROM scores_v),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + tn) / nullif(tp + fp + tn + fn, 0) AS accuracy FROM c)
SELECT 'scores' AS run_id, 'metric' AS kind, name, CAST(NULL AS VARCHAR) AS text_value, round(value, 6) AS metric_value FROM (
  SELECT unnest(['tp', 'fp', 'tn', 'fn', 'precision', 'recall', 'f1', 'accuracy']) AS name,
         unnest([tp::DOUBLE, fp, tn, fn, "precision", recall, f1, accuracy]) AS value FROM m)
UNION ALL SELECT 'scores', 'param', unnest(['numTrees', 'maxDepth', 'minInstancesPerNode', 'featureSubsetStrategy']),
       unnest(['100', '10', '5', 'sqrt']), NULL
UNION ALL SELECT 'scores', 'signature', unnest(['amount', 'location']), unnest(['double', 'string']), NULL"""


@query("run_record", with_views(RUN_SQL, "scores_v"))
def q_run_record(spark, sf):
    """Record the evaluation of the scored transactions as a run and read the record back."""
    s = V.scores_v(spark, sf)
    path = scratch_path(spark, "runs")
    metrics = ml.classification_metrics(s, "prediction", "is_simulated_fraud")
    for _ in range(2):  # recording a run again replaces it
        registry.record_run(path, "scores", params=ml.FOREST, metrics=metrics, signature=s.select("amount", "location").schema,
                            start_time=0, end_time=1)
    part = lambda p: registry.read_runs(spark, path, p)
    none = F.lit(None).cast("double").alias("metric_value")
    return (part("metrics").select("run_id", F.lit("metric").alias("kind"), F.col("metric_name").alias("name"),
                                   F.lit(None).cast("string").alias("text_value"), F.round("metric_value", 6).alias("metric_value"))
            .unionByName(part("params").select("run_id", F.lit("param").alias("kind"), F.col("param_name").alias("name"),
                                               F.col("param_value").alias("text_value"), none))
            .unionByName(part("signature").select("run_id", F.lit("signature").alias("kind"), F.col("column_name").alias("name"),
                                                  F.col("column_type").alias("text_value"), none)))


TRAINED_SQL = f"""
WITH s AS (SELECT "Class" AS y, {SPLIT_EXPR} AS split FROM tx_signal_v),
c AS (SELECT count(*) FILTER (split = 'train' AND y = 0) AS a, count(*) FILTER (split = 'train' AND y = 1) AS b,
             count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'test' AND y = 1) AS n_test_fraud FROM s)
SELECT a + b AS n_train, n_test, n_test_fraud, greatest(a, b) AS n_balanced_0, greatest(a, b) AS n_balanced_1, true AS auc_at_least_075 FROM c"""


@query("train_forest", with_views(TRAINED_SQL, "tx_signal_v"))
def q_train_forest(spark, sf):
    """Train the forest on the training split: rows of the split and of the
    balanced training set, and whether the hold-out ROC-AUC passes the gate."""
    _, auc, balanced, split = train(spark, sf)
    test = F.col("split") == "test"
    rows = split.agg(F.count_if(~test).alias("n_train"), F.count_if(test).alias("n_test"),
                     F.count_if(test & (F.col("is_fraud") == 1)).alias("n_test_fraud"))
    parity = balanced.agg(F.count_if(F.col("is_fraud") == 0).alias("n_balanced_0"), F.count_if(F.col("is_fraud") == 1).alias("n_balanced_1"))
    passed = auc.select((F.col("roc_auc") >= ml.GATE_THRESHOLD).alias("p"))
    return rows.select("*", parity.select("n_balanced_0").scalar().alias("n_balanced_0"), parity.select("n_balanced_1").scalar().alias("n_balanced_1"),
                       passed.scalar().alias("auc_at_least_075"))


@query("score_batch", with_views("""
SELECT CAST(id AS VARCHAR) AS transaction_id, 'int' AS prediction_type, true AS prediction_ok, "Class" = 1 AS was_fraud, '1' AS model_version
FROM tx_signal_v""", "tx_signal_v"))
def q_score_batch(spark, sf):
    """Load the stored model artifact (model + feature list + scaler) and
    score every transaction: align -> scale -> predict -> envelope."""
    path = train(spark, sf)[0]
    model, feats, params = ml.load_model(spark, path)
    df = training_frame(spark, sf).withColumn("transaction_id", F.col("id").cast("string"))
    aligned = curation.align_features(df, feats, keep=["transaction_id", "is_fraud", "transaction_amount"])
    scored = ml.score(model, ml.apply_scaler(aligned, params))
    scored = scored.withColumn("was_fraud", F.col("is_fraud") == 1)
    env = curation.score_envelope(scored.drop("is_fraud"), ["transaction_id", "transaction_amount", "was_fraud"],
                                  model_version=F.lit("1"), scored_at=F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return env.select("transaction_id", F.typeof("prediction").alias("prediction_type"), consistent_columns().alias("prediction_ok"),
                      "original_data.was_fraud", "model_version")


def consistent_columns():
    """Probability in [0, 1] and a prediction that follows from it (either one at exactly one half)."""
    p = F.col("fraud_probability")
    return p.between(0, 1) & ((p == 0.5) | (F.col("prediction") == (p > 0.5).cast("int")))


@query("smote", """
WITH c AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
n AS (SELECT count(*) FILTER (WHERE y = 1) AS n_min, count(*) FILTER (WHERE y = 0) AS n_maj FROM c)
SELECT y, false AS is_synthetic, count(*) AS n_rows, 0 AS n_on_segment FROM c GROUP BY y
UNION ALL
SELECT 1, true, n_maj - n_min, n_maj - n_min FROM n WHERE n_maj > n_min""")
def q_smote(spark, sf):
    """Oversample the rarest embedding class (label 0) to parity with the
    rest: rows per (class, synthetic), and how many of them lie on the segment
    between two different minority rows of the table."""
    e = V.table(spark, sf, "embeddings")
    df = e.select("vec_id", F.col("embedding").cast("array<double>").alias("features"),
                  F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0)).alias("y"))
    out = ml.smote(df, "features", "y", ["vec_id"], k=5, lineage=True)
    real = df.where("y = 1").select(F.col("vec_id").cast("string").alias("id"), "features")
    end = lambda n: real.select(F.col("id").alias(n), F.col("features").alias(f"{n}_at"))
    both = out.join(end("_parent"), "_parent", "left").join(end("_neighbour"), "_neighbour", "left")
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    detour = far("_parent_at", "features") + far("features", "_neighbour_at") - far("_parent_at", "_neighbour_at")
    on = (F.col("_parent") != F.col("_neighbour")) & (F.abs(detour) < 1e-9)
    return both.groupBy("y", "is_synthetic").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(on).alias("n_on_segment"))


@query("nearest_rows", """
WITH p AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, c_nationkey / 2.0::DOUBLE AS b, length(c_mktsegment)::DOUBLE AS c FROM customer),
d AS (SELECT p.id, q.id AS neighbour, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) AS distance
      FROM p, p q WHERE p.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d)
SELECT id, neighbour, rank::INTEGER AS rank, round(distance, 6) AS distance, true AS over_a_quarter_skipped FROM r WHERE rank <= 5""")
def q_nearest_rows(spark, sf):
    """The five most similar customers of every customer, and whether pruning
    spared over a quarter of the comparisons of a row with a block."""
    c = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / F.lit(2.0),
                                                F.length("c_mktsegment").cast("double")).alias("vector"))
    stats: dict = {}
    near = nearest_neighbours(c, k=5, block_rows=32, stats=stats)
    return near.select("id", "neighbour", "rank", F.round("distance", 6).alias("distance"),
                       F.lit(stats.get("skipped", 0.0) > 0.25).alias("over_a_quarter_skipped"))
