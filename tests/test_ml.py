import random

from pyspark.sql import functions as F

from tidewater.operators import ml
from tidewater.operators import registry as R
from tidewater.operators.common import prefix_sum, range_cut


def _auc_brute(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_roc_auc_exact_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = ml.roc_auc(df, "s", "y").first()
    assert abs(got.roc_auc - _auc_brute(rows)) < 1e-12 and (got.positives, got.negatives) == (3, 2)


def test_roc_auc_grouped_random(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), round(rnd.random(), 2), rnd.randrange(2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r.roc_auc for r in ml.roc_auc(df, "s", "y", group_by=["g"], num_partitions=7).collect()}
    for g in "abc":
        exp = _auc_brute([(s, y) for gg, s, y in rows if gg == g])
        assert abs(got[g] - exp) < 1e-12


def test_range_cut_is_balanced_on_crowded_scores(spark):
    """99.8 % of the scores near 0, and a group with most rows: no partition holds twice its share, and sums stay right."""
    rows = [(0 if i % 10 else i % 7, 1e-9 * i if i % 500 else float(i), i % 3) for i in range(50_000)]
    df = spark.createDataFrame(rows, "g int, s double, v int").repartition(8)
    sizes = [r["count"] for r in range_cut(df, ["g", "s"], 16).groupBy("_ps_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 50_000 / 16
    want, total = {}, {}
    for g, s, v in sorted(rows):
        want[g, s] = total.get(g, 0)
        total[g] = want[g, s] + v
    assert {(r.g, r.s): r.c for r in prefix_sum(df, ["g"], "s", "v", "c", num_partitions=16).collect()} == want


def test_prefix_sum_of_text_order_and_null_groups(spark):
    df = spark.createDataFrame([(None, "b", 2), (None, "a", 1), ("x", None, 5), ("x", "c", 7), (None, "d", None)], "g string, o string, v int")
    got = {(r.g, r.o): r.c for r in prefix_sum(df, ["g"], "o", "v", "c", num_partitions=3, inclusive=True).collect()}
    assert got == {(None, "a"): 1, (None, "b"): 3, (None, "d"): 3, ("x", None): 5, ("x", "c"): 12}


def test_prefix_sum_matches_brute(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["x", "x", "x", "y"]), i * 3 + rnd.randrange(3), rnd.randrange(10)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r.g, r.o): r.c for r in prefix_sum(df, ["g"], "o", "v", "c", num_partitions=5).collect()}
    for g, o, _v in rows:
        assert got[(g, o)] == sum(v for gg, oo, v in rows if gg == g and oo < o)
    glob = {r.o: r.c for r in prefix_sum(df, [], "o", "v", "c", num_partitions=4, inclusive=True).collect()}
    for _g, o, _v in rows:
        assert glob[o] == sum(v for _gg, oo, v in rows if oo <= o)


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    p = ml.scaler_params(ml.fit_scaler(df, ["a", "c"]), ["a", "c"])
    assert abs(p["a"][1] - 1.118033988749895) < 1e-12 and p["c"] == (5.0, 1.0)
    out = ml.apply_scaler(df, p).collect()
    assert [r.c for r in out] == [0.0] * 4


def test_classification_metrics_zero_guard(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "p int, y int")
    r = ml.classification_metrics(df, "p", "y").first()
    assert (r.tp, r.fp, r.tn, r.fn) == (0, 0, 1, 1) and r.precision == 0.0 and r.f1 == 0.0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    w = {r.y: r.weight for r in ml.class_weights(df, "y").collect()}
    assert w == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}


def test_split_is_deterministic(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a = ml.stratified_split(df, ["id"], label="y")
    b = ml.stratified_split(df.repartition(9), ["id"], label="y")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    share = {r.y: r.t / r.n for r in a.groupBy("y").agg(F.count("*").alias("n"),
                                                         F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert all(0.15 < v < 0.25 for v in share.values())


def test_forest_train_and_score(spark):
    rnd = random.Random(2)
    rows = [(float(i), rnd.random(), int(i % 7 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = ml.train_forest(df, ["a", "b"], "y", numTrees=5, maxDepth=3)
    out = ml.score(model, df)
    assert {"prediction", "fraud_probability"} <= set(out.columns)
    vals = out.select("fraud_probability").collect()
    assert all(0.0 <= r[0] <= 1.0 for r in vals)


def test_registry_ops(spark):
    reg = spark.createDataFrame(
        [("m", 1, "None", 1, 1, "r1", "READY"), ("m", 2, "Staging", 2, 2, "r2", "READY"),
         ("m", 3, "Production", 3, 3, "r3", "READY")],
        "model_name string, version int, current_stage string, creation_time long, last_updated_time long, "
        "run_id string, status string")
    t = {r.version: r.current_stage for r in R.transition(reg, "m", 2, "Production").collect()}
    assert t == {1: "None", 2: "Production", 3: "Archived"}
    cands = spark.createDataFrame([("m", "r4", 10, 0.9), ("m", "r5", 11, 0.5)],
                                  "model_name string, run_id string, creation_time long, roc_auc double")
    new = {r.version: (r.current_stage, r.run_id) for r in R.register(reg, cands).collect()}
    assert new[4] == ("Staging", "r4") and new[2] == ("Archived", "r2") and 5 not in new
    assert [tuple(r) for r in R.current_version(reg, "Production").collect()] == [("m", 3)]
    lat = {r.current_stage: r.version for r in R.latest_by_stage(reg).collect()}
    assert lat == {"None": 1, "Staging": 2, "Production": 3}


def test_smote_parity_and_segments(spark):
    import numpy as np
    rnd = np.random.default_rng(4)
    maj = [(i, [float(x) for x in rnd.normal(size=3)], 0) for i in range(60)]
    mino = [(100 + i, [float(x) for x in rnd.normal(loc=3.0, size=3)], 1) for i in range(7)]
    df = spark.createDataFrame(maj + mino, "rid long, f array<double>, y int")
    out = ml.smote(df, "f", "y", ["rid"], k=3).cache()
    counts = {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 60, 1: 60}
    real = np.array([m[1] for m in mino])
    for r in out.where("is_synthetic").collect():
        x = np.array(r.f)
        src = np.array(real[[str(m[0]) for m in mino].index(r._key.split("#")[0])])
        # the point lies on a segment from its source row to some other minority row
        ok = False
        for other in real:
            d = other - src
            if np.allclose(d, 0):
                continue
            u = float(np.dot(x - src, d) / np.dot(d, d))
            if -1e-9 <= u <= 1 + 1e-9 and np.allclose(src + u * d, x, atol=1e-9):
                ok = True
        assert ok
    again = ml.smote(df.repartition(5), "f", "y", ["rid"], k=3)
    assert sorted((r._key, tuple(round(v, 9) for v in r.f)) for r in out.collect()) == \
        sorted((r._key, tuple(round(v, 9) for v in r.f)) for r in again.collect())


def test_smote_neighbours_are_the_nearest_beyond_one_block(spark):
    import numpy as np
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(900, 10))
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(1000 + i, [0.0] * 10, 0) for i in range(5400)],
                               "rid long, f array<double>, y int")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = [set(r[:5].tolist()) for r in np.argsort(d, axis=1)]
    out = ml.smote(df, "f", "y", ["rid"], k=5, lineage=True, block_rows=20).where("is_synthetic").select("_parent", "_neighbour").collect()
    assert len(out) == 4500 and all(int(r._neighbour) in near[int(r._parent)] for r in out)


def test_smote_parity_with_repeated_keys_and_many_blocks(spark):
    import numpy as np
    rnd = np.random.default_rng(8)
    vec = lambda: [float(x) for x in rnd.normal(size=3)]
    mino = [(i % 150, vec(), 1) for i in range(400)] + [(7, [1.0, 1.0, 1.0], 1)] * 100
    df = spark.createDataFrame([(i, vec(), 0) for i in range(1234)] + mino, "rid long, f array<double>, y int")
    for kw in ({}, {"block_rows": 20}):
        out = ml.smote(df, "f", "y", ["rid"], k=4, lineage=True, **kw)
        counts = {(r.y, r.is_synthetic): r["count"] for r in out.groupBy("y", "is_synthetic").count().collect()}
        assert counts == {(0, False): 1234, (1, False): 500, (1, True): 734}
        assert out.where("is_synthetic and (_neighbour is null or _parent is null)").count() == 0


def test_class_weight_does_not_shuffle_the_rows(spark):
    """Also where Spark cannot tell that there are few classes: a large table's estimate is above any threshold."""
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(99, None)], "a long, y int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ml.with_class_weight(df, "y")
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.y, r.weight) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(0, 41 / (3 * 30)), (1, 41 / (3 * 10)), (None, None)} and out.count() == 41


def test_forest_keeps_no_node_ids_and_grows_the_same_trees(spark):
    rnd = random.Random(3)
    rows = [(rnd.random(), rnd.random(), 0) for _ in range(300)]
    df = spark.createDataFrame([(a, b, int(a * b > 0.3)) for a, b, _ in rows], "a double, b double, y int").coalesce(2)
    plain, cached = (ml.train_forest(df, ["a", "b"], "y", numTrees=4, **kw).stages[-1] for kw in ({}, {"cacheNodeIds": True}))
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert not plain.getCacheNodeIds() and cached.getCacheNodeIds() and trees(plain) == trees(cached)


def test_training_leaves_its_frame_and_the_copies_only(spark, tmp_path):
    """The tables of the neighbour search are gone before the forest is fitted, and no row is stored twice."""
    import datetime
    import os
    from tidewater import session
    from tidewater.plans import q_ml
    rnd = random.Random(4)
    rows = [(i, 1, float(rnd.randrange(1, 51)), rnd.randrange(11) / 100, rnd.randrange(9) / 100, rnd.random() * 1e4, "N",
             datetime.date(1995, 1, 1) + datetime.timedelta(rnd.randrange(900))) for i in range(500)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
                                "l_extendedprice double, l_returnflag string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    first, stored = len(session._scratch), []
    session.stage_observers.append(lambda name, df: stored.append(name))
    try:
        _, _, balanced, split = q_ml.train(spark, str(tmp_path))
    finally:
        session.stage_observers.pop()
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in session._scratch[first:]}
    assert "nn-visits" in stored and "train_copies" in stored and "train_balanced" not in stored
    assert {"training_frame", "train_copies", "forest"} <= left and not {n for n in left if n.startswith(("nn-", "smote"))}
    n = {r.is_fraud: r["count"] for r in balanced.groupBy("is_fraud").count().collect()}
    assert n[0] == n[1] == split.where("split = 'train' and is_fraud = 0").count() and split.count() == 500


def test_interim_keeps_what_it_names(spark):
    import os
    import pytest
    from tidewater import session
    was = spark.conf.get(session._DROP_SHUFFLES, None)
    df = spark.range(100)
    with session.interim(spark, "outer"):
        outer = session.materialize(df, "outer", file_rows=30)
        with session.interim(spark, "inner"):
            gone, inner = session.materialize(df, "gone"), session.materialize(df.repartition(3), "inner")
        assert inner.count() == 100 and not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
    assert outer.count() == 100 and len(outer.inputFiles()) >= 4 and spark.conf.get(session._DROP_SHUFFLES, None) == was
    assert not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
    with pytest.raises(ValueError), session.interim(spark):
        made = session.materialize(df, "made")
        raise ValueError
    assert not os.path.exists(made.inputFiles()[0].removeprefix("file://")) and session._inside.paths is None


def _forest_rows(spark, n=4000, seed=5):
    import numpy as np
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(b), float(c), int((a * b > 0.3) != (rng.random() < 0.05))) for a, b, c in rng.random((n, 3))]
    return spark.createDataFrame(rows, "a double, b double, c double, y int").coalesce(3)


def test_forest_splits_are_the_best_by_brute_force(spark):
    """Every node's rows, class weights and split, recomputed row by row from the stored tree and the tree's bootstrap."""
    import numpy as np
    from tidewater.operators import forest
    for weights in ({0: 0.5, 1: 2.0}, None):
        df = _forest_rows(spark, 600).withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(0.5) if weights else F.col("a") + 0.5)
        data = forest.pack(df.withColumn("y", F.col("y").cast("double")), ["a", "b", "c"], "y", "w", 32, 42)
        assert (data.class_weight is not None) == (weights is not None)
        tree = forest.grow(data, trees=2, depth=4, least=5, subset=3, seed=42)[1]
        x, y, w = [], [], []
        for b in data.blocks.collect():
            code = np.frombuffer(b.codes, np.uint8).reshape(b.rows, 3)
            at, times = forest.bootstrap(42, 1, b.block, b.rows)
            cw = np.frombuffer(b.weight) if data.class_weight is None else data.class_weight[code[:, 0] % 2]
            again = np.repeat(at, times.astype(int))
            x.append(code[again] // 2), y.append(code[again, 0] % 2), w.append(cw[again])
        x, y, w = np.concatenate(x), np.concatenate(y), np.concatenate(w)
        rows = {0: np.arange(len(y))}
        for node in range(len(tree.feature)):
            r = rows[node]
            stats = np.array([w[r][y[r] == k].sum() for k in (0, 1)])
            assert tree.raw[node] == len(r) and np.allclose(tree.stats[node], stats)
            if tree.feature[node] < 0:
                continue
            left = x[r, tree.feature[node]] <= tree.bin[node]
            rows[tree.left[node]], rows[tree.left[node] + 1] = r[left], r[~left]
            best = -1.0
            for f in range(3):
                for b in range(31):
                    go = x[r, f] <= b
                    if min(go.sum(), (~go).sum()) < 5:
                        continue
                    part = [np.array([w[r][s & (y[r] == k)].sum() for k in (0, 1)]) for s in (go, ~go)]
                    gain = forest.gini(stats) - sum(p.sum() / stats.sum() * forest.gini(p) for p in part)
                    best = max(best, float(gain))
            assert abs(best - tree.gain[node]) < 1e-9


def test_forest_is_as_good_as_that_of_spark_ml(spark, tmp_path):
    """Other draws, the same method: hold-out AUC, number of nodes and importances are close."""
    import numpy as np
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    df, test = _forest_rows(spark).cache(), _forest_rows(spark, 3000, 6).cache()
    conf = dict(numTrees=20, maxDepth=6, minInstancesPerNode=5, featureSubsetStrategy="sqrt")
    ours = ml.train_forest(df, ["a", "b", "c"], "y", **conf)
    theirs = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features", handleInvalid="keep"), RandomForestClassifier(
        featuresCol="_features", labelCol="y", seed=42, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", **conf)]).fit(df)
    theirs.write().save(f"{tmp_path}/theirs")
    theirs = PipelineModel.load(f"{tmp_path}/theirs")  # without its training summary, which does not go into tasks
    auc = [ml.roc_auc(ml.score(m, test), "fraud_probability", "y").first().roc_auc for m in (ours, theirs)]
    a, b = (m.stages[-1] for m in (ours, theirs))
    assert abs(auc[0] - auc[1]) < 0.02 and min(auc) > 0.85
    assert 0.7 < a.totalNumNodes / b.totalNumNodes < 1.4 and a.getNumTrees == b.getNumTrees == 20
    assert np.abs(a.featureImportances.toArray() - b.featureImportances.toArray()).max() < 0.1


def test_forest_passes_are_not_row_at_a_time(spark):
    """The rows are packed once, into one stored table; before, nothing was packed."""
    from tidewater import session
    seen = []
    session.stage_observers.append(lambda name, df: seen.append(name))
    try:
        ml.train_forest(_forest_rows(spark, 500), ["a", "b", "c"], "y", numTrees=3, maxDepth=2)
    finally:
        session.stage_observers.pop()
    assert seen == ["forest_blocks"]


def test_scores_by_arrays_are_those_of_the_stored_model(spark, tmp_path):
    df = _forest_rows(spark)
    model = ml.train_forest(df, ["a", "b", "c"], "y", numTrees=15, save_to=f"{tmp_path}/model")
    ml.save_model(model, str(tmp_path), ["a", "b", "c"], None, spark)
    again = ml.load_model(spark, str(tmp_path))[0]
    odd = df.withColumn("a", F.when(F.col("b") < 0.1, None).when(F.col("b") < 0.2, float("nan")).when(F.col("b") < 0.22, float("inf")).otherwise(F.col("a")))
    fast = ml.score(again, odd)
    assert again._scorer is not None and "ArrowEvalPython" in fast._jdf.queryExecution().executedPlan().toString()
    again._scorer = None
    slow = ml.score(again, odd)
    assert fast.dtypes == slow.dtypes and fast.exceptAll(slow).isEmpty() and slow.exceptAll(fast).isEmpty()


def test_smote_hashes_a_copy_once(spark):
    """The draw of a copy is a column of its own; inside the lambda it was hashed again for every component."""
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], int(i < 5)) for i in range(20)], "id long, x array<double>, y int")
    plan = ml.smote(df, "x", "y", ["id"], k=2)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" in plan and "md5" not in plan.split("zip_with(", 1)[1].split("\n", 1)[0]
