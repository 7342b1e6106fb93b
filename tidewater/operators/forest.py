"""Random forest grown from histograms over packed blocks, as a Spark ML model.

The method is that of Spark ML's classifier: continuous splits from quantiles
of a sample, a Poisson(1) bootstrap per tree, a random feature subset per node,
Gini gain on weighted class counts, all trees level by level, and sibling
leaves of one prediction merged.  Only the work differs: the rows are binned
once into blocks of a byte per feature, and a pass adds up whole arrays (numpy)
instead of one row, tree and feature at a time.  What a pass deals out follows
tasks times nodes, not rows.  ``write_model`` stores the trees in Spark ML's
format, so loading, scoring and inspection are Spark's.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import interim, materialize

BLOCK_ROWS = 32768       # rows of a block: what one array operation covers
HELD_ROWS = 1 << 22      # rows that a task holds at once (a byte per feature each)
MERGED_NODES = 8192      # nodes of one tree, counted once per task, whose histograms meet in a group
SPLIT_SAMPLE = 10000     # least rows that splits are taken from (Spark ML's value; bins squared if that is more)
_EPS = 2.0 ** -52
#: what the classifier may be told here; anything else is left to Spark ML
KNOWN = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "maxMemoryInMB", "cacheNodeIds"}


class Tree:
    """Nodes as they grow: a leaf's ``feature`` is -1 and its ``left`` itself; a right child follows the left one."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.gain = [-1], [0], [0], [0.0]
        self.stats: list[np.ndarray | None] = [None]
        self.raw = [0]
        self.open = np.array([0])


class Data(NamedTuple):
    blocks: DataFrame        # block, rows, codes, weight
    splits: list[np.ndarray]
    classes: int
    class_weight: np.ndarray | None   # of each class, if all its rows have one weight


@contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for rows that are blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def splits_of(values: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds of a feature: between all its values if they are few, else at equal shares of the weight."""
    ok = ~np.isnan(values)
    value, at = np.unique(values[ok], return_inverse=True)
    if len(value) < 2:
        return np.empty(0)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= most:
        return middle
    total = np.bincount(at, weight[ok], len(value)).cumsum()
    stride = total[-1] / (most + 1)
    # the boundary nearest to each multiple of the stride
    target = stride * np.arange(1, most + 1)
    i = np.clip(np.searchsorted(total[:-1], target), 1, len(middle) - 1)
    i -= np.abs(total[i - 1] - target) < np.abs(total[i] - target)
    return middle[np.unique(i)]


def pack(data: DataFrame, features: list[str], label: str, weight_col: str | None, bins: int, seed: int) -> Data:
    """Rows binned and stored as blocks; splits from a sample, classes and their weights from one aggregate."""
    x = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = data.select(*x, F.col(label).cast("double").alias("y"), w.alias("w"))
    found = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low"), F.max("w").alias("high"),
                                  F.count_if(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0)).alias("bad")).collect()
    n = sum(r["n"] for r in found)
    if not n:
        raise ValueError("a forest needs rows")
    if any(r["y"] is None or not (r["y"] >= 0 and float(r["y"]).is_integer()) for r in found):
        raise ValueError("labels must be the whole numbers from 0 on, without nulls")
    if any(r["bad"] for r in found):
        raise ValueError("weights must not be null, NaN or negative")
    classes = int(max(r["y"] for r in found)) + 1
    class_weight = None
    if all(r["low"] == r["high"] for r in found):
        class_weight = np.zeros(classes)
        class_weight[[int(r["y"]) for r in found]] = [r["low"] for r in found]
    bins = min(bins, n)
    share = max(bins * bins, SPLIT_SAMPLE) / n
    some = rows.drop("y") if share >= 1 else rows.drop("y").sample(False, share, seed)
    t = some.toArrow()
    weight = t["w"].to_numpy()
    splits = [splits_of(t[f"f{i}"].to_numpy().astype(float), weight, bins - 1) for i in range(len(x))]
    codes = max(len(s) + 1 for s in splits) * classes
    kind = np.uint8 if codes < 256 else np.uint16 if codes < 65536 else np.uint32
    names = ["block", "rows", "codes", "weight"]

    def block(part: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(part)
        y = table["y"].to_numpy().astype(kind)
        code = np.empty((len(y), len(splits)), kind)
        for i, s in enumerate(splits):
            # a value at a threshold goes left, NaN and null last
            code[:, i] = np.searchsorted(s, table[f"f{i}"].to_numpy().astype(float)).astype(kind) * kind(classes) + y
        heavy = b"" if class_weight is not None else table["w"].to_numpy().tobytes()
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(y)], pa.int32()), pa.array([code.tobytes()]), pa.array([heavy])], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, part, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, BLOCK_ROWS - held)
                batch = batch.slice(piece.num_rows)
                part.append(piece)
                held += piece.num_rows
                if held == BLOCK_ROWS:
                    yield block(part, number)
                    number, part, held = number + 1, [], 0
        if held:
            yield block(part, number)

    blocks = materialize(rows.mapInArrow(packed, "block long, rows int, codes binary, weight binary"), "forest_blocks")
    return Data(blocks, splits, classes, class_weight)


#: P(a Poisson(1) number is at most k), in 65,536ths
_AT_MOST = np.array([round(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8)], np.uint32)
_AT_MOST = _AT_MOST[_AT_MOST < 65536].astype(np.uint16)


def bootstrap(seed: int, tree: int, block: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that a tree sees, and how often: the same in every pass and every retry."""
    draw = np.random.SFC64([seed & 0xFFFFFFFF, tree, block]).random_raw(-(-rows // 4)).view(np.uint16)[:rows]
    times = (draw >= _AT_MOST[0]).view(np.uint8)
    for limit in _AT_MOST[1:]:
        times += draw >= limit
    at = np.flatnonzero(times)
    return at, times[at].astype(float)


class Pass(NamedTuple):
    """What a pass needs of one tree."""
    tree: int
    feature: np.ndarray      # by node
    limit: np.ndarray        # by node: the largest code that goes left
    left: np.ndarray
    slot: np.ndarray         # by node: place among the open nodes, the place after the last for the others
    subset: np.ndarray       # feature subset: by rank, then node
    depth: int
    open: int


def _histograms(p: Pass, held: list[tuple], codes: int, seed: int, heavy: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Open nodes x subset x codes: rows (with repetition), and their weight if it differs within a class."""
    m = len(p.subset)
    count = np.zeros((m, (p.open + 1) * codes))
    weight = np.zeros_like(count) if heavy else None
    left, slot = p.left.astype(np.int64), p.slot.astype(np.int64) * codes
    feature, subset = p.feature.astype(np.int64), p.subset.astype(np.int64)
    for number, rows, code, w in held:
        at, times = bootstrap(seed, p.tree, number, rows)
        base = at * (len(code) // rows)
        node = np.zeros(len(at), np.int64)
        where, child, here, top = np.empty_like(node), np.empty_like(node), np.empty(len(at), code.dtype), np.empty(len(at), code.dtype)
        # indices are in range: "clip" only spares numpy a buffered copy
        for _ in range(p.depth):
            np.take(feature, node, out=where, mode="clip")
            where += base
            np.take(code, where, out=here, mode="clip")
            np.take(p.limit, node, out=top, mode="clip")
            np.take(left, node, out=child, mode="clip")
            np.add(child, here > top, out=node)
        np.take(slot, node, out=child, mode="clip")
        for j in range(m):
            np.take(subset[j], node, out=where, mode="clip")
            where += base
            np.take(code, where, out=here, mode="clip")
            np.add(child, here, out=where)
            count[j] += np.bincount(where, times, count.shape[1])
            if heavy:
                weight[j] += np.bincount(where, times * w[at], count.shape[1])
    shape = lambda h: h.reshape(m, p.open + 1, codes)[:, :p.open].transpose(1, 0, 2)
    return shape(count), shape(weight) if heavy else None


def _counted(data: Data, todo: list[Pass], codes: int, seed: int, kind: type, tasks: int, together: int) -> DataFrame:
    """(tree, chunk, count, weight): histograms of the open nodes, a row per task, tree and ``together`` nodes."""
    heavy = data.class_weight is None
    names = ["tree", "chunk", "count", "weight"]

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for p in todo:
            count, weight = _histograms(p, held, codes, seed, heavy)
            for c in range(0, p.open, together):
                part = slice(c, c + together)
                yield pa.RecordBatch.from_arrays([pa.array([p.tree], pa.int32()), pa.array([c // together], pa.int32()),
                                                  pa.array([count[part].astype(np.uint32).tobytes()]),
                                                  pa.array([weight[part].tobytes() if heavy else b""])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for number, rows, code, w in zip(*(batch.column(i) for i in range(4))):
                rows = rows.as_py()
                held.append((number.as_py(), rows, np.frombuffer(code.as_buffer(), kind), np.frombuffer(w.as_buffer()) if heavy else None))
                n += rows
                if n >= HELD_ROWS:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return data.blocks.coalesce(tasks).mapInArrow(run, "tree int, chunk int, count binary, weight binary")


def gini(stats: np.ndarray) -> np.ndarray:
    """Impurity of class weights (last axis); 0 without any."""
    total = stats.sum(-1)
    share = stats / np.where(total > 0, total, 1.0)[..., None]
    return np.where(total > 0, 1.0 - (share * share).sum(-1), 0.0)


def best_splits(count: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per node of nodes x subset x bins x classes: place in the subset, bin, gain (not positive: no split),
    and of the whole node and its left side the rows and class weights."""
    n, m, bins, classes = weight.shape
    left, raw = weight.cumsum(2)[:, :, :-1], count.sum(3).cumsum(2)
    total, rows = weight[:, 0].sum(1), raw[:, 0, -1]
    raw = raw[:, :, :-1]
    right = total[:, None, None] - left
    heavy = np.maximum(total.sum(1), 1e-300)[:, None, None]
    gain = gini(total)[:, None, None] - left.sum(3) / heavy * gini(left) - right.sum(3) / heavy * gini(right)
    gain[(raw < least) | (rows[:, None, None] - raw < least)] = -np.inf
    flat = gain.reshape(n, -1)
    if not flat.shape[1]:
        return np.zeros(n, int), np.zeros(n, int), np.full(n, -np.inf), rows, total, rows, total
    at = flat.argmax(1)
    j, b = np.divmod(at, bins - 1)
    i = np.arange(n)
    return j, b, flat[i, at], rows, total, raw[i, j, b], left[i, j, b]


def _merged(counted: DataFrame, shape: tuple[int, int, int], class_weight: np.ndarray | None, least: int, together: int) -> DataFrame:
    """The best split of every open node from the tasks' histograms."""
    m, bins, classes = shape

    def merge(table: pa.Table) -> pa.Table:
        total = lambda c, kind: sum((np.frombuffer(x.as_buffer(), kind).astype(float) for x in table[c].combine_chunks()), 0.0)
        count = total("count", np.uint32).reshape(-1, m, bins, classes)
        weight = count * class_weight if class_weight is not None else total("weight", np.float64).reshape(count.shape)
        j, b, gain, rows, stats, left_rows, left_stats = best_splits(count, weight, least)
        n = len(j)
        chunk = table["chunk"][0].as_py()
        return pa.table([pa.array(np.full(n, table["tree"][0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32) + chunk * together),
                         pa.array(j.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(gain), pa.array(rows), pa.array(left_rows),
                         pa.array(list(stats), pa.list_(pa.float64())), pa.array(list(left_stats), pa.list_(pa.float64()))],
                        ["tree", "place", "j", "bin", "gain", "rows", "left_rows", "stats", "left_stats"])

    return counted.groupBy("tree", "chunk").applyInArrow(merge, "tree int, place int, j int, bin int, gain double, rows double, left_rows double, "
                                                                "stats array<double>, left_stats array<double>")


def subset_size(strategy: str, features: int, trees: int) -> int:
    """Features that a node may split on, as Spark ML reads the strategy."""
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    if strategy in ("all", "sqrt", "log2", "onethird"):
        size = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))),
                "onethird": math.ceil(features / 3)}[strategy]
    else:
        size = math.ceil(float(strategy) * features) if "." in strategy else int(strategy)
    return max(1, min(features, size))


def grow(data: Data, *, trees: int, depth: int, least: int, subset: int, seed: int) -> list[Tree]:
    """All trees, a level of all of them in each pass over the blocks."""
    spark = data.blocks.sparkSession
    n = len(data.splits)
    bins = max(len(s) + 1 for s in data.splits)
    codes = bins * data.classes
    kind = np.uint8 if codes < 256 else np.uint16 if codes < 65536 else np.uint32
    tasks = 2 * spark.sparkContext.defaultParallelism
    together = max(16, MERGED_NODES // tasks)
    forest = [Tree() for _ in range(trees)]
    for level in range(depth):
        todo, drawn = [], {}
        for number, t in enumerate(forest):
            if not len(t.open):
                continue
            rng = np.random.default_rng([seed & 0xFFFFFFFF, number, level])
            some = np.sort(rng.random((len(t.open), n)).argsort(1)[:, :subset], 1)
            drawn[number] = some
            feature = np.array(t.feature)
            by_node = np.zeros((subset, len(feature)), np.int16)
            by_node[:, t.open] = some.T
            slot = np.full(len(feature), len(t.open), np.int32)
            slot[t.open] = np.arange(len(t.open))
            # a leaf keeps its rows: no code is above its limit
            limit = np.where(feature < 0, np.iinfo(kind).max, np.array(t.bin) * data.classes + data.classes - 1).astype(kind)
            todo.append(Pass(number, np.maximum(feature, 0).astype(np.int16), limit, np.array(t.left, np.int32), slot, by_node, level, len(t.open)))
        if not todo:
            break
        with interim(spark), _small_batches(spark, 16):
            counted = _counted(data, todo, codes, seed, kind, tasks, together)
            found = _merged(counted, (subset, bins, data.classes), data.class_weight, least, together).toArrow()
        found = found.sort_by([("tree", "ascending"), ("place", "ascending")])
        col = {c: found[c].to_numpy() for c in ("tree", "place", "j", "bin", "gain", "rows", "left_rows")}
        stats, left_stats = (np.array(found[c].combine_chunks().flatten()).reshape(-1, data.classes) for c in ("stats", "left_stats"))
        fresh: dict[int, list[int]] = {number: [] for number in drawn}
        for i, (number, place) in enumerate(zip(col["tree"].tolist(), col["place"].tolist())):
            t = forest[number]
            node = int(t.open[place])
            t.stats[node], t.raw[node] = stats[i], int(col["rows"][i])
            if not col["gain"][i] > 0:
                continue
            first = len(t.feature)
            t.feature[node], t.bin[node] = int(drawn[number][place, col["j"][i]]), int(col["bin"][i])
            t.left[node], t.gain[node] = first, float(col["gain"][i])
            rows = int(col["left_rows"][i])
            for k, (s, r) in enumerate(((left_stats[i], rows), (stats[i] - left_stats[i], t.raw[node] - rows))):
                t.feature.append(-1)
                t.bin.append(0)
                t.left.append(first + k)
                t.gain.append(0.0)
                t.stats.append(s)
                t.raw.append(r)
                if gini(s) > _EPS:
                    fresh[number].append(first + k)
        for number, t in enumerate(forest):
            t.open = np.array(fresh.get(number, []), np.int64)
    return forest


_NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                   ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                   ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])


def node_rows(tree: Tree, splits: list[np.ndarray]) -> list[dict]:
    """Nodes in Spark ML's order (a parent, its left side, its right side); leaves of one parent and one prediction are merged."""
    guess = [float(s.argmax()) if s is not None else 0.0 for s in tree.stats]
    leaf = [f < 0 for f in tree.feature]
    # children follow their parents
    for node in range(len(leaf) - 1, -1, -1):
        a = tree.left[node]
        if not leaf[node] and leaf[a] and leaf[a + 1] and guess[a] == guess[a + 1]:
            leaf[node], guess[node] = True, guess[a]
    out, stack = [], [(0, None, "")]
    while stack:
        node, parent, side = stack.pop()
        me = len(out)
        if parent is not None:
            out[parent][side] = me
        stats = tree.stats[node]
        row = {"id": me, "prediction": guess[node], "impurity": float(gini(stats)), "impurityStats": stats.tolist(), "rawCount": tree.raw[node],
               "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        out.append(row)
        if not leaf[node]:
            f = tree.feature[node]
            row["gain"] = tree.gain[node]
            row["split"] = {"featureIndex": f, "leftCategoriesOrThreshold": [float(splits[f][tree.bin[node]])], "numCategories": -1}
            stack += [(tree.left[node] + 1, me, "rightChild"), (tree.left[node], me, "leftChild")]
    return out


def write_model(spark: SparkSession, path: str, assembler: VectorAssembler, classifier: RandomForestClassifier, forest: list[Tree],
                data: Data) -> None:
    """The pipeline of ``assembler`` and the grown forest in the format of ``PipelineModel.save``."""
    def meta(where: str, **more) -> None:
        spark.createDataFrame([(json.dumps(more),)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}/metadata")

    now = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    meta(path, **{"class": "org.apache.spark.ml.PipelineModel"}, **now, uid=f"PipelineModel_{uuid.uuid4().hex[:12]}",
         paramMap={"stageUids": [assembler.uid, classifier.uid]}, defaultParamMap={})
    assembler.write().overwrite().save(f"{path}/stages/0_{assembler.uid}")
    stage = f"{path}/stages/1_{classifier.uid}"
    given, default = ({p.name: v for p, v in m.items()} for m in (classifier._paramMap, classifier._defaultParamMap))
    meta(stage, **{"class": "org.apache.spark.ml.classification.RandomForestClassificationModel"}, **now, uid=classifier.uid, paramMap=given,
         defaultParamMap=default, numFeatures=len(data.splits), numClasses=data.classes, numTrees=len(forest))
    only = lambda m: {k: v for k, v in m.items() if k not in ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")}
    one = lambda: json.dumps({"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", **now,
                              "uid": f"dtc_{uuid.uuid4().hex[:12]}", "paramMap": only(given), "defaultParamMap": only(default)})
    spark.createDataFrame([(i, one(), 1.0) for i in range(len(forest))], "_1 int, _2 string, _3 double").coalesce(1).write.mode("overwrite").parquet(f"{stage}/treesMetadata")
    rows = [(i, r) for i, t in enumerate(forest) for r in node_rows(t, data.splits)]
    nodes = pa.table([pa.array([i for i, _ in rows], pa.int32()), pa.array([r for _, r in rows], _NODE)], ["treeID", "nodeData"])
    spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{stage}/data")


def fit(train: DataFrame, features: list[str], label: str, weight_col: str | None, assembler: VectorAssembler,
        classifier: RandomForestClassifier, path: str) -> None:
    """Grow the forest that ``classifier`` describes and store it, behind ``assembler``, under ``path``."""
    get = classifier.getOrDefault
    spark, seed = train.sparkSession, int(get("seed"))
    with interim(spark):
        data = pack(train, features, label, weight_col, get("maxBins"), seed)
        grown = grow(data, trees=get("numTrees"), depth=get("maxDepth"), least=get("minInstancesPerNode"), seed=seed,
                     subset=subset_size(get("featureSubsetStrategy"), len(features), get("numTrees")))
        write_model(spark, path, assembler, classifier, grown, data)


# ------------------------------------------------------------------ scoring

class Scorer(NamedTuple):
    """A stored forest as arrays: the trees' nodes one after the other, siblings next to each other."""
    inputs: list[str]
    limits: list[np.ndarray]  # by feature: its thresholds in all trees
    root: np.ndarray
    feature: np.ndarray
    limit: np.ndarray         # the largest code that goes left; a leaf's is the largest of all
    left: np.ndarray          # a leaf's is itself
    share: np.ndarray         # nodes x classes
    depth: np.ndarray         # by tree


def read_model(spark: SparkSession, path: str, inputs: list[str]) -> Scorer:
    """The forest of a pipeline that was saved under ``path``."""
    t = spark.read.parquet(f"{path}/stages/1_*/data").select(
        "treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("at")).toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    col = {c: t[c].to_numpy() for c in ("treeID", "id", "leftChild", "rightChild", "featureIndex", "at")}
    stats = t["impurityStats"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    total = stats.sum(1)[:, None]
    share = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    limits = [np.unique(col["at"][col["featureIndex"] == f]) for f in range(len(inputs))]
    kind = np.uint8 if max(map(len, limits)) < 255 else np.uint16 if max(map(len, limits)) < 65535 else np.uint32
    first = np.flatnonzero(col["id"] == 0)
    offset = np.repeat(first, np.diff(np.append(first, t.num_rows)))
    # a level of all trees at a time: where every node's children go
    old, left, depth = [first], np.zeros(t.num_rows, np.int64), np.zeros(len(first), int)
    begin, level, tree = 0, first, np.arange(len(first))
    while len(level):
        inner = col["featureIndex"][level] >= 0
        number = begin + np.arange(len(level))
        left[number[~inner]] = number[~inner]
        begin += len(level)
        left[number[inner]] = begin + 2 * np.arange(inner.sum())
        up = level[inner]
        level = np.stack([offset[up] + col["leftChild"][up], offset[up] + col["rightChild"][up]], 1).ravel()
        tree = np.repeat(tree[inner], 2)
        depth[np.unique(tree)] += 1
        old.append(level)
    order = np.concatenate(old)
    feature = col["featureIndex"][order]
    limit = np.full(t.num_rows, np.iinfo(kind).max, kind)
    for f, values in enumerate(limits):
        at = feature == f
        limit[at] = np.searchsorted(values, col["at"][order][at])
    return Scorer(list(inputs), limits, np.arange(len(first)), np.maximum(feature, 0).astype(np.int16), limit, left.astype(np.int32), share[order], depth)


STRIP = 8192  # rows that a tree scores at once


def votes(s: Scorer, x: list[np.ndarray]) -> np.ndarray:
    """Rows x classes: the trees' class shares added up, in their order as Spark ML does."""
    n = len(x[0])
    code = np.empty((n, len(x)), s.limit.dtype)
    for f, values in enumerate(s.limits):
        # x <= values[k] exactly where its code is at most k; NaN goes right
        code[:, f] = np.searchsorted(values, x[f])
    feature, left = s.feature.astype(np.int64), s.left.astype(np.int64)
    out = np.zeros((n, s.share.shape[1]))
    for lo in range(0, n, STRIP):
        flat, mine = code[lo:lo + STRIP].ravel(), out[lo:lo + STRIP]
        base = np.arange(len(mine)) * len(x)
        node, where, child = (np.empty(len(mine), np.int64) for _ in range(3))
        here, top = np.empty(len(mine), code.dtype), np.empty(len(mine), code.dtype)
        for root, depth in zip(s.root, s.depth):
            node.fill(root)
            for _ in range(depth):
                np.take(feature, node, out=where, mode="clip")
                where += base
                np.take(flat, where, out=here, mode="clip")
                np.take(s.limit, node, out=top, mode="clip")
                np.take(left, node, out=child, mode="clip")
                np.add(child, here > top, out=node)
            mine += s.share[node]
    return out


def scored(s: Scorer, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction`` and ``fraud_probability`` (of class 1), the values that the stored model gives."""
    def run(*columns: pa.Array) -> pa.Array:
        found = votes(s, [c.to_numpy(zero_copy_only=False) for c in columns])
        return pa.StructArray.from_arrays([pa.array(found.argmax(1).astype(np.int32)), pa.array(found[:, 1] / found.sum(1))], ["prediction", "p"])

    # a result that is filtered on must not be computed twice
    vote = F.arrow_udf(run, "prediction int, p double").asNondeterministic()
    out = df.withColumn("_vote", vote(*[F.col(c).cast("double") for c in s.inputs]))
    return out.withColumns({"prediction": F.col("_vote.prediction"), "fraud_probability": F.col("_vote.p")}).drop("_vote")
