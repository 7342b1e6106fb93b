"""Toxicity by cumulative-link ordinal regression.

The labels say toxic or not; severity grades follow from them: 0 not toxic, 2
toxic with more indicators (selected features that speak for toxicity) than
the median toxic text of the sample that has any, 1 other toxic texts.
P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector
for all grades and ordered thresholds; the expected severity is the sum of
these probabilities.  x: presence of the words (letters and digits, lower
case, as 64-bit hashes) that the fit selected.

The fit sees a bounded sample: at most ``max_rows`` labelled documents, half
of them toxic where there are enough, chosen by a hash over all labels and
weighted back to the label counts.  Features are selected among those in at
least ``min_docs`` sampled texts by the z-score of their log-odds; their
counts are summed in Spark, and only the selected features of sampled rows
reach the driver (at most ``max_rows`` x ``max_words`` short integers).  Every
document is scored over its whole text.

Defined results: null, empty or word-less texts are scored by the thresholds
alone; several labels of one document count as the largest ``toxic``; null
``toxic`` is no label; without labels of both kinds every severity is 0.0 and nothing is toxic;
a null doc_id is scored but not learned from; repeated rows repeat; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textvec import beginnings, scan, slices, word_hashes
from tidewater.session import materialize

MAX_ROWS = 12_000
MAX_WORDS = 4096
MIN_DOCS = 8
MIN_Z = 4.0
#: letters of the word beginnings, and marks that tell their hashes and those of repeated features from those of words
STEMS = (3, 4, 5, 6, 7)
BEGINNING = np.uint64(0x5BD1E9955BD1E995)
TWICE = np.uint64(0x2545F4914F6CDD1D)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of every labelled document."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
            .agg((F.max("toxic") > 0).alias("bad")))


def grades(bad: np.ndarray, words: list[list[int]], speaks: np.ndarray) -> np.ndarray:
    """Severity grade 0, 1 or 2 of each sampled text; ``speaks``: whether a selected word speaks for toxicity."""
    n = np.array([int(speaks[np.asarray(x, np.int64)].sum()) if x else 0 for x in words])
    have = n[bad & (n > 0)]
    return np.where(bad, np.where(n > (np.median(have) if len(have) else 0), 2, 1), 0)


def _hashes(run: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word and of every word beginning, kind by kind."""
    w = scan(run, "alnum")
    yield w.doc, word_hashes(w)
    yield from ((w.doc[at], h ^ BEGINNING) for at, h in beginnings(w, STEMS))


def _distinct_features(texts: list) -> list[np.ndarray]:
    out = []
    for run in slices(texts):
        parts = list(_hashes(run))
        doc, h = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(h) != 0))) if len(h) else np.zeros(0, np.int64)
        again = np.diff(np.append(first, len(h))) > 1
        doc, h = doc[first], h[first]
        cut = [np.searchsorted(d, np.arange(len(run) + 1), "left") for d in (doc, doc[again])]
        twice = h[again] ^ TWICE
        out += [np.concatenate([h[cut[0][i]:cut[0][i + 1]], twice[cut[1][i]:cut[1][i + 1]]]).view(np.int64) for i in range(len(run))]
    return out


def _feature_set(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(_distinct_features(batch.to_pylist()), pa.list_(pa.int64()))

    return words(text)


# --------------------------------------------------------------------- fit
def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[int, list[int]]], weight: np.ndarray, n_words: int, *, steps: int = 1500, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the two ordered thresholds by Adam on the weighted log-likelihood.

    theta_2 = theta_1 + exp(gap) keeps the thresholds ordered.
    """
    y = np.array([g for g, _ in rows])
    size = np.array([len(x) for _, x in rows])
    flat = np.concatenate([np.asarray(x, np.int64) for _, x in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), size)
    p = np.zeros(n_words + 2)
    p[-2:] = 2.0, 0.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    total = weight.sum()
    for step in range(1, steps + 1):
        eta = np.bincount(doc, p[:n_words][flat], len(rows))
        t1, t2 = p[-2], p[-2] + np.exp(p[-1])
        a, b = _sigmoid(eta - t1), _sigmoid(eta - t2)  # P(grade >= 1), P(grade >= 2)
        mid = np.maximum(a - b, 1e-9)
        # d log-likelihood / d (eta - t1) and / d (eta - t2)
        d1 = np.where(y == 0, -a, np.where(y == 1, a * (1 - a) / mid, 0.0))
        d2 = np.where(y == 2, 1 - b, np.where(y == 1, -b * (1 - b) / mid, 0.0))
        d1, d2 = -d1 * weight / total, -d2 * weight / total
        g = np.zeros_like(p)
        g[:n_words] = np.bincount(flat, (d1 + d2)[doc], n_words) + l2 * p[:n_words] / max(1, n_words) ** 0.5
        g[-2], g[-1] = -(d1 + d2).sum(), -(d2.sum()) * np.exp(p[-1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return p[:n_words], np.array([p[-2], p[-2] + np.exp(p[-1])])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS,
        max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> dict:
    """Model: sorted word hashes, their weights, thresholds, and the probability cut for ``toxic``."""
    none = {"words": np.zeros(0, np.int64), "weights": np.zeros(0), "theta": None, "cut": 1.0}
    known_ids = materialize(labelled(labels), "toxicity-labels")
    counts = {r["bad"]: r["n"] for r in known_ids.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return none
    n_toxic = min(counts[True], max_rows // 2)
    by_hash = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    part = lambda bad, n: known_ids.where(F.col("bad") == bad).orderBy(*by_hash).limit(n)
    sample = part(True, n_toxic).unionByName(part(False, max_rows - n_toxic))  # at most max_rows (id, label) pairs
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"))
            .join(F.broadcast(sample), "doc_id"))
    # equal texts are one example: toxic if any of them is labelled so, under their smallest id
    copy = F.xxhash64(F.coalesce("_text", F.lit("")))
    rows = rows.groupBy(copy.alias("copy")).agg(F.min("doc_id").alias("doc_id"), F.max("bad").alias("bad"), F.min("_text").alias("_text"))
    rows = materialize(rows.select("doc_id", "bad", _feature_set(F.col("_text")).alias("words")), "toxicity-sample")
    total = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return none
    p, n = F.col("p") + 0.5, F.col("n") - F.col("p") + 0.5
    np_, nn = total[True] + 1.0, total[False] + 1.0
    z = (F.log(p / (np_ - p)) - F.log(n / (nn - n))) / F.sqrt(1 / p + 1 / n)
    chosen = sorted((r["w"], r["z"]) for r in (
        rows.select(F.col("bad").cast("int").alias("t"), F.explode("words").alias("w")).groupBy("w")
        .agg(F.sum("t").alias("p"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
        .withColumn("z", z).where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "w").limit(max_words).collect()))
    words = np.array([w for w, _ in chosen], np.int64)
    speaks = np.array([z > 0 for _, z in chosen], bool)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("array<int>")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch:
                at, hit = _lookup(shared.value, np.array(x.as_py() or [], np.int64))
                out.append(at[hit].astype(np.int32))
            yield pa.array(out, pa.list_(pa.int32()))

    data = sorted((r["doc_id"], r["bad"], r["x"]) for r in rows.select("doc_id", "bad", known(F.col("words")).alias("x")).collect())
    weight = np.array([counts[b] / total[b] for _, b, _ in data])
    grade = grades(np.array([b for _, b, _ in data], bool), [x for _, _, x in data], speaks)
    w, theta = train([(int(g), x) for g, (_, _, x) in zip(grade, data)], weight, len(words))
    eta = np.array([w[np.asarray(x, np.int64)].sum() for _, _, x in data])
    cut = best_cut(_sigmoid(eta - theta[0]), grade > 0, weight)
    return {"words": words, "weights": w, "theta": theta, "cut": cut}


def _lookup(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each hash among the sorted ``words`` and whether it is there."""
    at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
    return at, (words[at] == h) if len(words) else np.zeros(len(h), bool)


def best_cut(p: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> float:
    """Probability between two neighbouring values that separates the sample with the best weighted F1."""
    value, group = np.unique(-p, return_inverse=True)  # largest probability first
    hit = np.cumsum(np.bincount(group, weight * bad, len(value)))
    wrong = np.cumsum(np.bincount(group, weight * ~bad, len(value)))
    f1 = 2 * hit / (hit + wrong + (weight * bad).sum())
    i = int(f1.argmax())
    return float(-(value[i] + value[min(i + 1, len(value) - 1)]) / 2)


# ------------------------------------------------------------------- score
def grade_probabilities(model: dict, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= 1) and P(grade >= 2) of each text."""
    if model["theta"] is None:
        return np.zeros(len(texts)), np.zeros(len(texts))
    known = model["words"].view(np.uint64)
    base = np.unique(np.concatenate([known, known ^ TWICE])).view(np.int64)  # what a selected feature may be made of
    base.sort()
    k = max(1, len(base))
    # weight of a feature that occurs, and what it adds when it occurs again
    once, again = (np.where(hit, model["weights"][at] if len(known) else 0.0, 0.0) for at, hit in (
        _lookup(model["words"], base), _lookup(model["words"], (base.view(np.uint64) ^ TWICE).view(np.int64))))
    etas = []
    for run in slices(texts):
        pairs = []
        for doc, h in _hashes(run):
            at, hit = _lookup(base, h.view(np.int64))
            pairs.append(doc[hit] * k + at[hit] if hit.any() else np.zeros(0, np.int64))
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        gain = once[pair % k] + np.where(times > 1, again[pair % k], 0.0) if len(pair) else None
        etas.append(np.bincount(pair // k, gain, len(run)))
    eta = np.concatenate(etas or [np.zeros(0)])
    return _sigmoid(eta - model["theta"][0]), _sigmoid(eta - model["theta"][1])


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """(doc_id, p_toxic, p_severe, severity, toxic) per row; ``threshold`` defaults to the model's own cut."""
    threshold = model["cut"] if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("a double, b double")
    def probs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            a, b = grade_probabilities(shared.value, batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["a", "b"])

    rows = docs.select(F.col(id_col).alias("doc_id"), probs.asNondeterministic()(F.col(text)).alias("p"))
    return rows.select("doc_id", F.col("p.a").alias("p_toxic"), F.col("p.b").alias("p_severe"),
                       (F.col("p.a") + F.col("p.b")).alias("severity"), (F.col("p.a") >= threshold).alias("toxic"))
