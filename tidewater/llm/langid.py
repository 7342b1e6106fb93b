"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label.  Emission features are character
trigrams (with word ends), three-letter prefixes and suffixes and the word
itself (lexicon), all hashed into fixed tables; label transitions are
learned.  Forward-backward gives each word's label marginals and the text's
language is the label with the largest summed marginal.

Training: a bounded sample of ``max_windows_per_lang`` word windows per
language (chosen by text hash, one window per distinct text, at a hashed
position) is concatenated into code-switched sequences, so that the
transition weights see language changes inside a sequence.  Sampling looks
at all labelled rows; only the chosen windows reach the driver.

Defined results: null text or text without letters -> ``und`` with score
0.0; empty table -> no rows; without any labelled row every text is ``und``;
repeated rows are predicted alike; ties go to the language first in code
point order.  Memory in a task follows one slice of texts (see
``textvec``); long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.textvec import Words, scan, slices, word_hashes

TABLE_BITS = {"gram": 16, "prefix": 14, "suffix": 14, "lexicon": 16}
_BLOCK = 128


# ---------------------------------------------------------------- features
def _slot(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    h = a * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35) + c * np.uint32(0x27D4EB2F)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)


def features(w: Words) -> dict[str, np.ndarray]:
    """Table slots: one per word and table, for ``gram`` one per letter."""
    c, s, n = np.concatenate([w.codes, np.zeros(3, np.uint32)]), w.start, w.length
    offset = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(s - offset, n)
    zero = np.uint32(0)
    before = np.where(at > 0, c[at - 1], zero)
    e = s + n - 1
    return {
        "gram": _slot(before, c[at], c[at + 1], TABLE_BITS["gram"]),
        "prefix": _slot(c[s], np.where(n > 1, c[s + 1], zero), np.where(n > 2, c[s + 2], zero), TABLE_BITS["prefix"]),
        "suffix": _slot(c[e], np.where(n > 1, c[e - 1], zero), np.where(n > 2, c[e - 2], zero), TABLE_BITS["suffix"]),
        "lexicon": (word_hashes(w) >> np.uint64(64 - TABLE_BITS["lexicon"])).astype(np.uint32),
        "_offset": offset,
    }


def emissions(model: dict, f: dict) -> np.ndarray:
    """Label scores per word (words x labels); trigram scores are averaged over the word."""
    size = np.diff(np.append(f["_offset"], len(f["gram"])))[:, None]
    e = np.add.reduceat(model["gram"][f["gram"]], f["_offset"], axis=0) / size
    for t in ("prefix", "suffix", "lexicon"):
        e += model[t][f[t]]
    return e


# ---------------------------------------------------------------- training
def _padded_marginals(e: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Marginals and summed pair marginals of equally long sequences (S x T x L)."""
    S, T, L = e.shape
    p = np.exp(e - e.max(2, keepdims=True))
    A, pi = np.exp(trans), np.exp(start)
    alpha, beta = np.empty_like(p), np.ones_like(p)
    alpha[:, 0] = pi * p[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, T):
        a = (alpha[:, t - 1] @ A) * p[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((L, L))
    for t in range(T - 2, -1, -1):
        nxt = p[:, t + 1] * beta[:, t + 1]
        joint = alpha[:, t][:, :, None] * A * nxt[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = nxt @ A.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    m = alpha * beta
    return m / m.sum(2, keepdims=True), pairs


def train(windows: list[tuple[str, str]], *, steps: int = 60, length: int = 64, l2: float = 1e-4, seed: int = 7) -> dict:
    """Fit the CRF on (language, window text) pairs by full-batch Adam on the log-likelihood."""
    langs = sorted({lang for lang, _ in windows})
    model = {"langs": langs}
    L = len(langs)
    for t, bits in TABLE_BITS.items():
        model[t] = np.zeros((1 << bits, L), np.float32)
    model["trans"], model["start"] = np.zeros((L, L)), np.zeros(L)
    windows = sorted(windows)
    w = scan([t for _, t in windows], "alpha")
    if L < 2 or not len(w.start):
        return model
    rng = np.random.default_rng(seed)
    label_of = np.array([langs.index(lang) for lang, _ in windows])[w.doc]
    # pieces of 4 to 32 words, shuffled and joined: neighbours often differ in language
    pieces, i = [], 0
    cut = np.flatnonzero(np.diff(w.doc)) + 1
    for part in np.split(np.arange(len(w.start)), cut):
        i = 0
        while i < len(part):
            k = int(rng.integers(4, 33))
            pieces.append(part[i:i + k])
            i += k
    order = np.concatenate([pieces[j] for j in rng.permutation(len(pieces))])
    S = max(1, len(order) // length)
    T = min(length, len(order))
    order = order[:S * T]
    y = label_of[order].reshape(S, T)
    f = features(w)
    n = w.length[order]
    letter = np.arange(int(n.sum())) + np.repeat(f["_offset"][order] - (np.cumsum(n) - n), n)
    g = {"gram": f["gram"][letter], "_offset": np.cumsum(n) - n}
    g |= {t: f[t][order] for t in ("prefix", "suffix", "lexicon")}
    hot = np.eye(L)[y]
    seen_pairs = np.zeros((L, L))
    np.add.at(seen_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    names = [*TABLE_BITS, "trans", "start"]
    m1 = {k: np.zeros(model[k].shape, np.float32) for k in names}
    m2 = {k: np.zeros(model[k].shape, np.float32) for k in names}
    for step in range(1, steps + 1):
        marg, pairs = _padded_marginals(emissions(model, g).reshape(S, T, L).astype(float), model["trans"], model["start"])
        diff = (marg - hot).reshape(-1, L)
        grad = {"trans": (pairs - seen_pairs) / len(order), "start": (marg[:, 0] - hot[:, 0]).sum(0) / len(order)}
        per_letter = np.repeat(diff / n[:, None], n, axis=0)
        for t, bits in TABLE_BITS.items():
            d, slot = (per_letter, g["gram"]) if t == "gram" else (diff, g[t])
            grad[t] = np.stack([np.bincount(slot, d[:, k], 1 << bits) for k in range(L)], 1) / len(order)
        for k in names:
            gr = grad[k] + l2 * model[k] / max(1, S)
            m1[k] = 0.9 * m1[k] + 0.1 * gr
            m2[k] = 0.99 * m2[k] + 0.01 * gr * gr
            model[k] = model[k] - 0.2 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
    for t in TABLE_BITS:
        model[t] = model[t].astype(np.float32)
    return model


# --------------------------------------------------------------- inference
def _chain(p: np.ndarray, reset: np.ndarray, A: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normalised forward messages of one long chain that restarts where ``reset`` is set.

    The chain is cut into blocks: transfer matrices of all blocks are built
    side by side, block inputs are passed along, then messages are filled in
    side by side.  Exact, and the number of numpy steps does not depend on
    how long single texts are.
    """
    n, L = p.shape
    nb = -(-n // _BLOCK)
    pad = nb * _BLOCK - n
    p = np.concatenate([p, np.ones((pad, L), p.dtype)]).reshape(nb, _BLOCK, L)
    r = np.concatenate([reset, np.zeros(pad, bool)]).reshape(nb, _BLOCK)
    M = np.broadcast_to(np.eye(L, dtype=p.dtype), (nb, L, L)).copy()
    for s in range(_BLOCK):
        N = (M.reshape(-1, L) @ A).reshape(nb, L, L)
        N[r[:, s]] = first
        N *= p[:, s, None, :]
        M = N / N.sum((1, 2), keepdims=True)
    into, a = np.empty((nb, L), p.dtype), first / first.sum()
    for b in range(nb):
        into[b] = a
        a = a @ M[b]
        a = a / a.sum()
    out = np.empty_like(p)
    a = into
    for s in range(_BLOCK):
        a = a @ A
        a[r[:, s]] = first
        a = a * p[:, s]
        a = a / a.sum(1, keepdims=True)
        out[:, s] = a
    return out.reshape(-1, L)[:n]


def word_marginals(model: dict, w: Words) -> np.ndarray:
    """Forward-backward label marginals of every word (float64, words x labels)."""
    e = emissions(model, features(w)).astype(np.float64)
    p = np.exp(e - e.max(1, keepdims=True))
    A, pi = np.exp(model["trans"]), np.exp(model["start"])
    starts = np.append(True, np.diff(w.doc) != 0)
    ends = np.append(np.diff(w.doc) != 0, True)
    alpha = _chain(p, starts, A, pi)
    # the same recursion on the reversed chain holds p * beta; dividing by p leaves beta
    back = _chain(p[::-1], ends[::-1], A.T, np.ones(len(pi)))[::-1]
    m = alpha * back / np.maximum(p, 1e-300)
    return m / m.sum(1, keepdims=True)


def predict_texts(model: dict, texts: list) -> tuple[list, list]:
    """Language and score of each text."""
    langs, out_lang, out_score = model["langs"], [], []
    for run in slices(texts):
        w = scan(run, "alpha")
        lang, score = ["und"] * len(run), [0.0] * len(run)
        if len(w.start) and langs:
            m = word_marginals(model, w)
            first = np.flatnonzero(np.append(True, np.diff(w.doc) != 0))
            mean = np.add.reduceat(m, first, axis=0) / np.diff(np.append(first, len(w.doc)))[:, None]
            for d, k, v in zip(w.doc[first].tolist(), mean.argmax(1).tolist(), mean.max(1).tolist()):
                lang[d], score[d] = langs[k], min(1.0, max(0.0, v))
        out_lang += lang
        out_score += score
    return out_lang, out_score


def training_windows(docs: DataFrame, usable: Column, *, text: str = "text", lang: str = "lang",
                     max_windows_per_lang: int = 600, words: int = 48) -> list[tuple[str, str]]:
    """At most ``max_windows_per_lang`` (lang, window) pairs per language, chosen by text hash among all usable rows."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    # copies share a hash and are kept or dropped together, so the rate is one of distinct texts
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count_distinct(F.xxhash64("_text")).alias("n")).collect()}
    if not counts:
        return []
    scale = 1 << 30
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        rate = min(scale, 4 * max_windows_per_lang * scale // n + 1)
        keep = keep | ((F.col("_lang") == F.lit(value)) & (F.pmod(F.col("_h"), F.lit(scale)) < F.lit(rate)))
    parts = F.split("_text", r"[\x20\x09-\x0D]+", -1)
    at = F.when(F.size("_w") > words, F.pmod(F.col("_h"), F.size("_w") - words + 1)).otherwise(0).cast("int")
    best = Window.partitionBy("_lang").orderBy("_h")
    chosen = (rows.withColumn("_h", F.xxhash64("_text")).where(keep).dropDuplicates(["_lang", "_h"])
              .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= max_windows_per_lang)
              .withColumn("_w", parts).select("_lang", F.array_join(F.slice("_w", at + 1, words), " ").alias("_t")))
    return [(r["_lang"], r["_t"]) for r in chosen.collect()]


def fit(docs: DataFrame, usable: Column, *, text: str = "text", lang: str = "lang", **kw) -> dict:
    """Train on the rows where ``usable`` holds."""
    return train(training_windows(docs, usable, text=text, lang=lang, **kw))


def predict(docs: DataFrame, model: dict, *, text: str = "text", out: str = "_lid") -> DataFrame:
    """Add struct column ``out`` (lang string, score double).  The broadcast model has a fixed size per language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lang, score = predict_texts(shared.value, batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return docs.withColumn(out, label.asNondeterministic()(F.col(text)))
