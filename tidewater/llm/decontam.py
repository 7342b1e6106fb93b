"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

1. Items and documents become word sequences (lower case, letters and
   digits), words as 64-bit hashes.
2. How rare an n-gram of an item is, is told by its surroundings: a first pass
   over the documents counts, per n-gram, the different words ``ASIDE`` words
   before it and those as far after it; the lesser number counts.  Copies of
   one passage, however many, have the same surroundings and leave it rare
   (at an end of the passage on one side still); an n-gram of a stock phrase
   has different ones in every text.  n-grams that the corpus holds with at
   most ``RARE`` surroundings are seeds.  Every run of ``LONG`` words of an
   item with a commoner n-gram in it is a seed as well; an item of fewer
   words keeps its n-grams.  So every stretch of an item that the corpus may
   hold has a seed, and a stock phrase alone pairs nothing.
3. A second pass cuts passages out of the documents: the words within the
   longest item's reach of a seed.  Neighbouring hits share a passage; one
   passage holds the hits of at most ``reach`` words, so it is never longer
   than about three times that.  Only passages leave the task.
4. Passages meet items in a shuffle join on the seed; a seed with many hits is
   dealt over several keys.  A (passage, item) pair whose common words cannot
   add up to ``min_score`` goes; each other one is
   aligned once with Smith-Waterman over words (match 2, mismatch and gap -1),
   which scores edited and paraphrased copies.  Score: best local alignment
   over the item's self-alignment, 0 to 1.  A region is found when it scores
   ``min_score`` and holds a seed of the item.

Both passes test words against Bloom filters of ``BITS_PER_GRAM`` bits per
n-gram, of at most ``BLOOM_BITS`` bits: the only thing sent to every task.

Defined results: null or empty texts and items shorter than ``n`` words match
nothing; a null doc_id or item_id is reported as null; repeated rows and
several passages of one document give one row per (doc_id, item_id), the best
(ties: first in the text); empty tables give no rows; extra columns are not
read (``drop_contaminated`` passes them through).  Texts are processed whole;
memory follows one slice of texts and one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textvec import ngram_hashes, scan, slices, word_hashes
from tidewater.session import materialize

N = 3
LONG = 8
RARE = 16
ASIDE = 5
MIN_SCORE = 0.5
BITS_PER_GRAM = 512         # so that about one in 60,000 other n-grams passes
BLOOM_BITS = 1 << 28        # at most 32 MB
SEED_ROWS = 4096            # hits of one seed that meet its items under one key
MATCH, MISMATCH, GAP = 2, -1, -1


# ------------------------------------------------------------------ bloom
def _bloom(grams: DataFrame) -> np.ndarray:
    """Bit words of a filter of two slots per n-gram; what reaches the driver is bounded by BLOOM_BITS."""
    bits = min(BLOOM_BITS, max(1 << 20, 1 << int(BITS_PER_GRAM * grams.count()).bit_length()))
    slots = F.array(F.col("gram").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(bits - 1)))
    rows = (grams.select(F.explode(slots).alias("s"))
            .groupBy(F.shiftright("s", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow())
    words = np.zeros(bits // 64, np.uint64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return words


def _maybe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    m = np.uint64(len(words) * 64 - 1)
    bit = lambda s: (words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)
    hit = bit(h & m).astype(bool)
    hit[hit] = bit((h[hit] >> np.uint64(32)) & m).astype(bool)
    return hit


# ------------------------------------------------------------------ items
def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, words array<long>): word hashes of each distinct item."""
    @F.arrow_udf("array<long>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                out.append(word_hashes(scan([t], "alnum")).view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    key = F.concat_ws(":", F.col(item_id).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return benchmark.select(key.alias("item"), F.col(item_id).alias("item_id"), words(F.col(text)).alias("words")).dropDuplicates(["item"])


def _grams(items: DataFrame, n: int) -> DataFrame:
    """(item, gram) with repeats inside an item removed."""
    @F.arrow_udf("array<long>")
    def grams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for w in batch:
                h = np.array(w.as_py(), np.int64).view(np.uint64)
                out.append(np.unique(ngram_hashes(h, np.zeros(len(h), np.int64), n)[0]).view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    return items.select("item", F.explode(grams(F.col("words"))).alias("gram"))


# ------------------------------------------------------------------ seeds
def _surroundings(docs: DataFrame, bloom: np.ndarray, n: int) -> DataFrame:
    """(gram, kinds): different surroundings in the corpus of each n-gram that may be in the filter.

    A task passes on at most RARE + 1 different ones of an n-gram, side and
    batch, which tells rare from common as well as all of them would.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch.column(0).to_pylist()):
                w = scan(run, "alnum")
                h = word_hashes(w)
                g, first = ngram_hashes(h, w.doc, n)
                hit = _maybe(shared.value, g)
                g, first = g[hit], first[hit]
                if not len(g):
                    continue
                for side, at in ((0, first - ASIDE), (1, first + n - 1 + ASIDE)):
                    inside = np.clip(at, 0, len(h) - 1)
                    word = np.where((inside == at) & (w.doc[inside] == w.doc[first]), h[inside], np.uint64(0))  # 0: the text ends before
                    pairs = np.unique(np.stack([g, word], 1), axis=0)
                    begin = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
                    place = np.arange(len(pairs)) - np.repeat(begin, np.diff(np.append(begin, len(pairs))))
                    pairs = pairs[place <= RARE].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(np.full(len(pairs), side, np.int32)),
                                                      pa.array(pairs[:, 1].copy())], ["gram", "side", "word"])

    seen = docs.select("_text").mapInArrow(around, "gram long, side int, word long").distinct()
    return seen.groupBy("gram", "side").agg(F.count("*").alias("kinds")).groupBy("gram").agg(F.min("kinds").alias("kinds"))


def _seeds(items: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(item, gram): the seeds of every item; grams of ``n`` or ``LONG`` words."""
    grams = materialize(_grams(items, n), "decontam-grams")
    kinds = _surroundings(docs, _bloom(grams.select("gram").distinct()), n)
    found = materialize(grams.join(kinds, "gram"), "decontam-found-grams")  # n-grams that no document holds are no seeds
    short = items.where(F.size("words") < LONG).select(F.col("item").alias("s_item"))
    rare = found.where(F.col("kinds") <= RARE).select("item", "gram")
    kept = found.where(F.col("kinds") > RARE).join(short, F.col("item") == F.col("s_item")).select("item", "gram")
    stock = found.where(F.col("kinds") > RARE).groupBy("item").agg(F.collect_set("gram").alias("stock"))  # no more than an item has words

    @F.arrow_udf("array<long>")
    def long_grams(words: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for all_words, stocks in words:
            out = []
            for w, common in zip(all_words, stocks):
                h = np.array(w.as_py(), np.int64).view(np.uint64)
                none = np.zeros(len(h), np.int64)
                usual = np.isin(ngram_hashes(h, none, n)[0].view(np.int64), np.array(common.as_py(), np.int64))
                size = LONG - n + 1
                holds = np.convolve(usual, np.ones(size, np.int64), "valid") > 0 if len(usual) >= size else np.zeros(0, bool)
                out.append(np.unique(ngram_hashes(h, none, LONG)[0][:len(holds)][holds]).view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    longer = items.select("item", "words").join(stock, "item").select("item", F.explode(long_grams(F.col("words"), F.col("stock"))).alias("gram"))
    return rare.unionByName(kept).unionByName(longer)


# --------------------------------------------------------------- passages
def _passages(docs: DataFrame, bloom: np.ndarray, n: int, reach: int) -> DataFrame:
    """(doc_id, doc_hash, at, words, grams): passages around possible seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            texts = batch.column(2).to_pylist()
            src, at, words, grams = [], [], [], []
            for run in slices(texts):
                w = scan(run, "alnum")
                h = word_hashes(w)
                both = [ngram_hashes(h, w.doc, k) for k in (n, LONG)]
                g, first = (np.concatenate([x[i] for x in both]) for i in (0, 1))
                hit = _maybe(shared.value, g)
                g, first = g[hit], first[hit]
                order = np.argsort(first, kind="stable")
                g, first = g[order], first[order]
                lo = np.searchsorted(w.doc, np.arange(len(run)), "left")
                hi = np.searchsorted(w.doc, np.arange(len(run)), "right")
                d, s = w.doc[first], 0
                while s < len(first):
                    # the hits of one document within `reach` words of the first of them
                    k = d[s]
                    e = int(np.searchsorted(first, min(first[s] + reach, hi[k] - 1), "right"))
                    a, b = max(lo[k], first[s] - reach), min(hi[k], first[e - 1] + LONG + reach)
                    src.append(row + int(k))
                    at.append(int(a - lo[k]))
                    words.append(h[a:b].view(np.int64))
                    grams.append(np.unique(g[s:e]).view(np.int64))
                    s = e
                row += len(run)
            take = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64()),
                 pa.array(words, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))],
                ["doc_id", "doc_hash", "at", "words", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "doc_hash", "_text").mapInArrow(
        cut, f"doc_id {kind}, doc_hash long, at long, words array<long>, grams array<long>")


def _meetings(passages: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, at, item): passages and items with a common seed; a seed of many hits is dealt over several keys."""
    hits = passages.select("doc_id", "doc_hash", "at", F.explode("grams").alias("gram"))
    many = (hits.groupBy("gram").agg(F.ceil(F.count("*") / F.lit(SEED_ROWS)).cast("int").alias("deal")).where("deal > 1")
            .select(F.col("gram").alias("m_gram"), "deal"))
    dealt = lambda df: df.join(many, F.col("gram") == F.col("m_gram"), "left").withColumn("deal", F.coalesce("deal", F.lit(1)))
    left = dealt(hits).withColumn("part", F.pmod(F.xxhash64("doc_hash", "at"), F.col("deal")).cast("int")).drop("m_gram", "deal")
    right = dealt(seeds).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))).drop("m_gram", "deal")
    return left.join(right, ["gram", "part"]).select("doc_id", "doc_hash", "at", "item").distinct()


# -------------------------------------------------------------- alignment
def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of ``a`` against ``b`` and the half-open span of ``b`` it covers."""
    def best(a, b):
        # row by row; a gap along the row is a running maximum of (score + gap cost so far)
        ramp = -GAP * np.arange(len(b))
        row, top, end_a, end_b = np.zeros(len(b) + 1, np.int64), 0, 0, 0
        for i, x in enumerate(a):
            t = np.maximum(np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP), 0)
            row[1:] = np.maximum.accumulate(t + ramp) - ramp
            j = int(row[1:].argmax())
            if row[j + 1] > top:
                top, end_a, end_b = int(row[j + 1]), i + 1, j + 1
        return top, end_a, end_b

    if not len(a) or not len(b):
        return 0, 0, 0
    top, ea, eb = best(a, b)
    if not top:
        return 0, 0, 0
    _, _, back = best(a[:ea][::-1], b[:eb][::-1])
    return top, eb - back, eb


def _score(pairs: DataFrame, min_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i in range(batch.num_rows):
                item = np.array(batch.column(4)[i].as_py(), np.int64)
                passage = np.array(batch.column(5)[i].as_py(), np.int64)
                if np.isin(item, passage).sum() / len(item) < min_score:  # each match needs one of these words
                    continue
                s, lo, hi = align(item, passage)
                score = s / (MATCH * len(item))
                if score >= min_score:
                    at = batch.column(3)[i].as_py()
                    keep.append(i)
                    out.append((score, at + lo, at + hi))
            take = pa.array(keep, pa.int64())
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in range(3)] + cols,
                                             ["doc_id", "doc_hash", "item_id", "score", "start_word", "end_word"])

    kinds = {f: pairs.schema[f].dataType.simpleString() for f in ("doc_id", "item_id")}
    return pairs.select("doc_id", "doc_hash", "item_id", "at", "words", "passage").mapInArrow(
        run, f"doc_id {kinds['doc_id']}, doc_hash long, item_id {kinds['item_id']}, score double, start_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", n: int = N, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, doc_hash, item_id, score, start_word, end_word): best alignment of each document and item that reaches ``min_score``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("doc_hash"), F.col(text).alias("_text"))
    items = materialize(_items(benchmark, item_id, item_text), "decontam-items")
    seeds = materialize(_seeds(items, docs, n), "decontam-seeds")
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    passages = materialize(_passages(docs, _bloom(seeds.select("gram").distinct()), n, longest + longest // 4 + 8), "decontam-passages")
    key = ["doc_id", "doc_hash", "at"]
    met = _meetings(passages, seeds)
    p = passages.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("words").alias("passage"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("doc_hash") == F.col("_doc_hash")) & (F.col("at") == F.col("_at"))
    scored = _score(met.join(p, same).join(items, "item"), min_score)
    best = scored.groupBy("doc_id", "doc_hash", "item_id").agg(F.max(F.struct(
        F.col("score"), (-F.col("start_word")).alias("s"), F.col("end_word"))).alias("m"))
    return best.select("doc_id", "doc_hash", "item_id", "m.score", (-F.col("m.s")).alias("start_word"), "m.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents that hold an aligned passage; columns unchanged."""
    found = materialize(contaminated(docs, benchmark, id_col=id_col, text=text, **kw)
                        .select(F.col("doc_id").alias("_dc_id"), F.col("doc_hash").alias("_dc_h")).distinct(), "decontam-found")
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_dc_id")) & (h == F.col("_dc_h")), "left_anti")
