"""SimHash near-duplicates with the generalised pigeonhole principle.

1. Each text gets a 64-bit fingerprint over its word shingles.  Equal
   fingerprints are one class from then on, so a large group of copies is
   one row of the search.
2. The 64 bits are cut into ``m`` partitions, correlated bits together.
   With partition thresholds t_i that sum to ``max_bits - m + 1`` (t_i = -1:
   partition unused) every pair within ``max_bits`` has a partition i in
   which it differs in at most t_i bits.  Thresholds (and m) come from a
   dynamic programme over estimated candidate counts; the estimate uses a
   bounded sample of fingerprints and only steers cost, never the result.
3. Every fingerprint is indexed under its bits of each used partition and
   probes all keys within t_i bits.  Rows that meet under a key are verified
   on all 64 bits.  A key with more than ``cell_rows`` rows is dealt over
   cells (pairs of chunks), so no task holds an unbounded key, and each cell
   emits a spanning star per linked set instead of all pairs.
4. Components of the links, smallest doc_id of each.

Defined results: null or word-less text -> fingerprint zero, linked like any
other; a text shorter than the shingle is one shingle; null doc_id rows take
part and are named by a component only when it holds no other id (then
component_id is null); repeated rows repeat in the result; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.graph import components
from tidewater.session import materialize

SAMPLE = 1024


# ------------------------------------------------------------ fingerprints
def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash: bit set when set in over half of the shingle hashes (XXH64, seed 42)."""
    w = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i:i + words]), 42) for i in range(at, min(n, at + 65536))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """(id_col, fp long): the unsigned fingerprint's bits as a signed long."""
    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), words) for t in batch], np.uint64).view(np.int64), pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text)).alias(out))


# ---------------------------------------------------------------- planning
def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Cut 64 bits into ``m`` partitions, growing each by the free bit most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(0) if len(bits) else 0
    norm = np.sqrt((bits * bits).sum(0)) + 1e-9
    corr = np.abs(bits.T @ bits) / norm[:, None] / norm[None]
    free, out = list(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        part = [free.pop(0)]
        while len(part) < width:
            best = max(free, key=lambda b: (round(float(corr[b, part].sum()), 9), -b))
            free.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def plan(sample: np.ndarray, n: int, max_bits: int) -> list[tuple[int, tuple[int, ...], int]]:
    """Partitions to use: (mask, bits, threshold), the cheapest over all m and threshold allocations.

    Cost: rows written (index and probe keys) plus the estimated pairs to
    verify, a pair counting as 1/200 of a row.
    """
    i, j = np.triu_indices(len(sample), 1)
    best_cost, best = math.inf, []
    for m in range(1, max_bits + 2):
        parts = group_bits(sample, m)
        total = max_bits - m + 1
        cost = []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            apart = np.bitwise_count((sample[i] ^ sample[j]) & mask)
            row = {-1: 0.0}
            for t in range(total + 1 + (m - 1)):
                if t > 2 and len(part) > 16:
                    break
                probes = sum(math.comb(len(part), d) for d in range(1, t + 1)) / 2
                chance = sum(math.comb(len(part), d) for d in range(t + 1)) / 2.0 ** len(part)
                seen = float((apart <= t).mean()) if len(apart) else 0.0
                row[t] = n * (1 + probes) + n * n / 2 * (chance + seen) / 200
            cost.append(row)
        table = {0: (0.0, [])}  # sum of thresholds so far -> (cost, thresholds)
        for row in cost:
            table = {s: min((c + row[t], [*ts, t]) for s0, (c, ts) in table.items() for t in row if s0 + t == s)
                     for s in {s0 + t for s0 in table for t in row}}
        if total in table and table[total][0] < best_cost:
            best_cost = table[total][0]
            best = [(sum(1 << b for b in p), tuple(p), t) for p, t in zip(parts, table[total][1]) if t >= 0]
    return best


# ------------------------------------------------------------------- links
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes(p: int, key: Column, flips: list[int]) -> Column:
    """Probe entries of partition ``p``: the keys above ``key`` that differ from it by one of ``flips``.

    The lambdas take one parameter: PySpark passes the array index to a second one, also when it has a default.
    """
    others = F.transform(F.array(*[F.lit(_signed(f)) for f in flips]), lambda f: key.bitwiseXOR(f))
    return F.transform(F.filter(others, lambda o: o > key),
                       lambda o: F.struct(F.lit(p).alias("part"), o.alias("key"), F.lit(True).alias("probe")))


def _keys(fps: DataFrame, partitions) -> DataFrame:
    """(part, key, fp, probe): every fingerprint under its own key and, for t > 0, under larger keys within t bits."""
    entries = []
    for p, (mask, bits, t) in enumerate(partitions):
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        entries.append(F.array(F.struct(F.lit(p).alias("part"), key.alias("key"), F.lit(False).alias("probe"))))
        flips = [sum(1 << b for b in c) for d in range(1, min(t, len(bits)) + 1) for c in combinations(bits, d)]
        if flips:
            entries.append(_probes(p, key, flips))
    return fps.select("fp", F.explode(F.concat(*entries)).alias("e")).select("e.part", "e.key", "fp", "e.probe")


def _stars(fp: np.ndarray, probe: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the link graph inside one cell, by breadth-first search over row blocks."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for s in range(0, len(front), 256):
                f = front[s:s + 256]
                near = np.bitwise_count(fp[f][:, None] ^ fp[left][None]) <= max_bits
                near &= ~(probe[f][:, None] & probe[left][None])
                hit |= near.any(0)
            front, left = left[hit], left[~hit]
            a += [fp[root]] * len(front)
            b += fp[front].tolist()
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _verify(max_bits: int):
    def close(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cell, fp, probe = cols
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(first, len(cell)))
        small = np.repeat(size <= 32, size)
        c, f, pr = cell[small], fp[small], probe[small]
        A, B = [], []
        for lag in range(1, 32):
            at = np.flatnonzero(c[lag:] == c[:-lag]) if len(c) > lag else np.zeros(0, int)
            if not len(at):
                break
            at = at[(np.bitwise_count(f[at] ^ f[at + lag]) <= max_bits) & ~(pr[at] & pr[at + lag])]
            A.append(f[at])
            B.append(f[at + lag])
        for s, n in zip(first[size > 32], size[size > 32]):
            x, y = _stars(fp[s:s + n], probe[s:s + n], max_bits)
            A.append(x)
            B.append(y)
        return np.concatenate(A or [np.zeros(0, np.uint64)]), np.concatenate(B or [np.zeros(0, np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64),
                    batch.column(2).to_numpy(zero_copy_only=False)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.searchsorted(cols[0], cols[0][-1], side="left")  # rows are sorted by cell number
            held = [x[last:] for x in cols]
            if last:
                yield _edges(*close([x[:last] for x in cols]))
        if held is not None and len(held[0]):
            yield _edges(*close(held))

    return run


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(fps: DataFrame, *, max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within ``max_bits``.

    ``fps`` holds distinct fingerprints and is read several times: pass a written table.
    """
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    partitions = plan(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), fps.count(), max_bits)
    keys = _keys(fps, partitions)
    hot = (keys.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
           .select("part", "key", F.ceil(F.col("n") / cell_rows).cast("int").alias("k")))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    cells = (keys.join(materialize(hot, "simhash-hot"), ["part", "key"], "left")
             .withColumn("o", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0)))
                                        .otherwise(F.sequence(F.lit(0), F.col("k") - 1))))
             .withColumn("c", F.coalesce(own, F.lit(0)))
             # equal (part, key, chunk pair) <=> equal cell number up to 64-bit hash collisions, which cost a comparison only
             .select(F.xxhash64("part", "key", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "fp", "probe"))
    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_verify(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3,
                    max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """(doc_id, fp long, component_id): one row per input row."""
    rows = materialize(fingerprints(docs, id_col=id_col, text=text, words=words), "simhash-docs")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits=max_bits, cell_rows=cell_rows))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(least, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 3,
             cell_rows: int = 4096) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: its smallest (id, text hash); columns unchanged.

    Rows that agree in id and text are one document, of which the least row
    is kept.  A null id sorts last.
    """
    mark = docs.select(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"),
                                F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).alias("_mark"), F.col(text).alias("_t"))
    rows = materialize(fingerprints(mark, id_col="_mark", text="_t", words=words), "simhash-docs")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits=max_bits, cell_rows=cell_rows))
    kept = (classes.join(roots, classes["fp"] == roots["node"], "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("m"))
            .select(F.col("m.i").alias("_sh_i"), F.col("m.h").alias("_sh_h")))
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    joined = docs.withColumn("_sh_t", h).join(
        kept, F.col(id_col).eqNullSafe(F.col("_sh_i")) & (F.col("_sh_t") == F.col("_sh_h")), "inner")
    whole = F.struct(*[F.col(f"`{c}`") for c in sorted(docs.columns, key=lambda c: c == text)])  # the text, which is the same, last
    return (joined.groupBy("_sh_i", "_sh_h").agg(F.min(whole).alias("_sh_row"))
            .select(*[F.col("_sh_row").getField(c).alias(c) for c in docs.columns]))
