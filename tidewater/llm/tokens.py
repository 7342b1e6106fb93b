"""Token counts by a map-side two-tier lookup (sentencepiece models).

A pre-token is a stretch of text that no merge of the model crosses: runs of
spaces start one, and a character that no piece contains (line break, tab,
...) stands alone.  ``splits_at_spaces`` checks on the vocabulary that this
holds; for a model where it does not, whole texts are encoded.

Tier 1: frequent pre-tokens with their token counts, sent to every task; its
size is bounded by ``TABLE`` entries of at most ``MAX_CHARS`` characters.  They
are counted in about ``SAMPLE`` rows (each row is drawn or not by its place, so
copies weigh as they do in the corpus), where they lie: a task sends its
``TASK_TOP`` most frequent to the driver, which adds up the lists.  The sample
decides speed only; every text is counted whole.
Tier 2: other pre-tokens are encoded by the library and remembered in a
bounded cache of the worker.  Neither texts nor pre-tokens are shuffled.

Counts equal the library's for the whole text: no begin, end or added
tokens; special strings inside texts are ordinary text.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows
repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textvec import slices

TABLE = 32768
TASK_TOP = 1024
SAMPLE = 2048
MAX_CHARS = 48
CACHE = 300_000

#: one line break or tab; or spaces and what follows them up to the next space, break or tab; or leftover spaces
_UNIT = re.compile(r"[\n\t]|[ ▁]*[^ ▁\n\t]+|[ ▁]+")


def splits_at_spaces(model: sentencepiece.SentencePieceProcessor) -> bool:
    """No piece has a space mark after another character, or a line break or tab."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    shape = all(re.fullmatch(r"▁*[^▁\n\t ]*", p) for p in pieces)
    probe = " a  b\n c\n\td\te ▁f "
    return shape and len(model.encode(probe)) == sum(_length(model, u) for u in _UNIT.findall(" " + probe))


def _length(model, unit: str) -> int:
    """Tokens of one pre-token in the middle of a text (the library itself puts one space before what it encodes)."""
    if unit[0] in " ▁":
        # a lone space cannot be asked for directly: take it before a break
        return len(model.encode(unit[1:])) if len(unit) > 1 else len(model.encode("\n")) - _break(model)
    return len(model.encode("\n" + unit)) - len(model.encode("\n"))


def _break(model) -> int:
    return len(model.encode("\n\n")) - len(model.encode("\n"))


class TokenCounter:
    """Token counts of texts in one worker: the shared table, then the worker's cache, then the library."""

    def __init__(self, proto: bytes, table: dict[str, int]):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.by_unit = splits_at_spaces(self.model)
        self.table, self.cache = table, {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_unit:
            return len(self.model.encode(text))
        units = _UNIT.findall(" " + text)
        got = list(map(self.table.get, units))
        if None in got:
            cache, model = self.cache, self.model
            if len(cache) > CACHE:
                cache.clear()
            for i, g in enumerate(got):
                if g is None:
                    u = units[i]
                    n = cache.get(u)
                    if n is None:
                        n = _length(model, u)
                        if len(u) <= MAX_CHARS:
                            cache[u] = n
                    got[i] = n
        return sum(got)


def frequent(docs: DataFrame, text: str, *, table: int = TABLE, task_top: int = TASK_TOP, sample: int = SAMPLE) -> list[str]:
    """The most frequent short pre-tokens of a sample; at most ``task_top`` of a task with drawn rows reach the driver."""
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for run in slices(batch.column(0).to_pylist()):
                for t in run:
                    if t:
                        seen.update(_UNIT.findall(t))
                if len(seen) > 8 * task_top:  # keep the heavier half; what returns later starts again at its new count
                    seen = Counter(dict(seen.most_common(4 * task_top)))
        best = [(u, n) for u, n in seen.most_common(2 * task_top) if len(u) <= MAX_CHARS][:task_top]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["unit", "n"])

    every = max(1, docs.count() // sample)
    drawn = (docs.select(F.col(text).alias("t"), F.monotonically_increasing_id().alias("place"))
             .where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select("t"))
    total: Counter = Counter()
    lists = drawn.mapInArrow(tops, "unit string, n long").toArrow()
    for u, n in zip(lists["unit"].to_pylist(), lists["n"].to_pylist()):
        total[u] += n
    return [u for u, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:table]]


def token_count(docs: DataFrame, model_path: str, *, text: str = "text", table: int = TABLE) -> Column:
    """Column of token counts of ``text`` for the model file at ``model_path`` (read on the driver, sent by value)."""
    with open(model_path, "rb") as f:
        proto = f.read()
    counter = TokenCounter(proto, {})
    known = {u: _length(counter.model, u) for u in frequent(docs, text, table=table)} if counter.by_unit else {}
    shared = docs.sparkSession.sparkContext.broadcast((proto, known))

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TokenCounter(*shared.value)
        for batch in batches:
            yield pa.array([counter.count(t.as_py()) for t in batch], pa.int64())

    return tokens(F.col(text))


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row."""
    n = token_count(docs, model_path, text=text)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
                       n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
