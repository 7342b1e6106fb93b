"""Document ingest: page tables, word-window chunking with overlap, chunk
numbering across the pages of a source, deterministic ids, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import uuid5
from tidewater.operators.common import join_null_safe, prefix_sum, spread
from tidewater.session import materialize

# Chunk size and overlap of the ingest splitter.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SENTENCE_END = r"""[.!?]["')\]]*$"""


def words(text: Column) -> Column:
    """Whitespace tokens of the whole text (empty tokens removed)."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != F.lit(""))


def chunk_starts(n_words: Column, size: int, overlap: int) -> Column:
    """Start offsets 0, step, 2*step, … (step = size - overlap), dropping a
    tail chunk that lies wholly inside the previous chunk's overlap."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    seq = F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0)), F.lit(step))
    return F.filter(seq, lambda s: (s == 0) | (s + overlap < n_words))


def chunk_text(df: DataFrame, text_col: str = "text", *, size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP, keep: list[str] | None = None,
               num_partitions: int | None = None) -> DataFrame:
    """One row per chunk: ``pos`` (0-based within the text) and ``text``.

    Row-local: arrays are built and exploded inside each task, so no
    shuffle is needed and each text is processed whole.  Empty texts give
    no chunks.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    # The word array is bound once as a lambda variable (``transform`` over a
    # one-element array): referenced by name, the optimizer could inline
    # the split into the per-chunk expression and redo it for every chunk.
    def chunks_of(w):
        texts = F.transform(chunk_starts(F.size(w), size, overlap),
                            lambda s: F.array_join(F.slice(w, s + 1, size), " "))
        return F.when(F.size(w) > 0, texts).otherwise(F.array().cast("array<string>"))

    c = spread(df, num_partitions).select(*keep, F.transform(F.array(words(F.col(text_col))), chunks_of)[0].alias("_c"))
    return c.select(*keep, F.posexplode("_c").alias("pos", "text"))


def _sentence_ends(w: Column, size: int) -> Column:
    """Word offsets at which a chunk may end: after a word that closes a sentence, and every ``size`` words inside a longer one."""
    n = F.size(w)
    closes = F.transform(w, lambda x, i: F.when(x.rlike(SENTENCE_END) | (i == n - 1), i + 1))
    ends = F.filter(closes, lambda e: e.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    inside = lambda a, b: F.when(b - a > size, F.array_append(F.sequence(a + size, b - 1, F.lit(size)), b)).otherwise(F.array(b))
    return F.flatten(F.zip_with(starts, ends, inside))


def _packed(cuts: Column, size: int, overlap: int) -> Column:
    """Word ranges (s, e) of the chunks: a fold over the cuts that carries the open chunk and the cuts inside it."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.array().cast("array<int>").alias("open"), none.alias("done"))

    def step(a: Column, cut: Column) -> Column:
        full = cut - a["s"] > size
        # the next chunk begins with the last whole sentences that fit into the overlap and leave room for this one
        later = F.filter(a["open"], lambda o: (a["e"] - o <= overlap) & (cut - o <= size))
        s = F.when(full, F.array_min(later)).otherwise(a["s"])
        done = F.when(full, F.array_append(a["done"], F.struct(a["s"].alias("s"), a["e"].alias("e")))).otherwise(a["done"])
        return F.struct(s.alias("s"), cut.alias("e"), F.array_append(F.filter(a["open"], lambda o: o > s), cut).alias("open"), done.alias("done"))

    return F.aggregate(cuts, start, step, lambda a: F.when(a["e"] > a["s"], F.array_append(a["done"], F.struct(a["s"].alias("s"), a["e"].alias("e"))))
                       .otherwise(a["done"]))


def chunk_sentences(df: DataFrame, text_col: str = "text", *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    keep: list[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """One row per chunk of whole sentences: ``pos`` (0-based), ``n_words`` and ``text``.

    A chunk takes sentences while it has at most ``size`` words.  The next one
    repeats the last whole sentences of at most ``overlap`` words that leave
    room for the sentence that did not fit.  A sentence of more than ``size``
    words is cut every ``size`` words.  A sentence ends with a word that ends
    in ``.``, ``!`` or ``?`` (closing quotes and brackets may follow).  Row-local;
    empty texts give no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]

    def chunks_of(w: Column) -> Column:
        texts = F.transform(_packed(_sentence_ends(w, size), size, overlap), lambda r: F.struct(
            (r["e"] - r["s"]).alias("n_words"), F.array_join(F.slice(w, r["s"] + 1, r["e"] - r["s"]), " ").alias("text")))
        return F.when(F.size(w) > 0, texts).otherwise(F.array().cast("array<struct<n_words:int,text:string>>"))

    c = spread(df, num_partitions).select(*keep, F.transform(F.array(words(F.col(text_col))), chunks_of)[0].alias("_c"))
    return c.select(*keep, F.posexplode("_c").alias("pos", "_x")).select(*keep, "pos", "_x.n_words", "_x.text")


def chunk_and_number(pages: DataFrame, *, source_col: str = "source", page_col: str = "page_no",
                     text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     num_partitions: int | None = None) -> DataFrame:
    """Chunk every page and number the chunks across all pages of a source
    (page order, then position); id = uuid5('<source>: <index>').

    A first pass counts the chunks of each page; the number of a page's first
    chunk is a prefix sum over these narrow rows, computed by ``prefix_sum``
    so a source with very many pages is still spread over many tasks.  The
    numbers are joined to the pages (the one shuffle of the texts), which are
    chunked in place.  ``num_partitions`` spreads a small input before its
    chunks are counted.  Pages are told by source and number.
    """
    # written: the range partitioning below reads its input twice, and the texts should be split into words once
    counted = materialize(spread(pages.select(source_col, page_col, text_col), num_partitions)
                          .select(source_col, page_col, F.size(words(F.col(text_col))).alias("_words")), "page-words")
    # the chunks that chunk_starts gives a text of that many words
    n_chunks = F.greatest(F.lit(1), F.ceil((F.col("_words") - overlap) / F.lit(size - overlap))).cast("long")
    per_page = counted.where("_words > 0").select(source_col, page_col, n_chunks.alias("_n"))
    first = prefix_sum(per_page, [source_col], page_col, "_n", "_first").drop("_n")
    numbered = join_null_safe(pages.select(source_col, page_col, text_col), first, [source_col, page_col])
    chunks = chunk_text(numbered, text_col, size=size, overlap=overlap, keep=[source_col, page_col, "_first"])
    idx = (F.col("_first") + F.col("pos")).cast("int")
    return chunks.select(
        uuid5(F.concat(F.coalesce(F.col(source_col), F.lit("")), F.lit(": "), idx.cast("string"))).alias("id"),
        F.col(source_col).alias("source"), idx.alias("chunk_index"),
        F.col(page_col), F.col(text_col).alias("text"))


def payload(source: Column, text: Column) -> Column:
    """What is stored with a point and comes back with a hit."""
    return F.struct(source.alias("source"), text.alias("text"))
