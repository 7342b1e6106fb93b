"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are counted once each and divided by
the host's pages; a line on more than ``max_ratio`` of them is boilerplate
there and is dropped from that host's pages.  So that a line which two pages
share by chance stays, one on fewer than ``min_pages`` pages must be on at
least two and on more than ``small_ratio`` of them, which a line of a small
host can be.  Lines compare after trimming and collapsing spaces; blank lines are
neither counted nor dropped.

The counts see all pages and are summed on the map side first.  A host has
at most (distinct lines per page) / ``max_ratio`` boilerplate lines, so its
list of 64-bit line hashes fits one row however many pages it has; the lists
are written once and joined to the pages by host (Spark broadcasts them when
their size on disk is small, else it splits hot hosts).  Texts are not
grouped.

Defined results: null host is a host of its own; null text stays null with
no lines; a page whose lines all go keeps an empty text; every row is a page
(repeated rows count each); an empty table gives no rows; extra columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize

MAX_RATIO = 0.05
MIN_PAGES = 5
SMALL_RATIO = 0.5

SKIPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->"
BLOCKS = (r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|header|footer|nav|main|aside|"
          r"body|html|form|pre|blockquote)\b[^>]*>")
TAGS = r"<[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&"))
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; null without one."""
    h = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(h != "", h)


def html_lines(html: Column) -> Column:
    """Visible text with one line per block element; other tags vanish."""
    t = F.regexp_replace(html, SKIPPED, " ")
    t = F.regexp_replace(F.regexp_replace(t, BLOCKS, "\n"), TAGS, "")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(t, r"[ \t\r\n\f]*\n[ \t\r\n\f]*", "\n"), r"^\n+|\n+$", "")


def _hashes(text: Column) -> Column:
    """64-bit hash of each line, trimmed and with runs of spaces made one; null for a blank line."""
    flat = F.when(text.rlike(r"[\t\r\f]|  "), F.regexp_replace(text, r"[ \t\r\f]+", " ")).otherwise(text)
    return F.transform(F.split(flat, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(pages: DataFrame, *, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                small_ratio: float = SMALL_RATIO) -> DataFrame:
    """(_bp_host, _bp_lines array<long>): hashes of each host's boilerplate lines."""
    own = F.array_distinct(F.array_compact(_hashes(F.col(text))))
    lines = pages.select(F.col(host).alias("_bp_host"), F.explode(own).alias("h"))
    n_pages = pages.groupBy(F.col(host).alias("_bp_all")).agg(F.count("*").alias("pages"))
    by_chance = (F.col("n") < min_pages) & (F.col("n") <= F.col("pages") * F.lit(float(small_ratio)))
    return (lines.groupBy("_bp_host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min(2, min_pages))
            .join(n_pages, F.col("_bp_host").eqNullSafe(F.col("_bp_all")))
            .where((F.col("n") > F.col("pages") * F.lit(float(max_ratio))) & ~by_chance)
            .groupBy("_bp_host").agg(F.collect_list("h").alias("_bp_lines")))


def drop_boilerplate(pages: DataFrame, *, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                     small_ratio: float = SMALL_RATIO, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; optional counters of non-blank and dropped lines."""
    lists = materialize(boilerplate(pages, host=host, text=text, max_ratio=max_ratio, min_pages=min_pages, small_ratio=small_ratio), "boilerplate")
    joined = pages.join(lists, F.col(host).eqNullSafe(F.col("_bp_host")), "left")
    # let(value, use): the value is computed once however often the lambda reads it
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    gone = lambda h: F.transform(h, lambda x: F.coalesce(F.array_contains(F.col("_bp_lines"), x), F.lit(False)))
    clean = lambda g: F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.get(g, i)), "\n")
    result = let(_hashes(F.col(text)), lambda h: let(gone(h), lambda g: F.struct(
        F.when(F.exists(g, lambda x: x), clean(g)).otherwise(F.col(text)).alias("text"),
        F.size(F.array_compact(h)).cast("long").alias("lines"),
        F.size(F.filter(g, lambda x: x)).cast("long").alias("dropped"))))
    joined = joined.withColumn("_bp", F.when(F.col(text).isNotNull(), result))
    out = {c: F.col(f"`{c}`") for c in pages.columns}
    if n_lines:
        out[n_lines] = F.coalesce(F.col("_bp.lines"), F.lit(0))
    if n_dropped:
        out[n_dropped] = F.coalesce(F.col("_bp.dropped"), F.lit(0))
    out[text] = F.col("_bp.text")
    return joined.select(*[v.alias(k) for k, v in out.items()])
