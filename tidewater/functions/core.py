"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# IPv4 masking pattern and replacement (last octet becomes XXX):
IPV4_PATTERN = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.)\d{1,3}"
IPV4_REPLACEMENT = "$1XXX"
# Identifier redaction: every non-empty line becomes this text.
REDACTED = "REDACTED"
# RFC 4122 namespace for URLs (used for deterministic chunk ids).
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms_to_ts(c) -> Column:
    """Epoch milliseconds -> TIMESTAMP at second resolution.

    The sub-second part is dropped toward zero (−1500 ms → −1 s), which is
    what converting ``ms / 1000`` to whole seconds does.  Computed with
    integer arithmetic, no text round trip.
    """
    c = as_col(c)
    return F.timestamp_seconds(F.call_function("div", c, F.lit(1000)))


def anon_ipv4(c) -> Column:
    """Mask the last octet of every dotted quad in the value (unanchored)."""
    return F.regexp_replace(as_col(c), IPV4_PATTERN, IPV4_REPLACEMENT)


def redact(c) -> Column:
    """Replace each non-empty line with ``REDACTED``; null and '' stay."""
    return F.regexp_replace(as_col(c), r".+", REDACTED)


def iso_to_ts(c) -> Column:
    """ISO-8601 text -> TIMESTAMP; unparseable text gives null (not an error)."""
    return F.try_to_timestamp(as_col(c))


def hour_of_day_from_offset(seconds) -> Column:
    """floor(seconds / 3600) mod 24 with floor (not truncation) semantics."""
    return F.pmod(F.floor(as_col(seconds) / F.lit(3600)), F.lit(24)).cast("int")


def day_of_week_from_offset(seconds) -> Column:
    """floor(seconds / 86400) mod 7 — days counted from the first row."""
    return F.pmod(F.floor(as_col(seconds) / F.lit(86400)), F.lit(7)).cast("int")


def is_night(hour) -> Column:
    h = as_col(hour)
    return F.when((h < 6) | (h > 22), F.lit(1)).otherwise(F.lit(0))


def is_weekend(day) -> Column:
    return F.when(as_col(day) >= 5, F.lit(1)).otherwise(F.lit(0))


def _key_text(*keys) -> Column:
    return F.concat_ws("|", *[as_col(k).cast("string") for k in keys])


def seeded_bucket(keys, seed: int, n: int) -> Column:
    """Deterministic bucket in [0, n) from row keys and a seed.

    ``pmod(first 32 bits of md5(key ':' seed), n)`` — independent of
    partitioning and of row order, so a re-run (or a lost executor's
    recomputation) gives the same rows the same bucket.  The same formula
    is expressible in most SQL engines, which keeps results checkable.
    """
    if isinstance(keys, (str, Column)):
        keys = [keys]
    h = F.md5(F.concat(_key_text(*keys), F.lit(f":{seed}")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(n))


def seeded_unit(keys, seed: int) -> Column:
    """Deterministic pseudo-uniform double in [0, 1) from keys and seed."""
    if isinstance(keys, (str, Column)):
        keys = [keys]
    h = F.md5(F.concat(_key_text(*keys), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uuid5(name, namespace: str = NAMESPACE_URL) -> Column:
    """RFC 4122 version-5 UUID of ``name`` (UTF-8) in ``namespace``.

    sha1(namespace bytes || name bytes), first 16 bytes, version nibble 5,
    variant bits 10xx — built from sha1/unhex/conv only.
    """
    ns_hex = namespace.replace("-", "")
    h = F.sha1(F.concat(F.unhex(F.lit(ns_hex)), F.encode(as_col(name), "UTF-8")))
    variant = F.lower(F.conv(
        (F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)
        .cast("string"), 10, 16))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"),
        F.substring(h, 9, 4), F.lit("-"),
        F.lit("5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def vector_dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays (as DOUBLE)."""
    prods = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    sq = F.aggregate(as_col(a), F.lit(0.0).cast("double"),
                     lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(sq)


def normalize_vector(a) -> Column:
    """Unit-length copy of the vector as ARRAY<DOUBLE>; null for a zero vector.

    The squared norm is folded once and bound in the finish lambda, so the
    per-element division does not recompute it (O(d), not O(d^2)).
    """
    a = as_col(a)
    return F.aggregate(
        a, F.lit(0.0).cast("double"),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda acc: F.when(acc > 0, F.transform(a, lambda x: x.cast("double") / F.sqrt(acc))))


def cosine_similarity(a, b) -> Column:
    """Cosine of two vectors; null if either has zero length."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), vector_dot(a, b) / (na * nb))


def strip_version_prefix(c) -> Column:
    """'v2' -> '2', '2' -> '2' (score rows and registry rows disagree)."""
    return F.regexp_replace(as_col(c).cast("string"), r"^[vV]", "")
