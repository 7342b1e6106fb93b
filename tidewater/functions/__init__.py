"""Column expressions shared by batch and streaming operators.

All of them compile to built-in Catalyst expressions (no Python UDFs), so
they stay inside whole-stage code generation and work on streaming frames.
"""

from tidewater.functions.core import (  # noqa: F401
    anon_ipv4,
    as_col,
    cosine_similarity,
    day_of_week_from_offset,
    epoch_ms_to_ts,
    hour_of_day_from_offset,
    is_night,
    is_weekend,
    iso_to_ts,
    l2_norm,
    normalize_vector,
    redact,
    seeded_bucket,
    seeded_unit,
    strip_version_prefix,
    uuid5,
    vector_dot,
)
