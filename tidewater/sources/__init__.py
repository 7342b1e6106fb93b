"""Readers and writers.  Every reader takes a declared schema."""

from tidewater.sources.files import (  # noqa: F401
    empty_frame,
    read_bi_extracts,
    read_csv,
    read_jsonl,
    read_lake,
    read_or_empty,
    read_pages,
)
from tidewater.sources.sinks import (  # noqa: F401
    append_partitioned_parquet,
    insert_if_absent,
    write_csv,
    write_jdbc_overwrite,
    write_json_landing,
)
