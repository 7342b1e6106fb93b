"""Structured Streaming wiring of the operators (sources, parsing with a
dead-letter split, windowed measures, idempotent sinks, model scoring)."""

from tidewater.streaming.jobs import (  # noqa: F401
    dedup_into_table,
    file_json_stream,
    ingest_json_landing,
    kafka_json_stream,
    kafka_sink,
    parse_messages,
    running_fraud_rate,
    score_stream,
    text_stream,
    windowed_volume,
)
