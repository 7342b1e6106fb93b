"""Declared schemas (no inference pass on any read)."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, NTZ = T.TimestampType(), T.TimestampNTZType()

# Raw firewall log line (JSON), all fields nullable.
FIREWALL = _s(("ts_unix", L), ("src_ip", S), ("dest_ip", S), ("src_port", I),
              ("dest_port", I), ("protocol", S), ("act", S), ("bytes_sent", I))

# Raw cloud-audit log line (JSON).
CLOUD = _s(("event_time_iso", S), ("user_id", S), ("resource_name", S),
           ("operation", S), ("success", B), ("source_service", S))

CURATED_FIREWALL = _s(("event_time", TS), ("source_ip_anon", S), ("destination_ip", S),
                      ("src_port", I), ("dest_port", I), ("protocol", S), ("action", S),
                      ("bytes_sent", I), ("processed_at", TS), ("log_type", S))

CURATED_CLOUD = _s(("event_time", TS), ("user_id_anon", S), ("resource_name", S),
                   ("operation", S), ("success", B), ("source_service", S),
                   ("processed_at", TS), ("log_type", S))

# Raw transaction message on the input stream.
RAW_TRANSACTION = _s(("transaction_id", S), ("user_id", S), ("timestamp", L),
                     ("amount", D), ("currency", S), ("location", S), ("card_type", S),
                     ("merchant_category", S), ("is_simulated_fraud", B))

# Scored record envelope: original message kept verbatim as a struct.
SCORED = _s(("transaction_id", S), ("original_data", RAW_TRANSACTION), ("prediction", I),
            ("fraud_probability", D), ("is_fraud", B), ("model_version", S),
            ("scored_at", S), ("scoring_time_ms", I))

# Row of the score sink table.
SCORE_SINK = _s(("id", L), ("transaction_id", S), ("user_id", S), ("amount", D),
                ("location", S), ("is_simulated_fraud", B), ("prediction", I),
                ("fraud_probability", D), ("is_fraud", B), ("model_version", S),
                ("scored_at", NTZ))

# Training transactions: Time, V1..V28, Amount, Class.
TRANSACTIONS = T.StructType(
    [T.StructField("id", L, True), T.StructField("Time", D, True)]
    + [T.StructField(f"V{i}", D, True) for i in range(1, 29)]
    + [T.StructField("Amount", D, True), T.StructField("Class", I, True)]
)

# Stored predictions of the training database.
PREDICTIONS = _s(("id", L), ("transaction_id", L), ("predicted_class", I),
                 ("fraud_probability", D), ("model_version", S), ("predicted_at", NTZ),
                 ("is_correct", B))

# Model registry and run metrics (long format).
MODEL_REGISTRY = _s(("model_name", S), ("version", I), ("current_stage", S),
                    ("creation_time", L), ("last_updated_time", L), ("run_id", S),
                    ("status", S))
RUN_METRICS = _s(("run_id", S), ("experiment_id", I), ("start_time", L), ("end_time", L),
                 ("status", S), ("metric_name", S), ("metric_value", D))

# Document ingest.
PAGES = _s(("source_id", S), ("page_no", I), ("text", S))
CHUNKS = _s(("id", S), ("source", S), ("chunk_index", I), ("text", S))
POINTS = T.StructType([
    T.StructField("id", S, True),
    T.StructField("vector", T.ArrayType(T.FloatType()), True),
    T.StructField("payload", _s(("source", S), ("text", S)), True),
])
SEARCH_RESULT = T.StructType([
    T.StructField("contexts", T.ArrayType(S), True),
    T.StructField("sources", T.ArrayType(S), True),
])


def ddl(schema: T.StructType) -> str:
    """Schema as a DDL string (for readers that take text)."""
    return schema.simpleString()[len("struct<"):-1].replace(":", " ")
