"""Streaming jobs.

Every job takes a streaming DataFrame and a checkpoint location; the
checkpoint (offsets + committed batches) plus an idempotent or file sink
gives exactly-once output, which is deliberately stronger than committing
offsets while rows are still buffered in memory.

Triggers: ``processingTime`` for a continuous job (e.g. "30 seconds"),
``availableNow`` to drain what is there and stop (used by the tests).  The
per-trigger size cap is ``maxOffsetsPerTrigger`` (Kafka) or
``maxFilesPerTrigger`` (files); it bounds a batch but is not a flush rule.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewater.sources.sinks import BUCKETS, TS_OPTIONS, insert_if_absent, landing_partitions

CORRUPT = "_corrupt_record"


def _trigger(writer, trigger: str | None):
    if trigger in (None, "availableNow"):
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


# ----------------------------------------------------------------- sources

def kafka_json_stream(spark: SparkSession, bootstrap: str, topic: str, *,
                      starting_offsets: str = "earliest", max_offsets_per_trigger: int | None = None,
                      options: dict | None = None) -> DataFrame:
    """Topic as a (key, value, topic, partition, offset, timestamp) stream,
    value decoded as UTF-8 text.  Needs the Kafka connector on the class
    path.  ``starting_offsets`` 'earliest' replays the topic (log ingest),
    'latest' starts at the head (live scoring)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    df = r.options(**(options or {})).load()
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                     "topic", "partition", "offset", "timestamp")


def text_stream(spark: SparkSession, path: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    """Folder of text files (one message per line) as a ``value`` stream —
    the file-based stand-in for a topic."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def file_json_stream(spark: SparkSession, path: str, schema: T.StructType, *,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).options(**TS_OPTIONS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def parse_messages(messages: DataFrame, schema: T.StructType, value_col: str = "value"
                   ) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, dead letters) of a JSON message stream.

    Parsing is PERMISSIVE with a corrupt-record column: a message that is
    not valid JSON for the schema lands in the dead-letter frame with its
    raw text instead of stopping the job or vanishing.
    """
    s = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    p = messages.select("*", F.from_json(F.col(value_col), s,
                                         {"columnNameOfCorruptRecord": CORRUPT, **TS_OPTIONS}).alias("_m"))
    bad = F.col(f"_m.{CORRUPT}").isNotNull() | (F.col(value_col).isNotNull() & F.col("_m").isNull())
    parsed = p.where(~bad).select("_m.*").drop(CORRUPT)
    dead = p.where(bad).select(*[c for c in messages.columns], F.lit("unparseable").alias("reason"))
    return parsed, dead


# ----------------------------------------------------------------- jobs

def ingest_json_landing(stream: DataFrame, landing: str, checkpoint: str, *, topic: str,
                        ts: Column | None = None, trigger: str | None = "availableNow") -> StreamingQuery:
    """Land a stream as JSON lines under ``topic=/year=/month=/day=``.

    The date comes from ``ts`` (default: processing time).  The file sink
    and its log make a replayed batch invisible (exactly-once files)."""
    t = ts if ts is not None else F.current_timestamp()
    out = stream.select("*", F.lit(topic).alias("topic"), *landing_partitions(t))
    w = (out.writeStream.format("json").options(**TS_OPTIONS).option("checkpointLocation", checkpoint)
         .partitionBy("topic", "year", "month", "day"))
    return _trigger(w, trigger).start(landing)


def windowed_volume(stream: DataFrame, ts_col: str, *, every: str = "1 hour", watermark: str = "10 minutes",
                    metrics: dict[str, Column] | None = None) -> DataFrame:
    """Event-time tumbling windows with a watermark (append mode emits a
    window once the watermark passes its end; later rows are dropped)."""
    metrics = metrics or {"total_transactions": F.count(F.lit(1))}
    s = stream.withColumn("_et", F.col(ts_col).cast("timestamp")).withWatermark("_et", watermark)
    return (s.groupBy(F.window("_et", every).alias("w")).agg(*[v.alias(k) for k, v in metrics.items()])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *metrics.keys()))


def running_fraud_rate(stream: DataFrame, fraud_col: str = "is_fraud") -> DataFrame:
    """Running totals of the whole stream (complete mode): one row."""
    return stream.agg(F.count(F.lit(1)).alias("total_transactions"),
                      F.count_if(F.col(fraud_col)).alias("fraud_count"),
                      F.try_divide(F.count_if(F.col(fraud_col)), F.count(F.lit(1))).alias("fraud_rate"))


def write_each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, *,
                     output_mode: str = "append", trigger: str | None = "availableNow") -> StreamingQuery:
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(fn)
    return _trigger(w, trigger).start()


def dedup_into_table(stream: DataFrame, target: str, key: str, order: str, checkpoint: str, *,
                     n_buckets: int = BUCKETS, trigger: str | None = "availableNow") -> StreamingQuery:
    """Idempotent sink: each micro-batch is inserted with first-write-wins
    on ``key`` (``insert_if_absent``), so a replayed batch adds nothing."""
    spark = stream.sparkSession

    def each(batch: DataFrame, _epoch: int) -> None:
        insert_if_absent(spark, batch, target, key, order, n_buckets=n_buckets)

    return write_each_batch(stream, each, checkpoint, trigger=trigger)


def dedup_within_watermark(stream: DataFrame, keys: list[str], ts_col: str, *, watermark: str = "10 minutes") -> DataFrame:
    """First row of each key, as far as the state store remembers it.

    A copy is dropped while its first row is remembered (until the watermark
    has passed that row's event time plus ``watermark``), and so is any row
    older than the watermark.  State is bounded by the keys of that span; a
    copy with an event time beyond it counts as a new row.  For first-wins
    over all time use ``dedup_into_table``.
    """
    s = stream.withColumn("_et", F.col(ts_col).cast("timestamp")).withWatermark("_et", watermark)
    return s.dropDuplicatesWithinWatermark(keys).drop("_et")


def file_json_sink(stream: DataFrame, path: str, checkpoint: str, *, key_col: str, trigger: str | None = "availableNow") -> StreamingQuery:
    """Rows as JSON messages (key, value) in files: the stand-in for ``kafka_sink`` where there is no broker.

    The file sink's log makes a replayed batch invisible.
    """
    msgs = stream.select(F.col(key_col).cast("string").alias("key"),
                         F.to_json(F.struct(*[F.col(c) for c in stream.columns]), TS_OPTIONS).alias("value"))
    return _trigger(msgs.writeStream.format("json").option("checkpointLocation", checkpoint), trigger).start(path)


def score_stream(stream: DataFrame, current_version: Callable[[], str], load: Callable[[str], Callable[[DataFrame], DataFrame]],
                 sink: Callable[[DataFrame, int], None], checkpoint: str, *, refresh_seconds: int = 300,
                 trigger: str | None = "availableNow") -> StreamingQuery:
    """Score every micro-batch with the current model version.

    ``current_version()`` asks the registry, at most every
    ``refresh_seconds``; ``load(version)`` returns the scorer (batch ->
    scored rows) and runs only when the version changed, so the model is
    swapped between two micro-batches of a running query.  The sink gets the
    rows with ``model_version``.  Registry reads run on the driver; scoring
    runs on executors.
    """
    import time

    state: dict = {"version": None, "scorer": None, "checked": 0.0}

    def each(batch: DataFrame, epoch: int) -> None:
        now = time.time()
        if state["scorer"] is None or now - state["checked"] >= refresh_seconds:
            version = current_version()
            if version != state["version"]:
                state["version"], state["scorer"] = version, load(version)
            state["checked"] = now
        sink(state["scorer"](batch).withColumn("model_version", F.lit(state["version"])), epoch)

    return write_each_batch(stream, each, checkpoint, trigger=trigger)


def kafka_sink(df: DataFrame, bootstrap: str, topic: str, checkpoint: str, *, key_col: str,
               trigger: str | None = None) -> StreamingQuery:
    """Write rows as JSON messages keyed by ``key_col`` (needs the Kafka connector)."""
    msgs = df.select(F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    w = (msgs.writeStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("topic", topic).option("checkpointLocation", checkpoint))
    return _trigger(w, trigger).start()


# ----------------------------------------------------------------- counters

def write_counted(stream: DataFrame, write: Callable[[DataFrame, int], None], counters_path: str, checkpoint: str, *,
                  metrics: dict[str, Column] | None = None, trigger: str | None = "availableNow") -> StreamingQuery:
    """Write every micro-batch with ``write`` and keep its counters as a row of a table.

    The counters are observed while the batch is written (no extra pass) and
    stored below ``batch_id=``, replacing what an earlier attempt of the same
    batch left, so any number of batches and replays is counted once.
    """
    metrics = metrics or {"rows": F.count(F.lit(1))}
    spark = stream.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        seen = Observation(f"batch-{epoch}")
        write(batch.observe(seen, *[v.alias(k) for k, v in metrics.items()]), epoch)
        row = seen.get
        (spark.range(1).select(*[F.lit(row[k]).alias(k) for k in metrics])
         .write.mode("overwrite").parquet(f"{counters_path}/batch_id={epoch}"))

    return write_each_batch(stream, each, checkpoint, trigger=trigger)


class ProgressTable(StreamingQueryListener):
    """Counters of every micro-batch of the queries of a session, kept as a table: one row per query and batch.

    The engine reports a batch when it is done; a thread of the listener
    writes the report below ``query=/batch_id=``, so a batch that is run
    again after a restart replaces its row.  ``name`` is the query name;
    counters are those of ``observe`` under ``metrics``, 0 for a batch without
    rows.  Unlike ``write_counted`` this needs no ``foreachBatch`` and works
    with any sink; a batch whose report is lost with the driver has no row.
    """

    def __init__(self, spark: SparkSession, path: str, metrics: str, fields: list[str]):
        self.spark, self.path, self.metrics, self.fields = spark, path, metrics, fields
        self.todo: queue.Queue = queue.Queue()
        self.failed: list[Exception] = []
        threading.Thread(target=self._write, daemon=True).start()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.metrics)
        if p.name and seen is not None:
            self.todo.put((p.name, p.batchId, p.numInputRows, [seen[f] or 0 for f in self.fields]))

    def _write(self) -> None:
        while (item := self.todo.get()) is not None:
            name, batch, rows, counters = item
            try:
                (self.spark.range(1).select(F.lit(rows).cast("long").alias("input_rows"), *[F.lit(v).cast("long").alias(f) for f, v in zip(self.fields, counters)])
                 .write.mode("overwrite").parquet(f"{self.path}/query={name}/batch_id={batch}"))
            except Exception as e:  # noqa: BLE001 - reported by close()
                self.failed.append(e)
            finally:
                self.todo.task_done()
        self.todo.task_done()

    def close(self) -> None:
        """Wait until every report so far is written, and stop listening."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.todo.join()
        self.spark.streams.removeListener(self)
        self.todo.put(None)
        if self.failed:
            raise self.failed[0]


def write_batch(df: DataFrame, path: str, epoch: int) -> None:
    """Store a micro-batch under its id; a replay replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={epoch}")


def batch_counters(spark: SparkSession, counters_path: str) -> DataFrame:
    """One row of counters per micro-batch of all runs so far (``batch_id`` and the counters)."""
    return spark.read.parquet(counters_path)
