"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one BLAS thread per task: task slots already use every core
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, app: str = "tidewater",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    On a cluster ``master`` is left to ``spark-submit``; tests pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    pin_utc(spark)
    return spark


def pin_utc(spark: SparkSession) -> None:
    """All time arithmetic in this library is defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at storage every executor sees; it is
    read, never overridden.  Only on a local master may it be unset: then a
    private folder is created and registered as the checkpoint directory.  On
    a cluster a folder of one machine would be invisible to the others, so a
    missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewater-ckpt-")
        spark.sparkContext.setCheckpointDir(base)  # the setting itself cannot be changed in a running session
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: scratch folders that this process handed out
_scratch: list[str] = []
#: those that a thread handed out inside ``interim``
_inside = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared directory; it belongs to this process until ``remove_scratch``."""
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    if getattr(_inside, "paths", None) is not None:
        _inside.paths.append(path)
    return path


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this process handed out; returns their number.

    For the end of a job: frames that read them, and streams that write them,
    are of no use afterwards.
    """
    n = len(_scratch)
    while _scratch:
        _remove(spark, _scratch.pop())
    return n


#: Spark removes a query's shuffle files with the query (a frame that is run again makes them again)
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def interim(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Steps towards the tables named in ``keep``: at the end the other scratch folders that this thread was handed inside are deleted.

    Shuffle files of frames made inside go with the query that wrote them.
    Frames made inside that read a deleted folder are of no use afterwards.
    """
    outer, before = getattr(_inside, "paths", None), spark.conf.get(_DROP_SHUFFLES, None)
    _inside.paths = []
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
        made, _inside.paths = _inside.paths, outer
        kept = [p for p in made if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in keep]
        if outer is not None:
            outer += kept
        for path in set(made) - set(kept):
            _remove(spark, path)
            if path in _scratch:
                _scratch.remove(path)


#: called with (name, frame) before a stage is written: lets tests and reports see plans that a returned frame no longer shows
stage_observers: list = []


def materialize(df, name: str, file_rows: int | None = None):
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of
    recomputing upstream stages) and lets several consumers share one
    computation.  Columnar write/read is much cheaper than an RDD
    checkpoint of the same rows.  ``file_rows`` cuts what one task writes into
    files of at most that many rows, so that many tasks can read it.
    """
    path = scratch_path(df.sparkSession, name)
    for observe in stage_observers:
        observe(name, df)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)
