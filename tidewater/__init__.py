"""tidewater — Spark-native operators for event, transaction, feature and
document pipelines.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
is built from built-in DataFrame / SQL expressions so Catalyst can prune,
push down and code-generate the whole plan.  Sub-packages:

* ``functions``  – column expressions (epoch conversion, masking, hashing, …)
* ``sources``    – readers and writers (JSON lines, lake layout, CSV, Parquet,
  JDBC options, streaming sources)
* ``operators``  – curation, data quality, point-in-time features, KPIs,
  model training / scoring, documents and vectors, table replication
* ``streaming``  – the same operators wired to Structured Streaming
* ``plans``      – the registered queries over the test tables
"""

from tidewater.session import get_spark, scratch_path  # noqa: F401

__version__ = "0.1.0"
