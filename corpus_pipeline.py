"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  ``run`` writes each stage's result as Parquet in
the shared folder and reads it back as the next one's input, so a lost
executor never recomputes an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import langid, linededup, queries, simhash
from tidewater.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (no letters)."""
    model = langid.fit(docs, ~queries.held_out("doc_id"))
    p = langid.predict(docs, model, out="_lid")
    return p.where(F.col("_lid.lang") != "und").drop("_lid")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines of each source out of the texts; n_chars follows.  No document goes."""
    out = linededup.drop_boilerplate(docs, host="source", text="text")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs, words=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage aligned to a benchmark item."""
    from tidewater.llm import decontam
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training assignment of every document that is left, in training order."""
    return queries.mixed_rows(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("benchmark_decontamination", decontaminate), ("mixing", mix_sources)]
#: language ID and SimHash cannot be expressed in SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
