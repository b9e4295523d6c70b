"""The ledger, its completions view and its watermarks, kept up with a stream of transitions.

``ledger``  the folded transitions by day; a batch merges into the days it has rows of
``view``    the completions of each day; those days are derived anew from the ledger's
``chunks``  what watermarks need of each chunk, by a bucket of its run group; a batch merges into the buckets of its run groups
``marks``   of each bucket and model, the latest end of complete runs; derived anew for those buckets

A watermark is the maximum over a model's buckets, however long its history, so both the cost of a batch and that of reading follow what has changed.  All merges are maxima: a batch
that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.dates import days_ago_str
from tidemark.operators.ledger import CHUNK, VIEW, completions_of
from tidemark.operators.watermarks import chunk_ends, run_ends
from tidemark.scratch import Scratch
from tidemark.sources.compaction import merge_days, read_compacted
from tidemark.sources.generations import read_partitions, replace_partitions
from tidemark.sources.ledger_store import as_ledger

BUCKETS = 64
CHUNKS = "model_name string, run_group_id string, chunk_key string, started boolean, done boolean, end_ts timestamp_ntz, bucket int"
MARKS = "model_name string, watermark timestamp_ntz, bucket int"


def apply_transitions(spark: SparkSession, path: str, transitions: DataFrame) -> None:
    """Merges a batch of transitions into everything that is kept under ``path``."""
    scratch = Scratch(spark, "maintained")
    rows = scratch.table(as_ledger(transitions), "batch")
    _, days = merge_days(spark, f"{path}/ledger", rows)
    replace_partitions(completions_of(read_compacted(spark, f"{path}/ledger", days)), f"{path}/view", ["execution_ts"], lambda parts: parts.join(days, parts["execution_ts"].eqNullSafe(days["execution_ts"]), "left_semi"))

    bucket = F.pmod(F.xxhash64("run_group_id"), F.lit(BUCKETS)).cast("int")
    new = scratch.table(chunk_ends(rows).withColumn("bucket", bucket), "chunks")
    touched = scratch.table(new.select("bucket").distinct(), "buckets")
    both = read_partitions(spark, f"{path}/chunks", among=touched, schema=spark.createDataFrame([], CHUNKS).schema).unionByName(new)
    merged = scratch.table(both.groupBy(*CHUNK, "bucket").agg(F.max("started").alias("started"), F.max("done").alias("done"), F.max("end_ts").alias("end_ts")), "merged")
    replace_partitions(merged, f"{path}/chunks", ["bucket"])
    replace_partitions(run_ends(merged, "bucket"), f"{path}/marks", ["bucket"], lambda parts: parts.join(touched.select(F.col("bucket").cast("string").alias("bucket")), "bucket", "left_semi"))


def maintained_view(spark: SparkSession, path: str, as_of, days: int = 30) -> DataFrame:
    """The completions of the last ``days`` days; only their folders are read."""
    return read_partitions(spark, f"{path}/view", F.col("execution_ts") >= days_ago_str(as_of, days), schema=spark.createDataFrame([], VIEW).schema)


def maintained_watermark(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, watermark) of every model with a started row."""
    return read_partitions(spark, f"{path}/marks", schema=spark.createDataFrame([], MARKS).schema).groupBy("model_name").agg(F.max("watermark").alias("watermark"))


def stream_maintained(spark: SparkSession, transitions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps everything under ``path`` up with a stream of transitions, a batch at a time."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_transitions(batch.sparkSession, path, batch)

    return transitions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
