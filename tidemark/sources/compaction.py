"""An append-only log of transitions folded into a ledger by day, as much of both as has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import Scratch
from tidemark.sources.generations import note, numbers, read_partitions, replace_partitions
from tidemark.sources.ledger_store import LEDGER, as_ledger, fold, path_exists

DAY = "execution_ts"


def log_files(spark: SparkSession, log: str) -> DataFrame:
    """(file): the data files of a log, from its listing."""
    if not path_exists(spark, log):
        return spark.createDataFrame([], "file string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(log).select(F.col("path").alias("file"))


def read_compacted(spark: SparkSession, path: str, days: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """The ledger, or the part of it in ``days`` (execution_ts), whose folders alone are read."""
    return read_partitions(spark, path, among=days, version=version, schema=LEDGER).select(*LEDGER.names)


def merge_days(spark: SparkSession, path: str, transitions: DataFrame, notes: dict[str, DataFrame] | None = None) -> tuple[int, DataFrame]:
    """Folds transitions into the days of the ledger that they belong to; the other days stay as references.  Returns the version and these days.

    Merging is by maxima, so the same transitions merged twice change nothing.
    """
    scratch = Scratch(spark, "merge")
    new = scratch.table(fold(as_ledger(transitions)), "new")
    days = scratch.table(new.select(DAY).distinct(), "days")
    merged = fold(read_compacted(spark, path, days).unionByName(new))
    return replace_partitions(merged, path, [DAY], notes=notes), days


def compact_ledger(spark: SparkSession, log: str, path: str) -> int:
    """Folds the log files that no earlier compaction has folded, and returns the ledger's version.

    Only those files are read, and only the days they hold are read and written again.  Which files a version holds is kept with it, so a compaction that is killed has folded all of
    them or none.  Without new files nothing is read and the version stays.
    """
    folded = note(spark, path, "folded")
    if folded is None:
        folded = spark.createDataFrame([], "file string")
    fresh = Scratch(spark, "fresh").table(log_files(spark, log).join(folded, "file", "left_anti"))
    # The files of one interval between compactions.
    files = [r["file"] for r in fresh.toLocalIterator()]
    found = numbers(spark, path)
    if not files and found:
        return found[-1]
    rows = spark.read.schema(LEDGER).parquet(*files) if files else spark.createDataFrame([], LEDGER)
    return merge_days(spark, path, rows, {"folded": folded.unionByName(fresh)})[0]
