"""The run ledger on storage: its schema, snapshots and an append-only log of transitions (folded by :mod:`tidemark.sources.compaction`)."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import Scratch

LEDGER = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("execution_ts", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("run_group_id", T.StringType()),
        T.StructField("chunk_key", T.StringType()),
        T.StructField("heartbeat_at", T.TimestampNTZType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("end_ts", T.TimestampNTZType()),
    ]
)
#: Without one of these a table is not a ledger of this version.
REQUIRED = ("run_group_id", "chunk_key", "heartbeat_at", "start_ts", "end_ts")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, in place of an older one."""
    fs, at = _files(spark, path)
    with closing(fs.create(at, True)) as out:
        out.write(bytearray(text.encode()))


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _files(spark, path)
    with closing(fs.open(at)) as found:
        return bytes(found.readAllBytes()).decode()


def names(spark: SparkSession, path: str) -> list[str]:
    """The names directly under a folder; none if it is not there."""
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def scan_or_empty(spark: SparkSession, source: str, schema: T.StructType) -> DataFrame:
    """A table or parquet path; if there is none, an empty frame of ``schema``: the first run is no error."""
    if "/" in source:
        return spark.read.parquet(source) if path_exists(spark, source) else spark.createDataFrame([], schema)
    return spark.table(source) if spark.catalog.tableExists(source) else spark.createDataFrame([], schema)


def as_ledger(df: DataFrame, missing: str = "fill") -> DataFrame:
    """``df`` with the ledger's columns.  Names match in any case.

    If a required column is missing, ``fill`` adds it as null; ``replace`` starts an empty ledger, as a table of an older version would be replaced.
    """
    found = {c.lower(): c for c in df.columns}
    if missing == "replace" and any(c not in found for c in REQUIRED):
        return df.sparkSession.createDataFrame([], LEDGER)
    return df.select(*[(F.col(f"`{found[f.name]}`") if f.name in found else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER.fields])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete snapshots under ``path``, oldest first."""
    return sorted(int(n[2:]) for n in names(spark, path) if n.startswith("v=") and n[2:].isdigit() and path_exists(spark, f"{path}/{n}/_SUCCESS"))


def read_ledger(spark: SparkSession, path: str, missing: str = "fill", version: int | None = None) -> DataFrame:
    """A snapshot, by default the newest complete one, or an empty ledger if there is none."""
    found = versions(spark, path)
    if version is not None and version not in found:
        raise ValueError(f"no version {version} in {path}")
    at = found[-1] if version is None and found else version
    return spark.createDataFrame([], LEDGER) if at is None else as_ledger(spark.read.parquet(f"{path}/v={at}"), missing)


def expire_ledger(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Deletes all complete snapshots but the newest ``keep``, at least one; returns their numbers."""
    gone = versions(spark, path)[: -max(keep, 1)]
    for number in gone:
        delete_folder(spark, f"{path}/v={number}")
    return gone


def write_ledger(ledger: DataFrame, path: str) -> int:
    """Writes the next snapshot, partitioned by execution_ts, and returns its number; readers keep the snapshot they have."""
    number = max(versions(ledger.sparkSession, path), default=-1) + 1
    ledger.hint("rebalance", "execution_ts").write.mode("overwrite").partitionBy("execution_ts").parquet(f"{path}/v={number}")
    return number


def upsert_days(spark: SparkSession, path: str, incoming: DataFrame, upsert: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Applies ``upsert`` (ledger, incoming) to the days that ``incoming`` has, in a ledger kept by day at ``path``.

    Only those days (and rows without one) are read, as the join prunes partitions, and only they are replaced, so the cost follows the days touched and not the ledger.
    For upserts whose key holds execution_ts.  The result is written aside first, since a path cannot be read and replaced at once.
    """
    days = incoming.select(F.col("execution_ts").alias("__day")).distinct()
    if path_exists(spark, path):
        held = read_days(spark, path)
        held = held.join(days, F.col("execution_ts") == F.col("__day"), "left_semi").unionByName(held.filter(F.col("execution_ts").isNull()))
    else:
        held = spark.createDataFrame([], LEDGER)
    scratch = Scratch(spark, "days")
    merged = scratch.table(upsert(held, incoming))
    merged.hint("rebalance", "execution_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("execution_ts").parquet(path)
    scratch.drop(merged)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept by day at ``path``, or an empty one."""
    return spark.read.schema(LEDGER).parquet(path).select(*LEDGER.names) if path_exists(spark, path) else spark.createDataFrame([], LEDGER)


def append_transitions(transitions: DataFrame, path: str) -> None:
    """Adds transitions to an append-only log: no read, no shuffle."""
    as_ledger(transitions).write.mode("append").parquet(path)


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return scan_or_empty(spark, path, LEDGER)


def fold(transitions: DataFrame) -> DataFrame:
    """One row per key with the latest of every timestamp; null keys form rows of their own value."""
    keys = ["model_name", "execution_ts", "status", "run_group_id", "chunk_key"]
    return transitions.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("updated_at", "heartbeat_at", "start_ts", "end_ts")]).select(*LEDGER.names)

