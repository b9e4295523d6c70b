"""Watermarks: up to when each model is complete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import NTZ, as_column, execution_ts, resume_start, window_end
from tidemark.sources.generations import live, read_partitions


def partition_max(df: DataFrame, model: str, ts: str) -> DataFrame:
    """(model_name, partition_max) of one table that holds many models."""
    return df.groupBy(F.col(model).alias("model_name")).agg(F.max(F.col(ts).cast(NTZ)).alias("partition_max"))


def partition_max_of(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The same of many tables, each with its time column, in one job; an empty table gives null."""
    parts = [df.agg(F.max(F.col(ts).cast(NTZ)).alias("partition_max")).select(F.lit(name).alias("model_name"), "partition_max") for name, (df, ts) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def last_partition_max(spark: SparkSession, tables: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """(table, model_name, partition_max) of tables kept by model and day: {table: (path, model key, day key, time column)}.

    The last day of each model that holds rows is known from the list of live partitions; only that day's rows are read, whatever the table's size.  All tables are one union.
    """
    parts = []
    for name, (path, model, day, ts) in tables.items():
        last = live(spark, path, [model, day]).filter((F.col("rows") > 0) & F.col(day).isNotNull()).groupBy(model).agg(F.max(day).alias(day))
        parts.append(read_partitions(spark, path, among=last).groupBy(F.col(model).cast("string").alias("model_name")).agg(F.max(F.col(ts).cast(NTZ)).alias("partition_max")).select(F.lit(name).alias("table"), "model_name", "partition_max"))
    return reduce(DataFrame.unionByName, parts)


def read_watermark(ledger: DataFrame) -> DataFrame:
    """(model_name, watermark): the latest end of complete run groups, null if there is none, for every model with a started row.

    A run group is complete if each of its started chunks has succeeded.  A null run group matches nothing, so its ends count.
    """
    return run_ends(chunk_ends(ledger))


def chunk_ends(ledger: DataFrame) -> DataFrame:
    """(model_name, run_group_id, chunk_key, started, done, end_ts): what a watermark needs of each chunk; maxima of parts are those of the whole."""
    keys = ["model_name", "run_group_id", "chunk_key"]
    is_started, whole = F.col("status") == "started", reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    return ledger.groupBy(*keys).agg(F.max(is_started).alias("started"), F.max((F.col("status") == "succeeded") & whole).alias("done"), F.max(F.when(is_started, F.col("end_ts"))).alias("end_ts"))


def run_ends(chunks: DataFrame, *by: str) -> DataFrame:
    """(model_name, *by, watermark): the latest end of complete run groups among ``chunks``, which hold run groups as a whole."""
    runs = chunks.filter("started").groupBy("model_name", "run_group_id", *by).agg(F.min("done").alias("complete"), F.max("end_ts").alias("end_ts"))
    counts = F.col("model_name").isNotNull() & (F.col("complete") | F.col("run_group_id").isNull())
    return runs.groupBy("model_name", *by).agg(F.max(F.when(counts, F.col("end_ts"))).alias("watermark"))


def planning_watermark(models: DataFrame, watermarks: DataFrame, maxima: DataFrame) -> DataFrame:
    """(model_name, watermark): the ledger's, else the target's maximum, else null."""
    return models.select("model_name").join(watermarks, "model_name", "left").join(maxima, "model_name", "left").select("model_name", F.coalesce("watermark", "partition_max").alias("watermark"))


def resolve_start(models: DataFrame, watermarks: DataFrame, maxima: DataFrame) -> DataFrame:
    """``models`` (model_name, first_timestamp, lookback, ...) with ``start_ts``: just after the watermark less the lookback, no earlier than the first timestamp.

    Without watermark and target rows, the first timestamp stands for the watermark.
    """
    known = planning_watermark(models, watermarks, maxima)
    first = F.col("first_timestamp").cast(NTZ)
    return models.join(known, "model_name", "left").withColumn("start_ts", resume_start(F.coalesce("watermark", first), first, F.col("lookback"))).drop("watermark")


def window_bounds(models: DataFrame, watermarks: DataFrame, maxima: DataFrame, execution, incremental: bool = True, backfill_start=None, backfill_end=None) -> DataFrame:
    """``models`` with ``start_ts`` and ``end_ts``.

    A backfill's bounds go before all; a first or full build starts at the first timestamp; else see :func:`resolve_start`.  The end is the last second before the
    execution date less the model's lag.
    """
    if backfill_start is not None:
        out = models.withColumn("start_ts", as_column(backfill_start).cast(NTZ))
    elif incremental:
        out = resolve_start(models, watermarks, maxima)
    else:
        out = models.withColumn("start_ts", F.col("first_timestamp").cast(NTZ))
    return out.withColumn("end_ts", as_column(backfill_end).cast(NTZ) if backfill_end is not None else window_end(execution_ts(execution), F.col("lag")))


def incremental_filter(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; with literals, partitions and row groups are pruned.

    A date or a zoned timestamp is compared as a zone-less one, and its cast would keep the bounds from the scan; so bounds of its own type go before, wider by the day that a cast may shift.
    """
    low, high = as_column(start), as_column(end)
    kind, day = df.select(F.col(ts)).schema[0].dataType, F.make_dt_interval(days=F.lit(1))
    if isinstance(kind, T.DateType | T.TimestampType):
        df = df.filter((F.col(ts) >= (low.cast(NTZ) - day).cast(kind)) & (F.col(ts) <= (high.cast(NTZ) + day).cast(kind)))
    return df.filter(F.col(ts).cast(NTZ).between(low, high))


def backfill_bounds_errors(requests: DataFrame, watermarks: DataFrame) -> DataFrame:
    """``requests`` (model_name, backfill_start, backfill_end, first_timestamp) with a flag for each way its bounds are wrong."""
    start, end, first = (F.col(c).cast(NTZ) for c in ("backfill_start", "backfill_end", "first_timestamp"))
    return requests.join(watermarks.select("model_name", "watermark"), "model_name", "left").select(
        *requests.columns,
        "watermark",
        (start > end).alias("start_after_end"),
        F.coalesce(end > F.col("watermark"), F.lit(False)).alias("end_beyond_table"),
        F.coalesce(start < first, F.lit(False)).alias("start_before_first"),
    )


def check_window_args(mode: str, start=None, end=None, execution=None) -> None:
    """Raises ValueError unless a partial backfill has both bounds, in order, and no execution date, and other modes have no bounds."""
    if mode == "partial":
        if start is None or end is None:
            raise ValueError("a partial backfill needs a start and an end")
        if start >= end:
            raise ValueError("a partial backfill must start before it ends")
        if execution is not None:
            raise ValueError("a partial backfill takes no execution date")
    elif start is not None or end is not None:
        raise ValueError(f"mode {mode!r} takes neither start nor end")
