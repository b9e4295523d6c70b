"""Incremental loads and chunked backfills of fact tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import NTZ
from tidemark.operators.ledger import record_window_end, record_window_start, upsert_started, upsert_status
from tidemark.plans.windows import chunk_units
from tidemark.scratch import Scratch
from tidemark.sources.chunks import write_chunks
from tidemark.sources.generations import live, replace_partitions
from tidemark.sources.ledger_store import read_days, upsert_days

#: Units up to this many are sent to every executor; more are joined by shuffle.
BROADCAST_UNITS = 100_000


def sized(units: DataFrame, most: int = BROADCAST_UNITS) -> DataFrame:
    """``units`` with a broadcast hint if there are no more than ``most`` rows, which is counted and not guessed.

    They are written aside first, so that counting does not compute them twice.
    """
    units = Scratch(units.sparkSession, "units").table(units)
    return F.broadcast(units) if units.limit(most + 1).count() <= most else units


def cells_of(units: DataFrame, upto) -> DataFrame:
    """``units`` (model_name, chunk_id, chunk_start, chunk_end) by month: (__model, chunk_id, __from, __upto, __month), the upper bound excluded."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "MM")
    months = F.when(F.col("chunk_start") <= F.col("chunk_end"), F.sequence(month("chunk_start"), month("chunk_end"), F.expr("interval 1 month")))
    return units.select(F.col("model_name").alias("__model"), "chunk_id", F.col("chunk_start").alias("__from"), upto.alias("__upto"), F.explode(months).alias("__month"))


def upper_bound(half_open: bool = False):
    """Where a window that ends a second before the next boundary ends: with it, or, half-open, at the boundary, so that rows of that last second are taken in."""
    return F.col("chunk_end").cast(NTZ) + (F.make_dt_interval(secs=F.lit(1)) if half_open else F.expr("interval '0.000001' second"))


def between_bounds(facts: DataFrame, ts: str, windows: DataFrame, start: str, end: str) -> tuple[DataFrame, datetime | None, datetime | None]:
    """``facts`` from the earliest start to the latest end of ``windows``, and these two.

    They go into the filter as literals that reach the scan: files and row groups outside are not read.  A day is allowed on either side for what a cast of ``ts`` may shift; the
    windows themselves decide later.
    """
    low, high = windows.agg(F.min(F.col(start).cast(NTZ)), F.max(F.col(end).cast(NTZ))).first()
    if low is None or high is None:
        return facts.limit(0), None, None
    kind, day = facts.schema[ts].dataType, timedelta(days=1)
    literal = lambda at: F.lit(at.date()) if kind == T.DateType() else F.lit(at).cast(NTZ).cast(kind)
    return facts.filter((F.col(ts) >= literal(low - day)) & (F.col(ts) <= literal(high + day))), low, high


@dataclass(frozen=True)
class Layout:
    """Facts partitioned by a bucket of their model and by month; the buckets bound the number of folders where models are many."""

    buckets: int = 64
    bucket: str = "fact_bucket"
    month: str = "fact_month"

    def bucket_of(self, model: str) -> Column:
        return F.pmod(F.xxhash64(F.col(model).cast("string")), F.lit(self.buckets)).cast("int")


def lay_out(facts: DataFrame, path: str, model: str, ts: str, layout: Layout) -> None:
    """Writes facts in the layout that lets a load read only what its windows ask for; a partition of any size is written by several tasks."""
    laid = facts.withColumns({layout.bucket: layout.bucket_of(model), layout.month: F.trunc(F.col(ts).cast("date"), "MM")})
    laid.hint("rebalance", layout.bucket, layout.month).write.mode("overwrite").partitionBy(layout.bucket, layout.month).parquet(path)


def in_cells(facts: DataFrame, cells: DataFrame, model: str, ts: str, layout: Layout | None = None) -> DataFrame:
    """``facts`` in the windows of ``cells``, with their ``chunk_id``.

    An interval join by hash: equality on model and month narrows it to a window or two a row, then the bounds decide.  If ``facts`` are partitioned by ``layout``, the cells, where
    they are broadcast, prune the partitions: of each model the months of its own windows are read and not the span of all windows.
    """
    cells, at = sized(cells), F.col(ts).cast(NTZ)
    facts, low, high = between_bounds(facts, ts, cells, "__from", "__upto")
    hit = F.col(model) == F.col("__model")
    if layout and low is not None:
        # One key of bucket and month: two keys would prune by the buckets of all cells and, apart from that, by the months of all cells.
        pair = lambda bucket, month: F.concat(bucket.cast("string"), F.lit("@"), F.col(month).cast("string"))
        hit &= pair(F.col(layout.bucket), layout.month) == pair(layout.bucket_of("__model"), "__month")
        # This filters nothing; Spark prunes by a broadcast side only if it is filtered.
        cells = cells.filter(F.col("__month").between(F.lit(low.date().replace(day=1)), F.lit(high.date())))
    else:
        hit &= F.trunc(F.col(ts).cast("date"), "MM") == F.col("__month")
    return facts.join(cells, hit).filter((at >= F.col("__from")) & (at < F.col("__upto"))).select(*facts.columns, "chunk_id")


def assign_chunks(facts: DataFrame, units: DataFrame, model: str, ts: str, half_open: bool = False, layout: Layout | None = None) -> DataFrame:
    """``facts`` of many models with the ``chunk_id`` of the window they fall in; rows in no window are left out.  For ``layout`` see :func:`in_cells`."""
    return in_cells(facts, cells_of(units, upper_bound(half_open)), model, ts, layout)


def assign_model_chunks(facts: DataFrame, units: DataFrame, ts: str, half_open: bool = False) -> DataFrame:
    """The same for the facts of one model."""
    return assign_chunks(facts.withColumn("__m", F.lit("")), units.withColumn("model_name", F.lit("")), "__m", ts, half_open).drop("__m")


def incremental_load(facts: DataFrame, bounds: DataFrame, model: str, ts: str, layout: Layout | None = None) -> DataFrame:
    """Rows of each model inside its (start_ts, end_ts), both included.

    With ``layout`` (see :func:`in_cells`) each model's partitions are pruned by its own window.
    """
    if layout:
        units = bounds.select("model_name", F.lit("").alias("chunk_id"), F.col("start_ts").alias("chunk_start"), F.col("end_ts").alias("chunk_end"))
        return in_cells(facts, cells_of(units, upper_bound()), model, ts, layout).select(*facts.columns)
    windows = sized(bounds.select(F.col("model_name").alias("__model"), F.col("start_ts").alias("__start"), F.col("end_ts").alias("__end")))
    joined = between_bounds(facts, ts, windows, "__start", "__end")[0].join(windows, F.col(model) == F.col("__model"))
    return joined.filter(F.col(ts).cast(NTZ).between(F.col("__start"), F.col("__end"))).select(*facts.columns)


def record_bounds(ledger: DataFrame, bounds: DataFrame, execution_ts: str, run_group_id: str, now, chunk_key: str | Column = "full") -> DataFrame:
    """The ledger after a load of ``bounds``: started rows that carry the windows."""
    rows = bounds.select("model_name", F.lit(execution_ts).alias("execution_ts"), F.lit(run_group_id).alias("run_group_id"), (F.lit(chunk_key) if isinstance(chunk_key, str) else chunk_key).alias("chunk_key"), "start_ts", "end_ts", F.lit(0).alias("seq"))
    ledger = upsert_started(ledger, rows.select("model_name", "execution_ts", "run_group_id", "chunk_key"), now)
    return record_window_end(record_window_start(ledger, rows, now), rows, now)


def reload_days(facts: DataFrame, bounds: DataFrame, model: str, ts: str, path: str, half_open: bool = True) -> int:
    """Writes the rows inside each model's window by model and day, replacing the days it reads again.

    The lookback makes windows overlap, so days are replaced and not appended: late rows come in and nothing doubles.  A day is replaced as a whole, so a
    window is widened to whole days on both sides; days of it that have no rows any more come out empty.  All days are swapped at once
    (read them by ``read_partitions``); the version's number comes back.

    The last day is taken up to midnight; with ``half_open=False`` up to its last full second, 23:59:59, as closed windows end.
    """
    last = F.expr("interval '86399.999999' second" if half_open else "interval '86399' second")
    day = lambda c: F.col(c).cast("date").cast(NTZ)
    whole = Scratch(facts.sparkSession, "whole").table(bounds.select("model_name", day("start_ts").alias("start_ts"), (day("end_ts") + last).alias("end_ts")))
    rows = incremental_load(facts, whole, model, ts).withColumns({"load_model": F.col(model).cast("string"), "load_day": F.col(ts).cast("date")})

    def touched(parts: DataFrame) -> DataFrame:
        spans = whole.select(F.col("model_name").cast("string").alias("load_model"), F.col("start_ts").cast("date").alias("__a"), F.col("end_ts").cast("date").alias("__b"))
        return parts.join(spans, "load_model").filter(F.col("load_day").cast("date").between(F.col("__a"), F.col("__b")))

    return replace_partitions(rows, path, ["load_model", "load_day"], touched, packed=True)


def single_bounds(plan: DataFrame, bounds: DataFrame) -> DataFrame:
    """``bounds`` of the models that ``plan`` loads in one window."""
    return bounds.join(plan.filter(F.col("disposition") == "single").select("model_name"), "model_name", "left_semi")


def single_units(plan: DataFrame, bounds: DataFrame) -> DataFrame:
    """The same as units of one window each, called 'full'."""
    return single_bounds(plan, bounds).select("model_name", F.lit("full").alias("chunk_id"), F.col("start_ts").alias("chunk_start"), F.col("end_ts").alias("chunk_end"))


def chunked_backfill(facts: DataFrame, plan: DataFrame, bounds: DataFrame, model: str, ts: str, half_open: bool = False, layout: Layout | None = None) -> DataFrame:
    """All rows that a plan loads, with their ``chunk_id``: windows of chunked models, and the incremental window ('full') of the others.

    One join of ``facts``, read once, for all models and windows.
    """
    chunks = cells_of(chunk_units(plan), upper_bound(half_open))
    return in_cells(facts, chunks.unionByName(cells_of(single_units(plan, bounds), upper_bound())), model, ts, layout)


def write_backfill(facts: DataFrame, plan: DataFrame, bounds: DataFrame, model: str, ts: str, chunks: str, days: str, half_open: bool = False) -> None:
    """Loads a plan: chunks in place of their last version under ``chunks``, and the windows of the other models by day under ``days``.

    Windows with lookback overlap from run to run, so they replace days and not a chunk, which would lose what earlier runs have loaded.
    """
    units = Scratch(facts.sparkSession, "units").table(chunk_units(plan))
    ran = units.select(F.col("model_name").alias(model), "chunk_id")
    write_chunks(assign_chunks(facts, units, model, ts, half_open), chunks, model, ran=ran)
    reload_days(facts, single_bounds(plan, bounds), model, ts, days)


def unfinished(units: DataFrame, ledger: DataFrame, run_group_id: str) -> DataFrame:
    """``units`` (model_name, chunk_id, ...) that have not succeeded in this run group."""
    done = ledger.filter((F.col("run_group_id") == run_group_id) & (F.col("status") == "succeeded"))
    return units.join(done.select("model_name", F.col("chunk_key").alias("chunk_id")).distinct(), ["model_name", "chunk_id"], "left_anti")


def in_waves(units: DataFrame, waves: int) -> DataFrame:
    """``units`` with ``wave``, from 0: windows of one span of months each, so that a wave's bounds keep the others' facts from being read."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    low, high = units.agg(F.min(month("chunk_start")), F.max(month("chunk_start"))).first()
    if low is None:
        return units.withColumn("wave", F.lit(0))
    return units.withColumn("wave", F.coalesce(F.floor((month("chunk_start") - low) * waves / (high - low + 1)), F.lit(0)).cast("int"))


def resume_backfill(
    facts: DataFrame, plan: DataFrame, bounds: DataFrame, model: str, ts: str, chunks: str, days: str, ledger: str, execution_ts: str, run_group_id: str, clock: Callable[[], datetime],
    waves: int = 1, half_open: bool = False, layout: Layout | None = None,
) -> DataFrame:
    """Loads a plan as :func:`write_backfill` does, wave by wave, and keeps the outcome of every chunk in the ledger by day at ``ledger``.

    Chunks that have succeeded in this run group are not loaded again, so a backfill that was stopped goes on with the rest.  All chunks to load are started, with their windows,
    before the first is loaded: a model's watermark moves only when the last of them has succeeded.  A wave is one job for its chunks of all models; its chunks are swapped in
    together and then succeed, or fail together, which ends the run with the error.  A run that dies between swap and outcome loads that wave once more, in place.

    Returns (model_name, chunk_id, status, rows) of all units of the plan.  Rows are counted in what was written.
    """
    spark = facts.sparkSession
    scratch = Scratch(spark, "resume")
    units = scratch.table(chunk_units(plan).select("model_name", "chunk_id", "chunk_start", "chunk_end").unionByName(single_units(plan, bounds)), "units")
    mine = lambda: read_days(spark, ledger).filter(F.col("execution_ts") == execution_ts)
    left = scratch.table(in_waves(unfinished(units, mine(), run_group_id), waves), "left")

    def record(rows: DataFrame, status: str) -> None:
        keys = rows.select("model_name", F.lit(execution_ts).alias("execution_ts"), F.lit(status).alias("status"), F.lit(clock()).cast(NTZ).alias("updated_at"), F.lit(run_group_id).alias("run_group_id"), F.col("chunk_id").alias("chunk_key"))
        upsert_days(spark, ledger, keys, upsert_status)

    started = left.select("model_name", F.lit(execution_ts).alias("execution_ts"), "chunk_id", F.col("chunk_start").alias("start_ts"), F.col("chunk_end").alias("end_ts"))
    upsert_days(spark, ledger, started, lambda held, rows: record_bounds(held, rows, execution_ts, run_group_id, clock(), F.col("chunk_id")))
    for wave in sorted(r["wave"] for r in left.select("wave").distinct().collect()):
        now = left.filter(F.col("wave") == wave)
        several, once = now.filter("chunk_id <> 'full'"), now.filter("chunk_id = 'full'")
        try:
            if several.head(1):
                write_chunks(assign_chunks(facts, several, model, ts, half_open, layout), chunks, model, ran=several.select(F.col("model_name").alias(model), "chunk_id"))
            if once.head(1):
                reload_days(facts, once.select("model_name", F.col("chunk_start").alias("start_ts"), F.col("chunk_end").alias("end_ts")), model, ts, days)
        except Exception:
            record(now, "failed")
            raise
        record(now, "succeeded")
    status = mine().filter((F.col("run_group_id") == run_group_id) & (F.col("status") == "succeeded")).select("model_name", F.col("chunk_key").alias("chunk_id"), "status")
    by_chunk = live(spark, chunks, [model, "chunk_id"]).select(F.col(model).alias("model_name"), "chunk_id", "rows")
    by_day = live(spark, days, ["load_model", "load_day"]).join(units.filter("chunk_id = 'full'"), F.col("load_model") == F.col("model_name"))
    by_day = by_day.filter(F.col("load_day").cast("date").between(F.col("chunk_start").cast("date"), F.col("chunk_end").cast("date"))).groupBy("model_name", "chunk_id").agg(F.sum("rows").alias("rows"))
    counted = units.select("model_name", "chunk_id").join(status, ["model_name", "chunk_id"], "left").join(by_chunk.unionByName(by_day), ["model_name", "chunk_id"], "left")
    return counted.withColumn("rows", F.coalesce("rows", F.lit(0)))
