"""Chunk windows and run plans of backfills, for all models in one frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import NTZ, as_column, as_date, chunk_label, month_grid, month_span, resume_start, shift_seconds, to_naive_utc, upper_date, window_end
from tidemark.operators.watermarks import check_window_args

WINDOWS = "array<struct<chunk_id:string,start:timestamp_ntz,end:timestamp_ntz>>"


def with_cells(models: DataFrame, low, high) -> DataFrame:
    """``models`` (first_timestamp, chunk_months, ...) with ``__cells``: cells of the month grid that overlap [low, high), cut to it, as (start, end, chunk_id) in order.

    ``chunk_id`` is the month of the uncut start, so a chunk has the same id in every run.  No cells if ``high`` is not after ``low`` or the chunk size is under one.
    The grid is a column of its own, so that it is walked once a model.
    """
    framed = models.withColumns({"__lo": as_column(low).cast("date"), "__hi": as_column(high).cast("date")})
    framed = framed.withColumn("__bounds", month_grid("first_timestamp", "chunk_months", "__hi"))
    lo, bounds = F.col("__lo"), F.col("__bounds")
    inner = F.size(bounds) - 1
    cells = F.zip_with(F.slice(bounds, 1, inner), F.slice(bounds, 2, inner), lambda a, b: F.struct(F.greatest(a, lo).alias("start"), b.alias("end"), chunk_label(a).alias("chunk_id")))
    none = F.array().cast("array<struct<start:date,end:date,chunk_id:string>>")
    kept = F.when((F.col("__hi") > lo) & bounds.isNotNull(), F.filter(cells, lambda c: c["end"] > lo)).otherwise(none)
    return framed.withColumn("__cells", kept).drop("__lo", "__hi", "__bounds")


def closed_windows(first_start=None, final_end=None) -> Column:
    """``__cells`` as closed windows (chunk_id, start, end): from midnight to a second before the next boundary.

    ``first_start`` and ``final_end``, where given and not null, replace the first start and the last end.
    """
    cells = F.col("__cells")
    last = F.size(cells) - 1

    def window(c: Column, i: Column) -> Column:
        start, end = c["start"].cast(NTZ), shift_seconds(c["end"], -1)
        if first_start is not None:
            start = F.when(i == 0, F.coalesce(as_column(first_start), start)).otherwise(start)
        if final_end is not None:
            end = F.when(i == last, F.coalesce(as_column(final_end), end)).otherwise(end)
        return F.struct(c["chunk_id"].alias("chunk_id"), start.alias("start"), end.alias("end"))

    return F.transform(cells, window).cast(WINDOWS)


def chunk_windows(models: DataFrame, low, high) -> DataFrame:
    """(model_name, chunk_start, chunk_end, chunk_id): a row for each cell of each model (model_name, first_timestamp, chunk_months)."""
    return with_cells(models, low, high).select("model_name", F.explode("__cells").alias("c")).select("model_name", F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"), "c.chunk_id")


def plannable_models(models: DataFrame) -> DataFrame:
    """Chunked models with a first timestamp and a chunk size."""
    chunked = F.col("kind") == "chunked" if "kind" in models.columns else F.lit(True)
    return models.filter(chunked & F.col("first_timestamp").isNotNull() & F.col("chunk_months").isNotNull())


def static_chunks(models: DataFrame, today) -> DataFrame:
    """Every plannable model's chunks from its first timestamp to ``today``."""
    return chunk_windows(plannable_models(models), F.col("first_timestamp"), today)


def _planned(frame: DataFrame, chunked: Column, chunks: Column) -> DataFrame:
    return frame.select("model_name", F.when(chunked, "chunked").otherwise("single").alias("disposition"), F.when(chunked, chunks).otherwise(F.array().cast(WINDOWS)).alias("chunks"))


def plan_full(models: DataFrame, execution) -> DataFrame:
    """Always in chunks, from the first timestamp to the window's end; none if that is not later."""
    celled = with_cells(models, "first_timestamp", upper_date(execution, F.col("lag")))
    return _planned(celled, F.lit(True), closed_windows(final_end=window_end(execution, F.col("lag"))))


def plan_incremental(models: DataFrame, watermarks: DataFrame, execution) -> DataFrame:
    """From the watermark on: once if that is no longer than a chunk, else in chunks; in chunks from the first timestamp if there is no watermark."""
    known = models.join(watermarks.select("model_name", "watermark"), "model_name", "left")
    known = known.withColumns({"__start": resume_start("watermark", "first_timestamp", "lookback"), "__upper": upper_date(execution, F.col("lag"))})
    low = F.coalesce(F.col("__start").cast("date"), F.col("first_timestamp").cast("date"))
    known = known.withColumn("__low", low)
    chunked = F.col("watermark").isNull() | (month_span("__low", "__upper") > F.col("chunk_months"))
    return _planned(with_cells(known, "__low", "__upper"), chunked, closed_windows("__start", window_end(execution, F.col("lag"))))


def plan_partial(models: DataFrame, start, end) -> DataFrame:
    """The given window as it is: once if it is no longer than a chunk or a bound is missing, else in chunks."""
    if start is None or end is None:
        return _planned(models, F.lit(False), F.array().cast(WINDOWS))
    exact = lambda v: to_naive_utc(F.lit(v)) if isinstance(v, str) else as_column(v).cast(NTZ)
    first = F.col("first_timestamp").cast("date")
    framed = models.withColumns({"__low": F.greatest(as_date(exact(start)), first), "__high": as_date(exact(end)), "__start": F.greatest(exact(start), first.cast(NTZ)), "__end": exact(end)})
    chunked = (F.col("__high") > F.col("__low")) & (month_span("__low", "__high") > F.col("chunk_months")) & (F.size("__cells") > 0)
    return _planned(with_cells(framed, "__low", "__high"), F.coalesce(chunked, F.lit(False)), closed_windows("__start", "__end"))


def run_plan(models: DataFrame, watermarks: DataFrame, mode: str, execution=None, start=None, end=None) -> DataFrame:
    """(model_name, disposition, chunks) of every plannable model; modes: none (incremental), full and partial."""
    models = plannable_models(models)
    if mode == "partial":
        if start is not None and end is not None:
            check_window_args(mode, start, end)
        return plan_partial(models, start, end)
    if mode == "full":
        return plan_full(models, execution)
    return plan_incremental(models, watermarks, execution)


def chunk_units(plan: DataFrame) -> DataFrame:
    """(model_name, chunk_id, chunk_start, chunk_end): a unit of work for each window of chunked models."""
    units = plan.filter(F.col("disposition") == "chunked").select("model_name", F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL")  # a plain explode would have the grid computed again for a filter on its size
    return units.select("model_name", "c.chunk_id", F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"))


def plan_json(plan: DataFrame) -> DataFrame:
    """(model_name, plan): the plan of each model as JSON with ISO instants in UTC."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    chunks = F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), iso(c["start"]).alias("start"), iso(c["end"]).alias("end")))
    return plan.select("model_name", F.to_json(F.struct("disposition", chunks.alias("chunks"))).alias("plan"))


def plan_from_json(plans: DataFrame) -> DataFrame:
    """(model_name, disposition, chunks) of what :func:`plan_json` wrote, so that a plan kept as text gives units of work again."""
    read = F.from_json("plan", "disposition string, chunks array<struct<chunk_id:string,start:string,end:string>>")
    at = lambda t: to_naive_utc(t)
    chunks = F.transform("p.chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), at(c["start"]).alias("start"), at(c["end"]).alias("end"))).cast(WINDOWS)
    # Exploded, the plan is a row that later filters cannot be pushed through: in a filter on its disposition the text would be made and read once more.
    return plans.select("model_name", F.explode(F.array(read)).alias("p")).select("model_name", "p.disposition", chunks.alias("chunks"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: models, chunked and single ones, and chunks."""
    chunked = F.col("disposition") == "chunked"
    return plan.agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if(chunked).alias("chunked"),
        F.count_if(~chunked).alias("single"),
        F.coalesce(F.sum(F.size("chunks")), F.lit(0)).cast("long").alias("chunks"),
    )
