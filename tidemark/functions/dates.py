"""Calendar and timestamp expressions.  All timestamps are zone-less (TIMESTAMP_NTZ) and mean UTC."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def as_column(value) -> Column:
    """A column as it is; a string names a column; a date or datetime becomes a literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast(NTZ)
    if isinstance(value, date):
        return F.lit(value.isoformat()).cast("date")
    return F.col(value) if isinstance(value, str) else F.lit(value)


def execution_ts(as_of) -> Column:
    """The day of ``as_of``, at midnight."""
    return as_column(as_of).cast("date").cast(NTZ)


def cast_ts(text) -> Column:
    """'YYYY-MM-DD' with or without ' HH:MM:SS' as a timestamp; null if it is neither."""
    return as_column(text).try_cast(NTZ)


def shift_days(ts, days) -> Column:
    return as_column(ts).cast(NTZ) + F.make_dt_interval(days=as_column(days))


def shift_minutes(ts, minutes) -> Column:
    return as_column(ts).cast(NTZ) + F.make_dt_interval(mins=as_column(minutes))


def shift_seconds(ts, seconds) -> Column:
    return as_column(ts).cast(NTZ) + F.make_dt_interval(secs=as_column(seconds))


def datestr(ts) -> Column:
    return as_column(ts).cast("date").cast("string")


def days_ago_str(as_of, days) -> Column:
    return F.date_sub(as_column(as_of).cast("date"), as_column(days)).cast("string")


def instant_to_naive(ts) -> Column:
    """A zoned timestamp read at UTC, whatever the session's zone."""
    return F.lit("1970-01-01").cast(NTZ) + F.make_dt_interval(secs=(F.unix_micros(as_column(ts)) / F.lit(1000000)).cast("decimal(18,6)"))


def to_naive_utc(value, kind: str = "string") -> Column:
    """A string (with 'Z', an offset or neither), zoned timestamp or date as a zone-less UTC timestamp.

    ``kind`` is the Spark type of ``value``.
    """
    value = as_column(value)
    if kind == "timestamp":
        return instant_to_naive(value)
    if kind != "string":
        return value.cast(NTZ)
    text = F.trim(value)
    zoned = text.rlike(r"\d[T ]\d.*(Z|[+-]\d{2}(:?\d{2})?)$")
    return F.when(zoned, instant_to_naive(text.try_cast("timestamp"))).otherwise(text.try_cast(NTZ))


def as_timestamp_literal(text) -> Column:
    """'YYYY-MM-DD' becomes midnight; a longer ISO form is cut to seconds; blank stays blank."""
    text = F.trim(as_column(text))
    return F.when(text == "", text).when(F.contains(text, F.lit("T")), F.substring(text, 1, 19)).otherwise(F.concat(text, F.lit("T00:00:00")))


def parse_watermark(text) -> Column:
    """The timestamp in the first 19 characters, else the date in the first 10, else null."""
    text = F.replace(as_column(text), F.lit("T"), F.lit(" "))
    return F.coalesce(F.substring(text, 1, 19).try_cast(NTZ), F.substring(text, 1, 10).try_cast(NTZ))


def as_date(value) -> Column:
    """A timestamp, date or ISO string as a date."""
    return F.substring(as_column(value).cast("string"), 1, 10).cast("date")


def month_span(start, end) -> Column:
    """Months from ``start`` to ``end``, a begun month counting as one; 0 if ``end`` is not later."""
    start, end = as_column(start).cast("date"), as_column(end).cast("date")
    k = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    k = F.when(F.add_months(start, k) > end, k - 1).otherwise(k)
    return F.when(end <= start, 0).otherwise(k + (F.add_months(start, k) < end).cast("int"))


def window_end(execution, lag=0) -> Column:
    """The last second before ``execution`` less ``lag`` days; a negative lag counts as none."""
    return shift_seconds(shift_days(execution, -F.greatest(as_column(lag), F.lit(0))), -1)


def resume_start(watermark, first, lookback=0) -> Column:
    """The second after ``watermark`` less ``lookback`` days, no earlier than ``first``."""
    again = shift_days(shift_seconds(watermark, 1), -F.greatest(as_column(lookback), F.lit(0)))
    return F.when(as_column(watermark).isNotNull(), F.greatest(again, as_column(first).cast(NTZ)))


def upper_date(execution, lag=0) -> Column:
    """The first day that a window ending at :func:`window_end` does not reach."""
    return F.date_add(window_end(execution, lag).cast("date"), 1)


def chunk_label(start) -> Column:
    return F.date_format(as_column(start).cast("date"), "yyyy-MM")


def month_grid(first, months, until) -> Column:
    """Boundaries from ``first`` in steps of ``months`` up to ``until``, which is the last.

    Steps go from boundary to boundary, so a day clamped to a short month stays clamped: 01-31, 02-28, 03-28.  Null if ``first`` is not
    before ``until`` or ``months`` is under one.
    """
    first, months, until = as_column(first).cast("date"), as_column(months).cast("int"), as_column(until).cast("date")
    # Clamping only moves boundaries back, so a few steps more than the months between are enough to pass ``until``.
    steps = F.ceil(F.greatest(F.months_between(until, first), F.lit(0)) / months).cast("int") + 2
    spare = (F.floor(steps * months / 12 / 10)).cast("int")
    walked = F.aggregate(F.sequence(F.lit(1), steps + spare), F.array(first), lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), months))))
    inside = F.filter(walked, lambda d: d < until)
    return F.when((first < until) & (months >= 1), F.concat(inside, F.array(until)))
