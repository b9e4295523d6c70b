"""Calendar rules against plain Python, on random dates."""

import calendar
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.plans import windows


def add(d, months):
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def grid(first, months, until):
    out = [first]
    while out[-1] < until:
        out.append(min(add(out[-1], months), until))
    return out


def span(a, b):
    if b <= a:
        return 0
    k = 0
    while add(a, k + 1) <= b:
        k += 1
    return k + (add(a, k) < b)


def test_grid_and_span(spark):
    r = random.Random(3)
    day = lambda: date(2018, 1, 1) + timedelta(days=r.randrange(3000))
    rows = [(i, day(), r.choice([1, 1, 2, 3, 6, 12, 40]), day()) for i in range(600)] + [(600 + i, date(2020, 1, 31), 1, date(2021, 1, i + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, first date, months int, until date")
    got = {x.i: x for x in df.select("i", D.month_grid("first", "months", "until").alias("g"), D.month_span("first", "until").alias("s")).collect()}
    for i, first, months, until in rows:
        assert got[i].g == (grid(first, months, until) if first < until else None)
        assert got[i].s == span(first, until)


def test_small_months_zero_and_long_grids(spark):
    df = spark.createDataFrame([(date(1900, 1, 31), 1, date(2100, 1, 1)), (date(2020, 1, 1), 0, date(2021, 1, 1))], "first date, months int, until date")
    long, none = [r.g for r in df.select(D.month_grid("first", "months", "until").alias("g")).collect()]
    assert long == grid(date(1900, 1, 31), 1, date(2100, 1, 1)) and none is None


def plan(spark, mode, first="2022-01-01", months=6, wm=None, lag=0, lookback=0, execution=date(2026, 1, 1), start=None, end=None):
    models = spark.createDataFrame([("m", date.fromisoformat(first), months, lag, lookback)], "model_name string, first_timestamp date, chunk_months int, lag int, lookback int")
    marks = spark.createDataFrame([("m", wm)], "model_name string, watermark timestamp_ntz")
    (row,) = windows.run_plan(models, marks, mode, execution, start, end).collect()
    return row.disposition, [(c.chunk_id, c.start, c.end) for c in row.chunks]


def test_plans(spark):
    kind, chunks = plan(spark, "full", months=12)
    assert kind == "chunked" and [c[0] for c in chunks] == ["2022-01", "2023-01", "2024-01", "2025-01"]
    assert chunks[0][1:] == (datetime(2022, 1, 1), datetime(2022, 12, 31, 23, 59, 59)) and chunks[-1][2] == datetime(2025, 12, 31, 23, 59, 59)
    assert plan(spark, "none", wm=datetime(2025, 12, 20, 23, 59, 59)) == ("single", [])
    assert plan(spark, "none")[0] == "chunked"
    kind, chunks = plan(spark, "none", months=1, wm=datetime(2025, 9, 10, 5), lookback=3, lag=2)
    assert chunks[0][:2] == ("2025-09", datetime(2025, 9, 7, 5, 0, 1)) and chunks[-1][2] == datetime(2025, 12, 29, 23, 59, 59)
    # Ids come from the uncut grid.
    assert [c[0] for c in plan(spark, "partial", start="2025-11-01", end="2026-06-01")[1]] == ["2025-07", "2026-01"]
    assert plan(spark, "partial", start="2025-11-01", end="2026-01-01") == ("single", [])
    assert plan(spark, "partial")[0] == "single"
    kind, chunks = plan(spark, "partial", months=1, start="2025-01-15T06:00:00Z", end="2025-03-10T12:30:00Z")
    assert chunks[0][1] == datetime(2025, 1, 15, 6) and chunks[-1][2] == datetime(2025, 3, 10, 12, 30)
    # A first timestamp after the window's end: chunked, and nothing to run.
    assert plan(spark, "full", first="2027-01-01") == ("chunked", [])


def test_naive_utc(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01 12:00:00+02:00",), ("2024-05-01 10:00:00",), ("2024-05-01",), ("x",)], "t string")
    got = [r.n for r in df.select(D.to_naive_utc("t").alias("n")).collect()]
    assert got == [datetime(2024, 5, 1, 10)] * 3 + [datetime(2024, 5, 1), None]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = [r.n for r in df.limit(3).select(D.to_naive_utc("t").alias("n")).collect()]
        assert got == [datetime(2024, 5, 1, 10)] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_literals(spark):
    df = spark.createDataFrame([("2024-05-01",), (" 2024-05-01T10:11:12.5Z ",), ("",)], "t string")
    assert [r.n for r in df.select(D.as_timestamp_literal("t").alias("n")).collect()] == ["2024-05-01T00:00:00", "2024-05-01T10:11:12", ""]
    assert [r.n for r in df.select(D.parse_watermark(F.trim("t")).alias("n")).collect()] == [datetime(2024, 5, 1), datetime(2024, 5, 1, 10, 11, 12), None]


def test_bounds_reach_the_scan(spark, tmp_path):
    """The literals of a load's bounds are pushed into the scan of the facts, which is read once."""
    from datetime import datetime

    from tidemark.plans import loads

    path = f"{tmp_path}/facts"
    rows = [(str(i % 3), datetime(2024, 1, 1 + i % 28), i) for i in range(200)]
    spark.createDataFrame(rows, "model_name string, ts timestamp_ntz, n int").write.parquet(path)
    facts = spark.read.parquet(path)
    bounds = spark.createDataFrame([("1", datetime(2024, 1, 9, 6), datetime(2024, 1, 10, 6)), ("2", None, None)], "model_name string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    plan = spark.createDataFrame([("1", "single", [])], "model_name string, disposition string, chunks array<struct<chunk_id:string,start:timestamp_ntz,end:timestamp_ntz>>")
    for load in (loads.incremental_load(facts, bounds, "model_name", "ts"), loads.chunked_backfill(facts, plan, bounds, "model_name", "ts")):
        text = load._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in text.splitlines() if "FileScan" in line and "facts" in line]
        assert len(scans) == 1 and "GreaterThanOrEqual(ts,2024-01-08T06:00" in scans[0] and "LessThanOrEqual(ts,2024-01-11T06:00" in scans[0]
        assert sorted(r.n for r in load.collect()) == [i for i in range(200) if i % 3 == 1 and i % 28 == 9]
    assert loads.incremental_load(facts, bounds.limit(0), "model_name", "ts").count() == 0


def test_partitions_are_pruned_by_each_models_windows(spark, tmp_path):
    """A window of a day for one model and of ten years for another read only their own partitions: all other files are no parquet files at all."""
    import glob
    import re

    from tidemark.plans import loads

    path = f"{tmp_path}/facts"
    rows = [(m, datetime(year, month, 5), year) for m in "ABC" for year in range(2014, 2025) for month in (1, 6)]
    frame, layout = spark.createDataFrame(rows, "m string, ts timestamp_ntz, n int"), loads.Layout(16)
    loads.lay_out(frame, path, "m", "ts", layout)
    bucket = {str(r.b): r.m for r in frame.select("m", layout.bucket_of("m").alias("b")).distinct().collect()}
    assert len(bucket) == 3
    schema = spark.read.parquet(path).schema
    asked = {("A", 2020, 6)} | {("B", year, month) for year in range(2014, 2024) for month in (1, 6)}
    for file in glob.glob(f"{path}/*/*/*.parquet"):
        m, year, month = re.search(r"fact_bucket=(\d+)/fact_month=(\d+)-(\d+)", file).groups()
        if (bucket[m], int(year), int(month)) not in asked:
            with open(file, "w") as f:
                f.write("no parquet")
    facts = spark.read.schema(schema).parquet(path)
    units = [("A", "day", datetime(2020, 6, 5), datetime(2020, 6, 5, 23, 59, 59)), ("B", "years", datetime(2014, 1, 1), datetime(2023, 12, 31, 23, 59, 59))]
    units = spark.createDataFrame(units, "model_name string, chunk_id string, chunk_start timestamp_ntz, chunk_end timestamp_ntz")
    chunked = loads.assign_chunks(facts, units, "m", "ts", layout=layout)
    assert "dynamicpruning" in chunked._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.m, r.ts.year, r.ts.month) for r in chunked.collect()) == sorted(asked)
    bounds = units.select("model_name", units.chunk_start.alias("start_ts"), units.chunk_end.alias("end_ts"))
    loaded = loads.incremental_load(facts, bounds, "m", "ts", layout)
    assert loaded.columns == facts.columns and sorted((r.m, r.ts.year, r.ts.month) for r in loaded.collect()) == sorted(asked)
    assert loads.assign_chunks(facts, units.limit(0), "m", "ts", layout=layout).count() == 0


def test_resumed_backfill_records_failures(spark, tmp_path):
    """A wave that fails is recorded as failed and ends the run; the next run loads that wave and the rest, and leaves what had succeeded."""
    import itertools

    import pytest
    from pyspark.sql import functions as F

    from tidemark.operators import watermarks
    from tidemark.plans import loads
    from tidemark.sources import generations, ledger_store

    facts = spark.createDataFrame([("m", datetime(2024, month, 3), month) for month in range(1, 7)], "model_name string, ts timestamp_ntz, n int")
    window = "struct<chunk_id:string,start:timestamp_ntz,end:timestamp_ntz>"
    months = [(f"2024-0{i}", datetime(2024, i, 1), datetime(2024, i + 1, 1) - timedelta(seconds=1)) for i in range(1, 7)]
    plan = spark.createDataFrame([("m", "chunked", months)], f"model_name string, disposition string, chunks array<{window}>")
    bounds = spark.createDataFrame([], "model_name string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    at = {k: f"{tmp_path}/{k}" for k in ("chunks", "days", "ledger")}
    minutes = itertools.count()
    run = lambda facts: loads.resume_backfill(facts, plan, bounds, "model_name", "ts", **at, execution_ts="2024-07-01", run_group_id="g", clock=lambda: datetime(2024, 7, 1) + timedelta(minutes=next(minutes)), waves=3)
    broken = facts.withColumn("n", F.when(F.month("ts") == 4, F.raise_error(F.lit("bad row")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="bad row"):
        run(broken)
    states = lambda: {(r.chunk_key, r.status) for r in ledger_store.read_days(spark, at["ledger"]).collect()}
    mark = lambda: [r.watermark for r in watermarks.read_watermark(ledger_store.read_days(spark, at["ledger"])).collect()]
    started = {(c[0], "started") for c in months}
    assert states() == started | {("2024-01", "succeeded"), ("2024-02", "succeeded"), ("2024-03", "failed"), ("2024-04", "failed")} and mark() == [None]
    first = {r.chunk_id: r.generation for r in generations.live(spark, at["chunks"], []).collect()}
    out = run(facts).collect()
    assert sorted((r.chunk_id, r.status, r.rows) for r in out) == [(c[0], "succeeded", 1) for c in months] and mark() == [months[-1][2]]
    after = {r.chunk_id: r.generation for r in generations.live(spark, at["chunks"], []).collect()}
    assert {c: g for c, g in after.items() if c in first} == first and len(after) == 6
    assert sorted((r.chunk_id, r.rows) for r in run(facts.limit(0)).collect()) == [(c[0], 1) for c in months]
