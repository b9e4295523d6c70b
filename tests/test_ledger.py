"""Cases of the ledger that the driver's tables do not hold: nulls, ties, retries."""

from datetime import date, datetime, timedelta

import pytest

from tidemark.operators import ledger as L
from tidemark.operators import watermarks as W
from tidemark.sources import ledger_store as S

T0 = datetime(2026, 6, 5, 10)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def make(spark, *rows):
    """(status, run group, chunk, minutes, optional extras) on model m."""
    full = []
    for status, group, chunk, minutes, *more in rows:
        extra = more[0] if more else {}
        full.append(("m", extra.get("day", "2026-06-05"), status, at(minutes), group, chunk, extra.get("beat"), extra.get("start"), extra.get("end")))
    return spark.createDataFrame(full, S.LEDGER)


def view(spark, *rows):
    return [r.asDict() for r in L.completions_view(make(spark, *rows), date(2026, 6, 6)).collect()]


@pytest.mark.parametrize(
    "rows, status, chunk",
    [
        ([("started", "A", "full", 0), ("succeeded", "A", "full", 5)], "succeeded", "full"),
        ([("started", "A", "c1", 0), ("started", "A", "c2", 0), ("succeeded", "A", "c1", 5)], "started", "__all__"),
        ([("succeeded", "A", "c1", 5), ("failed", "A", "c2", 6)], "failed", "__all__"),
        ([("failed", "A", "c2", 6), ("succeeded", "A", "c2", 9), ("succeeded", "A", "c1", 5)], "succeeded", "__all__"),
        ([("failed", "A", "full", 6), ("succeeded", "B", "full", 9)], "succeeded", "full"),
        ([("succeeded", "A", "full", 9), ("failed", "B", "full", 9)], "failed", "full"),
        ([("succeeded", "A", "full", 1), ("locked_out", "B", "full", 9), ("crashed", "C", "full", 9)], "succeeded", "full"),
    ],
)
def test_view(spark, rows, status, chunk):
    (row,) = view(spark, *rows)
    assert (row["status"], row["chunk_key"]) == (status, chunk)


def test_view_without_rows(spark):
    assert view(spark, ("locked_out", "A", "full", 0)) == []
    assert view(spark, ("succeeded", "A", "full", 0, {"day": "2026-04-01"})) == []
    # A null run group that is latest hides the day.
    assert view(spark, ("succeeded", "A", "full", 0), ("failed", None, "full", 5)) == []
    assert L.completions_view(make(spark), date(2026, 6, 6)).count() == 0


def test_view_window(spark):
    (row,) = view(spark, ("started", "A", "c1", 0, {"start": at(-9), "end": at(-5)}), ("started", "A", "c2", 1, {"start": at(-7), "end": at(-3)}))
    assert (row["start_ts"], row["end_ts"], row["updated_at"]) == (at(-9), at(-3), at(1))


@pytest.mark.parametrize(
    "rows, mark",
    [
        ([("started", "A", "full", 0, {"end": at(-1)}), ("succeeded", "A", "full", 5)], at(-1)),
        ([("started", "A", "full", 0, {"end": at(-1)})], None),
        ([("started", "A", "full", 0, {"end": at(-1)}), ("failed", "A", "full", 5)], None),
        ([("started", "A", "full", 0, {"end": at(-1)}), ("failed", "A", "full", 5), ("succeeded", "A", "full", 7)], at(-1)),
        ([("started", "A", "c1", 0, {"end": at(-1)}), ("started", "A", "c2", 0, {"end": at(-2)}), ("succeeded", "A", "c1", 5)], None),
        ([("started", "A", "f", 0, {"end": at(-1)}), ("succeeded", "A", "f", 5), ("started", "B", "f", 8, {"end": at(9)})], at(-1)),
        ([("started", "A", "f", 0, {"end": at(-1)}), ("succeeded", "A", "f", 5), ("started", "B", "f", 8, {"end": at(-60)}), ("succeeded", "B", "f", 9)], at(-1)),
        # A null run group matches nothing: without an end it does no harm, with one it counts.
        ([("started", "A", "f", 0, {"end": at(-1)}), ("succeeded", "A", "f", 5), ("started", None, "f", 8)], at(-1)),
        ([("started", None, "f", 8, {"end": at(4)})], at(4)),
    ],
)
def test_watermark(spark, rows, mark):
    assert [r.watermark for r in W.read_watermark(make(spark, *rows)).collect()] == [mark]


def test_upsert_is_idempotent_and_keeps_null_keys(spark):
    old = make(spark, ("started", "A", "f", 0, {"end": at(3)}), ("started", None, "f", 1))
    new = make(spark, ("started", "A", "f", 4), ("started", "A", "f", 5), ("started", None, "f", 6), ("started", None, "f", 6), ("failed", "A", "f", 7))
    once = L.upsert_status(old, new)
    assert once.count() == 5
    assert [(r.updated_at, r.end_ts) for r in once.filter("run_group_id = 'A' and status = 'started'").collect()] == [(at(5), at(3))]
    whole = new.filter("run_group_id is not null")
    assert sorted(map(str, L.upsert_status(L.upsert_status(old, whole), whole).collect())) == sorted(map(str, L.upsert_status(old, whole).collect()))


def attempt(spark, group="A"):
    return spark.createDataFrame([("m", "2026-06-05", group, "f")], "model_name string, execution_ts string, run_group_id string, chunk_key string")


def test_started_retries(spark):
    first = L.upsert_started(make(spark), attempt(spark), at(0))
    again = L.upsert_started(first, attempt(spark), at(10))
    (row,) = again.collect()
    assert (row.status, row.updated_at, row.heartbeat_at) == ("started", at(0), at(10))
    out = L.apply_lockouts(again, attempt(spark), at(11))
    (row,) = out.collect()
    assert (row.status, row.updated_at) == ("locked_out", at(11))
    (row,) = L.upsert_started(out, attempt(spark), at(20)).collect()
    assert (row.status, row.updated_at, row.heartbeat_at) == ("started", at(20), at(20))


@pytest.mark.parametrize(
    "rows, losers",
    [
        ([("started", "A", "f", 0), ("started", "B", "f", 1)], {("B", "A")}),
        ([("started", "A", "f", 0), ("started", "B", "f", 0)], {("B", "A")}),
        ([("started", "A", "f", 0), ("succeeded", "A", "f", 1), ("started", "B", "f", 2)], set()),
        ([("started", "A", "c1", 0), ("started", "A", "c2", 5)], set()),
        ([("started", "A", "f", 0), ("crashed", "A", "f", 1), ("started", "B", "f", 2)], set()),
        ([("started", "A", "f", 2), ("started", "B", "f", 0), ("started", "C", "f", 1)], {("A", "B"), ("C", "B")}),
    ],
)
def test_lock(spark, rows, losers):
    assert {(r.run_group_id, r.winner) for r in L.lock_losers(make(spark, *rows)).collect()} == losers


def test_sweep(spark):
    rows = make(spark, ("started", "A", "f", 0, {"beat": at(0)}), ("started", "B", "f", 0, {"beat": at(200)}), ("started", "C", "f", 0), ("started", "D", "f", 0, {"beat": at(0)}), ("failed", "D", "f", 1))
    swept = L.sweep_crashed(rows, at(300))
    assert [r.run_group_id for r in swept.filter("status = 'crashed'").collect()] == ["A"]
    assert L.sweep_crashed(swept, at(400)).filter("status = 'crashed'").count() == 1 + 0


def test_ledger_schema_heals(spark, tmp_path):
    assert S.read_ledger(spark, f"{tmp_path}/none").columns == S.LEDGER.names
    old = spark.createDataFrame([("m", "2026-01-01", "started")], "MODEL_NAME string, execution_ts string, status string")
    assert S.as_ledger(old).schema == S.LEDGER and S.as_ledger(old).count() == 1
    assert S.as_ledger(old, "replace").count() == 0
    assert S.scan_or_empty(spark, "no_such_table", S.LEDGER).count() == 0


def test_window_args():
    W.check_window_args("partial", date(2024, 1, 1), date(2024, 2, 1))
    W.check_window_args("none", execution=date(2024, 1, 1))
    for bad in (("partial", None, date(2024, 1, 1)), ("partial", date(2024, 1, 1), date(2024, 1, 1)), ("partial", date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)), ("full", date(2024, 1, 1))):
        with pytest.raises(ValueError):
            W.check_window_args(*bad)


def test_upsert_days_touches_only_its_days(spark, tmp_path):
    import os

    path = f"{tmp_path}/ledger"
    both = make(spark, ("started", "A", "f", 0), ("started", "B", "f", 0, {"day": "2026-06-06"}), ("started", "C", "f", 0, {"day": None}))
    S.upsert_days(spark, path, both, L.upsert_status)
    before = sorted(os.listdir(f"{path}/execution_ts=2026-06-05"))
    new = make(spark, ("started", "B", "f", 9, {"day": "2026-06-06"}), ("failed", "D", "f", 9, {"day": None}))
    S.upsert_days(spark, path, new, L.upsert_status)
    assert sorted(os.listdir(f"{path}/execution_ts=2026-06-05")) == before
    got = {(r.run_group_id, r.updated_at) for r in spark.read.schema(S.LEDGER).parquet(path).collect()}
    assert got == {("A", at(0)), ("B", at(9)), ("C", at(0)), ("D", at(9))}


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_incremental_bounds_reach_the_scan_of_any_time_type(spark, tmp_path, kind, zone, capsys):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    hours = session.range(0, 24 * 30, 1, 4).selectExpr("id", f"CAST(timestamp_ntz'2024-03-01' + make_dt_interval(0, id) AS {kind}) AS ts")
    hours.unionByName(session.sql(f"SELECT -1L AS id, CAST(NULL AS {kind}) AS ts")).write.parquet(f"{tmp_path}/hours")
    table = session.read.parquet(f"{tmp_path}/hours")
    low, high = datetime(2024, 3, 10, 1), datetime(2024, 3, 12, 2, 30)
    got = W.incremental_filter(table, "ts", low, high)
    plain = table.filter(f"CAST(ts AS timestamp_ntz) >= timestamp_ntz'{low}' AND CAST(ts AS timestamp_ntz) <= timestamp_ntz'{high}'")
    assert sorted(got.collect()) == sorted(plain.collect()) != []
    got.explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


def test_incremental_bounds_may_be_columns_and_null(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, date'2024-01-02', date'2024-01-01', date'2024-01-03'), (2, date'2024-01-04', date'2024-01-01', date'2024-01-03'), (3, date'2024-01-02', NULL, date'2024-01-03') AS t(id, day, low, high)")
    assert [r.id for r in W.incremental_filter(frame, "day", "low", "high").collect()] == [1]
    assert W.incremental_filter(frame.limit(0), "day", "low", "high").collect() == []
