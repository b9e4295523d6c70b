from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.ledger import sweep_crashed
from tidemark.scratch import Scratch
from tidemark.sources.ledger_store import LEDGER, append_transitions, fold
from tidemark.streaming.heartbeats import stream_crashes

T0 = datetime(2024, 1, 1)
KEY = ["model_name", "run_group_id", "chunk_key", "execution_ts"]


def row(chunk, minute, status="started", model="m", group="g", day="2024-01-01"):
    at = T0 + timedelta(minutes=minute)
    return (model, day, status, at, group, chunk, at if status == "started" else None, None, None)


def streamed(spark, batches, **limits):
    """Crashed keys after each batch, each batch a run of its own from the same checkpoint."""
    scratch = Scratch(spark, "hb")
    log, path, checkpoint, after = scratch.path("log"), scratch.path("out"), scratch.path("checkpoint"), []
    for batch in batches:
        append_transitions(spark.createDataFrame(batch, LEDGER).coalesce(1), log)
        stream_crashes(spark, spark.readStream.schema(LEDGER).parquet(log), path, checkpoint, **limits).awaitTermination()
        after.append(spark.read.schema(LEDGER).parquet(path).collect())
    return after


def swept(spark, batches, late):
    """The same by a sweep over the ledger after each batch, at the stream's watermark."""
    seen, crashed, after = [], [], []
    for batch in batches:
        seen += batch
        now = max(r[3] for r in seen) - timedelta(minutes=late)
        out = sweep_crashed(fold(spark.createDataFrame(seen + crashed, LEDGER)), now).filter(F.col("status") == "crashed").collect()
        crashed = [tuple(r) for r in out if r["updated_at"] == now or tuple(r) in crashed]
        after.append({tuple(r[k] for k in KEY) for r in out if r["chunk_key"] is not None and tuple(r) in crashed})
    return after


def test_batches_equal_sweeps(spark):
    batches = [
        [row("a", 0), row("b", 0), row("c", 0), row("c", 30, "failed"), row("d", 90), row("d", 90), row(None, 0), row("a", 10), row("z", 100, model="other")],
        # b beats again in time, a has crashed; what comes for a later changes nothing.
        [row("b", 230), row("e", 240), row("late", 400, "succeeded"), row("late", 395)],
        [row("a", 420, "succeeded"), row("a", 430), row("e", 410), row("f", 700)],
        [row("c", 1300), row("g", 1500, "succeeded")],
    ]
    got = streamed(spark, batches, late_minutes=60)
    assert [{tuple(r[k] for k in KEY) for r in rows} for rows in got] == swept(spark, batches, 60)
    last = got[-1]
    assert len(last) == len({tuple(r[k] for k in KEY) for r in last})
    assert all(r["status"] == "crashed" and r["heartbeat_at"] is None for r in last)
    due = {r["chunk_key"]: r["updated_at"] for r in last}
    assert due["a"] == T0 + timedelta(minutes=250) and due["e"] == T0 + timedelta(minutes=650) and "c" not in due and "late" not in due


def test_limits_are_exact_and_closed_chunks_are_forgotten(spark):
    batches = [
        [row("edge", 0), row("over", -1), row("done", 0, "succeeded"), row("x", 60, "succeeded")],
        # Two days on the closed chunk is forgotten: its new start counts.
        [row("y", 3000, "succeeded")],
        [row("done", 3010), row("y", 3200, "succeeded")],
    ]
    first, second, third = [{r["chunk_key"] for r in rows} for rows in streamed(spark, batches, ttl_minutes=60, late_minutes=0, forget_days=1)]
    assert first == {"over"} and second == {"over", "edge"} and third == {"over", "edge", "done"}


def test_no_rows_and_no_heartbeats(spark):
    silent = [("m", "2024-01-01", "started", T0, "g", "a", None, None, None), ("m", "2024-01-01", "started", None, "g", "b", None, None, None), row("c", 5000, "succeeded")]
    assert streamed(spark, [[], silent]) == [[], []]
