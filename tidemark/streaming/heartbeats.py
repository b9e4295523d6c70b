"""Crashes told from heartbeats that stop, as a stream: a timer for each open chunk instead of a sweep over the ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.dates import instant_to_naive
from tidemark.operators.ledger import CHUNK, TERMINAL
from tidemark.sources.ledger_store import LEDGER

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is remembered of a chunk: its attempt, the last heartbeat in milliseconds, and whether it is closed (by a terminal status or a crash).
STATE = "execution_ts string, heartbeat long, closed boolean"
CRASH = "model_name string, run_group_id string, chunk_key string, execution_ts string, crashed_ms long"
DAY_MS = 86_400_000


def naive_to_instant(value: Column) -> Column:
    """A zone-less UTC timestamp as the instant it names, whatever the session's zone."""
    return F.concat(value.cast("string"), F.lit(" UTC")).try_cast("timestamp")


class Heartbeats(StatefulProcessor):
    """One chunk: every heartbeat moves its timer, a terminal status ends it, and a timer that fires reports a crash.

    A closed chunk is remembered for ``forget_days`` of event time, so that a late start does not open it again; then its state is dropped.
    """

    def __init__(self, ttl_ms: int, forget_ms: int):
        self.ttl_ms, self.forget_ms = ttl_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunk = handle.getValueState("chunk", STATE)

    def alarm(self, at: int) -> None:
        """The chunk's only timer."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, heartbeat, closed = self.chunk.get() or (None, None, False)
        was, ended = closed, None
        for frame in rows:
            ends = frame["status"].isin(TERMINAL)
            closed = closed or bool(ends.any())
            beats = frame[(frame["status"] == "started") & frame["beat_ms"].notna()]
            if len(beats):
                last = beats.sort_values(["beat_ms", "execution_ts"]).iloc[-1]
                if heartbeat is None or last["beat_ms"] >= heartbeat:
                    heartbeat, attempt = int(last["beat_ms"]), last["execution_ts"]
            if ends.any():
                ended = max(ended or 0, int(frame.loc[ends, "at_ms"].max()))
        self.chunk.update((attempt, heartbeat, closed))
        if closed and not was:
            self.alarm(max(ended, timerValues.getCurrentWatermarkInMs()) + self.forget_ms)
        elif not closed and heartbeat is not None:
            # Due when the watermark has passed heartbeat + ttl, not when it has only reached it.
            self.alarm(heartbeat + self.ttl_ms + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, heartbeat, closed = self.chunk.get()
        if closed:  # and long enough ago
            self.chunk.clear()
            return
        self.chunk.update((attempt, heartbeat, True))
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.forget_ms)
        yield pd.DataFrame([[*key, attempt, heartbeat + self.ttl_ms]], columns=["model_name", "run_group_id", "chunk_key", "execution_ts", "crashed_ms"])

    def close(self) -> None:
        pass


def crashed_chunks(transitions: DataFrame, ttl_minutes: int = 240, late_minutes: int = 60, forget_days: int = 30) -> DataFrame:
    """Crashed ledger rows of a stream of transitions: one for every chunk whose heartbeat is older than ``ttl_minutes`` and that has no terminal status.

    They are what :func:`tidemark.operators.ledger.sweep_crashed` adds at the stream's watermark (the latest transition seen less ``late_minutes``), but each comes as its timer fires and carries the
    time at which it was due; nothing but the state of the chunks in a batch is read.  Transitions may arrive in any order within ``late_minutes``; older ones are dropped, as in any
    watermarked stream.  A started row counts at its heartbeat, others at ``updated_at``.

    Rows with a null model, run group or chunk are left out, since null keys match nothing; a start without a heartbeat never times out; repeated rows change nothing; of equal heartbeats the larger
    ``execution_ts`` is reported.  A chunk that starts again more than ``forget_days`` after it was closed counts as new.  The session needs the RocksDB state store (``PROVIDER``).
    """
    millis = lambda c: F.unix_millis(naive_to_instant(F.col(c)))
    at = naive_to_instant(F.when(F.col("status") == "started", F.coalesce("heartbeat_at", "updated_at")).otherwise(F.col("updated_at")))
    whole = F.col("model_name").isNotNull() & F.col("run_group_id").isNotNull() & F.col("chunk_key").isNotNull()
    told = transitions.filter(whole & F.col("status").isin("started", *TERMINAL)).select(*CHUNK, "execution_ts", "status", at.alias("at"), millis("heartbeat_at").alias("beat_ms"), F.unix_millis(at).alias("at_ms"))
    crashed = (
        told.filter(F.col("at").isNotNull())
        .withWatermark("at", f"{late_minutes} minutes")
        .groupBy(*CHUNK)
        .transformWithStateInPandas(Heartbeats(ttl_minutes * 60_000, forget_days * DAY_MS), CRASH, "Append", "EventTime")
    )
    due = instant_to_naive(F.timestamp_millis("crashed_ms"))
    given = {"status": F.lit("crashed"), "updated_at": due} | {c: F.col(c) for c in [*CHUNK, "execution_ts"]}
    return crashed.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER.fields])


def stream_crashes(spark: SparkSession, transitions: DataFrame, path: str, checkpoint: str, **limits: int) -> StreamingQuery:
    """Appends :func:`crashed_chunks` to the files at ``path``, each crash once even if a batch is replayed."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)  # a query keeps the settings it was started with
    try:
        out = crashed_chunks(transitions, **limits).writeStream.format("parquet").option("path", path)
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
