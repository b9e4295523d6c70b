"""Run-ledger operators: keyed upserts, the completions view and lock arbitration, for all models at once.

Null keys match nothing, as in a MERGE.  "now" is always an argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import as_column, days_ago_str, shift_minutes
from tidemark.sources.ledger_store import LEDGER

KEY = ["model_name", "execution_ts", "status", "run_group_id", "chunk_key"]
CHUNK = ["model_name", "run_group_id", "chunk_key"]
TERMINAL = ["succeeded", "failed", "locked_out", "crashed"]


def _whole(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _row(**given: Column) -> list[Column]:
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER.fields]


def _reduced(incoming: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per whole key, the last by ``order``; rows with a null in the key stay apart."""
    rest = [c for c in columns if c not in key]
    last = incoming.filter(_whole(key)).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return last.unionByName(incoming.filter(~_whole(key)).select(*key, *rest))


def upsert_status(ledger: DataFrame, incoming: DataFrame, late: bool = False) -> DataFrame:
    """Status transitions: a known key only has ``updated_at`` refreshed, an unknown one is inserted.

    Of several incoming rows with one key the latest counts.  With ``late``, incoming rows may be older than the ledger's, and ``updated_at`` never moves back.
    """
    new = _reduced(incoming, KEY, "updated_at", [*KEY, "updated_at"])
    new = new.select(*[F.col(c).alias(f"n_{c}") for c in KEY], F.col("updated_at").alias("n_updated_at"), F.lit(True).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"n_{c}") for c in KEY])
    kept = {c: F.coalesce(c, f"n_{c}") for c in KEY}
    updated = F.greatest("updated_at", "n_updated_at") if late else F.when(F.col("n"), F.col("n_updated_at")).otherwise(F.col("updated_at"))
    return ledger.join(new, same, "full_outer").select(*_row(**{c: F.col(c) for c in LEDGER.names} | kept | {"updated_at": updated}))


def upsert_started(ledger: DataFrame, attempts: DataFrame, now) -> DataFrame:
    """Attempts (model_name, execution_ts, run_group_id, chunk_key) take up their lifecycle row.

    No row: a started one is inserted.  Started: only the heartbeat moves, so priority stays.  Locked out: started again, with a fresh priority.
    """
    now = as_column(now)
    live = F.col("status").isin("started", "locked_out")
    new = _reduced(attempts, CHUNK, "execution_ts", [*CHUNK, "execution_ts"])
    new = new.select(*[F.col(c).alias(f"n_{c}") for c in [*CHUNK, "execution_ts"]], F.lit(True).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"n_{c}") for c in CHUNK])
    joined = ledger.filter(live).join(new, same, "full_outer")
    revived = F.col("n") & (F.col("status") == "locked_out")
    inserted = F.col("status").isNull()
    changed = joined.select(
        *_row(
            **{c: F.col(c) for c in LEDGER.names}
            | {c: F.coalesce(c, f"n_{c}") for c in [*CHUNK, "execution_ts"]}
            | {
                "status": F.when(F.col("n"), F.lit("started")).otherwise(F.col("status")),
                "updated_at": F.when(inserted | revived, now).otherwise(F.col("updated_at")),
                "heartbeat_at": F.when(F.col("n"), now).otherwise(F.col("heartbeat_at")),
            }
        )
    )
    return changed.unionByName(ledger.filter(~F.coalesce(live, F.lit(False))))


def record_window(ledger: DataFrame, windows: DataFrame, column: str, now) -> DataFrame:
    """Sets ``column`` (start_ts or end_ts) on the started rows of ``windows`` (model_name, execution_ts, run_group_id, chunk_key, ``column``, seq).

    Of several values for one chunk the last by ``seq`` counts; a started row is inserted where there is none.  A null start is not written.
    """
    if column == "start_ts":
        windows = windows.filter(F.col(column).isNotNull())
    new = _reduced(windows, CHUNK, "seq", [*CHUNK, "execution_ts", column])
    new = new.select(*[F.col(c).alias(f"n_{c}") for c in [*CHUNK, "execution_ts", column]], F.lit(True).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"n_{c}") for c in CHUNK])
    started = F.col("status") == "started"
    inserted = F.col("status").isNull()
    changed = (
        ledger.filter(started)
        .join(new, same, "full_outer")
        .select(
            *_row(
                **{c: F.col(c) for c in LEDGER.names}
                | {c: F.coalesce(c, f"n_{c}") for c in [*CHUNK, "execution_ts"]}
                | {
                    "status": F.lit("started"),
                    column: F.when(F.col("n"), F.col(f"n_{column}")).otherwise(F.col(column)),
                    "updated_at": F.when(inserted, as_column(now)).otherwise(F.col("updated_at")),
                }
            )
        )
    )
    return changed.unionByName(ledger.filter(~F.coalesce(started, F.lit(False))))


def record_window_end(ledger: DataFrame, windows: DataFrame, now) -> DataFrame:
    return record_window(ledger, windows, "end_ts", now)


def record_window_start(ledger: DataFrame, windows: DataFrame, now) -> DataFrame:
    return record_window(ledger, windows, "start_ts", now)


def open_rows(ledger: DataFrame) -> DataFrame:
    """Started rows whose chunk has reached no terminal status."""
    return ledger.filter(F.col("status") == "started").join(ledger.filter(F.col("status").isin(TERMINAL)).select(*CHUNK), CHUNK, "left_anti")


def sweep_crashed(ledger: DataFrame, now, ttl_minutes: int = 240) -> DataFrame:
    """Adds a crashed row for every open row whose last heartbeat is older than ``ttl_minutes``, unless its chunk has one."""
    stale = open_rows(ledger).filter(F.col("heartbeat_at") < shift_minutes(now, -ttl_minutes))
    new = stale.join(ledger.filter(F.col("status") == "crashed").select(*CHUNK), CHUNK, "left_anti")
    keys = {c: F.col(c) for c in ("model_name", "execution_ts", "run_group_id", "chunk_key")}
    return ledger.unionByName(new.select(*_row(**keys, status=F.lit("crashed"), updated_at=as_column(now))))


def lock_losers(ledger: DataFrame) -> DataFrame:
    """(model_name, run_group_id, winner): run groups with a started row that a foreign holder has priority over.

    A run group holds a model while it has an open row.  Only a model's earliest holder matters: whoever is not it and
    started later, or at the same time with a larger id, loses to it.
    """
    holder = open_rows(ledger).filter(F.col("run_group_id").isNotNull()).groupBy("model_name").agg(F.min(F.struct("updated_at", "run_group_id")).alias("h"))
    mine = ledger.filter((F.col("status") == "started") & F.col("run_group_id").isNotNull()).groupBy("model_name", "run_group_id").agg(F.min("updated_at").alias("mine"))
    later = (F.col("h.updated_at") < F.col("mine")) | ((F.col("h.updated_at") == F.col("mine")) & (F.col("h.run_group_id") < F.col("run_group_id")))
    return mine.join(holder, "model_name").filter((F.col("h.run_group_id") != F.col("run_group_id")) & later).select("model_name", "run_group_id", F.col("h.run_group_id").alias("winner"))


def apply_lockouts(ledger: DataFrame, losers: DataFrame, now) -> DataFrame:
    """Turns the started rows of ``losers`` (model_name, run_group_id[, chunk_key]) into locked-out ones."""
    key = [c for c in CHUNK if c in losers.columns]
    lost = losers.select(*key).distinct().withColumn("__lost", F.lit(True))
    out = F.coalesce("__lost", F.lit(False)) & (F.col("status") == "started")
    return ledger.join(lost, key, "left").select(
        *_row(**{c: F.col(c) for c in LEDGER.names} | {"status": F.when(out, F.lit("locked_out")).otherwise(F.col("status")), "updated_at": F.when(out, as_column(now)).otherwise(F.col("updated_at"))})
    )


def live_rows(ledger: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days (compared as text) that are neither locked out nor crashed."""
    return ledger.filter(~F.col("status").isin("locked_out", "crashed") & (F.col("execution_ts") >= days_ago_str(as_of, days)))


def completions_view(ledger: DataFrame, as_of, days: int = 30) -> DataFrame:
    """One row per (model_name, execution_ts): the state of its latest run group.

    The run group with the latest update wins, then the larger id.  Each of its chunks counts with its latest status; a failed one makes the row
    failed, else a started one makes it started.  A null run group may win, and then there is no row.  Three nested
    aggregations, each with partial sums, replace windows and self-joins, so a model with very many rows is reduced before it is shuffled.
    """
    return completions_of(live_rows(ledger, as_of, days))


VIEW = "model_name string, execution_ts string, status string, run_group_id string, chunk_key string, start_ts timestamp_ntz, end_ts timestamp_ntz, updated_at timestamp_ntz"


def completions_of(ledger: DataFrame) -> DataFrame:
    """The same of all days in ``ledger``; days do not depend on each other."""
    chunk = (
        ledger.filter(~F.col("status").isin("locked_out", "crashed"))
        .groupBy("model_name", "execution_ts", "run_group_id", "chunk_key")
        .agg(F.max(F.struct("updated_at", "status")).alias("last"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    )
    has = lambda s: F.max(F.col("last.status") == s)
    run = chunk.groupBy("model_name", "execution_ts", "run_group_id").agg(
        F.max("last.updated_at").alias("updated_at"),
        F.when(has("failed"), "failed").when(has("started"), "started").otherwise("succeeded").alias("status"),
        F.when(F.count("chunk_key") == 1, F.max("chunk_key")).otherwise("__all__").alias("chunk_key"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
    )
    best = run.groupBy("model_name", "execution_ts").agg(F.max(F.struct("updated_at", "run_group_id", "status", "chunk_key", "start_ts", "end_ts")).alias("w"))
    return best.filter(F.col("w.run_group_id").isNotNull()).select("model_name", "execution_ts", "w.status", "w.run_group_id", "w.chunk_key", "w.start_ts", "w.end_ts", "w.updated_at")
