"""Status transitions that arrive one by one."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ledger import upsert_status
from tidemark.sources.ledger_store import upsert_days


def stream_upsert_status(spark: SparkSession, transitions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of transitions into the ledger kept by day at ``path``.

    Each micro-batch is one upsert that reads and replaces only the days it has transitions of.  Files come in any order, so a batch may be older than what is held: the latest
    ``updated_at`` of a key stays.  An upsert is idempotent, so a batch that is replayed after a failure changes nothing.
    """

    def fold(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_days(batch.sparkSession, path, batch, partial(upsert_status, late=True))

    return transitions.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
