"""Sinks of chunked loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.generations import replace_partitions


def write_chunks(df: DataFrame, path: str, model: str = "model_name", by: str = "chunk_id", ran: DataFrame | None = None) -> int:
    """Replaces exactly the chunks of each model that ``df`` holds rows of: running a chunk again changes no other chunk and no other model's.

    Chunks of ``ran`` (``model``, ``by``) without rows in ``df`` come out empty.  Chunks are staged apart and swapped at once (see :mod:`tidemark.sources.generations`,
    whose ``read_partitions`` reads them), and packed, as they grow with the models; the version's number comes back.
    """
    covered = None if ran is None else ran.select(F.col(model).cast("string").alias(model), F.col(by).cast("string").alias(by)).distinct()
    return replace_partitions(df, path, [model, by], None if covered is None else lambda parts: parts.join(covered, [model, by], "left_semi"), packed=True)


def reset_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empties a table before a chunked full refresh."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def dry_run(df: DataFrame) -> DataFrame:
    """The columns of ``df`` and no rows: errors of the query show, data are not read."""
    return df.limit(0)
