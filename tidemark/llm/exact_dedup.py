"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch, parallelism

#: Runs that meet in one merge.
FAN = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["__run", "__h64", "__sha", "__len"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null reads as empty.

    ``lower`` has a fast path for pure ASCII, where both agree; other texts take ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def rounds_for(partitions: int) -> int:
    """Rounds of ``FAN``-way merging; the runs, ``FAN ** rounds``, are no fewer than the shuffle's partitions."""
    rounds = 3
    while FAN**rounds < partitions:
        rounds += 1
    return rounds


def fingerprint(df: DataFrame, payload: Column, id_col: str, rounds: int) -> DataFrame:
    """Adds the run a row belongs to and its digests.

    The run comes from a hash of the identifier, so a task that is run again after an executor is
    lost puts each row where it was, and copies of one text are spread over all runs.
    """
    return df.withColumns(
        {
            "__run": F.pmod(F.xxhash64(F.lit("run"), F.col(id_col)), F.lit(FAN**rounds)),
            "__h64": F.xxhash64(payload),
            "__sha": F.unhex(F.sha2(payload, 256)),
            "__len": F.octet_length(payload).cast("long"),
        }
    )


def merge_runs(prints: DataFrame, id_col: str, rounds: int, keep: str = "largest") -> DataFrame:
    """One row per (run, text) with what the whole table holds of that text: ``keep_id`` and ``group_size``.

    Round k brings ``FAN`` runs together under ``run // FAN``: their entries are exchanged by (parent run, digest) and sorted, which puts the entries of one text side by side,
    and of these the best stays with the sum of their sizes.  Entries meet by a 64-bit digest and are told apart by SHA-256 and length at every level, so no two texts are taken
    for one.  A run holds a text at most once after the leaves are made, so of a text with a third of all rows no more than ``FAN`` entries ever meet.
    """
    best, first = (F.max, F.desc_nulls_last) if keep == "largest" else (F.min, F.asc_nulls_last)
    leaves = prints.groupBy(*KEYS).agg(best(id_col).alias("__best"), F.count(F.lit(1)).alias("__n"))
    level = leaves
    side_by_side = Window.partitionBy(*KEYS)
    for _ in range(rounds):
        merged = level.withColumn("__run", F.floor(F.col("__run") / FAN)).repartition("__run", "__h64")
        merged = merged.withColumns({"__n": F.sum("__n").over(side_by_side), "__nth": F.row_number().over(side_by_side.orderBy(first("__best")))})
        level = merged.filter("__nth = 1").drop("__nth")
    root = level.select("__h64", "__sha", "__len", F.col("__best").alias("__keep"), F.col("__n").alias("__size"))
    return leaves.select(*KEYS).join(root, ["__h64", "__sha", "__len"])


def mark_copies(df: DataFrame, payload: Column, id_col: str, keep: str = "largest", rounds: int | None = None) -> DataFrame:
    """``df`` with ``__keep`` (id of the row that stays), ``__size``, ``__kept`` and the digests.

    Rows come back through their own run, so the copies of a frequent text are joined in as many
    places as there are runs.

    Defined results: a null payload is the empty text, and empty texts are copies of each other; a null id loses to any
    other, and where all ids of a text are null, ``__keep`` is null; of rows that repeat both id and text, exactly one is
    kept; an empty table gives an empty result; other columns pass through untouched.
    """
    spark = df.sparkSession
    rounds = rounds or rounds_for(parallelism(spark))
    prints = fingerprint(df, payload, id_col, rounds)
    verdict = merge_runs(prints.select(id_col, *KEYS), id_col, rounds, keep)
    joined = prints.join(verdict, KEYS)
    same = Window.partitionBy(*KEYS, F.col(id_col)).orderBy(F.lit(0))
    return joined.withColumn("__kept", F.col("__keep").eqNullSafe(F.col(id_col)) & (F.row_number().over(same) == 1))


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents whose text no kept document repeats; columns as they came.

    Texts are equal when identical after lower-casing A-Z.  See :func:`mark_copies` for nulls, ties and repeated rows.
    """
    # A row goes as one value, so no name of its columns can meet one of ours.
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"))
    return mark_copies(packed, ascii_lower(F.col("row.text")), "id", keep).filter("__kept").select("row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document, dropped ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", ascii_lower(F.col("text")).alias("text"))
    rounds = rounds_for(parallelism(spark))
    scratch = Scratch(spark, "op3")
    prints = scratch.table(fingerprint(docs, F.col("text"), "doc_id", rounds).drop("text"), "prints")
    verdict = merge_runs(prints, "doc_id", rounds)
    same = Window.partitionBy(*KEYS, "doc_id").orderBy(F.lit(0))
    return prints.join(verdict, KEYS).select(
        "doc_id",
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__keep").eqNullSafe(F.col("doc_id")) & (F.row_number().over(same) == 1)).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


OP3_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t)
         AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
