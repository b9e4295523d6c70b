"""Filters, deduplicates and packs a corpus; each stage is one operator of ``tidemark.llm``.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns they were given.

In all stages a null text is empty, texts of any length are taken whole, columns beyond doc_id and text pass through untouched whatever their names, and an empty table gives an
empty table.  What each stage makes of nulls, empty texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, minhash, packing, quality, toxicity
from tidemark.llm.names import unused
from tidemark.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's cut.

    Null and empty texts are scored like others, and so stay or go; rows with one text stay or go together, whatever their ids, null ones too; a score at the cut stays.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(["score"], docs.columns)
    return toxicity.score(docs, model, score).filter(F.col(score) >= quality.CUT).drop(score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the classifier's cut.

    Null and empty texts are scored like others, and so stay or go; rows with one text stay or go together, whatever their ids, null ones too; a score at the cut goes.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(["score"], docs.columns)
    return toxicity.score(docs, model, score).filter(F.col(score) < toxicity.CUT).drop(score)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Null and empty texts are equal; a null id loses to any other; of rows that repeat id and text, or of a text with null ids only, one stays.
    """
    return exact_dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id, then with the smallest hash of its text.

    Texts without words, null and empty ones among them, are one group; a null id is named by its text and loses to none; rows that repeat id and text are one document.
    """
    return minhash.near_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and place.

    A null or empty text is one piece, the closing id; rows that repeat an id or text are pieces of their own; pieces of equal length are placed in order of id, null ids first.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]
#: Classifiers, signatures and tokenizers are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
