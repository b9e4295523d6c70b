"""Bulk-synchronous best-fit packing of token pieces into sequences."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import _OTHER, blocks
from tidemark.scratch import Scratch, parallelism

PIECE_FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]
_tokenizers: dict[str, object] = {}


def token_function(path: str):
    """A function from a text to its ids (numpy), as ``tokenizers`` gives them for the vocabulary in ``path``.

    A text that spells one of the vocabulary's added tokens gets that token's id, as ``tokenizers`` does by default.  The same vocabulary and merges run in ``tiktoken`` several
    times faster.  The two could differ only by added tokens and by their Unicode tables, so texts that hold an added token, control separators or letters from U+0250 on go to
    ``tokenizers`` itself.
    """
    if path in _tokenizers:
        return _tokenizers[path]
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    # Byte-level vocabularies write each byte as a printable character.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"] for x in told.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if _OTHER.search(text) or any(word in text for word in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    _tokenizers[path] = ids
    return ids


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids and a closing id 0, cut from the end into ``capacity`` tokens, so that only the first piece may be shorter."""
    schema = T.StructType([*PIECE_FIELDS, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        ids_of = token_function(tokenizer_path)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                rows: dict[str, list] = {f.name: [] for f in schema.fields}
                for doc_id, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts, strict=True):
                    ids = np.append(ids_of(text), np.uint32(0)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [first, *range(first + capacity, len(ids) + 1, capacity)], strict=True)):
                        for name, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32)), strict=False):
                            rows[name].append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=False)], names=list(rows))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over size classes: rows (length, first rank, ranks, first sequence, offset).

    A superstep matches all pieces of one length.  Its sweep finds the successor gap class (the smallest gap they fit), and
    conflicts for it are resolved by rank: consecutive ranks take consecutive sequences of the class, each as many
    as it holds; then those gaps shrink and the sweep goes on with the ranks left over.  Pieces of equal length are interchangeable, so this is
    best-fit over all rows, with work and output bounded by the capacity and not by the rows.
    """
    gaps: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fitting = open_gaps >> size
            if fitting:
                gap = size + (fitting & -fitting).bit_length() - 1
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps &= ~(1 << gap)
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // size))
                sequences += n
            each = gap // size
            full = min(n, left // each)
            for used, fill in ((full, each), (1, left - full * each)) if full < n and left - full * each < each else ((full, each),):
                if not used or not fill:
                    continue
                out += [(size, rank + k * used, used, first, capacity - gap + k * size) for k in range(fill)]
                rank, left = rank + used * fill, left - used * fill
                if rest := gap - fill * size:
                    gaps[rest].append([first, used])
                    open_gaps |= 1 << rest
                first, n = first + used, n - used
            if n:
                gaps[gap].append([first, n])
                open_gaps |= 1 << gap
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``__rank``, from 0, within each length.

    A length may hold a third of all rows, so each is ranked in salted parts, and the parts' counts give each part its first rank.
    """
    salts = max(64, parallelism(pieces.sparkSession))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    parts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    return salted.join(firsts, ["length", "__salt"]).withColumn("__rank", F.col("__first") + F.row_number().over(within) - 1).drop("__salt", "__first")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; sorted by both, ``ids`` fill each sequence without gaps.

    A null text is empty and gives one piece, the closing id; empty and repeated rows are pieces like any other; pieces of equal length are
    placed in order of doc_id (nulls first), and full pieces stand alone; an empty table gives no rows; other columns are not used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.table(cut(docs, tokenizer_path, capacity, with_ids), "pieces")
    # At most one row a length: bounded by the capacity.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(sweep(counts, capacity), "__len long, __from long, __n long, __seq long, __off long")
    fits = (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__n"))
    return (
        ranked(pieces)
        .join(F.broadcast(plan), fits)
        .withColumns({"sequence_id": F.col("__seq") + F.col("__rank") - F.col("__from"), "offset": F.col("__off")})
        .select(*pieces.columns, "sequence_id", "offset")
    )


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
