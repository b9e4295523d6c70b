"""Bounded-space online packing of documents into sequences.

A task keeps a fixed number of open windows while its documents stream past.  A document goes into the window it leaves least room in; if it fits into none, its head fills the
fullest window, which is emitted without padding, and the rest is placed again.  What is open at the end of the tasks is merged by the same rule, a few tasks' windows at
a time, until one group is left; its last tokens are cut into powers of two, which need no padding.  A task or group holds ``windows`` windows at a time, whatever the table's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import blocks
from tidemark.llm.packing import token_function
from tidemark.scratch import Scratch

CLOSING = 1
#: Tasks whose open windows meet in one merge.
FAN = 8
#: Sequence numbers: the round, then the task or group, then a counter.
TASK_BITS, COUNT_BITS = 24, 32
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, part long, open boolean"


class Piece:
    """Ids of one document from ``start`` on."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


class Windows:
    """At most ``most`` open windows of ``capacity`` tokens; ``place`` yields the windows it fills."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, list[Piece]]] = []  # (room, pieces)

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) > self.capacity:
            head, piece = piece.cut(self.capacity)
            yield [head]
        while len(piece.ids):
            size = len(piece.ids)
            fitting = [(room, k) for k, (room, _) in enumerate(self.open) if room >= size]
            if fitting:
                room, k = min(fitting)
            elif len(self.open) < self.most:
                room, k = self.capacity, len(self.open)
                self.open.append((room, []))
            else:
                room, k = min((room, k) for k, (room, _) in enumerate(self.open))
            head, piece = piece.cut(min(size, room))
            inside = self.open[k][1]
            inside.append(head)
            if room > size:
                self.open[k] = (room - size, inside)
            else:
                self.open.pop(k)
                yield inside

    def close(self) -> Iterator[list[Piece]]:
        """What is open as full windows, and the last tokens as windows of powers of two, the largest first."""
        rest = sorted(self.open, key=lambda w: w[0])
        self.open, self.most = [], 1
        for _, pieces in rest:
            for piece in pieces:
                yield from self.place(piece)
        if self.open:
            left = self.capacity - self.open[0][0]
            pieces, self.open = self.open[0][1], []
            for bit in reversed(range(left.bit_length())):
                if left >> bit & 1:
                    window, missing = [], 1 << bit
                    while missing:
                        head, tail = pieces[0].cut(min(missing, len(pieces[0].ids)))
                        window.append(head)
                        missing -= len(head.ids)
                        pieces = [tail, *pieces[1:]] if len(tail.ids) else pieces[1:]
                    yield window


class Rows:
    """Rows of placed pieces."""

    def __init__(self, number: int, part: int, with_ids: bool):
        self.next = (number << TASK_BITS | part) << COUNT_BITS
        self.part, self.with_ids, self.rows = part, with_ids, []

    def add(self, window: list[Piece], is_open: bool = False) -> None:
        offset = 0
        for p in window:
            n = len(p.ids)
            ids = p.ids.astype(np.int32) if is_open or self.with_ids else None
            self.rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, self.next, offset, ids, self.part, is_open))
            offset += n
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 10
        self.rows = []
        types = [*[pa.int64()] * 7, pa.list_(pa.int32()), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PLACED.split(", ")])


def place_documents(docs: DataFrame, tokenizer_path: str, capacity: int, windows: int, with_ids: bool) -> DataFrame:
    """Pieces of full windows, and of those still open at a task's end with their ids."""

    def run(batches):
        ids_of = token_function(tokenizer_path)
        held, rows = Windows(capacity, windows), Rows(0, TaskContext.get().partitionId(), with_ids)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                for doc_id, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts, strict=True):
                    ids = np.append(ids_of(text), np.uint32(CLOSING))
                    for window in held.place(Piece(doc_id, 0, ids, len(ids))):
                        rows.add(window)
                yield rows.take()
        for _, window in held.open:
            rows.add(window, True)
        yield rows.take()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PLACED)


def merge(number: int, capacity: int, windows: int, with_ids: bool, last: bool):
    """For the open windows of a few tasks: full windows, and those open after it or, at last, the rest in powers of two."""

    def run(table: pa.Table) -> pa.Table:
        held = Windows(capacity, windows)
        order = [("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]
        table = table.sort_by(order)
        rows = Rows(number, table.column("group")[0].as_py(), with_ids)
        columns = [table.column(c) for c in ("doc_id", "start", "doc_tokens", "ids")]
        for k in range(table.num_rows):
            doc_id, start, total, ids = (c[k] for c in columns)
            for window in held.place(Piece(doc_id.as_py(), start.as_py(), np.asarray(ids.values, np.uint32), total.as_py())):
                rows.add(window)
        if last:
            for window in held.close():
                rows.add(window)
        for _, window in held.open:
            rows.add(window, True)
        return pa.Table.from_batches([rows.take()])

    return run


def pack_online(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, windows: int = 8, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all pieces; sorted by the last two, ``ids`` fill each sequence without gaps.

    Every sequence is full but for a few at the very end, whose lengths are different powers of two under ``capacity``.  A document is cut only where it is longer than a window or
    fits into none.  Which documents share a sequence follows the order in which tasks read them.

    Defined results: a null text is empty, and an empty text gives one piece, the closing id; a null id stays null; repeated rows and ties are documents of their own; a document
    of any length is cut into full sequences and a rest; an empty table gives no rows; other columns are not used, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "online")
    placed = scratch.table(place_documents(docs, tokenizer_path, capacity, windows, with_ids), "placed")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    done, number = [placed.filter("NOT open").select(*out)], 0
    parts = placed.filter("open").agg(F.max("part") + 1).first()[0] or 0
    while parts:
        number, groups = number + 1, -(-parts // FAN)
        left = placed.filter("open").withColumn("group", F.floor(F.col("part") / FAN))
        placed = scratch.table(left.groupBy("group").applyInArrow(merge(number, capacity, windows, with_ids, groups == 1), PLACED), "merged")
        done.append(placed.filter("NOT open").select(*out))
        parts = groups if groups > 1 else 0
    return reduce(DataFrame.unionByName, done)


def op12_online_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_online(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
