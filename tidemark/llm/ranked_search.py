"""Ranked lexical search by dense blocked matrix multiplication.

Items are taken in tiles whose texts are small enough to send to every task.  For a tile, the documents are read once: a task keeps of each document the counts of the tile's terms, and of
each block of documents the counts that the statistics need.  Then tiles of documents become dense matrices of term impacts (documents x terms), which are multiplied with the items'
term weights (terms x items) a tile of terms at a time.  All entries are whole numbers and no partial sum reaches 2^53, so float64 products are exact; they are added up as 64-bit integers.
A task keeps the best documents of each item with ties told apart by doc_id, and the tasks' lists meet in two steps.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import blocks
from tidemark.llm.exact_dedup import LOWER, UPPER
from tidemark.scratch import Scratch

#: A term, and the scale of weights and impacts: fixed by the query's contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, IMPACT, LENGTH, FLAT, SLOPE = 1000, 1_000_000_000, 12, 75, 25
#: An impact is under IMPACT / SCALE; the weights of an item in one tile of terms add up to no more than this.
MOST_WEIGHT = 2**53 // (IMPACT // SCALE) - 1
#: Items and characters of a tile of items, terms of a tile of terms, documents of a tile of documents.
TILE_ITEMS, TILE_CHARS, TILE_TERMS, TILE_DOCS = 1024, 2_000_000, 1024, 1024
_term = re.compile(TERM)
_low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COUNTED = "doc_id long, n long, docs long, terms array<int>, counts array<long>"
BEST = "item int, doc_id long, score long, part long"


def terms_of(text: str | None) -> list[str]:
    return _term.findall((text or "").translate(_low))


def vocabulary_of(texts: list[str | None]) -> tuple[dict[str, int], np.ndarray]:
    """The terms of some items, numbered, and (item, term, repeats) rows sorted by term."""
    known: dict[str, int] = {}
    rows: dict[tuple[int, int], int] = {}
    for item, text in enumerate(texts):
        for word in terms_of(text):
            key = known.setdefault(word, len(known)), item
            rows[key] = rows.get(key, 0) + 1
    return known, np.array([(item, term, n) for (term, item), n in sorted(rows.items())], np.int64).reshape(-1, 3)


def count_terms(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """For each document with one of the ``known`` terms: its terms in all (``n``) and those it knows with their counts.  For each block, with ``docs`` not null: its documents with
    terms, their terms in all, and how many of them hold each known term.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                rows: list[tuple] = []
                holding = np.zeros(len(number), np.int64)
                some = total = 0
                for doc_id, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts, strict=True):
                    words = terms_of(text)
                    some, total = some + bool(words), total + len(words)
                    mine = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                    terms, counts = np.unique(mine[mine >= 0], return_counts=True)
                    if len(terms):
                        holding[terms] += 1
                        rows.append((doc_id, len(words), None, terms, counts))
                held = np.flatnonzero(holding)
                rows.append((None, total, some, held.astype(np.int32), holding[held]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n", "docs", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COUNTED)


def weighted(rows: np.ndarray, holding: np.ndarray, n_docs: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The items' weights in tiles of terms: (first term, terms from there, items, weights).

    A tile ends before a weight sum could pass :data:`MOST_WEIGHT`; a weight that is larger alone is spread over tiles of its term.
    """
    unit = np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in holding.tolist()], np.int64)
    tiles, now, first, held = [], [], 0, 0
    starts = [*np.flatnonzero(np.diff(rows[:, 1], prepend=-1)).tolist(), len(rows)]

    def end() -> None:
        if now:
            items, terms, weights = (np.concatenate(x) for x in zip(*now, strict=True))
            tiles.append((first, terms - first, items, weights))
            now.clear()

    for a, b in zip(starts, starts[1:], strict=False):
        term, items = int(rows[a, 1]), rows[a:b, 0]
        weights = rows[a:b, 2] * unit[term]
        while weights.any():
            most = min(int(weights.max()), MOST_WEIGHT)
            if held + most > MOST_WEIGHT or now and term - first >= TILE_TERMS:
                end()
            if not now:
                first, held = term, 0
            taken = np.minimum(weights, most)
            now.append((items, np.full(len(items), term), taken))
            weights, held = weights - taken, held + most
    end()
    return tiles


def best_of(items: np.ndarray, docs: np.ndarray, none: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each item the ``k`` best rows: highest score, then smallest doc_id, null before all."""
    order = np.lexsort((docs, ~none, -scores, items))
    items, docs, none, scores = (x[order] for x in (items, docs, none, scores))
    at = np.arange(len(items))
    starts = np.maximum.accumulate(np.where(np.diff(items, prepend=-1) != 0, at, 0))
    keep = at - starts < k
    return items[keep], docs[keep], none[keep], scores[keep]


def rank_tile(counted: DataFrame, tiles: list, n_items: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, part): the ``k`` best documents of each item in each task."""
    shared = counted.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = shared.value
        best = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        last = np.zeros(n_items, np.int64)  # what a score must reach
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                doc_id, n, terms, counts = (batch.column(c).slice(start, TILE_DOCS) for c in ("doc_id", "n", "terms", "counts"))
                size = len(n)
                rows = np.repeat(np.arange(size), np.diff(terms.offsets.to_numpy()))
                flat, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
                m = FLAT + SLOPE * n.to_numpy() * n_docs // n_terms
                impact = (IMPACT * tf // (SCALE * tf + LENGTH * m[rows])).astype(np.float64)
                order = np.argsort(flat, kind="stable")
                flat, rows, impact = flat[order], rows[order], impact[order]
                scores = np.zeros((size, n_items), np.int64)
                for first, at, items, weights in tiles:
                    a, b = np.searchsorted(flat, (first, first + int(at[-1]) + 1))
                    if a < b:
                        left, right = np.zeros((size, int(at[-1]) + 1)), np.zeros((int(at[-1]) + 1, n_items))
                        left[rows[a:b], flat[a:b] - first] = impact[a:b]
                        right[at, items] = weights
                        scores += (left @ right).astype(np.int64)
                doc, item = np.nonzero((scores > 0) & (scores >= last))
                ids = doc_id.fill_null(0).to_numpy()[doc]
                best = best_of(*(np.concatenate(x) for x in zip(best, (item, ids, doc_id.is_null().to_numpy(zero_copy_only=False)[doc], scores[doc, item]), strict=True)), k)
                full = np.bincount(best[0], minlength=n_items) >= k
                lowest = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(lowest, best[0], best[3])
                last = np.where(full, lowest, 0)
        items, docs, none, scores = best
        part = np.full(len(items), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(docs, pa.int64(), mask=none), pa.array(scores), pa.array(part)], names=["item", "doc_id", "score", "part"])

    return counted.filter("docs IS NULL").select("doc_id", "n", "terms", "counts").mapInArrow(run, BEST)


def item_tiles(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """``items`` with ``tile``, and the tiles: no more than TILE_ITEMS items and TILE_CHARS characters each, unless one item is longer alone."""
    items = scratch.table(items.withColumn("row", F.monotonically_increasing_id()), "items")
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    tiles = 1 + 2 * max(n // TILE_ITEMS, chars // TILE_CHARS)
    while True:
        dealt = items.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles)))
        sizes = dealt.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
        if not sizes.filter((F.col("n") > TILE_ITEMS) | (F.col("n") > 1) & (F.col("chars") > TILE_CHARS)).head(1):
            return dealt, [r["tile"] for r in sizes.select("tile").orderBy("tile").toLocalIterator()]
        tiles *= 2


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents (doc_id, text) of highest score for each of ``items`` (item_id, text).

    Defined results: a null or empty text has no terms, so an item without terms has no rows and a document without terms counts nowhere; only scores over 0 count; of equal scores the
    smaller doc_id goes first, a null one before all; repeated documents are ranked each, rows that repeat an item's id are items of their own; texts of any length are taken
    whole; an empty table of either kind gives no rows; other columns are not used, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    items, tiles = item_tiles(items.select(F.col("item_id").cast("long"), "text"), scratch)
    found = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for tile in tiles:
        # A tile's items fit the driver: TILE_ITEMS of them, TILE_CHARS characters.
        mine = items.filter(F.col("tile") == tile).orderBy("row").collect()
        known, rows = vocabulary_of([r["text"] for r in mine])
        counted = scratch.table(count_terms(docs, known), "counted")
        n_docs, n_terms = counted.filter("docs IS NOT NULL").agg(F.sum("docs"), F.sum("n")).first()
        if not n_terms or not known:
            continue
        holding = np.zeros(len(known), np.int64)
        each = counted.filter("docs IS NOT NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
        for r in each.collect():  # at most a row for each term of the tile's items
            holding[r["terms"]] = r["n"]
        best = scratch.table(rank_tile(counted, weighted(rows, holding, n_docs), len(mine), n_docs, n_terms, k), "best")
        order = [F.desc("score"), F.asc_nulls_first("doc_id")]
        place = lambda *by: F.row_number().over(Window.partitionBy("item", *by).orderBy(*order))
        few = best.withColumn("part", F.col("part") % 64).withColumn("rank", place("part")).filter(F.col("rank") <= k)
        ranked = few.withColumn("rank", place()).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "item int, item_id long")
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))"
OP11_SQL = f"""
WITH words AS (SELECT doc_id, {_TERMS_SQL} AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_TERMS_SQL} AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT term, doc_id, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor({SCALE} * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term, docs),
sums AS (SELECT item_id, doc_id, CAST(sum(q * w * (({IMPACT} * tf) // ({SCALE} * tf + {LENGTH} * ({FLAT} + ({SLOPE} * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sums WHERE score > 0) WHERE rank <= 20
"""
