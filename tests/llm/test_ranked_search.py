import math
import re
import string
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ranked_search as R

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(docs, items, k=20):
    """Every item against every document, a term at a time; one list of (rank, doc_id, score) for each item."""
    counted = [(d, Counter(words(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            score = 0
            for t in words(text):
                if c[t]:
                    m = 100 - 25 + (25 * c.total() * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def compare(spark, docs, items, **more):
    found = R.ranked_search(docs, items, **more).collect()
    assert sorted(map(tuple, found), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], **more)
    return found


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "Same TEXT alpha", "a"), (1, "alpha gamma", "b"), (2, None, "c"), (3, "", "d"), (None, "straße 中文 alpha alpha", "e"), (4, "nowhere_found", "f")], "item_id long, text string, score string")
    assert compare(spark, odd, items)
    assert R.ranked_search(odd.limit(0), items).count() == 0
    assert R.ranked_search(odd, items.limit(0)).count() == 0
    assert R.ranked_search(odd.filter("doc_id = 8"), items).count() == 0


def test_ties_over_tiles_and_tasks(spark):
    """Thousands of equal scores, over several tiles of documents and several tasks."""
    docs = spark.range(0, 6000, 1, 3).selectExpr("id * 31 % 6000 AS doc_id", "IF(id % 3 = 0, 'hot word', concat('word ', id % 7)) AS text")
    items = spark.createDataFrame([(1, "hot"), (2, "word 3"), (3, "6 6 hot")], "item_id long, text string")
    found = compare(spark, docs, items)
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank) if r.item_id == 1] == [3 * i for i in range(20)]


@pytest.mark.parametrize("most, terms", [(2**53 // 10**6 - 1, 3), (40_000, 1024), (3_000, 2)])
def test_tiles_of_terms(spark, monkeypatch, most, terms):
    """Weights that pass the bound are spread over tiles; the sums stay the same."""
    monkeypatch.setattr(R, "MOST_WEIGHT", most)
    monkeypatch.setattr(R, "TILE_TERMS", terms)
    known, rows = R.vocabulary_of(["a b c d e f", "b " * 50 + "f", "zz"])
    tiles = R.weighted(rows, np.array([1, 5, 9, 2, 2, 3, 0]), 10)
    assert len(tiles) > 1
    total = np.zeros((len(known), 3), np.int64)
    for first, at, items, weights in tiles:
        right = np.zeros((len(known), 3), np.int64)
        np.add.at(right, (first + at, items), weights)
        assert right.sum(0).max() <= most and len(set(zip(at.tolist(), items.tolist(), strict=True))) == len(at) and at[-1] < terms
        total += right
    assert total[known["b"]].tolist() == [math.floor(1000 * math.log(22 / 11)), 50 * math.floor(1000 * math.log(22 / 11)), 0]
    docs = spark.createDataFrame([(i, "a b b c " * (i % 4) + "f d " * (i % 3)) for i in range(12)], "doc_id long, text string")
    compare(spark, docs, spark.createDataFrame([(1, "a b c d e f"), (2, "b " * 50 + "f"), (3, "zz")], "item_id long, text string"), k=3)


def test_tiles_of_items(spark, monkeypatch):
    monkeypatch.setattr(R, "TILE_ITEMS", 2)
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5}") for i in range(20)], "doc_id long, text string")
    compare(spark, docs, spark.createDataFrame([(i, f"w{i % 5} w1") for i in range(7)], "item_id long, text string"), k=4)


def test_query_equals_sql_and_plain(spark, small, duck, same_rows):
    found = R.op11_ranked_search(spark, small).toPandas()
    assert same_rows(found) == same_rows(duck.execute(R.OP11_SQL).df())
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(key, "text").collect()] for t, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(found[["item_id", "rank", "doc_id", "score"]].itertuples(index=False, name=None), key=str) == plain(docs, items)
