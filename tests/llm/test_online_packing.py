import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import online_packing as O

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(pieces, texts, library, capacity):
    """Pieces are the documents, cut; sequences have no gaps and are full but for a few of different powers of two."""
    by, whole = {}, Counter()
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
        whole[r.doc_id] += r.length
    sizes = []
    for rows in by.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end and r.length > 0
            end += r.length
        sizes.append(end)
    short = [s for s in sizes if s != capacity]
    assert len(set(short)) == len(short) and all(s < capacity and s & (s - 1) == 0 for s in short)
    # Equal documents are told apart by nothing, so pieces are compared as a bag of what each document could be cut into.
    docs = {}
    for doc_id, text in texts:
        docs.setdefault(doc_id, []).append(library(text))
    assert whole == Counter({d: sum(map(len, ids)) for d, ids in docs.items()})
    for r in pieces:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in docs[r.doc_id])
    for doc_id, all_ids in docs.items():
        starts = Counter((r.start, r.doc_tokens) for r in pieces if r.doc_id == doc_id)
        ends = Counter((r.start + r.length, r.doc_tokens) for r in pieces if r.doc_id == doc_id)
        for ids in all_ids:  # every end but a document's last is a start of the next piece
            starts[len(ids), len(ids)] += 1
            ends[0, len(ids)] += 1
        assert starts == ends


@pytest.mark.parametrize("capacity, most, count", [(64, 1, 500), (64, 4, 500), (64, 8, 3), (1, 2, 5), (100, 3, 0)])
def test_windows(capacity, most, count):
    r = random.Random(capacity * most)
    held, full, sizes = O.Windows(capacity, most), [], [r.choice([1, 3, 20, 63, 64, 65, 200]) for _ in range(count)]
    for i, n in enumerate(sizes):
        full += held.place(O.Piece(i, 0, np.arange(n, dtype=np.uint32), n))
        assert len(held.open) <= most
    assert all(sum(len(p.ids) for p in w) == capacity for w in full)
    full += held.close()
    assert sum(len(p.ids) for w in full for p in w) == sum(sizes)
    short = [n for n in (sum(len(p.ids) for p in w) for w in full) if n != capacity]
    assert len(set(short)) == len(short) and all(n < capacity and n & (n - 1) == 0 for n in short)
    for i, n in enumerate(sizes):
        assert sorted(int(x) for w in full for p in w if p.doc_id == i for x in p.ids) == list(range(n))


def test_best_fit():
    """A piece goes where it leaves least room; the fullest window is filled up when none fits."""
    held = O.Windows(10, 2)
    for doc_id, n in enumerate((6, 7, 2, 9)):
        out = list(held.place(O.Piece(doc_id, 0, np.zeros(n, np.uint32), n)))
    assert [(p.doc_id, p.start, len(p.ids)) for p in out[0]] == [(1, 0, 7), (2, 0, 2), (3, 0, 1)]
    assert [[(p.doc_id, p.start, len(p.ids)) for p in w] for _, w in held.open] == [[(0, 0, 6)], [(3, 1, 8)]]


def test_odd_rows(spark, odd, library):
    pieces = O.pack_online(odd.repartition(5), PATH, 64, 2).collect()
    check(pieces, [(r.doc_id, r.text) for r in odd.collect()], library, 64)
    assert all(len(r.ids) == r.length for r in pieces)
    assert O.pack_online(odd.limit(0), PATH).count() == 0


def test_merges_in_rounds(spark, library):
    """Open windows of more tasks than meet in one merge."""
    docs = spark.range(0, 300, 1, O.FAN * O.FAN + 3).selectExpr("id AS doc_id", "repeat('word ', cast(id % 50 AS int)) AS text")
    pieces = O.pack_online(docs, PATH, 128, 3, with_ids=False).collect()
    check(pieces, [(r.doc_id, r.text) for r in docs.collect()], library, 128)


def test_query(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    check(O.op12_online_packing(spark, small).collect(), docs, library, 2048)
