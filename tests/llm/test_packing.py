import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = P.path("byte_bpe_50k.json")


def best_fit(sizes, capacity):
    """Plain best-fit decreasing, a piece at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fit:
            gaps[min(fit)[1]] -= s
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_sweep_is_best_fit(sizes):
    used, spans, ranks = Counter(), {}, {}
    for size, rank, n, first, offset in packing.sweep(Counter(sizes), 40):
        for k in range(n):
            assert rank + k not in ranks.setdefault(size, set())
            ranks[size].add(rank + k)
            used[first + k] += size
            spans.setdefault(first + k, []).append((offset, offset + size))
    assert {s: len(r) for s, r in ranks.items()} == Counter(sizes)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][1] <= 40
    assert sorted(40 - u for u in used.values()) == best_fit(sizes, 40)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(pieces, texts, library, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    expected = Counter()
    for doc_id, text in texts:
        ids = library(text)
        first = (len(ids) - 1) % capacity + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids) + 1, capacity)], strict=True)):
            expected[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected


def test_odd_rows(spark, odd, library):
    pieces = packing.pack(odd, PATH, 64).collect()
    check(pieces, [(r.doc_id, r.text) for r in odd.collect()], library, 64)
    assert all(len(r.ids) == r.length for r in pieces)
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_added_tokens(library):
    """A text that spells an added token gets its id, as the library's plain call gives it."""
    ids = packing.token_function(PATH)
    assert len(ids("a <|endoftext|> b")) == 4
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "<|endoftext|>\u4e2d", "plain"):
        assert ids(text).tolist() == library(text)[:-1].tolist()


def test_query(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    pieces = packing.op8_best_fit_packing(spark, small).collect()
    check(pieces, docs, library, 2048)
    assert len({r.sequence_id for r in pieces}) == len(best_fit([r.length for r in pieces], 2048))
