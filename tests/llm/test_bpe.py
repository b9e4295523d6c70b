import hashlib

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


TEXT = st.one_of(st.text(max_size=80), st.text("ab'stvermld \n\t1²½Éß|!\x1c\x85\xa0", max_size=80), st.text("abc", max_size=200))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_splits_as_the_pattern(text):
    assert bpe.splitter(P.PATTERN)(text) == regex.findall(P.PATTERN, text)


def test_blocks_encode_as_the_library(library):
    mine = bpe.encoder(PATH, P.PATTERN)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXT, min_size=1, max_size=5))
    def check(texts):
        ids, starts = mine.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]

    check()


def test_lower_rank_after_a_merge():
    # "ab" + "c" and "a" + "bc" spell one token; "cab" comes up while "ab" is being merged and goes first.
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"cab": 1, b"ab": 5, b"abc": 2, b"bc": 7}
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(ranks, r"\S+|\s+")

    @settings(max_examples=300, deadline=None)
    @given(st.text("abc", min_size=1, max_size=30))
    def check(text):
        assert mine.encode([text])[0].tolist() == library.encode_ordinary(text)

    check()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdetnis ", min_size=1, max_size=24), min_size=1, max_size=20), st.integers(0, 3))
def test_waves_replay_as_the_index(words, seed):
    """Waves and the inverted index give the same tokens, for a vocabulary of any ranks."""
    import random

    r = random.Random(seed)
    pieces = sorted({w[i : i + n] for w in words for i in range(len(w)) for n in (2, 3, 4) if len(w[i : i + n]) == n})
    r.shuffle(pieces)
    ranks = {bytes([b]): 10_000 + b for b in range(256)} | {p.encode(): k for k, p in enumerate(pieces)}
    mine = bpe.Encoder(ranks, r"\S+|\s+")
    raw = [w.encode() for w in words]
    flat, count = mine.tokens(raw)
    ends = count.cumsum()
    expected = [[ranks[w]] if w in ranks else bpe.replay([w], ranks, mine.spelled, {})[0] for w in raw]
    assert [flat[e - n : e].tolist() for e, n in zip(ends, count, strict=True)] == expected


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    mine = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
    for text in ("one two three four", "five six one two", "", "seven"):
        assert mine.encode([text, text])[0].tolist() == library.encode_ordinary(text) * 2


def test_round_trip_of_odd_rows(spark, odd, library):
    coded = bpe.decode(bpe.encode(odd, PATH, P.PATTERN), PATH).collect()
    assert len(coded) == odd.count()
    for r in coded:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(odd.limit(0), PATH, P.PATTERN), PATH).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(nulls, PATH).collect()] == [b"", b""]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    told = bpe.digests(odd, PATH, P.PATTERN).collect()
    expected = [(r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids)).encode()), sha(bytes(r.decoded))) for r in coded]
    assert sorted(map(tuple, told), key=str) == sorted(expected, key=str)
    assert bpe.digests(odd.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in bpe.op4_byte_bpe(spark, small).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
