"""Byte-level BPE encoding and decoding by merge replay.

A task replays the merges over all distinct words of a block of documents at once.  Each word's merges are applied in rank order, those of all words together: a wave merges,
at every place of the block where a word's lowest pair stands, and looks up only the two touched neighbours anew.  Very long words, and the few in which a merge
brings up a pair that goes before it, are replayed pair by pair with an inverted index from a merge to the places of its pair.
Blocks are independent, so nothing is shuffled and no vocabulary of the corpus has to fit anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text handled at once, and words a worker remembers between blocks.
BLOCK_CHARS = 1 << 20
REMEMBERED = 300_000
#: Words of more bytes are replayed with the inverted index: waves are for many words with few merges each.
LONG_WORD = 256
_PAIR = 1 << 20
_NEVER = np.int64(1 << 40)

# For texts below U+0250 the general pattern can be spelled out in plain character classes, which the standard
# library matches about twice as fast.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\\t-\\r \x85\xa0"
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")


def splitter(pattern: str):
    """A function from a text to its words."""
    general = regex.compile(pattern)
    import public_tokenizers

    plain = _PLAIN if pattern == public_tokenizers.PATTERN else None
    return lambda text: (plain if plain and not _OTHER.search(text) else general).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def replay(words: list[bytes], ranks: dict[bytes, int], spelled: list[bytes], known: dict[int, int]) -> list[list[int]]:
    """Token ids of each word.

    ``known`` maps a pair of ids to what it merges to (-1: nothing) and is filled on the way.  Entries of the index
    that a merge has made stale are recognised when their turn comes.  A merge may bring up a pair of lower or equal
    rank; then the word's later places wait until that pair has had its turn.
    """
    token: list[int] = []
    after: list[int] = []
    before: list[int] = []
    word_of: list[int] = []
    starts: list[int] = []
    index: dict[int, list[int]] = {}
    single = [ranks[bytes([b])] for b in range(256)]

    def merged(a: int, b: int) -> int:
        key = a * _PAIR + b
        rank = known.get(key)
        if rank is None:
            rank = known[key] = ranks.get(spelled[a] + spelled[b], -1)
        return rank

    for w, word in enumerate(words):
        at = len(token)
        starts.append(at)
        n = len(word)
        ids = [single[b] for b in word]
        token += ids
        after += range(at + 1, at + n + 1)
        before += range(at - 1, at + n - 1)
        word_of += [w] * n
        if n:
            after[-1] = before[at] = -1
        for i in range(n - 1):
            key = ids[i] * _PAIR + ids[i + 1]
            rank = known.get(key)
            if rank is None:
                rank = merged(ids[i], ids[i + 1])
            if rank >= 0:
                if rank in index:
                    index[rank].append(at + i)
                else:
                    index[rank] = [at + i]
    waiting = list(index)
    heapq.heapify(waiting)
    while waiting:
        rank = heapq.heappop(waiting)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        held: set[int] = set()
        for place in places:
            right = after[place]
            if right < 0 or token[place] < 0 or known.get(token[place] * _PAIR + token[right]) != rank:
                continue
            if held and word_of[place] in held:
                index.setdefault(rank, []).append(place)
                continue
            token[place] = rank
            token[right] = -1
            far = after[place] = after[right]
            after[right] = -1
            near = before[place]
            for left, a, b in ((place, rank, token[far] if far >= 0 else -1), (near, token[near] if near >= 0 else -1, rank)):
                if a < 0 or b < 0:
                    continue
                key = a * _PAIR + b
                new = known.get(key)
                if new is None:
                    new = merged(a, b)
                if new >= 0:
                    if new <= rank:
                        held.add(word_of[place])
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(waiting, new)
            if far >= 0:
                before[far] = place
        if rank in index:
            heapq.heappush(waiting, rank)
    starts.append(len(token))
    return [[t for t in token[a:b] if t >= 0] for a, b in zip(starts, starts[1:], strict=False)]


class Merges:
    """All pairs of tokens that merge, as sorted arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = sorted((a * _PAIR + b, rank) for word, rank in ranks.items() for i in range(1, len(word)) if (a := ranks.get(word[:i])) is not None and (b := ranks.get(word[i:])) is not None)
        self.key, self.rank = np.array([k for k, _ in pairs] or [-1], np.int64), np.array([r for _, r in pairs] or [0], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytewise = self.of(np.repeat(self.single, 256), np.tile(self.single, 256))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges to, _NEVER if to nothing."""
        key = a * _PAIR + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NEVER)

    def waves(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all words in a row, how many each has, and the words (by number) that need the inverted index and have none here; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        token = self.single[data]
        rank = np.full(len(data), _NEVER)
        rank[:-1] = self.bytewise[data[:-1].astype(np.int64) * 256 + data[1:]]
        rank[np.cumsum(sizes) - 1] = _NEVER
        out, count, odd = np.full(len(data), -1, np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int64)]
        home, word, length = np.cumsum(sizes) - sizes, np.arange(len(words)), sizes.copy()
        while len(word):
            start = np.cumsum(length) - length
            lowest = np.minimum.reduceat(rank, start)
            over = lowest == _NEVER
            if over.any():
                whole = np.repeat(over, length)
                out[np.repeat((home[word] - start)[over], length[over]) + np.flatnonzero(whole)] = token[whole]
                count[word[over]] = length[over]
                token, rank, word, length, lowest = token[~whole], rank[~whole], word[~over], length[~over], lowest[~over]
                if not len(word):
                    break
                start = np.cumsum(length) - length
            owner = np.repeat(np.arange(len(word)), length)
            hit = np.flatnonzero(rank == lowest[owner])
            # Of places that overlap, every other one.
            begins = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
            nth = np.arange(len(hit)) - np.repeat(begins, np.diff(np.append(begins, len(hit))))
            hit = hit[nth % 2 == 0]
            mine = owner[hit]
            token[hit] = lowest[mine]
            kept = np.ones(len(token), bool)
            kept[hit + 1] = False
            at = hit - np.arange(len(hit))  # as many tokens are gone before it
            token, rank = token[kept], rank[kept]
            times = np.bincount(mine, minlength=len(word))
            length = length - times
            start = np.cumsum(length) - length
            right, left = at[at != (start + length - 1)[mine]], at[at != start[mine]]
            rank[(start + length - 1)[mine]] = _NEVER
            rank[right] = self.of(token[right], token[right + 1])
            rank[left - 1] = self.of(token[left - 1], token[left])
            # Where a merge brings up a pair that goes before it, the word's other places should have waited.
            if (times > 1).any():
                fresh = np.concatenate([right, left - 1])
                fresh = np.repeat(np.arange(len(word)), length)[fresh[rank[fresh] <= lowest[np.repeat(np.arange(len(word)), length)[fresh]]]]
                bad = np.zeros(len(word), bool)
                bad[fresh] = True
                bad &= times > 1
                if bad.any():
                    odd.append(word[bad])
                    gone = np.repeat(bad, length)
                    token, rank, word, length = token[~gone], rank[~gone], word[~bad], length[~bad]
        return out[out >= 0], count, np.concatenate(odd)


class Encoder:
    """Encodes blocks of texts, remembering the words of earlier blocks up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.merges = ranks, splitter(pattern), Merges(ranks)
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.spelled[rank] = word
        self.known: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)

    def tokens(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and how many each has."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in raw), np.int64, len(raw))
        short = [i for i in np.flatnonzero(whole < 0).tolist() if 0 < len(raw[i]) <= LONG_WORD]
        flat, some, odd = self.merges.waves([raw[i] for i in short])
        count = np.zeros(len(raw), np.int64)
        count[whole >= 0] = 1
        count[short] = some
        rest = [i for i in np.flatnonzero(whole < 0).tolist() if len(raw[i]) > LONG_WORD] + [short[k] for k in odd.tolist()]
        spelt = replay([raw[i] for i in rest], self.ranks, self.spelled, self.known)
        count[rest] = [len(x) for x in spelt]
        starts = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        out[starts[whole >= 0]] = whole[whole >= 0]
        out[np.repeat(starts[short] - (np.cumsum(some) - some), some) + np.arange(len(flat))] = flat
        for i, x in zip(rest, spelt, strict=True):
            out[starts[i] : starts[i] + len(x)] = x
        return out, count

    def learn(self, words: Iterable[str]) -> None:
        words = list(words)
        found, count = self.tokens([w.encode() for w in words])
        first = len(self.code)
        self.code.update(zip(words, range(first, first + len(words)), strict=True))
        ends = (self.ends[first - 1] if first else 0) + np.cumsum(count)
        while len(self.ends) < first + len(words):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[first : first + len(words)] = ends
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[ends[-1] - len(found) : ends[-1]] = found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more entry at the end)."""
        split = [self.split(t) for t in texts]
        words = [w for s in split for w in s]
        if len(self.code) > REMEMBERED:
            self.forget()
        if new := set(words).difference(self.code):
            self.learn(new)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        starts = np.where(codes > 0, self.ends[codes - 1], 0)
        sizes = self.ends[codes] - starts
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(done[-1]) + np.repeat(starts - done[:-1], sizes)]
        return ids, done[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; Spark reuses workers, so later tasks find its words."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``most`` characters of text each (a longer text stands alone), nulls as empty; only a slice's texts are Python strings at once."""
    texts = batch.column(batch.schema.get_field_index(column))
    first, size = 0, 0
    for i, n in enumerate(pc.utf8_length(texts).fill_null(0).to_pylist()):
        if i > first and size + n > most:
            part = batch.slice(first, i - first)
            yield part, [t or "" for t in texts.slice(first, i - first).to_pylist()]
            first, size = i, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first), [t or "" for t in texts.slice(first).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the token ids of ``text``.

    Null and empty texts give an empty list; a text may be of any length (memory of a task follows the longest text); repeated rows and
    ties are rows like any other; a column already named ``out`` is replaced; an empty table gives an empty table.
    """
    docs = docs.drop(out)

    def run(batches):
        mine = encoder(ranks_path, pattern)
        for batch in batches:
            for part, texts in blocks(batch, text):
                ids, starts = mine.encode(texts)
                yield with_column(part, out, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


class Spelling:
    """Writes a string of bytes for each id of a list, one after the other."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(w) for w in spelled], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def write(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all lists in a row, and where each list's bytes begin (one more at the end)."""
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(self.size):
            raise ValueError("an id is outside the vocabulary")
        size = self.size[flat]
        done = np.concatenate([[0], np.cumsum(size)])
        return self.letters[np.arange(done[-1]) + np.repeat(self.begin[flat] - done[:-1], size)], done[starts]


_decoders: dict[str, tuple[Spelling, Spelling]] = {}


def decoder(path: str) -> tuple[Spelling, Spelling]:
    """The worker's tables of ids as bytes and as decimal numbers with a space behind each."""
    if path not in _decoders:
        spelled = [b""] * (max((ranks := read_ranks(path)).values()) + 1)
        for word, rank in ranks.items():
            spelled[rank] = word
        _decoders[path] = Spelling(spelled), Spelling([b"%d " % i for i in range(len(spelled))])
    return _decoders[path]


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the bytes that ``ids`` spell; null and empty lists give no bytes.

    Bytes, since ids need not spell valid UTF-8.  An id outside the vocabulary is an error.
    """
    docs = docs.drop(out)

    def run(batches):
        spelling = decoder(ranks_path)[0]
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                values = part.column(at)
                counts = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, offsets = spelling.write(flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
                yield with_column(part, out, pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """DIGESTS of each document (doc_id, text): what :func:`encode` and :func:`decode` give, of which only digests leave the task.

    Nulls, empty and long texts, repeated rows and empty tables are as in these two; other columns are not used.
    """

    def run(batches):
        mine, (spelling, numbers) = encoder(ranks_path, pattern), decoder(ranks_path)
        sha = lambda data, a, b: hashlib.sha256(data[a:b]).hexdigest()
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                ids, starts = mine.encode(texts)
                ids = ids.astype(np.int64)
                shown, at = numbers.write(ids, starts)
                decoded, to = spelling.write(ids, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array(np.diff(starts)),
                        pa.array([sha(shown, a, max(a, b - 1)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
                        pa.array([sha(decoded, a, b) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]),
                    ],
                    names=[c.split()[0] for c in DIGESTS.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGESTS)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
