"""Document quality: a linear-chain conditional random field over lines, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import in_portions, mix, words
from tidemark.llm.toxicity import best_cut, sample, score

#: Most labelled rows of each class that training takes (by a hash of the id): a bound on the driver's memory.
MOST_OF_CLASS = {0: 2000, 1: 4000}
CUT = 0.3
BINS = 10
#: Kinds of bytes that are counted in a line.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", ".,;:?'\"()", "!", "|", "#$%&*@^~<>{}[]\\_=+/`-"]
_KIND = np.full(256, len(KINDS), np.int64)
for _k, _letters in enumerate(KINDS):
    _KIND[np.frombuffer(_letters.encode(), np.uint8)] = _k


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numeric features of every line, its length in bytes, and each text's first line (one more at the end).  An empty text is one empty line."""
    raw = [t.encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    n = len(ends)
    line_of = np.repeat(np.arange(n), length + 1)
    kinds = np.bincount(line_of * (len(KINDS) + 1) + _KIND[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1).astype(np.float64)
    kinds[:, -1] -= 1  # the line's end
    share = kinds / np.maximum(length, 1)[:, None]
    # Words are hashed in the lower-cased text, whose lines are the same.
    word, _, at, to, _ = words([t + "\n" for t in texts])
    low = np.frombuffer(b"".join((t + "\n").lower().encode() + b" " for t in texts), np.uint8)
    own = np.searchsorted(np.flatnonzero(low == 10), at)
    many = np.maximum(np.bincount(own, minlength=n), 1)
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    distinct = np.unique(mix(own.astype(np.uint64)) ^ word, return_index=True)[1] if len(word) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(firsts))
    total = np.zeros(n, np.uint64)
    np.add.at(total, own, mix(word))
    _, back, copies = np.unique(mix(total) ^ mix(text_of.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    last = data[np.maximum(ends - 1, 0)]
    features = np.column_stack(
        [
            np.log1p(length),
            share,
            np.bincount(own, to - at, n) / many,
            np.bincount(own, again, n) / many,
            np.bincount(own[distinct], minlength=n) / many,
            np.log1p(copies[back] - 1) * (length > 0),
            np.isin(last, np.frombuffer(b".!?", np.uint8)) & (length > 0),
            np.log1p(np.diff(firsts))[text_of],
        ]
    )
    return features, length.astype(np.float64), firsts


def chain(node: np.ndarray, step: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: marginals of each line, and of the two labels across each line and the next.

    Position t of every text that has one is handled together, so the loop is as long as the longest text.
    """
    sizes = np.diff(firsts)
    order = np.argsort(-sizes, kind="stable")
    begin, size = firsts[:-1][order], sizes[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    forward, backward = np.empty_like(node), np.zeros_like(node)
    for t, n in enumerate(alive):
        at = begin[:n] + t
        if t == 0:
            forward[at] = node[at]
        else:
            before = forward[at - 1]
            forward[at] = node[at] + np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1])
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        after = node[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
    joint = forward + backward
    norm = np.logaddexp(joint[:, :1], joint[:, 1:])
    inner = np.ones(len(node), bool)
    inner[firsts[1:] - 1] = False
    at = np.flatnonzero(inner)
    pair = forward[at][:, :, None] + step + (node[at + 1] + backward[at + 1])[:, None, :] - norm[at][:, :, None]
    return np.exp(joint - norm), np.exp(pair)


@dataclass
class Model:
    """``weights``: of each bin of each feature, for the line itself, the one before and the one after, by label."""

    edges: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    step: np.ndarray
    cut: float

    def bins(self, features: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Columns of ``weights`` that a line switches on; the lines beyond a text's ends have a bin of their own."""
        own = np.column_stack([np.searchsorted(e, f, side="right") for e, f in zip(self.edges, features.T, strict=True)])
        none = np.full((1, own.shape[1]), BINS)
        before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
        full = np.diff(firsts) > 0
        before[firsts[:-1][full]] = BINS
        after[firsts[1:][full] - 1] = BINS
        return (np.concatenate([own, before, after], axis=1) + np.arange(3 * own.shape[1]) * (BINS + 1)).astype(np.int32)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        good = np.zeros(len(bins))
        for column in bins.T:
            good += self.weights[column]
        return np.column_stack([np.zeros(len(bins)), good + self.bias])

    def raw(self, texts: list[str]) -> np.ndarray:
        """Length-weighted share of good lines, from their marginals."""
        features, length, firsts = lines(texts)
        marginal, _ = chain(self.nodes(self.bins(features, firsts)), self.step, firsts)
        weight = length + 1e-9
        return np.add.reduceat(marginal[:, 1] * weight, firsts[:-1]) / np.add.reduceat(weight, firsts[:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.raw(texts)
        return np.where(x < self.cut, CUT * x / self.cut, CUT + (1 - CUT) * (x - self.cut) / (1 - self.cut))


def train(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 2e-4, seed: int = 5) -> Model:
    """Gradient ascent (Adam) on the likelihood of each text's label on all its lines; the cut is set on a held fifth."""
    held = np.random.default_rng(seed).random(len(texts)) < 0.2
    fit = np.flatnonzero(~held)
    parts = [lines(part) for part in in_portions([texts[i] for i in fit])]
    features = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, lines([""])[0].shape[1]))
    sizes = np.concatenate([np.diff(p[2]) for p in parts]) if parts else np.zeros(0, np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    edges = np.stack([np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1]) for f in features.T]) if len(features) else np.zeros((features.shape[1], BINS - 1))
    model = Model(edges, np.zeros(3 * features.shape[1] * (BINS + 1)), np.zeros(1), np.zeros((2, 2)), 0.5)
    if not len(features):
        return model
    bins = model.bins(features, firsts)
    y = np.repeat(labels[fit], sizes).astype(np.float64)
    # Every text counts alike, however many lines it has.
    weight = np.repeat(1 / sizes, sizes)
    inner = np.ones(len(y), bool)
    inner[firsts[1:] - 1] = False
    stays = np.zeros((inner.sum(), 2, 2))
    stays[np.arange(len(stays)), y[inner].astype(int), y[inner].astype(int)] = 1
    value = [model.weights, model.bias, model.step]
    mean, square = [np.zeros_like(v) for v in value], [np.zeros_like(v) for v in value]
    for t in range(1, rounds + 1):
        marginal, pair = chain(model.nodes(bins), model.step, firsts)
        short = (y - marginal[:, 1]) * weight
        g = np.zeros_like(model.weights)
        for column in bins.T:
            g += np.bincount(column, short, len(g))
        step = ((stays - pair) * weight[inner][:, None, None]).sum(0)
        for k, gradient in enumerate((g / len(fit) - decay * model.weights, np.array([short.sum() / len(fit)]), step / len(fit) - decay * model.step)):
            mean[k] = 0.9 * mean[k] + 0.1 * gradient
            square[k] = 0.99 * square[k] + 0.01 * gradient**2
            value[k] += rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
    own = np.flatnonzero(held)
    if len(own) and 0 < labels[own].sum() < len(own):
        raw = np.concatenate([model.raw(part) for part in in_portions([texts[i] for i in own])])
        model.cut = float(np.clip(1 - best_cut(1 - raw, 1 - labels[own]), 0.02, 0.98))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier of ``labels.quality``, from documents outside the held-out fold; see :func:`tidemark.llm.toxicity.sample` for nulls, repeats and bounds.

    Without labels every line is as likely good as bad.
    """
    return train(*sample(docs, labels, "quality", MOST_OF_CLASS, 5, 0))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """A score for every document; see :func:`tidemark.llm.toxicity.score` and :func:`learn` for nulls, empty and repeated rows and empty tables.  ``held_out`` of a null doc_id is null: it is in no fold and is not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
