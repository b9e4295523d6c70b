"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import blocks, with_column
from tidemark.llm.textvec import in_portions, mix, portions, span_hash, words

#: Most labelled rows of each class that training takes (by a hash of the id), and most characters of each: bounds on the driver's memory.
MOST_OF_CLASS = {1: 3000, 0: 6000}
MOST_CHARS = 40_000_000
#: A word or prefix has an embedding if it is in so many training texts at least.
LEAST_TEXTS = 3
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
SLOTS = 1 << 22
#: A step of training takes 32 texts, or fewer if they have more words than this, which bounds its memory.
BATCH_WORDS = 1 << 17
#: A word shares an embedding with all words that begin with the same bytes.
PREFIX_BYTES = (4, 6)
CUT = 0.7
#: Common function words, by which a text's language is told for calibration.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as was are be this from",
    "de": "der die und das den mit ein zu ist nicht sich auf für von eine",
    "fr": "le la les des et une est que pour dans un du au avec par",
    "es": "el la los las del que una por con para se su al es y",
}


def hashed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, and of their beginnings of each length, and each text's first word (one more at the end)."""
    word, firsts, starts, ends, prefix = words(texts)
    heads = [mix(span_hash(prefix, starts, np.minimum(ends, starts + n)) ^ np.uint64(0xC2B2AE3D27D4EB4F + n)) for n in PREFIX_BYTES]
    return [word, *heads], firsts


@dataclass
class Model:
    """``slot`` finds the row of a hash, ``name`` confirms it; row 0 is every unknown word and stays zero.

    Rows whose slot another row has are found by binary search in ``spare``, their sorted hashes.
    """

    slot: np.ndarray
    name: np.ndarray
    spare: np.ndarray
    spare_row: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        row = self.slot[(hashes >> np.uint64(42)).astype(np.int64)]
        row = np.where(self.name[row] == hashes, row, 0)
        if len(self.spare):
            at = np.minimum(np.searchsorted(self.spare, hashes), len(self.spare) - 1)
            row = np.where(self.spare[at] == hashes, self.spare_row[at], row)
        return row

    def vectors(self, kinds: list[np.ndarray]) -> np.ndarray:
        return sum(self.embedding[self.rows(h)] for h in kinds)

    def maps(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Every filter at every word; a window that reaches past its text sees zeros there."""
        last = np.repeat(firsts[1:], np.diff(firsts))
        at = np.arange(len(x))
        out = []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            total = x @ w[0]
            for k in range(1, width):
                part = x[k:] @ w[k]
                part[(at[:-k] + k) >= last[:-k]] = 0
                total[: len(x) - k] += part
            out.append(total)
        return np.concatenate(out, axis=1) + self.bias

    def logits(self, kinds: list[np.ndarray], firsts: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(firsts) - 1, len(self.bias)), np.float32)
        full = np.flatnonzero(np.diff(firsts))
        if len(full):
            maps = self.maps(self.vectors(kinds), firsts)
            pooled[full] = np.maximum(np.maximum.reduceat(maps, firsts[full], axis=0), 0)
        return pooled @ self.out + self.out_bias

    def scores(self, texts: list[str]) -> np.ndarray:
        kinds, firsts = hashed(texts)
        z = self.logits(kinds, firsts) - self.cuts[languages(kinds[0], firsts)]
        return 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -50, 50)))


def languages(word: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Number of the language with most function words in each text, told from the text alone."""
    known = [np.sort(words([w])[0]) for w in FUNCTION_WORDS.values()]
    counts = []
    for names in known:
        hit = np.concatenate([[0], np.cumsum(names[np.minimum(np.searchsorted(names, word), len(names) - 1)] == word)])
        counts.append(hit[firsts[1:]] - hit[firsts[:-1]])
    return np.argmax(counts, axis=0)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold of ``z`` with the best F1 for ``y``, midway between the scores beside it."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    last = np.append(z[1:] < z[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def table(name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What leads from a hash to its row in ``name``, whose first row is no hash."""
    slot = np.zeros(SLOTS, np.int32)
    at = (name >> np.uint64(42)).astype(np.int64)
    slot[at[1:]] = np.arange(1, len(name))
    late = np.flatnonzero(slot[at] != np.arange(len(name)))
    late = late[late > 0]
    late = late[np.argsort(name[late])]
    return slot, name, name[late], late


def constant(logit: float) -> Model:
    """A model that says the same of every text, for want of two classes to learn from."""
    none = len(WIDTHS) * FILTERS
    filters = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
    return Model(*table(np.zeros(1, np.uint64)), np.zeros((1, DIM), np.float32), filters, np.zeros(none, np.float32), np.zeros(none, np.float32), logit, np.zeros(len(FUNCTION_WORDS), np.float32))


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, seed: int = 7) -> Model:
    """Fits the network on four fifths of the texts and a threshold for each language on the rest.

    Where the labels are not of two classes, the model is a constant.
    """
    rng = np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return constant(5.0 if len(labels) and labels[0] else -5.0)
    chunks = in_portions(texts)
    kept = []
    for kind in range(1 + len(PREFIX_BYTES)):
        seen = []
        for chunk in chunks:
            kinds, at = hashed(chunk)
            seen += [np.unique(kinds[kind][a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        name, n = np.unique(np.concatenate(seen), return_counts=True)
        kept.append(name[n >= LEAST_TEXTS])
        del seen, name, n
    name = np.concatenate([np.zeros(1, np.uint64), *kept])
    model = Model(
        *table(name),
        (rng.standard_normal((len(name), DIM)) * 0.1).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32),
        0.0,
        np.zeros(len(FUNCTION_WORDS), np.float32),
    )
    model.embedding[0] = 0
    # Hashes are made again from the texts; only the rows they lead to are kept.
    rows = [([model.rows(h).astype(np.int32) for h in kinds], np.diff(at)) for kinds, at in map(hashed, chunks)]
    rows_of = [np.concatenate([r[0][k] for r in rows]) for k in range(1 + len(PREFIX_BYTES))]
    sizes = np.concatenate([r[1] for r in rows])
    firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    del rows
    y = labels.astype(np.float32)
    held = rng.random(len(y)) < 0.2
    fit = np.flatnonzero(~held)
    squares: dict[str, np.ndarray] = {}

    def step(key: str, value: np.ndarray, gradient: np.ndarray, at=slice(None), rate: float = 0.05) -> None:
        """Adagrad."""
        g2 = squares.setdefault(key, np.full(value.shape, 1e-6, np.float32))
        g2[at] += gradient**2
        value[at] -= rate * gradient / np.sqrt(g2[at])

    for _ in range(epochs):
        rng.shuffle(fit)
        for part in portions(sizes[fit], 32, BATCH_WORDS):
            batch = fit[part]
            batch = batch[sizes[batch] > 0]
            if not len(batch):
                continue
            at = np.concatenate([np.arange(firsts[i], firsts[i + 1]) for i in batch])
            begins = np.concatenate([[0], np.cumsum(sizes[batch])])
            x = sum(model.embedding[rows[at]] for rows in rows_of)
            maps = model.maps(x, begins)
            top = np.stack([maps[a:b].argmax(0) + a for a, b in zip(begins[:-1], begins[1:], strict=True)])
            value = np.take_along_axis(maps, top, 0)
            pooled = np.maximum(value, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
            dz = (p - y[batch]) / len(batch)
            dmap = (dz[:, None] * model.out) * (value > 0)
            dx: dict[str, list] = {"row": [], "g": []}
            for k_w, width in enumerate(WIDTHS):
                columns = slice(k_w * FILTERS, (k_w + 1) * FILTERS)
                place, g = top[:, columns], dmap[:, columns]
                dw = np.zeros_like(model.filters[k_w])
                for k in range(width):
                    inside = place + k < begins[1:, None]
                    spot = np.where(inside, place + k, 0)
                    gk = g * inside
                    dw[k] = np.einsum("nf,nfd->df", gk, x[spot])
                    gx = (gk[:, :, None] * model.filters[k_w][k].T[None]).reshape(-1, DIM)
                    for rows in rows_of:
                        dx["row"].append(rows[at[spot]].ravel())
                        dx["g"].append(gx)
                step(f"w{k_w}", model.filters[k_w], dw)
            row, back = np.unique(np.concatenate(dx["row"]), return_inverse=True)
            total = np.zeros((len(row), DIM), np.float32)
            np.add.at(total, back, np.concatenate(dx["g"]))
            step("e", model.embedding, total, row, 0.1)
            model.embedding[0] = 0
            step("b", model.bias, dmap.sum(0))
            step("o", model.out, dz @ pooled)
            model.out_bias -= 0.5 * float(dz.sum())
    told = [(model.logits(kinds, at), languages(kinds[0], at)) for kinds, at in map(hashed, chunks)]
    z, language = np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told])
    cut = best_cut(z[held], y[held]) if held.any() and 0 < y[held].sum() < held.sum() else 0.0
    for n in range(len(FUNCTION_WORDS)):
        own = held & (language == n)
        model.cuts[n] = best_cut(z[own], y[own]) if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20 else cut
    return model


def sample(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int], folds: int, held_out: int, chars: int = MOST_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from: at most ``most[label]`` rows and ``chars`` characters of each label outside the held-out fold, by a hash of the id.

    A doc_id that is null or labelled both ways is left out; one that is labelled twice alike counts once.  Of documents that repeat a doc_id the first text in
    order counts.  Texts are whole: one that would pass ``chars`` is left out with all after it.
    """
    known = labels.filter(F.col(column).isin(list(most)) & F.col("doc_id").isNotNull()).filter(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
    known = known.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("__other")).filter("label = __other").select("doc_id", "label")
    picked = None
    for value, n in most.items():
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    # The rows picked are bounded, so the documents meet them without a shuffle.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    so_far = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = found.withColumn("__chars", so_far).filter(F.col("__chars") <= chars).select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["label"] for r in rows], np.int64)


def score(docs: DataFrame, model, out: str = "score", block: int = 1 << 19) -> DataFrame:
    """``docs`` with ``out``, what ``model.scores`` gives for each whole text, in blocks of bounded size.

    A null text is empty, and an empty one has a score too; a text of any length is scored whole (a task's memory follows the longest text); repeated rows score alike; a column already
    named ``out`` is replaced and all others stay; an empty table gives an empty table.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text", block):
                yield with_column(part, out, pa.array(shared.value.scores(texts).astype(np.float64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier of ``labels.toxic``, from documents outside the held-out fold; see :func:`sample` for nulls, repeats and bounds.

    Without labels, or with those of one class, it scores all texts alike.
    """
    return train(*sample(docs, labels, "toxic", MOST_OF_CLASS, 3, 1))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document; see :func:`score` and :func:`learn` for nulls, empty and repeated rows and empty tables.  ``held_out`` of a null doc_id is null: it is in no fold and is not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
