import zlib

import numpy as np
import pytest

from tidemark.llm import quality as Q
from tidemark.llm import toxicity as X

from ..conftest import DATA


@pytest.mark.parametrize("query, column, folds, held, least", [(X.op6_toxicity, "toxic", 3, 1, 0.85), (Q.op10_quality, "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, column, folds, held, least):
    sf = f"{DATA}/sf0.1"
    got = query(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")[column]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all((zlib.crc32(str(i).encode()) % folds == held) == h for i, h in got.held_out.items())
    assert got.score.between(0, 1).all() and ((got.score >= (0.7 if column == "toxic" else 0.3)) == (got.predicted == 1)).all()
    out = got[got.held_out].join(labels, how="inner")
    rare = 1 if column == "toxic" else 0
    hit = (out.predicted == rare) & (out[column] == rare)
    f1 = 2 * hit.sum() / ((out.predicted == rare).sum() + (out[column] == rare).sum())
    assert f1 >= least


def test_forward_backward_is_exact():
    """Marginals against all labellings of short chains."""
    import itertools

    r = np.random.default_rng(0)
    firsts = np.array([0, 1, 4, 9])
    node, step = r.standard_normal((9, 2)), r.standard_normal((2, 2))
    single, pair = Q.chain(node, step, firsts)
    at = 0
    for a, b in itertools.pairwise(firsts):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weight[y] = np.exp(sum(node[a + t, v] for t, v in enumerate(y)) + sum(step[u, v] for u, v in itertools.pairwise(y)))
        z = sum(weight.values())
        for t in range(b - a):
            assert np.isclose(single[a + t, 1], sum(w for y, w in weight.items() if y[t]) / z)
        for t in range(b - a - 1):
            assert np.isclose(pair[at, 1, 0], sum(w for y, w in weight.items() if y[t] and not y[t + 1]) / z)
            at += 1


def test_network_against_plain_loops():
    """The forward pass, word by word and filter by filter."""
    r = np.random.default_rng(4)
    texts = ["der Hund und die Katze", "", "one two", "abcdefgh abcdefxy Abcd the of and", "x"]
    names = np.unique(np.concatenate([k for k in X.hashed(texts)[0]]))
    names = np.concatenate([np.zeros(1, np.uint64), r.permutation(names)[: len(names) * 2 // 3]])
    many = len(X.WIDTHS) * X.FILTERS
    normal = lambda *shape: r.standard_normal(shape).astype(np.float32)
    model = X.Model(*X.table(names), normal(len(names), X.DIM), [normal(w, X.DIM, X.FILTERS) for w in X.WIDTHS], normal(many), normal(many), 0.3, normal(4))
    model.embedding[0] = 0
    row = {int(h): i for i, h in enumerate(names) if i}
    expected = []
    for text in texts:
        kinds, _ = X.hashed([text])
        words = [sum((model.embedding[row[int(k[i])]] for k in kinds if int(k[i]) in row), np.zeros(X.DIM)) for i in range(len(kinds[0]))]
        z = model.out_bias
        for k, width in enumerate(X.WIDTHS):
            for f in range(X.FILTERS):
                at = [sum(words[i + j] @ model.filters[k][j, :, f] for j in range(width) if i + j < len(words)) + model.bias[k * X.FILTERS + f] for i in range(len(words))]
                z += max([0, *at]) * model.out[k * X.FILTERS + f]
        counts = [sum(w in of.split() for w in text.lower().split()) for of in X.FUNCTION_WORDS.values()]
        z += np.log(X.CUT / (1 - X.CUT)) - model.cuts[int(np.argmax(counts))]
        expected.append(1 / (1 + np.exp(-z)))
    assert np.allclose(model.scores(texts), expected, atol=1e-4)


def test_words_that_share_a_slot():
    names = np.array([0, 5, (7 << 42) + 1, (7 << 42) + 2, (7 << 42) + 9, (9 << 42)], np.uint64)
    model = X.Model(*X.table(names), *[None] * 5, None)
    assert model.rows(np.append(names[1:], np.uint64((7 << 42) + 3))).tolist() == [1, 2, 3, 4, 5, 0]


def test_sample_is_bounded_and_unambiguous(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * 90) for i in range(40)] + [(1, "a second text"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (3, 1), (3, 1), (None, 1)], "doc_id long, toxic int")
    texts, y = X.sample(docs, labels, "toxic", {1: 100, 0: 100}, 2, 9)
    assert len(texts) == 39 and "a second text" in texts and y.sum() == 20
    assert not any(t.startswith("text 2 ") for t in texts)
    few, y = X.sample(docs, labels, "toxic", {1: 7, 0: 100}, 2, 9, chars=1000)
    assert y.sum() == 7 and all(len(t) >= 13 for t in few) and sum(len(t) for t, v in zip(few, y, strict=True) if not v) <= 1000


def test_scores_do_not_depend_on_blocks():
    texts = ["", "one", "The quick brown fox.\nJumps over!!", "\n\n", "x " * 5000, "a b c\n" * 50]
    labels = np.array([0, 1, 1, 0, 0, 1])
    for module in (X, Q):
        model = module.train(texts * 20, np.tile(labels, 20))
        whole = model.scores(texts)
        assert np.allclose(whole, np.concatenate([model.scores([t]) for t in texts]), atol=1e-5)
        assert ((whole >= 0) & (whole <= 1)).all()


def test_gradient_of_the_network():
    """Training lowers the loss on what it is given."""
    good, bad = [f"nice word{i} thing" for i in range(60)], [f"awful word{i} thing" for i in range(60)]
    model = X.train(good + bad, np.array([0] * 60 + [1] * 60))
    assert model.scores(["awful thing"])[0] > 0.7 > model.scores(["nice thing"])[0]


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 10)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    for module in (X, Q):
        for given in (none, labels):
            scored = X.score(odd, module.learn(odd, given), "s")
            assert scored.columns == [*odd.columns, "s"]
            assert all(0 <= r.s <= 1 for r in scored.collect())
        assert X.score(odd.limit(0), module.learn(odd.limit(0), labels)).count() == 0


def test_portions_bound_number_and_length():
    from tidemark.llm.textvec import in_portions, portions

    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 300):
        sizes = rng.integers(0, 40, n)
        sizes[rng.random(n) < 0.1] = 500
        parts = portions(sizes, 9, 100)
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(n))
        assert all(p.stop - p.start <= 9 and (sizes[p].sum() <= 100 or p.stop - p.start == 1) for p in parts)
        # No two neighbours would fit together.
        assert all(b.stop - a.start > 9 or sizes[a.start : b.start + 1].sum() > 100 for a, b in zip(parts, parts[1:]))
    texts = ["x" * k for k in (3, 1 << 20, 5, 0)]
    assert [t for part in in_portions(texts) for t in part] == texts and len(in_portions(texts)) == 3


def test_training_with_very_long_texts_is_bounded():
    """One text is longer than all that a step takes at once; the classes are still told apart."""
    from tidemark.llm import toxicity

    texts = [("vile " if i % 2 else "kind ") * 40 + f"word{i % 7} " * 5 for i in range(160)]
    texts[1], texts[2] = "vile day " * (toxicity.BATCH_WORDS // 2 + 10), "kind day " * (toxicity.BATCH_WORDS // 2 + 10)
    labels = np.array([i % 2 for i in range(160)])
    model = toxicity.train(texts, labels, epochs=3)
    assert ((model.scores(texts) >= toxicity.CUT) == labels).mean() > 0.95
