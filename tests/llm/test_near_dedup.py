import itertools
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import embedding_dedup as E
from tidemark.llm import minhash as M
from tidemark.llm import skew as S
from tidemark.llm.components import components
from tidemark.scratch import Scratch
from tests.conftest import DATA


def classes(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def shingled(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(texts, threshold=0.8):
    sets = {k: shingled(t) for k, t in texts.items()}
    size = {k: x.total() for k, x in sets.items()}
    links = []
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or (min(size[a], size[b]) >= threshold * max(size[a], size[b]) and (x & y).total() >= threshold * (x | y).total()):
            links.append((a, b))
    return classes(list(texts), links)


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 500)]
    scratch = Scratch(spark, "test")
    got = {x.node: x.component for x in components(scratch, spark.createDataFrame(pairs, "a long, b long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    assert got == classes({n for p in pairs for n in p}, pairs)
    assert components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    """Hot keys by broadcast and the others by a shuffle, on stars, chains of hubs and strays."""
    monkeypatch.setattr(S, "SHARE", 20)
    pairs = [(1000, i) for i in range(300)] + [(999, 1000)] + [(2000, i) for i in range(3000, 3050)] + [(i, i + 1) for i in range(4000, 4040)]
    got = {x.node: x.component for x in components(Scratch(spark, "test"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == classes({n for p in pairs for n in p}, pairs)


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 3)
    rows = spark.createDataFrame([(k, i) for i in range(60) for k in [0 if i % 2 else i, None if i == 7 else 1]], "k long, i long")
    told = rows.groupBy("k").agg(M.F.count(M.F.lit(1)).alias("n"), M.F.max("i").alias("most"))
    got = S.join_hot(rows, told.filter("k IS NULL OR k <> 4"), ["k"], rows.count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(told, "k").filter("k <> 4").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    a = r.integers(1, 2**63, 600).astype(np.uint64)
    b = np.concatenate([r.integers(1, 2**63, 60).astype(np.uint64), a[60:]])
    wa, wb = r.integers(1, 9, 600).astype(float), r.integers(1, 9, 600).astype(float)
    got = M.signatures([a, b, a[:0], a[:1]], [wa, wb, wa[:0], wa[:1]], 4000)
    low = np.minimum(wa, wb)[60:].sum()
    assert abs((got[0] == got[1]).mean() - low / (wa.sum() + wb.sum() - low)) < 0.03
    assert not got[2].any() and got[3].all()


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    r = np.random.default_rng(4)
    texts = {x.doc_id: x.text for x in docs.collect()}
    base = [k for k in texts if len(texts[k].split()) > 60][:12]
    extra, n = [], 10**6
    for k in base:  # chains of edits, whose ends are less alike than the threshold
        words = texts[k].split()
        for _ in range(6):
            words = list(words)
            words[r.integers(len(words))] = f"w{n}"
            extra.append((n, " ".join(words)))
            n += 1
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    expected = brute(texts | dict(extra))
    got = M.near_groups(both).collect()
    assert {x.doc_id: x.class_id for x in got} == expected
    sizes = {c: sum(v == c for v in expected.values()) for c in expected.values()}
    assert all(x.class_size == sizes[x.class_id] and x.kept == (x.doc_id == x.class_id) for x in got)
    whole = texts | dict(extra)
    for x in got:
        assert (x.link_id is None) == (x.similarity is None) == (x.class_size == 1)
        if x.link_id is not None:
            a, b = shingled(whole[x.doc_id]), shingled(whole[x.link_id])
            assert x.link_id != x.doc_id and expected[x.link_id] == x.class_id
            assert x.similarity == (1.0 if a == b else (a & b).total() / (a | b).total()) >= 0.8


def test_weights_count(spark):
    """Texts with one set of shingles, of which one repeats a passage many times, are far apart."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:30] * 20 + words[30:])), (3, " ".join([*words, "more"])), (4, " ".join(words[:30] * 20 + words[30:] + ["more"]))]
    got = {r.doc_id: r.class_id for r in M.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(dict(rows)) == {1: 1, 2: 2, 3: 1, 4: 2}


def test_one_id_for_several_texts(spark):
    """Rows that repeat a doc_id with another text are documents of their own, and each text finds its links."""
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(7, " ".join(a)), (7, " ".join(b)), (7, " ".join(b)), (8, " ".join([*b, "end"])), (9, " ".join([*a, "end"])), (7, " ".join([*a, "last"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_groups(docs).collect()
    sizes = Counter((r.class_size, r.kept) for r in got)
    assert sizes == {(3, True): 3, (3, False): 3}
    texts = [r.text.split()[0] for r in M.near_dedup(docs).collect()]
    assert Counter(texts) == Counter(a0=1, b0=2)


def test_loose_group(spark):
    """A group whose members are alike, but mostly not alike enough: classes are those of all pairs, and few pairs are compared."""
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for n in range(220):
        words = list(base)
        for at in r.choice(150, r.integers(1, 8), replace=False):
            words[at] = f"x{r.integers(40)}"
        texts[n] = " ".join(words)
    got = {x.doc_id: x.class_id for x in M.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts)


def test_crowded_buckets_are_dealt(spark, monkeypatch):
    """The same with buckets dealt over many tasks and with hot and other keys joined in both ways."""
    monkeypatch.setattr(M, "DEALT", 8)
    monkeypatch.setattr(S, "SHARE", 12)
    r = np.random.default_rng(5)
    texts = {}
    for group, members in enumerate([90, 30, 4, 2]):
        base = [f"g{group}w{i}" for i in range(120)]
        for _ in range(members):
            words = list(base)
            for at in r.choice(120, r.integers(1, 6), replace=False):
                words[at] = f"x{r.integers(40)}"
            texts[len(texts)] = " ".join(words)
    got = {x.doc_id: x.class_id for x in M.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts)


def test_bitmaps_bound_what_sets_do_not_share(spark):
    r = np.random.default_rng(3)
    rows, truth = [], []
    for _ in range(200):
        a = r.integers(1, 2**63, r.integers(1, 400)).astype(np.uint64)
        keep = r.random(len(a)) < r.random()
        b = np.concatenate([a[keep], r.integers(1, 2**63, len(a) - keep.sum()).astype(np.uint64)])[: max(1, int(len(a) * r.uniform(0.8, 1)))]
        truth.append(len(np.setxor1d(a, b)))
        rows.append((M.parity(a).tolist(), M.parity(b).tolist()))
    got = [x.n for x in spark.createDataFrame(rows, "a array<long>, b array<long>").select(M.apart(M.F.col("a"), M.F.col("b")).alias("n")).collect()]
    assert all(g <= t for g, t in zip(got, truth, strict=True)) and sum(got) > 0.6 * sum(truth)


def test_recall_against_all_rows(spark):
    """Documents whose id is divisible by 50, compared with every row."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {x.doc_id: shingled(x.text) for x in docs.collect()}
    size = {k: x.total() for k, x in sets.items()}
    got = {x.doc_id: x.class_id for x in M.near_groups(docs).collect()}
    links = [
        (a, b)
        for a in sets
        if a % 50 == 0
        for b in sets
        if a != b and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()
    ]
    assert links and sum(got[a] == got[b] for a, b in links) == len(links)


def test_odd_documents(spark, odd):
    got = M.near_groups(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.class_id, []).append(r.doc_id)
    assert len(got) == 12
    assert sorted(map(len, by.values())) == sorted([4, 4, 1, 1, 1, 1])
    kept = M.near_dedup(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (5, 6, 7, 9)").count() == 4
    assert M.near_groups(odd.limit(0)).count() == 0 and M.near_dedup(odd.limit(0)).count() == 0


def brute_vectors(rows, threshold=0.93):
    def unit(v):
        v = np.array([np.nan if x is None else x for x in v], float) if v is not None and len(v) else np.array([np.nan])
        return v / np.linalg.norm(v) if np.isfinite(v).all() and v.any() else None

    units = [unit(v) for _, v, _ in rows]
    links = [
        (i, j)
        for i, j in itertools.combinations(range(len(rows)), 2)
        if rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold
    ]
    return links


@pytest.mark.parametrize("size", [400])
def test_vectors(spark, size):
    r = np.random.default_rng(6)
    rows = []
    for i in range(size):
        rows.append((i, r.standard_normal(16).tolist(), i % 3))
    for i in range(size, size + 260):  # a cloud larger than a neighbour list, and scattered pairs
        near = np.array(rows[5 if i % 2 else r.integers(200)][1])
        label = 5 % 3 if i % 2 else None
        k = 5 if i % 2 else int(r.integers(200))
        near = np.array(rows[k][1])
        rows.append((i, (near + r.standard_normal(16) * 0.18).tolist(), rows[k][2] if i % 7 else label))
    rows += [(2000, rows[5][1], 2), (2001, rows[5][1], 2), (2002, [0.0] * 16, 1), (2003, None, 1), (2004, [float("nan")] * 16, 1), (2005, [None] * 16, 1), (2006, [1.0], 1), (2007, [1e38, 1e38], 1), (2008, [1e-38, 1e-38], 1), (2009, [], 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS unit", "2 AS component", "3 AS links")
    links = brute_vectors(rows)
    degree = dict.fromkeys((r[0] for r in rows), 0)
    for i, j in links:
        degree[rows[i][0]] += 1
        degree[rows[j][0]] += 1
    component = classes([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    got = {x.vec_id: x for x in E.near_vectors(frame).collect()}
    assert {k: x.n_links for k, x in got.items()} == degree
    assert {k: x.component_id for k, x in got.items()} == component
    assert all(x.kept == (k == x.component_id) and x.audited_recall >= 0.99 for k, x in got.items())


def test_odd_vectors(spark):
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [1.0, 2.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((x.vec_id or 0, x.n_links) for x in E.near_vectors(frame).collect())
    assert got == [(0, 3), (0, 3), (3, 3), (3, 3), (4, 0)]
    assert E.near_vectors(frame.limit(0)).count() == 0


def test_doubles(spark):
    """Vectors of doubles whose components are beyond single precision's range, or differ below its precision."""
    rows = [(1, [1e200, 2e200], 1), (2, [1e200, 2e200], 1), (3, [1e-200, 2e-200], 1), (4, [1.0, 2.0], 1), (5, [-1.0, 2.0], 1), (6, [1.0, float("inf")], 1)]
    # Two vectors just above and just below the threshold from (1, 0), by less than single precision tells.
    rows += [(7, [1.0, 0.0], 2), (8, [0.93, (1 - 0.93**2) ** 0.5 * (1 - 1e-9)], 2), (9, [0.93, -((1 - 0.93**2) ** 0.5) * (1 + 1e-9)], 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9)}


def test_counts_over_several_blocks(spark, monkeypatch):
    """A component of many blocks: links within and across blocks, every copy counted."""
    monkeypatch.setattr(E, "COUNTED", 16)
    monkeypatch.setattr(E, "ROWS", 5)
    r = np.random.default_rng(1)
    x = (np.array([1.0, 0, 0, 0]) + r.standard_normal((150, 4)) * 0.2).round(3)
    copies = r.integers(1, 4, 150)
    members = spark.createDataFrame([(i, 0, int(n), v.tolist()) for i, (n, v) in enumerate(zip(copies, x, strict=True))], "unit long, component long, copies long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) | np.eye(150, dtype=bool)
    assert {a.unit: a.links for a in E.counted(members, 0.93).collect()} == dict(enumerate((linked @ copies - 1).tolist()))


def test_dense_clouds(spark):
    """Links between clouds whose vectors all have more than a full list of nearer neighbours."""
    r = np.random.default_rng(12)
    dim, size = 32, 120
    a, b = np.linalg.qr(r.standard_normal((dim, 2)))[0].T
    centres = [a, 0.9305 * a + np.sqrt(1 - 0.9305**2) * b]
    vectors = [c + r.standard_normal(dim) * 0.012 for c in centres for _ in range(size)]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[i % 3][1], 1) for i in range(300)]  # copies, which hide what is missing
    links = brute_vectors(rows)
    across = [(i, j) for i, j in links if (i % 1000 < size or i >= 2 * size) != (j < size or j >= 2 * size)]
    assert 0 < len(across) < len(links)
    degree = dict.fromkeys((x[0] for x in rows), 0)
    for i, j in links:
        degree[rows[i][0]] += 1
        degree[rows[j][0]] += 1
    got = {x.vec_id: x for x in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {k: x.n_links for k, x in got.items()} == degree
    assert {x.component_id for x in got.values()} == {0}


def test_audit_leaves_out_own_copies(spark):
    units = spark.createDataFrame([(1, "a", 2, [1.0, 0.0], 5), (2, "a", 2, [1.0, 0.1], 1)], "unit long, grp string, dim int, embedding array<float>, copies long")
    found = spark.createDataFrame([(1, 4), (2, 0)], "unit long, links long")
    assert E.audit(units, found, 0.93, 100) == 0


def test_missed_recall_compares_all(spark, monkeypatch):
    """Where the graph has no links at all and no pass may repair it, all vectors are compared."""
    monkeypatch.setattr(E, "FLOOR", 2.0)
    rows = [(i, [1.0, 0.01 * (i % 7)], 1) for i in range(14)] + [(20, [-1.0, 0.0], 1), (21, [0.0, 1.0], 1)]
    got = {x.vec_id: x for x in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), max_passes=1).collect()}
    assert {k: (x.component_id, x.n_links) for k, x in got.items()} == {**{i: (0, 13) for i in range(14)}, 20: (20, 0), 21: (21, 0)}
    assert all(x.audited_recall == 1 for x in got.values())
