import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle as M

COLUMNS = M.LEAF


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def rise(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain(rows, seen):
    """The manifest as the definition reads: (doc_id, leaf, subroot, root, proof, folded root) of every row."""
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(r | {"text": seen(r)}), r["doc_id"]))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    inside = {n: rise([x[2] for x in trees[n]]) for n in names}
    over = rise([inside[n][-1][0] for n in names])
    out = []
    for place, n in enumerate(names):
        for i, (_, _, own, other, key) in enumerate(trees[n]):
            path, folded = [], other
            for levels, at in ((inside[n], i), (over, place)):
                for level in levels[:-1]:
                    run, slot = level[at // 8 * 8 :][:8], at % 8
                    path += run[:slot] + run[slot + 1 :]
                    folded = H(*run[:slot], folded, *run[slot + 1 :])
                    at //= 8
            out.append((key, own, inside[n][-1][0], over[-1][0], H(*path), folded))
    return sorted(out, key=str)


def lowered(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if hit and r["text"] is not None else r["text"]


def compare(docs, seen=lambda r: r["text"], **more):
    got = M.manifest(docs, COLUMNS, **more).withColumn("again", M.fold(F.col("leaf"), F.col("proof"))).collect()
    expected = plain([r.asDict() for r in docs.collect()], seen)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str) == expected
    assert all(r.verified == (r.folded_root == r.root) and r.again == r.root for r in got)
    return got


def test_odd_rows(odd):
    compare(odd)
    assert M.manifest(odd.limit(0), COLUMNS).count() == 0


@pytest.mark.parametrize("where", ["doc_id = 5", "doc_id IS NULL AND text IS NULL", "lang = 'es'"])
def test_lone_rows_and_trees(odd, where):
    compare(odd.filter(where))


def test_several_superblocks_and_many_trees(spark):
    """One tree over more leaves than a superblock holds, 700 trees of a leaf, so that the tree over them has rounds too, and tampered rows."""
    hot = spark.range(1500).selectExpr("id * 7 % 1500 AS doc_id", "'en' AS lang")
    lone = spark.range(700).selectExpr("id + 5000 AS doc_id", "concat('é', id) AS lang")
    docs = hot.unionByName(lone).selectExpr("doc_id", "'s' AS source", "lang", "doc_id AS n_chars", "IF(doc_id % 2 = 0, concat('Text ', doc_id), 'same') AS text", "'mine' AS digest", "1 AS pos")
    got = compare(docs, lambda r: r["text"].replace("T", "#"), tampered={"text": F.replace(F.col("text"), F.lit("T"), F.lit("#"))})
    assert sum(not r.verified for r in got) == sum(1 for r in got if r.doc_id % 2 == 0)


def test_large_ids_stay_exact(spark):
    docs = spark.createDataFrame([(2**62 + 1, None, "a", 1, "x"), (None, "s", "a", 2, "y"), (-(2**63), "s", "a", 2, "y")], "doc_id long, source string, lang string, n_chars long, text string")
    assert {r.doc_id for r in compare(docs)} == {2**62 + 1, None, -(2**63)}


def test_query_equals_sql_and_plain(spark, small, duck, same_rows):
    got = M.op13_merkle_manifest(spark, small).toPandas()
    assert same_rows(got) == same_rows(duck.execute(M.OP13_SQL).df())
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert sorted(got[names].itertuples(index=False, name=None), key=str) == plain(rows, lowered)
    assert 0 < got.verified.sum() < len(got)
