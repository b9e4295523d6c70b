import string

import numpy as np
import pytest

import corpus_pipeline as P
from tidemark.llm import quality, toxicity

from .test_near_dedup import brute
from .test_packing import best_fit

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    pdf = docs.toPandas().sort_values("doc_id")

    def texts(frame):
        return {r.doc_id: r.text for r in frame.collect()}

    kept = P.quality_stage(spark, docs, small)
    assert kept.columns == docs.columns
    model = quality.learn(docs, labels)
    assert set(texts(kept)) == set(pdf.doc_id[model.scores(pdf.text.tolist()) >= quality.CUT])
    model = toxicity.learn(docs, labels)
    assert set(texts(P.toxicity_stage(spark, docs, small))) == set(pdf.doc_id[model.scores(pdf.text.tolist()) < toxicity.CUT])

    groups = {}
    for i, t in zip(pdf.doc_id, pdf.text, strict=True):
        groups.setdefault(t.translate(LOW), []).append(i)
    exact = P.exact_dedup_stage(spark, docs, small)
    assert sorted(texts(exact)) == sorted(map(max, groups.values()))

    near = P.near_dedup_stage(spark, docs, small)
    assert set(texts(near)) == set(brute(texts(docs)).values())

    pieces = P.packing_stage(spark, docs, small).collect()
    assert len({r.sequence_id for r in pieces}) == len(best_fit([r.length for r in pieces], 2048))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_through_all_stages(spark, small, odd, empty):
    docs = odd.limit(0) if empty else odd
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        rows = out.collect()
        assert (len(rows) == 0) if empty else rows
        if name == "packing":
            assert all(np.isfinite(r.sequence_id) for r in rows)
        else:
            assert out.columns == docs.columns
            assert all(r[c] == "mine" for r in rows for c in docs.columns[5:])


def test_run(spark, small):
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    assert P.run(spark, small).count() > 0
