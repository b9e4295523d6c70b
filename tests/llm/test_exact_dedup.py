import hashlib
import string

from tidemark.llm import exact_dedup as X

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_query_equals_sql(spark, small, duck, same_rows):
    assert same_rows(X.op3_exact_dedup(spark, small).toPandas()) == same_rows(duck.execute(X.OP3_SQL).df())


def test_odd_rows(spark, odd):
    kept = X.exact_dedup(odd).collect()
    assert X.exact_dedup(odd).columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, i) for i in (2, 4, 5, 6, 7, 8, 9)]
    assert X.exact_dedup(odd, keep="smallest").filter("doc_id = 1").count() == 1
    assert X.exact_dedup(odd.limit(0)).count() == 0
    only_null = odd.filter("doc_id is null")
    assert X.exact_dedup(only_null).count() == 2


def test_hot_text_in_many_runs(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('t', id % 1000) END AS text")
    marked = X.mark_copies(docs, X.ascii_lower(docs.text), "doc_id", rounds=4).toPandas()
    expected = {}
    for i in range(5000):
        expected.setdefault("hot" if i % 3 == 0 else f"t{i % 1000}", []).append(i)
    got = marked.set_index("doc_id")
    for group in expected.values():
        assert set(got.loc[group, "__keep"]) == {max(group)} and set(got.loc[group, "__size"]) == {len(group)}
        assert got.loc[group, "__kept"].sum() == 1
        assert bytes(got.loc[group[0], "__sha"]) == hashlib.sha256(got.loc[group[0], "text"].translate(LOW).encode()).digest()


def test_runs_are_sorted_and_merged_in_every_round(spark, small):
    prints = X.fingerprint(spark.read.parquet(f"{small}/documents.parquet"), X.ascii_lower(X.F.col("text")), "doc_id", 3)
    plan = X.merge_runs(prints, "doc_id", 3)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    merges = [line for line in plan.splitlines() if " Sort [" in line and "__run" in line and "__h64" in line and "__sha" in line]
    assert len(merges) >= 3
