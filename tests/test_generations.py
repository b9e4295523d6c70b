"""Tables that are swapped as a whole: isolation, references, odd keys, retention."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.sources import generations as G

KEYS = ["model", "day"]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "model string, day date, n int")


def contents(df):
    return sorted(((r.model, r.day, r.n) for r in df.collect()), key=str)


A, B, C = ("a", date(2024, 1, 1), 1), ("a", date(2024, 1, 2), 2), ("b", date(2024, 1, 1), 3)


def data_files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def test_untouched_partitions_are_references(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert G.replace_partitions(frame(spark, A, B, C), path, KEYS) == 0
    before = data_files(path)
    new = ("a", date(2024, 1, 2), 9)
    assert G.replace_partitions(frame(spark, new), path, KEYS) == 1
    assert contents(G.read_partitions(spark, path)) == sorted([A, new, C], key=str)
    after = data_files(path)
    assert before.items() <= after.items() and len(after) == len(before) + 1
    parts = {(r.model, r.day): (r.generation[:8], r.rows) for r in G.live(spark, path, KEYS).collect()}
    assert parts == {("a", "2024-01-01"): ("00000000", 1), ("a", "2024-01-02"): ("00000001", 1), ("b", "2024-01-01"): ("00000000", 1)}


def test_reader_during_a_write_and_killed_writes(spark, tmp_path):
    path = f"{tmp_path}/t"
    G.replace_partitions(frame(spark, A, C), path, KEYS)
    reader = G.read_partitions(spark, path)
    staged = G.stage(frame(spark, ("a", date(2024, 1, 1), 7)), path, KEYS)
    assert contents(G.read_partitions(spark, path)) == [A, C]
    # Killed while the list of partitions was written: the version is there, but not complete.
    os.makedirs(f"{path}/live/v=1")
    assert contents(G.read_partitions(spark, path)) == [A, C]
    G.publish(spark, staged)
    assert contents(reader) == [A, C]
    assert contents(G.read_partitions(spark, path)) == [("a", date(2024, 1, 1), 7), C]


def test_covered_partitions_come_out_empty(spark, tmp_path):
    path = f"{tmp_path}/t"
    G.replace_partitions(frame(spark, A, B, C), path, KEYS)
    G.replace_partitions(frame(spark), path, KEYS, lambda parts: parts.filter("model = 'a'"))
    assert contents(G.read_partitions(spark, path)) == [C]
    G.replace_partitions(frame(spark), path, KEYS, lambda parts: parts)
    assert contents(G.read_partitions(spark, path)) == [] and G.read_partitions(spark, path).columns == ["model", "day", "n"]


def test_odd_keys(spark, tmp_path):
    """Nulls, signs that folders escape, and texts that look like numbers or dates."""
    path = f"{tmp_path}/t"
    rows = [(m, d, i) for i, (m, d) in enumerate([(None, None), ("a b", None), ("x/y=z", date(2024, 1, 1)), ("50%+é:'", None), ("007", date(1999, 12, 31)), ("2024-01-01", None)])]
    G.replace_partitions(frame(spark, *rows), path, KEYS)
    assert {r.model for r in G.live(spark, path, KEYS).collect()} == {r[0] for r in rows}
    again = [(m, d, i + 100) for m, d, i in rows]
    G.replace_partitions(frame(spark, *again), path, KEYS)
    assert contents(G.read_partitions(spark, path)) == sorted(again, key=str)
    assert contents(G.read_partitions(spark, path, F.col("model") == "x/y=z")) == [again[2]]
    assert contents(G.read_partitions(spark, path, "model IS NULL")) == [again[0]]


def test_only_asked_folders_are_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    G.replace_partitions(frame(spark, A, B, C), path, KEYS)
    for file in data_files(path):
        if "model=b" in file:
            with open(file, "w") as f:
                f.write("no parquet")
    assert contents(G.read_partitions(spark, path, "model = 'a'")) == [A, B]


def test_versions_and_retention(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert G.expire(spark, path) == [] and contents(G.read_partitions(spark, path, schema=frame(spark).schema)) == []
    for i in range(4):
        G.replace_partitions(frame(spark, ("a", date(2024, 1, 1), i)) if i else frame(spark, A, C), path, KEYS, notes={"log": spark.range(i)})
    G.stage(frame(spark, A), path, KEYS)
    assert contents(G.read_partitions(spark, path, version=1)) == [("a", date(2024, 1, 1), 1), C]
    assert G.note(spark, path, "log").count() == 3 and G.note(spark, path, "log", 1).count() == 1 and G.note(spark, path, "none") is None
    # Generation 0 still holds model b, generation 1 nothing; the staged one waits for its version.
    assert [g[:8] for g in G.expire(spark, path, keep=2)] == ["00000001"]
    assert G.numbers(spark, path) == [2, 3]
    with pytest.raises(ValueError):
        G.read_partitions(spark, path, version=1)
    assert contents(G.read_partitions(spark, path, version=2)) == [("a", date(2024, 1, 1), 2), C]
    G.replace_partitions(frame(spark, A, C), path, KEYS)
    assert [g[:8] for g in G.expire(spark, path)] == ["00000000", "00000002", "00000003", "00000004"]
    assert contents(G.read_partitions(spark, path)) == [A, C]


def test_columns_may_change(spark, tmp_path):
    path = f"{tmp_path}/t"
    G.replace_partitions(frame(spark, A, C), path, KEYS)
    G.replace_partitions(frame(spark, B).withColumn("more", F.lit("x")), path, KEYS)
    assert sorted(((r.n, r.more) for r in G.read_partitions(spark, path).collect()), key=str) == [(1, None), (2, "x"), (3, None)]


def test_maxima_read_the_last_day_only(spark, tmp_path):
    from tidemark.operators import watermarks as W

    path = f"{tmp_path}/t"
    G.replace_partitions(frame(spark, A, B, C, ("c", None, 4)), path, KEYS)
    for file in data_files(path):
        if "model=a/day=2024-01-01" in file or "model=c" in file:
            with open(file, "w") as f:
                f.write("no parquet")
    got = W.last_partition_max(spark, {"t": (path, "model", "day", "day")}).collect()
    assert sorted((r.table, r.model_name, str(r.partition_max)) for r in got) == [("t", "a", "2024-01-02 00:00:00"), ("t", "b", "2024-01-01 00:00:00")]
