"""What only larger or finer tables show: last seconds, late files, very many partitions."""

import os
from datetime import datetime

import duckdb

from tidemark import queries as Q
from tidemark.sources import ledger_store as S


def test_closed_reload_ends_with_the_last_full_second(spark, tmp_path, same_rows):
    """The query equals its SQL where rows lie within the last second of the window, and before it."""
    times = ["2024-01-07 23:59:59.5", "2024-01-08 00:00:00", "2024-01-20 23:59:59.9", "2024-01-29 23:59:59", "2024-01-29 23:59:59.25", "2024-01-30 00:00:00"]
    rows = [(i, datetime.fromisoformat(t), "view") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("reload_days", "reload_days_midday"):
        assert same_rows(Q.QUERIES[name](spark, str(tmp_path)).toPandas()) == same_rows(con.execute(Q.ORACLE_SQL[name]).df())


def test_streamed_upserts_in_any_order(spark, tmp_path):
    """An older file that comes after a newer one does not move a key back."""
    from tidemark.streaming.upserts import stream_upsert_status

    log, path = f"{tmp_path}/log", f"{tmp_path}/ledger"
    for i, hour in enumerate((9, 17, 4)):
        row = ("m", "2026-06-01", "succeeded", datetime(2026, 6, 1, hour), "A", "f", None, None, None)
        S.append_transitions(spark.createDataFrame([row], S.LEDGER).coalesce(1), log)
        for file in os.listdir(log):  # files are streamed in the order of their times
            if file.endswith(".parquet") and os.path.getmtime(f"{log}/{file}") > 1e9:
                os.utime(f"{log}/{file}", (1000.0 + i, 1000.0 + i))
    stream = spark.readStream.schema(S.LEDGER).option("maxFilesPerTrigger", 1).parquet(log)
    stream_upsert_status(spark, stream, path, f"{tmp_path}/checkpoint").awaitTermination()
    assert [r.updated_at for r in S.read_days(spark, path).collect()] == [datetime(2026, 6, 1, 17)]


def test_files_do_not_follow_the_number_of_chunks(spark, tmp_path):
    """A thousand chunks of 500 models come in a few files, and are replaced, emptied and read one by one all the same."""
    from pyspark.sql import functions as F

    from tidemark.sources.chunks import write_chunks
    from tidemark.sources.generations import live, read_partitions

    path = f"{tmp_path}/t"
    rows = spark.range(3000).select((F.col("id") % 500).cast("string").alias("model_name"), F.when(F.col("id") % 1500 < 500, F.lit("a")).otherwise(F.lit("b")).alias("chunk_id"), F.col("id").alias("n"))
    write_chunks(rows, path)
    files = lambda: sum(f.endswith(".parquet") for _, _, fs in os.walk(f"{path}/data") for f in fs)
    first = files()
    assert first <= 128 and live(spark, path, []).count() == 1000
    # Model 7 runs both chunks again and has rows for one of them.
    ran = spark.createDataFrame([("7", "a"), ("7", "b")], "model_name string, chunk_id string")
    write_chunks(spark.createDataFrame([("7", "b", -1)], rows.schema), path, ran=ran)
    assert files() == first + 1
    now = sorted((r.model_name, r.chunk_id, r.n) for r in read_partitions(spark, path).collect())
    assert now == sorted([(r.model_name, r.chunk_id, r.n) for r in rows.filter("model_name <> '7'").collect()] + [("7", "b", -1)])
    asked = read_partitions(spark, path, "model_name IN ('7', '8') AND chunk_id = 'b'").collect()
    assert sorted((r.model_name, r.chunk_id, r.n) for r in asked) == sorted([("7", "b", -1)] + [("8", "b", r.n) for r in rows.filter("model_name = '8' AND chunk_id = 'b'").collect()])
    assert read_partitions(spark, path, version=0).count() == 3000


def test_a_plan_read_from_json_walks_each_grid_once(spark, small):
    plan = Q.QUERIES["plan_from_json"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("from_json(") == 1


def test_models_of_one_manifest_are_dealt_over_tasks(spark):
    """Each node's text is read once, by many tasks, and a node that two manifests hold is not multiplied with itself."""
    import json

    from pyspark.sql import functions as F

    from tidemark.operators import lineage as K

    nodes = {f"model.p.m{i}": {"resource_type": "model", "name": f"m{i}", "raw_code": f"select start_ts('ts', {i}, '2020-01-01'), end_ts(1)"} for i in range(40)}
    got = K.models_from_manifest(spark.createDataFrame([(json.dumps({"nodes": nodes}),)] * 2, "manifest string").coalesce(1))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted((r.model_name, r.lookback, r.lag) for r in got.collect()) == sorted([(f"m{i}", i, 1) for i in range(40)] * 2)
