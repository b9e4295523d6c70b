"""Ledgers, models, tasks and texts derived from the driver's tables, as frames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.ledger_store import fold

EXECUTION = "2001-12-01"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status transition an event."""
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_type")
    started = kind == "view"
    status = F.when(started, "started").when(kind.isin("click", "purchase"), "succeeded").when(kind == "error", "failed").when(F.col("event_id") % 2 == 0, "locked_out").otherwise("crashed")
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("model_"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("model_name"),
        day.alias("execution_ts"),
        status.alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("updated_at"),
        F.concat(F.lit("rg_"), day, F.when(F.hour("ts") < 12, "_a").otherwise("_b")).alias("run_group_id"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("chunk_key"),
        F.when(started, F.col("ts").cast("timestamp_ntz")).alias("heartbeat_at"),
        F.when(started, F.col("ts").cast("date").cast("timestamp_ntz") - F.expr("interval '1' day")).alias("start_ts"),
        F.when(started, second).alias("end_ts"),
        "event_id",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(transitions(spark, sf_dir))


TRANSITIONS = """transitions AS (
  SELECT 'model_' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS model_name, strftime(ts, '%Y-%m-%d') AS execution_ts,
    CASE WHEN event_type = 'view' THEN 'started' WHEN event_type IN ('click', 'purchase') THEN 'succeeded' WHEN event_type = 'error' THEN 'failed'
         WHEN event_id % 2 = 0 THEN 'locked_out' ELSE 'crashed' END AS status,
    ts AS updated_at, 'rg_' || strftime(ts, '%Y-%m-%d') || CASE WHEN hour(ts) < 12 THEN '_a' ELSE '_b' END AS run_group_id,
    'c' || CAST(event_id % 3 AS VARCHAR) AS chunk_key,
    CASE WHEN event_type = 'view' THEN ts END AS heartbeat_at,
    CASE WHEN event_type = 'view' THEN date_trunc('day', ts) - INTERVAL 1 DAY END AS start_ts,
    CASE WHEN event_type = 'view' THEN date_trunc('second', ts) END AS end_ts, event_id
  FROM events)"""


def folded(name: str, source: str = "transitions", where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT model_name, execution_ts, status, max(updated_at) AS updated_at, run_group_id, chunk_key, max(heartbeat_at) AS heartbeat_at, max(start_ts) AS start_ts, max(end_ts) AS end_ts
  FROM {source} WHERE {where} GROUP BY model_name, execution_ts, status, run_group_id, chunk_key)"""


LEDGER = TRANSITIONS + ",\n" + folded("ledger")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each supplier of ``lineitem``, with its watermark."""
    k, at = F.col("l_suppkey"), F.col("l_shipdate").cast("timestamp_ntz")
    by = read(spark, sf_dir, "lineitem").groupBy(k.alias("k")).agg(F.min(at).cast("date").alias("lo"), F.max(F.when(F.year(at) <= 1995 + k % 7, at)).alias("hi"))
    k = F.col("k")
    return by.select(
        k.cast("string").alias("model_name"),
        F.when(k % 5 == 0, F.last_day("lo")).otherwise(F.col("lo")).alias("first_timestamp"),
        (1 + k % 12).cast("int").alias("chunk_months"),
        (k % 4).cast("int").alias("lag"),
        (k % 8).cast("int").alias("lookback"),
        F.when(k % 10 != 0, F.col("hi")).alias("watermark"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("model_name"), "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("ts"))


MODELS = """models AS (
  SELECT CAST(k AS VARCHAR) AS model_name, CASE WHEN k % 5 = 0 THEN last_day(lo) ELSE lo END AS first_timestamp, CAST(1 + k % 12 AS INT) AS chunk_months,
    CAST(k % 4 AS INT) AS lag, CAST(k % 8 AS INT) AS lookback, CASE WHEN k % 10 <> 0 THEN hi END AS watermark
  FROM (SELECT l_suppkey AS k, CAST(min(l_shipdate) AS DATE) AS lo,
    max(CASE WHEN year(l_shipdate) <= 1995 + l_suppkey % 7 THEN CAST(l_shipdate AS TIMESTAMP) END) AS hi FROM lineitem GROUP BY l_suppkey)),
facts AS (SELECT CAST(l_suppkey AS VARCHAR) AS model_name, l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem)"""


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "success").otherwise("skipped")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("model_name"), status.alias("status"), F.col("o_orderkey").alias("key"))


def tests(spark: SparkSession, sf_dir: str, skipping: bool = False) -> DataFrame:
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "pass").when(flag == "N", "warn").otherwise("fail")
    if skipping:
        status = F.when(F.col("l_linenumber") == 7, "skipped").otherwise(status)
    return read(spark, sf_dir, "lineitem").select(F.array(F.col("l_orderkey").cast("string")).alias("parents"), status.alias("status"))


BUILDS = """builds AS (SELECT CAST(o_orderkey AS VARCHAR) AS model_name, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'success' ELSE 'skipped' END AS status, o_orderkey AS key FROM orders),
tests AS (SELECT CAST(l_orderkey AS VARCHAR) AS model_name, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'warn' ELSE 'fail' END AS status, l_linenumber AS n FROM lineitem)"""


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of run and test tasks; every seventh is written in the flat form."""
    from pyspark.sql import Window

    kind, role = F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "run").otherwise("test")
    state = F.when(kind == "view", "success").when(kind == "click", "failed").when(kind == "purchase", "skipped").when(kind == "error", "upstream_failed").otherwise("running")
    model = F.concat(F.lit("model_"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"))
    task = F.concat(F.lit("models."), model, F.when(F.col("user_id") % 7 == 0, F.lit("_")).otherwise(F.lit(".")), role)
    rows = read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), task.alias("task_id"), state.alias("state"), F.col("ts").cast("timestamp_ntz").alias("changed_at"), "event_id")
    before = F.lag("state").over(Window.partitionBy("run_id", "task_id").orderBy("changed_at", "event_id"))
    return rows.withColumn("previous_state", before)


TASKS = """raw_tasks AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, 'model_' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS model_name, CASE WHEN event_id % 2 = 0 THEN 'run' ELSE 'test' END AS role,
    CASE WHEN user_id % 7 = 0 THEN '_' ELSE '.' END AS sep,
    CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'skipped' WHEN 'error' THEN 'upstream_failed' ELSE 'running' END AS state, ts AS changed_at, event_id FROM events),
tasks AS (SELECT *, 'models.' || model_name || sep || role AS task_id, lag(state) OVER (PARTITION BY run_id, model_name, role, sep ORDER BY changed_at, event_id) AS previous_state FROM raw_tasks)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model text for each part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    start = F.concat(F.lit("start_ts('ts', "), s(size % 10), F.lit(", '19"), s(90 + k % 9), F.lit("-01-01')"))
    noted = F.when(k % 11 == 0, F.lit("\n-- start_ts('old', 99, '1901-01-01') and end_ts(99)")).otherwise("")
    end = F.when(k % 13 == 0, F.lit("end_ts(var('lag'))")).otherwise(F.concat(F.lit("end_ts("), s(k % 4), F.lit(")")))
    ref = F.concat(F.lit("{{ source('s"), s(size % 5), F.lit("', 't"), s(k % 7), F.lit("') }}"))
    text = F.concat(F.lit("select * from "), ref, F.lit(" where ts between "), start, F.lit(" and "), end, noted)
    return read(spark, sf_dir, "part").select(F.concat(F.lit("part_"), s(k)).alias("model_name"), text.alias("text"), k.alias("k"), size.alias("size"))


TEXTS = """texts AS (SELECT 'part_' || p_partkey AS model_name, CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS size FROM part)"""


def nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model text for each part whose arguments hold calls, brackets, quotes and commas of their own."""
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    column = F.when(k % 4 == 0, F.lit("var('column', default=\"ts\")")).when(k % 4 == 1, F.concat(F.lit('"DATE(ts, '), s(k % 3), F.lit(')"'))).when(k % 4 == 2, F.lit("coalesce(a[1, 2], {'b': (c)})")).otherwise("'ts'")
    start = F.concat(F.lit("start_ts(\n  "), column, F.lit(", "), s(size % 10), F.lit(" , '20"), s(10 + k % 9), F.lit("-01-01'\n)"))
    end = F.when(k % 13 == 0, F.lit("end_ts(greatest(1, 2))")).otherwise(F.concat(F.lit("end_ts( "), s(k % 4), F.lit(" )")))
    text = F.concat(F.lit("select (a, b) from t where ts between {{ "), start, F.lit(" }} and {{ "), end, F.lit(" }}) -- start_ts(f(x), 99, '1901-01-01')"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("part_"), s(k)).alias("model_name"), text.alias("text"))
