"""Outcomes of builds, tests and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import as_column, datestr
from tidemark.operators.ledger import upsert_status

FAILED = ("failed", "upstream_failed")


def _run_keys(df: DataFrame) -> list[str]:
    """Models of one run are told by name; of many runs, by run group and name."""
    return [c for c in ("run_group_id", "model_name") if c in df.columns or c == "model_name"]


def tests_by_model(tests: DataFrame) -> DataFrame:
    """([run_group_id,] model_name, failing, ran) of tests ([run_group_id,] parents, status), a test counting for each of its parents.

    A failing test failed or broke; skipped tests did not run; warnings pass.
    """
    keys = _run_keys(tests)
    each = tests.select(*keys[:-1], F.explode("parents").alias("model_name"), "status")
    return each.groupBy(*keys).agg(F.max(F.coalesce(F.col("status").isin("fail", "error"), F.lit(False))).alias("failing"), F.max(F.coalesce(F.col("status") != "skipped", F.lit(True))).alias("ran"))


def run_outcomes(builds: DataFrame, tests: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """([run_group_id,] model_name, status) of each model built ([run_group_id,] model_name, status) or tested.

    A skipped build gives no row.  A failed build or failing test makes it failed; a good build, or tests that ran where there was no build, succeeded.
    Models in ``locked`` ([run_group_id,] model_name) backed off in that run and give no row; a ledger's locked-out rows serve as ``locked``.
    """
    keys = _run_keys(builds)
    joined = builds.select(*keys, F.col("status").alias("build")).join(tests_by_model(tests), keys, "full_outer")
    failing, ran = F.coalesce("failing", F.lit(False)), F.coalesce("ran", F.lit(False))
    status = F.when(F.col("build") == "skipped", None).when(failing | (F.col("build") != "success"), "failed").when((F.col("build") == "success") | ran, "succeeded")
    out = joined.select(*keys, status.alias("status")).filter(F.col("status").isNotNull())
    return out if locked is None else out.join(locked.select(*keys).distinct(), keys, "left_anti")


def models_with_tests(models: DataFrame, tests: DataFrame) -> DataFrame:
    """The models that some test depends on."""
    return models.join(tests.select(F.explode("parents").alias("model_name")).distinct(), "model_name", "left_semi")


def defer_success(transitions: DataFrame, tests: DataFrame) -> DataFrame:
    """Transitions without the successes of models that have tests, whose outcome comes with their tests."""
    tested = tests.select(F.explode("parents").alias("model_name")).distinct()
    good = F.coalesce(F.col("status") == "succeeded", F.lit(False))
    return transitions.filter(~good).unionByName(transitions.filter(good).join(tested, "model_name", "left_anti"))


def set_by_hand() -> Column:
    """Whether a task state (previous_state, state) was set by hand: neither the end of a running task nor no change; an unknown previous state counts."""
    return ~F.col("previous_state").eqNullSafe("running") & ~F.col("previous_state").eqNullSafe(F.col("state"))


def manual_transitions(states: DataFrame) -> DataFrame:
    """The task states set by hand."""
    return states.filter(set_by_hand())


def parse_task_ids(states: DataFrame) -> DataFrame:
    """``states`` with ``model_name`` and ``role`` (run or test) from ``task_id``, null for other tasks.

    Forms: '<groups>.<model>.run' and '<groups>.<model>_run', and likewise for tests; a last part that begins with 'test_' is no model's test.
    """
    parts = F.split("task_id", r"\.")
    leaf = F.element_at(parts, -1)
    nested = leaf.isin("run", "test") & (F.size(parts) >= 2)
    run, test = F.endswith(leaf, F.lit("_run")), F.endswith(leaf, F.lit("_test")) & ~F.startswith(leaf, F.lit("test_"))
    role = F.when(nested, leaf).when(run, "run").when(test, "test")
    model = F.when(nested, F.try_element_at(parts, F.lit(-2))).when(run, F.substring(leaf, F.lit(1), F.length(leaf) - 4)).when(test, F.substring(leaf, F.lit(1), F.length(leaf) - 5))
    return states.withColumns({"model_name": model, "role": role})


def states_by_model(states: DataFrame, *more: Column) -> DataFrame:
    """(run_id, model_name, run_state, test_state, and aggregates in ``more``): the latest state of each role, ties to the larger state."""
    known = parse_task_ids(states).filter(F.col("role").isNotNull())
    latest = lambda role: F.max_by(F.when(F.col("role") == role, F.col("state")), F.when(F.col("role") == role, F.struct("changed_at", "state")))
    return known.groupBy("run_id", "model_name").agg(latest("run").alias("run_state"), latest("test").alias("test_state"), *more)


def manual_status(run_state: str = "run_state", test_state: str = "test_state") -> Column:
    """failed, succeeded or null from the states of a model's run and test."""
    run, test = F.col(run_state), F.col(test_state)
    failed = F.coalesce(run.isin(*FAILED), F.lit(False)) | F.coalesce(test.isin(*FAILED), F.lit(False))
    run_good, test_good = run.eqNullSafe("success"), test.eqNullSafe("success")
    return F.when(failed, "failed").when(run_good & (test.isNull() | test_good), "succeeded").when(test_good & (run.isNull() | run.eqNullSafe("skipped")), "succeeded")


def manual_outcomes(states: DataFrame, *more: Column) -> DataFrame:
    return states_by_model(states, *more).withColumn("status", manual_status()).filter(F.col("status").isNotNull())


def reconcile(states: DataFrame, ledger: DataFrame, now) -> DataFrame:
    """The ledger after the outcomes of models whose tasks were set by hand; the run's id is the run group, the chunk 'full'."""
    found = manual_outcomes(states, F.max(set_by_hand()).alias("touched")).filter("touched")
    rows = found.select("model_name", datestr(now).alias("execution_ts"), "status", F.col("run_id").alias("run_group_id"), F.lit("full").alias("chunk_key"), as_column(now).alias("updated_at"))
    return upsert_status(ledger, rows)


def failed_tasks(states: DataFrame, leave_out: str = "alert_on_failure") -> DataFrame:
    """(run_id, failed_ids): sorted ids of tasks that failed themselves, in any case of letters."""
    bad = states.filter((F.lower("state") == "failed") & (F.col("task_id") != leave_out))
    return bad.groupBy("run_id").agg(F.sort_array(F.collect_set("task_id")).alias("failed_ids"))
