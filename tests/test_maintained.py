"""Compaction and maintenance follow the change and equal full recomputation."""

import random
from datetime import date, datetime, timedelta

from tidemark.operators import ledger as L
from tidemark.operators import watermarks as W
from tidemark.sources import compaction, generations
from tidemark.sources import ledger_store as S
from tidemark.streaming import maintained

T0 = datetime(2026, 6, 1)


def rows(spark, *some):
    """(model, day, status, run group, chunk, minute) as transitions; windows follow from the minute."""
    full = [(m, d, s, T0 + timedelta(minutes=t), g, c, None, T0 if s == "started" else None, T0 + timedelta(hours=t) if s == "started" else None) for m, d, s, g, c, t in some]
    return spark.createDataFrame(full, S.LEDGER)


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def live_generations(spark, path):
    return {r.execution_ts: r.generation[:8] for r in generations.live(spark, path, ["execution_ts"]).collect()}


def test_compaction_reads_new_files_and_writes_their_days(spark, tmp_path):
    log, path = f"{tmp_path}/log", f"{tmp_path}/ledger"
    assert compaction.compact_ledger(spark, log, path) == 0 and compaction.read_compacted(spark, path).count() == 0
    first = rows(spark, ("m", "2026-06-01", "started", "A", "f", 1), ("m", "2026-06-02", "started", "B", "f", 2), ("m", None, "started", "C", "f", 3))
    S.append_transitions(first, log)
    assert compaction.compact_ledger(spark, log, path) == 1
    assert compaction.compact_ledger(spark, log, path) == 1
    # Folded files are not opened again.
    for (file,) in compaction.log_files(spark, log).collect():
        with open(file.removeprefix("file:"), "w") as f:
            f.write("no parquet")
    second = rows(spark, ("m", "2026-06-02", "started", "B", "f", 9), ("m", "2026-06-02", "succeeded", "B", "f", 5), ("m", None, "failed", "C", "f", 4))
    S.append_transitions(second, log)
    assert compaction.compact_ledger(spark, log, path) == 2
    assert bag(compaction.read_compacted(spark, path)) == bag(S.fold(first.unionByName(second)))
    assert live_generations(spark, path) == {"2026-06-01": "00000001", "2026-06-02": "00000002", None: "00000002"}
    assert bag(compaction.read_compacted(spark, path, version=1)) == bag(S.fold(first))


def test_killed_compaction_folds_all_or_nothing(spark, tmp_path):
    log, path = f"{tmp_path}/log", f"{tmp_path}/ledger"
    first = rows(spark, ("m", "2026-06-01", "started", "A", "f", 1))
    S.append_transitions(first, log)
    real = generations.publish
    try:
        generations.publish = None  # dies after the data
        try:
            compaction.compact_ledger(spark, log, path)
        except TypeError:
            pass
    finally:
        generations.publish = real
    assert generations.numbers(spark, path) == []
    assert compaction.compact_ledger(spark, log, path) == 0
    assert bag(compaction.read_compacted(spark, path)) == bag(S.fold(first))


def test_batches_equal_recomputation(spark, tmp_path):
    """Random transitions with nulls and ties in batches, one of them twice: view and watermarks equal those of the whole at every step."""
    r = random.Random(5)
    pick = lambda: (r.choice(["a", "b", None]), f"2026-06-0{r.randint(1, 4)}", r.choice(["started", "started", "succeeded", "failed", "locked_out", "crashed"]), r.choice(["A", "B", "C", None]), r.choice(["x", "y"]), r.randrange(40))
    batches = [rows(spark, *[pick() for _ in range(25)]) for _ in range(2)]
    path, so_far = f"{tmp_path}/kept", None
    assert maintained.maintained_view(spark, path, date(2026, 6, 5)).count() == 0 and maintained.maintained_watermark(spark, path).count() == 0
    for batch in (batches[0], batches[1], batches[1]):
        maintained.apply_transitions(spark, path, batch)
        so_far = batch if so_far is None else so_far.unionByName(batch)
        whole = S.fold(so_far)
        assert bag(maintained.maintained_view(spark, path, date(2026, 6, 5))) == bag(L.completions_view(whole, date(2026, 6, 5)))
        assert bag(maintained.maintained_watermark(spark, path)) == bag(W.read_watermark(whole))


def test_a_batch_touches_its_days_and_buckets(spark, tmp_path):
    path = f"{tmp_path}/kept"
    maintained.apply_transitions(spark, path, rows(spark, *[("m", f"2026-06-0{i}", "started", f"g{i}", "f", i) for i in range(1, 6)]))
    maintained.apply_transitions(spark, path, rows(spark, ("m", "2026-06-03", "succeeded", "g3", "f", 9)))
    assert {d for d, g in live_generations(spark, f"{path}/view").items() if g == "00000001"} == {"2026-06-03"}
    assert {r.generation[:8]: r.n for r in generations.live(spark, f"{path}/chunks", []).groupBy("generation").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}["00000001"] == 1
    assert [r.watermark for r in maintained.maintained_watermark(spark, path).collect()] == [T0 + timedelta(hours=3)]
    # A later chunk of the run that is not done takes the mark back.
    maintained.apply_transitions(spark, path, rows(spark, ("m", "2026-06-03", "started", "g3", "other", 10)))
    assert [r.watermark for r in maintained.maintained_watermark(spark, path).collect()] == [None]
