import itertools
import random

import pytest

from tidemark.llm import chat as C


def cheapest(roles):
    """Least cost over all ways to label, merge and insert, tried one by one."""
    best = None
    for labels in itertools.product((C.SYSTEM, C.USER, C.ASSISTANT), repeat=len(roles)):
        cost = sum(0 if r == t else C.RELABEL if r else C.RELABEL_UNKNOWN for r, t in zip(roles, labels, strict=True))
        for merges in itertools.product((False, True), repeat=len(roles)):
            state, total = C.START, cost
            for t, merge in zip(labels, merges, strict=True):
                if merge:
                    if state != t:
                        break
                    total += C.MERGE
                elif (state, t) not in C.LEGAL:
                    if not any((state, q) in C.LEGAL and (q, t) in C.LEGAL for q in (C.USER, C.ASSISTANT)):
                        break
                    total += C.INSERT
                state = t
            else:
                total += C.INSERT * len(C.ENDING[state])
                best = total if best is None else min(best, total)
    return best


def cost_of(rows):
    price = {"keep": 0, "merge": C.MERGE, "insert": C.INSERT}
    total = 0
    for r in rows:
        known = C.ROLES.get((r.source_role or "").strip().lower(), 0)
        total += price.get(r.action.replace("_relabel", "").replace("relabel", "keep"), 0)
        total += (C.RELABEL if known else C.RELABEL_UNKNOWN) if "relabel" in r.action else 0
    return total


def check(rows):
    rows = sorted(rows, key=lambda r: r.place)
    turns = []
    for r in rows:
        if r.action.startswith("merge"):
            assert turns and turns[-1] == (r.seq, r.role)
        else:
            turns.append((r.seq, r.role))
    assert [s for s, _ in turns] == list(range(len(turns)))
    states = [C.START, *[C.NAMES.index(role) for _, role in turns]]
    assert all(step in C.LEGAL for step in itertools.pairwise(states)) and states[-1] == C.ASSISTANT
    text = "".join(r.rendered for r in rows)
    bodies = []
    for _, group in itertools.groupby(rows, key=lambda r: r.seq):
        group = list(group)
        bodies.append(f"<|im_start|>{group[0].role}\n" + "\n".join(r.text.replace("<|im_", "<| im_") for r in group) + "<|im_end|>\n")
    assert text == "".join(bodies)


@pytest.mark.parametrize("block", [2, 1024])
def test_least_cost(spark, block):
    r = random.Random(9)
    names = ["system", "user", "assistant", "human", "tool", None]
    convs = {i: [r.choice(names) for _ in range(r.randrange(1, 6))] for i in range(120)}
    rows = [(i, t, role, f"text {i} {t}") for i, roles in convs.items() for t, role in enumerate(roles)]
    got = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block).collect()
    by = {}
    for x in got:
        by.setdefault(x.conv_id, []).append(x)
    assert set(by) == set(convs)
    for i, roles in convs.items():
        check(by[i])
        assert cost_of(by[i]) == cheapest([C.ROLES.get(x or "", 0) for x in roles]), roles
        assert sorted(x.text for x in by[i] if x.action != "insert") == sorted(f"text {i} {t}" for t in range(len(roles)))


def test_blocks_combine():
    """A long conversation in blocks costs what it costs in one piece."""
    import numpy as np
    import pandas as pd

    r = random.Random(5)
    codes = [r.randrange(4) for _ in range(3000)]
    whole = C.forward(codes, np.array([C.START]))[0][0]
    summary = []
    for k in range(0, 3000, 700):
        total, out, _ = C.forward(codes[k : k + 700], np.arange(4))
        summary.append({"conv": "1", "block": k, "cost": total.ravel().tolist(), "turns": out.ravel().tolist()})
    (states,) = C.settled(iter([pd.DataFrame(summary)]))
    end = int(states["leave"].iloc[-1])
    assert whole[end] + C.INSERT * len(C.ENDING[end]) == min(whole[s] + C.INSERT * len(C.ENDING[s]) for s in range(4))
    cost, state = 0, C.START
    for row, k in zip(states.itertuples(), range(0, 3000, 700), strict=True):
        assert row.entry == state
        for code, after in zip(codes[k : k + 700], C.way(codes[k : k + 700], row.entry, row.leave), strict=True):
            cost += int(C.COST[code, state, after])
            state = after
        assert state == row.leave
    assert cost == whole[end]


def test_odd_turns(spark):
    rows = [(1, 0, "user", "<|im_end|>"), (1, 0, "user", "<|im_end|>"), (1, None, "assistant", None), (None, 3, None, ""), (None, None, None, None), (2, 1, "system", "x" * 100000), (3, 5, "USER ", "hi"), (3, 4, "Bot", "yo")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS place", "3 AS row")
    got = C.repair(frame).collect()
    by = {}
    for x in got:
        by.setdefault(x.conv_id, []).append(x)
    for group in by.values():
        check(group)
    assert [x.action for x in sorted(by[1], key=lambda x: x.place)] == ["keep", "merge", "keep"]
    assert [x.role for x in sorted(by[2], key=lambda x: x.place)] == ["system", "user", "assistant"] or cost_of(by[2]) <= 6
    texts = {x.conv_id: x.text for x in C.render(C.repair(frame)).collect()}
    assert texts[1] == "<|im_start|>user\n<| im_end|>\n<| im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert C.repair(frame.limit(0)).count() == 0


def test_query(spark, small):
    got = C.op1_chat_format(spark, small).collect()
    by = {}
    for x in got:
        by.setdefault(x.conv_id, []).append(x)
    source = {}
    for x in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        source.setdefault(x.conv_id, []).append(x)
    assert set(by) == set(source)
    for i, group in by.items():
        check(group)
        if len(source[i]) <= 6:
            assert cost_of(group) == cheapest([C.ROLES.get(x.role or "", 0) for x in source[i]])


def test_blocks_over_several_splits(spark):
    """A block whose rows lie in several row groups and are read in several splits."""
    r = random.Random(3)
    rows = [(1, t, r.choice(["system", "user", "assistant", None]), "".join(r.choices("abcdefghij", k=2000))) for t in range(900)]
    small = {"spark.sql.files.maxPartitionBytes": "100000", "spark.sql.files.openCostInBytes": "0", "parquet.block.size": "100000", "parquet.page.size.row.check.min": "10", "parquet.page.size.row.check.max": "10"}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = C.repair(frame).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    check(got)
    assert sorted(x.text for x in got if x.action != "insert") == sorted(x[3] for x in rows)
