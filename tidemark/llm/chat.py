"""Chat formatting: repairs the order of roles at the least cost and renders the result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch, parallelism

#: States of the automaton: before the first turn, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "model": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs: taking a turn for another role's, or for any role's if its own is unknown; merging it into the turn before; inserting an empty turn.
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
#: Turns that one step of the repair handles together.
BLOCK = 1024
NEVER = 1 << 40
OUT = "conv_id long, place long, seq long, role string, action string, source_role string, text string, rendered string"


def _tables() -> tuple[np.ndarray, np.ndarray, list]:
    """For a turn of each role (0: unknown), from and to each state: cost, turns put out, and (merged, inserted roles)."""
    cost, turns = np.full((4, 4, 4), NEVER, np.int64), np.zeros((4, 4, 4), np.int64)
    ways: list = [[[None] * 4 for _ in range(4)] for _ in range(4)]
    for role in range(4):
        for p in range(4):
            for t in (SYSTEM, USER, ASSISTANT):
                named = 0 if role == t else RELABEL if role else RELABEL_UNKNOWN
                options = [(named, 1, (False, []))] if (p, t) in LEGAL else []
                if p == t:
                    options.append((named + MERGE, 0, (True, [])))
                options += [(named + INSERT, 2, (False, [q])) for q in (USER, ASSISTANT) if (p, q) in LEGAL and (q, t) in LEGAL]
                if options:
                    best = min(options, key=lambda o: (o[0], o[1]))
                    cost[role, p, t], turns[role, p, t], ways[role][p][t] = best
    return cost, turns, ways


COST, TURNS, WAYS = _tables()
#: What it takes to end in each state with an assistant's turn.
ENDING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def forward(roles: list[int], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From each state of ``entry`` (rows) to each state: least cost, turns put out on that way, and the choices on it."""
    total = np.full((len(entry), 4), NEVER, np.int64)
    total[np.arange(len(entry)), entry] = 0
    out = np.zeros((len(entry), 4), np.int64)
    back = []
    every = np.arange(len(entry))[:, None]
    for role in roles:
        through = total[:, :, None] + COST[role]
        choice = through.argmin(1)
        out = out[every, choice] + TURNS[role][choice, np.arange(4)]
        total = np.minimum(through[every, choice, np.arange(4)], NEVER)
        back.append(choice)
    return total, out, back


def way(roles: list[int], entry: int, leave: int) -> list[int]:
    """The states after each turn, on the cheapest way from ``entry`` to ``leave``."""
    back = forward(roles, np.array([entry]))[2]
    states = [leave]
    for choice in reversed(back[1:]):
        states.append(int(choice[0, states[-1]]))
    return states[::-1]


def joined_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows with the same ``key``, put together across batches."""
    kept: pd.DataFrame | None = None
    for frame in frames:
        if kept is not None:
            frame = pd.concat([kept, frame], ignore_index=True)
        if not len(frame):
            continue
        values = frame[key]
        change = np.flatnonzero((values.to_numpy()[1:] != values.to_numpy()[:-1])) + 1
        edges = [0, *change.tolist()]
        for a, b in pairwise(edges):
            yield frame.iloc[a:b]
        kept = frame.iloc[edges[-1] :]
    if kept is not None and len(kept):
        yield kept


def blocked(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Numbers sorted turns and cuts each conversation into blocks of ``most`` turns; a block's last row has its costs."""
    task = TaskContext.get().partitionId() << 40
    pos = block = 0
    held: tuple = ()
    roles: list[int] = []
    row: dict | None = None

    def closed() -> dict:
        total, out, _ = forward(roles, np.arange(4))
        return row | {"cost": total.ravel().tolist(), "turns": out.ravel().tolist()}

    for frame in frames:
        done = []
        for conv, role, text in zip(frame["conv_id"].array, frame["role"], frame["text"], strict=True):
            name = (pd.isna(conv), None if pd.isna(conv) else int(conv))
            if row is not None and (name != held or len(roles) == most):
                done.append(closed())
                roles, block = [], block + 1
            elif row is not None:
                done.append(row)
            held = name
            code = ROLES.get((role or "").strip().lower(), 0)
            roles.append(code)
            row = {"conv_id": name[1], "block": task + block, "pos": task + pos, "code": code, "role": role, "text": text, "cost": None, "turns": None}
            pos += 1
        if done:
            yield pd.DataFrame(done).astype({"conv_id": "Int64"})
    if row is not None:
        yield pd.DataFrame([closed()]).astype({"conv_id": "Int64"})


def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every block of a conversation: the states it is entered and left in, its first turn's number, and whether it is the last."""
    rows: list[tuple] = []
    for group in joined_groups(frames, "conv"):
        blocks = group.sort_values("block")
        cost = [np.array(c, np.int64).reshape(4, 4) for c in blocks["cost"]]
        turns = [np.array(c, np.int64).reshape(4, 4) for c in blocks["turns"]]
        total = np.array([0, NEVER, NEVER, NEVER], np.int64)
        back = []
        for c in cost:
            through = total[:, None] + c
            back.append(through.argmin(0))
            total = np.minimum(through.min(0), NEVER)
        state = int((total + [INSERT * len(ENDING[s]) for s in range(4)]).argmin())
        states = [state]
        for choice in reversed(back):
            states.append(int(choice[states[-1]]))
        states = states[::-1]
        first = 0
        for k, name in enumerate(blocks["block"]):
            rows.append((int(name), states[k], states[k + 1], first, k == len(cost) - 1))
            first += int(turns[k][states[k], states[k + 1]])
        if len(rows) > 5000:
            yield pd.DataFrame(rows, columns=["block", "entry", "leave", "first", "last"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["block", "entry", "leave", "first", "last"])


def opened(state: int, first: bool) -> str:
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{NAMES[state]}\n"


def repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The turns of each block as its states have them, with inserted ones."""
    columns = [x.split()[0] for x in OUT.split(", ")]
    rows: list[tuple] = []
    size = 0
    for group in joined_groups(frames, "block"):
        head = group.iloc[0]
        state, seq, conv = int(head["entry"]), int(head["first"]) - 1, None if pd.isna(head["conv_id"]) else int(head["conv_id"])
        codes = group["code"].tolist()
        for k, (code, after, pos, role, text) in enumerate(zip(codes, way(codes, state, int(head["leave"])), group["pos"], group["role"], group["text"], strict=True)):
            merged, inserted = WAYS[code][state][after]
            for n, q in enumerate(inserted):
                seq += 1
                rows.append((conv, int(pos) * 4 + n, seq, NAMES[q], "insert", None, "", opened(q, state == START)))
            body = (text or "").replace("<|im_", "<| im_")
            if merged:
                shown = "\n" + body
            else:
                seq += 1
                shown = opened(after, state == START and not inserted) + body
            action = ("merge" if merged else "keep") if code == after else ("merge_relabel" if merged else "relabel")
            close = k == len(codes) - 1 and head["last"] and not ENDING[after]
            rows.append((conv, int(pos) * 4 + 1, seq, NAMES[after], action, role, text or "", shown + "<|im_end|>\n" * bool(close)))
            size += len(shown)
            state = after
        if head["last"]:
            for n, q in enumerate(ENDING[state]):
                seq += 1
                rows.append((conv, int(group["pos"].iloc[-1]) * 4 + 2 + n, seq, NAMES[q], "insert", None, "", opened(q, False) + "<|im_end|>\n" * (n == len(ENDING[state]) - 1)))
        if size > 1 << 20 or len(rows) > 5000:
            yield pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns of each conversation after the cheapest repair; ``rendered`` pieces in order of ``place`` are the conversation's text.

    A repaired conversation may begin with a system turn, then user and assistant alternate, and an assistant's turn ends it.  A turn may be
    merged into the one before, taken for another role's, or preceded by an empty turn.  The least cost over all choices comes from dynamic
    programming over (turn, last role).  Costs of a block of turns are a small matrix, and matrices of consecutive blocks combine, so a
    conversation of any length is repaired by many tasks: turns are sorted by range, blocks are summarised, each conversation's
    summaries (one row for 1,024 turns) give the states between blocks, and blocks are then repaired apart.

    Turns are in order of ``turn`` (nulls last), then role, then text; repeated rows are turns like any other.  A null conv_id is a conversation of its own.  A null
    text is empty; a null or unknown role may become any role.  Marks of the template inside a text get a space.  ``seq`` numbers a conversation's turns from 0, and
    merged turns share a number.  An empty table gives an empty table; other columns are not used.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat")
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    order = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("hash"), F.asc("row")]
    ordered = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    schema = "conv_id long, block long, pos long, code int, role string, text string, cost array<long>, turns array<long>"
    blocks = scratch.table(ordered.mapInPandas(lambda frames: blocked(frames, block), schema), "blocks")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    ends = blocks.filter(F.col("cost").isNotNull()).select(conv, "block", "cost", "turns")
    # A row here stands for a whole block, so the number of tasks is set and not left to the bytes of these rows.
    states = ends.repartition(parallelism(spark), "conv").sortWithinPartitions("conv", "block").mapInPandas(settled, "block long, entry int, leave int, first long, last boolean")
    joined = blocks.drop("cost", "turns").join(states, "block")
    # A block is read in several splits, and a skewed join is split too.  Dealt by another expression than the join's key, so that the exchange is not left out.
    return joined.repartition(F.xxhash64("block")).sortWithinPartitions("block", "pos").mapInPandas(repaired, OUT)


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation as one text, for conversations that fit a row."""
    pieces = F.sort_array(F.collect_list(F.struct("place", "rendered")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["rendered"]), "").alias("text"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
