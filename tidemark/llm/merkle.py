"""Merkle manifest of a table: a digest tree for each value of a column, one tree over their roots, and a checked proof for each row.

Leaves are cut into superblocks of ``ARITY ** DEPTH`` neighbours.  On the way up a superblock becomes its root, and the roots become the leaves of the next round, until one is
left of each tree.  On the way down the nodes of a superblock and the outer nodes that its proofs need (the runs above it) are cogrouped by superblock: one
function finishes the reduction inside, joins the two parts of each proof and folds it.  A group holds one superblock and a run for each level above, whatever the table's size.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import LOWER, UPPER, ascii_lower
from tidemark.plans.loads import sized
from tidemark.scratch import Scratch, parallelism

#: Nodes of a run, which share a parent, and levels inside a superblock.
ARITY, DEPTH = 8, 3
BLOCK = ARITY**DEPTH
NODE = "tree string, pos long, n long, digest string"
OUTER = "tree string, block long, level int, slot int, own int, digest string, above boolean"
PROOF = "array<struct<slot:int,siblings:array<string>>>"


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256, in lower-case hex, of the columns in a row: ``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = lambda c: c.cast("string")
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its ``proof`` lead to; for readers of a manifest, on Spark alone."""
    joined = lambda x: F.array_join(x, "")
    up = lambda d, p: F.sha2(F.concat(joined(F.slice(p["siblings"], F.lit(1), p["slot"])), d, joined(F.slice(p["siblings"], p["slot"] + 1, F.lit(ARITY)))), 256)
    return F.aggregate(proof, leaf, up)


def placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos``, from 0 in order within each ``tree``, and ``n``, the tree's rows.

    Rows are dealt by ranges of (tree, order), so a tree with most rows is spread over many tasks; what comes before a task's rows is counted from the written ranges.
    """
    by = ["tree", *order]
    dealt = rows.repartitionByRange(parallelism(rows.sparkSession), *by).sortWithinPartitions(*by)
    dealt = scratch.table(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33).alias("__part")
    counts = dealt.groupBy("tree", part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range and tree in it: no more than there are tasks and trees.
    starts = sized(counts.select("tree", "__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("tree")).alias("n")))
    joined = dealt.withColumn("__part", F.shiftright("__at", 33)).join(starts, ["tree", "__part"])
    return joined.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


def levels_inside(n: int) -> int:
    """Levels that a superblock of a tree with ``n`` nodes is reduced by: all, or what is left up to the tree's root."""
    return next(k for k in range(DEPTH + 1) if k == DEPTH or ARITY**k >= n)


def rise(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """``nodes`` (tree, pos, n, digest) and the rounds above them; in the last each tree has one node, its root."""
    rounds = [nodes.select("tree", "pos", "n", "digest")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    above = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / ARITY).cast("int")), lambda i: F.sha2(F.array_join(F.slice(a, i * ARITY + 1, ARITY), ""), 256))
    while most > 1:
        # At most BLOCK entries meet.
        grouped = rounds[-1].groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("a"), F.max("n").alias("n"))
        grouped = grouped.withColumn("a", F.col("a.digest"))
        for k in range(DEPTH):
            grouped = grouped.withColumn("a", F.when(F.col("n") > ARITY**k, above(F.col("a"))).otherwise(F.col("a")))
        rounds.append(scratch.table(grouped.select("tree", "pos", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("a")[0].alias("digest")), "round"))
        most = -(-most // BLOCK)
    return rounds


def digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def reduce_inside(leaves: list[str], n: int) -> list[list[str]]:
    """The levels of one superblock, from its leaves to its root."""
    levels = [leaves]
    for _ in range(levels_inside(n)):
        last = levels[-1]
        levels.append([digest(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def runs_above(outer: pd.DataFrame) -> list[tuple[list[str], int, bool]]:
    """The runs over a superblock, upwards: (digests, the slot of its own, whether over the tree)."""
    return [(list(run.digest), int(run.own.iloc[0]), bool(run.above.iloc[0])) for _, run in outer.sort_values(["level", "slot"]).groupby("level")]


def hand_down(over_trees: bool):
    """For a group of nodes and their outer nodes: the outer nodes of what is under each node."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, rows = nodes.sort_values("pos"), []
        if len(nodes):
            levels, runs = reduce_inside(list(nodes.digest), int(nodes.n.iloc[0])), runs_above(outer)
            for i, (tree, block) in enumerate(zip(nodes.under_tree, nodes.under_block, strict=True)):
                path = [(level[k // ARITY * ARITY :][:ARITY], k % ARITY, over_trees) for level, k in zip(levels[:-1], (i // ARITY**d for d in range(DEPTH)), strict=False)]
                rows += [(tree, block, height, slot, own, d, above) for height, (digests, own, above) in enumerate(path + runs) for slot, d in enumerate(digests)]
        return pd.DataFrame(rows, columns=["tree", "block", "level", "slot", "own", "digest", "above"])

    return run


def prove(with_proof: bool):
    """For a superblock of leaves and its outer nodes: roots, proofs and folded roots of the leaves."""

    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves, out = leaves.sort_values("pos"), []
        if not len(leaves):
            return pd.DataFrame(columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"][: 7 if with_proof else 6])
        levels, runs = reduce_inside(list(leaves.digest), int(leaves.n.iloc[0])), runs_above(outer)
        top = levels[-1][0]
        subroot = next((digests[own] for digests, own, above in runs if above), None)
        root = digest(runs[-1][0]) if runs else top
        subroot = subroot or root
        beside = [("".join(digests[:own]), "".join(digests[own + 1 :])) for digests, own, _ in runs]
        for i, (key, leaf, seen) in enumerate(zip(leaves.id, leaves.digest, leaves.seen, strict=True)):
            inner = [(level[k // ARITY * ARITY :][:ARITY], k % ARITY) for level, k in zip(levels[:-1], (i // ARITY**d for d in range(DEPTH)), strict=False)]
            path = [("".join(digests[:own]), "".join(digests[own + 1 :])) for digests, own in inner] + beside
            folded = seen
            for left, right in path:
                folded = digest((left, folded, right))
            row = (key, leaf, subroot, root, digest(left + right for left, right in path), folded)
            if with_proof:
                row += ([{"slot": own, "siblings": digests[:own] + digests[own + 1 :]} for digests, own, *_ in inner + runs],)
            out.append(row)
        return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"][: 7 if with_proof else 6])

    return run


def manifest(docs: DataFrame, columns: list[str], tree: str = "lang", key: str = "doc_id", tampered: dict[str, Column] | None = None, with_proof: bool = True) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]) of every row.

    Leaves are digests of ``columns``.  Rows of one ``tree`` value ascend by ``key``; subroots are ordered by that value.  ``tampered`` has changed versions of columns: the root is
    folded from the leaf they give and the proof of the original, and ``verified`` says whether it is the root.  ``proof`` has, level by level, the row's slot and its siblings.

    Defined results: a null tree value is a tree of its own, the first; null keys come first; rows that repeat a key are ordered by their leaf, and rows that repeat all columns are
    leaves of their own with equal digests; an empty text differs from a null one; a text may be of any length; a lone row is its own subroot; an empty table gives no rows; other
    columns are not used, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    name = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit(":"), F.col(tree).cast("string")))
    tampered = tampered or {}
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(changed) for c, changed in tampered.items()], F.lit(False))
    seen = F.when(differs, leaf_digest([tampered.get(c, F.col(c)) for c in columns]))
    leaves = docs.select(name.alias("tree"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in columns]).alias("digest"), seen.alias("seen"), F.monotonically_increasing_id().alias("row"))
    # Texts are read once; "row" only spreads repeated rows over tasks, as equal rows have equal digests.
    leaves = placed(scratch.table(leaves, "leaves"), ["key", "digest", "row"], scratch).withColumn("seen", F.coalesce("seen", "digest"))
    rounds = rise(leaves, scratch)
    subroots = placed(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], scratch)
    over = rise(subroots, scratch)
    spark = docs.sparkSession
    outer = spark.createDataFrame([], OUTER)
    blocked = lambda nodes: nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "block")
    for k in range(max(len(over) - 2, 0), -1, -1):
        nodes = over[k].select("*", F.col("tree").alias("under_tree"), F.col("pos").alias("under_block")) if k else subroots.select("tree", "pos", "n", "digest", F.col("name").alias("under_tree"), F.lit(0).cast("long").alias("under_block"))
        outer = scratch.table(blocked(nodes).cogroup(outer.groupBy("tree", "block")).applyInPandas(hand_down(True), OUTER), "outer")
    for k in range(len(rounds) - 2, 0, -1):
        nodes = rounds[k].select("*", F.col("tree").alias("under_tree"), F.col("pos").alias("under_block"))
        outer = scratch.table(blocked(nodes).cogroup(outer.groupBy("tree", "block")).applyInPandas(hand_down(False), OUTER), "outer")
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", proof {PROOF}" if with_proof else "")
    # Keys go as text: pandas would make numbers with nulls inexact.
    proved = blocked(leaves.select("tree", "pos", "n", "digest", "seen", F.col("key").cast("string").alias("id"))).cogroup(outer.groupBy("tree", "block")).applyInPandas(prove(with_proof), schema)
    kind = docs.schema[key].dataType
    return proved.select(
        F.col("id").cast(kind).alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["proof"] if with_proof else [])
    )


#: Fixed by the query's contract: the columns of a leaf, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by language; of every third document by CRC-32 of its id, the text is seen with A-Z in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False)) & F.col("text").isNotNull()
    return manifest(docs, LEAF, tampered={"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))}, with_proof=False)



def _leaf_sql(text: str) -> str:
    part = lambda c, of: f"CASE WHEN {of} IS NULL THEN '-' ELSE concat(strlen(CAST({of} AS VARCHAR)), ':', {of}) END"
    return f"sha256(concat({', '.join(part(c, text if c == 'text' else c) for c in LEAF)}))"


def _path_sql(rows: str, at: str, nodes: str, on: str, level: str) -> str:
    """Of every row and level of a tree: the siblings before and after its node."""
    run = "n.nodes[i // 8 * 8 + 1 : i // 8 * 8 + 8]"
    return f"""SELECT rid, {level} AS level, array_to_string(({run})[1 : i % 8], '') AS before, array_to_string(({run})[i % 8 + 2 : 8], '') AS after
  FROM (SELECT r.rid, n.level, n.nodes, {at} // CAST(pow(8, n.level) AS BIGINT) AS i FROM {rows} r JOIN {nodes} n ON {on} WHERE len(n.nodes) > 1) n"""


#: CRC-32, unsigned, of a number's decimal digits, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_RISE_SQL = "list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], '')))"
OP13_SQL = f"""
WITH RECURSIVE seen AS (SELECT *, CASE WHEN {_CRC_SQL} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents),
leaves AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, {_leaf_sql("other")} AS changed, row_number() OVER () AS rid FROM seen),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
trees(lang, level, nodes) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM rows_ GROUP BY lang UNION ALL SELECT lang, level + 1, {_RISE_SQL} FROM trees WHERE len(nodes) > 1),
subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1),
tops(level, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM subs UNION ALL SELECT level + 1, {_RISE_SQL} FROM tops WHERE len(nodes) > 1),
placed AS (SELECT r.*, s.subroot, s.place FROM rows_ r JOIN subs s ON r.lang IS NOT DISTINCT FROM s.lang),
paths AS ({_path_sql("placed", "r.pos", "trees", "n.lang IS NOT DISTINCT FROM r.lang", "level")} UNION ALL {_path_sql("placed", "r.place", "tops", "TRUE", "1000 + level")}),
steps AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k FROM paths),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY k) AS siblings FROM steps GROUP BY rid),
folds(rid, k, v) AS (SELECT rid, 0, changed FROM leaves UNION ALL SELECT s.rid, s.k, sha256(concat(s.before, f.v, s.after)) FROM folds f JOIN steps s ON s.rid = f.rid AND s.k = f.k + 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed LEFT JOIN proofs USING (rid) JOIN (SELECT rid, arg_max(v, k) AS folded_root FROM folds GROUP BY rid) USING (rid), (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
"""
