"""Near-duplicate vectors by NN-descent on a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components
from tidemark.scratch import Scratch

THRESHOLD = 0.93
#: Neighbours kept of each vector; farther ones than FLOOR are of no use in finding links and are not kept.
NEIGHBOURS, FLOOR = 10, 0.7
#: Random orders that begin the graph, refinements of it, and what an audit asks for.
ORDERS, RECALL, AUDITED = 8, 0.99, 1000
#: A graph is refined until a round changes less than this share of it, or so many times.
SETTLED, REFINEMENTS = 0.01, 8
#: Vectors compared at once: half a window of an order, members of a local join, a block of a component.
HALF, JOINED, BLOCK = 128, 64, 512
#: Vectors of a block where a component is counted: each vector is sent once for every block of its component.
COUNTED, ROWS = 2048, 256
BITS = 40
EDGE = "v long, u long, cosine double"
PIECE = "grp string, dim int, block long, first long, last long, saturated boolean, components array<long>, vectors binary, centre array<double>, radius double"


def unit_rows(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    # Scaled first, so that very large or small components neither overflow nor vanish.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector, label):
    """Whether a vector links with anything: it has a label, is not null or zero, and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def best_neighbours(ids: np.ndarray, x: np.ndarray, k: int, floor: float) -> pd.DataFrame:
    """The ``k`` nearest of each vector among the others, from ``floor`` on."""
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"v": [], "u": [], "cosine": []}).astype({"v": "int64", "u": "int64"})
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(cosine, near, 1)
    good = value >= floor
    return pd.DataFrame({"v": np.repeat(ids, k)[good.ravel()], "u": ids[near][good], "cosine": value[good]})


def embedding_type(df: DataFrame) -> str:
    """Vectors of single precision stay so on the way; all others are doubles.  Cosines are of double precision in any case."""
    return "array<float>" if df.schema["embedding"].dataType == T.ArrayType(T.FloatType(), df.schema["embedding"].dataType.containsNull) else "array<double>"


def ordered_neighbours(units: DataFrame, orders: int, seed: int, k: int, floor: float) -> DataFrame:
    """Edges between vectors that stand close in one of ``orders`` random orders of their group.

    An order sorts vectors by the signs of random projections, as leaves of a projection tree; each vector is
    compared with the window around it.  Orders are range-partitioned, so a label with very many vectors is spread.
    """

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                x = unit_rows(part["embedding"])
                for order in range(orders):
                    planes = np.random.default_rng([seed, order, int(dim)]).standard_normal((int(dim), BITS))
                    value = np.zeros(len(x), np.int64)
                    flip = np.zeros(len(x), np.int64)
                    for column in (x @ planes > 0).T.astype(np.int64):
                        flip ^= column  # Gray code: neighbouring leaves differ in one sign
                        value = value * 2 + flip
                    yield part.assign(turn=order, code=value)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for frame in frames:
            for _, part in frame.groupby(["turn", "grp", "dim"], sort=False):
                if kept is not None and len(kept) and tuple(kept.iloc[0][["turn", "grp", "dim"]]) == tuple(part.iloc[0][["turn", "grp", "dim"]]):
                    part = pd.concat([kept, part])
                ids, x = part["unit"].to_numpy(), unit_rows(part["embedding"])
                for first in range(0, max(1, len(ids) - HALF), HALF):
                    yield best_neighbours(ids[first : first + 2 * HALF], x[first : first + 2 * HALF], k, floor)
                kept = part.iloc[-HALF:]

    coded = units.select("grp", "dim", "unit", "embedding").mapInPandas(code, f"grp string, dim int, unit long, embedding {embedding_type(units)}, turn int, code long")
    return coded.repartitionByRange("turn", "grp", "dim", "code", "unit").sortWithinPartitions("turn", "grp", "dim", "code", "unit").mapInPandas(near, EDGE)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct neighbours of each vector."""
    once = edges.groupBy("v", "u").agg(F.max("cosine").alias("cosine"))
    return once.withColumn("__r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cosine"), "u"))).filter(F.col("__r") <= k).drop("__r")


def refined(graph: DataFrame, units: DataFrame, k: int, floor: float) -> DataFrame:
    """Edges among the neighbours of each vector, both those it lists and those that list it.

    A vector that very many others list has its neighbours dealt into several joins.
    """
    around = graph.select(F.col("v").alias("centre"), F.col("u").alias("unit")).unionByName(graph.select(F.col("u").alias("centre"), F.col("v").alias("unit"))).distinct()
    parts = around.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / JOINED).alias("parts"))
    dealt = around.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("unit", "centre"), F.col("parts"))).drop("parts")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return best_neighbours(frame["unit"].to_numpy(), unit_rows(frame["embedding"]), k, floor)

    return dealt.join(units.select("unit", "embedding"), "unit").groupBy("centre", "part").applyInPandas(join, EDGE)


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """(unit, links): vectors at or over ``threshold`` from each in its component, every copy counted.

    Components are compared in blocks of bounded size whose counts alone leave the task.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / COUNTED).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    dealt = (
        members.join(sizes, "component")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    )

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        ids, copies, x = frame["unit"].to_numpy(), frame["copies"].to_numpy(), unit_rows(frame["embedding"])
        one = frame["i"].iloc[0] == frame["j"].iloc[0]
        left = np.ones(len(x), bool) if one else (frame["block"] == frame["i"]).to_numpy()
        right = left if one else ~left
        links, back = np.zeros(len(x), np.int64), np.zeros(right.sum(), np.int64)
        for at in np.split(np.flatnonzero(left), range(ROWS, int(left.sum()), ROWS)):
            linked = x[at] @ x[right].T >= threshold
            if one:
                linked[np.arange(len(at)), at] = True
            links[at] = linked @ copies[right] - one
            back += linked.T @ copies[at]
        if not one:
            links[right] = back
        return pd.DataFrame({"unit": ids, "links": links})

    return dealt.groupBy("component", "i", "j").applyInPandas(count, "unit long, links long").groupBy("unit").agg(F.sum("links").alias("links"))


def pieces(placed: DataFrame) -> DataFrame:
    """``placed`` (grp, dim, unit, embedding, component, saturated) in blocks of at most BLOCK vectors of one group, each with the ball around it.

    Vectors are sorted by range on the signs of their component's first member, so that blocks hold what lies together.
    """

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                planes = np.random.default_rng([0, 0, int(dim)]).standard_normal((int(dim), BITS))
                yield pd.DataFrame({"head": part["unit"], "code": (unit_rows(part["embedding"]) @ planes > 0) @ (1 << np.arange(BITS, dtype=np.int64))})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        kept: pd.DataFrame | None = None

        def piece(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            number += 1
            x, component = unit_rows(rows["embedding"]), rows["component"]
            mean = x.mean(0)
            size = np.linalg.norm(mean)
            centre = mean / size if size > 1e-9 else x[0]
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            one = [rows["grp"].iloc[0], int(rows["dim"].iloc[0]), number, int(component.min()), int(component.max()), bool(rows["saturated"].any()), component.tolist(), x.tobytes(), centre.tolist(), radius]
            return pd.DataFrame([one], columns=[c.split()[0] for c in PIECE.split(", ")])

        for frame in frames:
            if kept is not None:
                frame = pd.concat([kept, frame], ignore_index=True)
            kept = None
            groups = [g for _, g in frame.groupby(["saturated", "grp", "dim"], sort=False)]
            for n, group in enumerate(groups):
                whole = len(group) if n < len(groups) - 1 else len(group) // BLOCK * BLOCK
                for at in range(0, whole, BLOCK):
                    yield piece(group.iloc[at : min(at + BLOCK, whole)])
                if whole < len(group):
                    kept = group.iloc[whole:]
        if kept is not None and len(kept):
            yield piece(kept)

    heads = placed.filter("unit = component").select("dim", "unit", "embedding").mapInPandas(sign, "head long, code long").dropDuplicates(["head"])
    order = ["saturated", "grp", "dim", "code", "component", "unit"]
    coded = placed.join(heads, F.col("component") == F.col("head")).select(*order, "embedding")
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, PIECE)


def bridges(scratch: Scratch, placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of components of ``placed`` with a link between them of which an end is saturated; all such links are found.

    Every block with a saturated vector meets every other block of its group, but for those that its ball rules out exactly.
    """
    blocks = scratch.table(pieces(placed), "pieces")
    shape = ["grp", "dim", "block", "first", "last", "saturated", "centre", "radius"]
    i, j = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in shape]) for side in "ij")
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("i_centre", "j_centre", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x))))
    several = F.least("i_first", "j_first") < F.greatest("i_last", "j_last")
    # A pair with a saturated end has it in i; where both are, one order is enough.
    once = ~F.col("j_saturated") | (F.col("i_block") <= F.col("j_block"))
    pairs = i.filter("i_saturated").join(j, (F.col("i_grp") == F.col("j_grp")) & (F.col("i_dim") == F.col("j_dim")) & once & several)
    pairs = pairs.filter(between <= F.col("i_radius") + F.col("j_radius") + math.acos(threshold) + 1e-6).select(F.col("i_block").alias("i"), F.col("j_block").alias("j"))
    dealt = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))).join(blocks.select("block", "dim", "components", "vectors"), "block")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ends = [frame.iloc[0], frame.iloc[-1]]
        (a, x), (b, y) = ((np.asarray(e["components"]), np.frombuffer(e["vectors"]).reshape(-1, int(e["dim"]))) for e in ends)
        at, to = np.nonzero((x @ y.T >= threshold) & (a[:, None] != b[None, :]))
        return pd.DataFrame({"a": np.minimum(a[at], b[to]), "b": np.maximum(a[at], b[to])}).drop_duplicates()

    return dealt.groupBy("i", "j").applyInPandas(compare, "a long, b long").distinct()


def enlarged(scratch: Scratch, units: DataFrame, parts: DataFrame, full: DataFrame | None, threshold: float) -> DataFrame:
    """``parts`` (node, component) after all links of the vectors of ``full`` (unit), or of all vectors if it is None."""
    placed = units.join(parts.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    placed = placed.withColumn("saturated", F.lit(True)) if full is None else placed.join(full.withColumn("saturated", F.lit(True)), "unit", "left").fillna(False, ["saturated"])
    placed = scratch.table(placed.select("grp", "dim", "unit", "embedding", "component", "saturated"), "placed")
    joined = components(scratch, scratch.table(bridges(scratch, placed, threshold), "bridges")).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    after = placed.select("unit", "component").join(joined, "component", "left").join(parts.select(F.col("node").alias("unit"), F.lit(True).alias("had")), "unit", "left")
    return scratch.table(after.filter("had OR wider IS NOT NULL").select(F.col("unit").alias("node"), F.coalesce("wider", "component").alias("component")).distinct(), "parts")


def audit(units: DataFrame, found: DataFrame, threshold: float, wanted: int) -> float:
    """The share of all links of about ``wanted`` vectors with others that ``found`` (unit, links) has, by comparing these with every vector.

    A vector's own copies are always found and count on neither side.

    The vectors are drawn by a hash; ``wanted`` bounds what is broadcast, and the work grows with the rows alone.
    """
    spark = units.sparkSession
    every = max(1, units.count() // wanted)
    asked = units.filter(F.pmod(F.xxhash64(F.lit("audit"), "unit"), F.lit(every)) == 0).select("unit", "grp", "dim", "embedding")
    rows = asked.limit(4 * wanted).collect()
    if not rows:
        return 1.0
    by_group: dict[tuple, tuple] = {}
    for r in rows:
        by_group.setdefault((r["grp"], r["dim"]), []).append((r["unit"], r["embedding"]))
    shared = spark.sparkContext.broadcast({g: (np.array([u for u, _ in v]), unit_rows([e for _, e in v])) for g, v in by_group.items()})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, part in frame.groupby(["grp", "dim"]):
                if group in shared.value:
                    ids, x = shared.value[group]
                    linked = x @ unit_rows(part["embedding"]).T >= threshold
                    linked &= ids[:, None] != part["unit"].to_numpy()[None, :]
                    yield pd.DataFrame({"unit": ids, "links": linked @ part["copies"].to_numpy()})

    truth = units.select("unit", "grp", "dim", "embedding", "copies").mapInPandas(compare, "unit long, links long").groupBy("unit").agg(F.sum("links").alias("truth"))
    others = found.join(units.select("unit", "copies"), "unit").select("unit", (F.col("links") - F.col("copies") + 1).alias("links"))
    both = truth.filter("truth > 0").join(others, "unit", "left").agg(F.sum("truth").alias("t"), F.sum(F.least("truth", F.coalesce("links", F.lit(0)))).alias("f")).first()
    return 1.0 if not both["t"] else both["f"] / both["t"]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, max_passes: int = 4) -> DataFrame:
    """Each row's ``vec_id`` with ``n_links``, ``component_id``, ``kept`` and ``audited_recall``.

    Vectors are compared within equal labels (and lengths).  Equal vectors are one unit.  Random orders begin a graph of neighbours, joins of
    neighbours of neighbours refine it until it hardly changes, and links at or over ``threshold`` make components.  A vector whose list is full of links may have more:
    these vectors are compared with all of their label that their balls do not rule out.  Components are then compared in full.  If an
    audit finds less than ``recall`` of the links of sampled vectors, more orders are added, up to ``max_passes`` times; after these, all vectors
    are compared in this way.

    A row whose label or vector is null, or whose vector is zero, empty or holds a null, NaN or infinity, has no links and is its own component.
    A null vec_id is named by its values, with a negative number; rows that share a vec_id are one vector, and each of their copies counts as a
    link of the others where their vectors are equal.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(embedding_type(vectors)).alias("embedding"), F.col("label").cast("string").alias("grp"))
    rows = rows.withColumn("key", F.coalesce("vec_id", F.xxhash64("embedding", "grp").bitwiseOR(F.lit(-(2**63)))))
    good = rows.filter(usable(F.col("embedding"), F.col("grp")))
    units = good.groupBy("grp", "embedding").agg(F.min("key").alias("unit"), F.count(F.lit(1)).alias("copies"))
    units = scratch.table(units.withColumn("dim", F.size("embedding")), "units")

    def audited() -> tuple[DataFrame, float]:
        members = units.join(parts.withColumnRenamed("node", "unit"), "unit")
        found = scratch.table(counted(members, threshold), "links")
        return found, audit(units, found, threshold, AUDITED)

    graph = None
    for turn in range(max_passes):
        edges = ordered_neighbours(units, ORDERS, turn, NEIGHBOURS, FLOOR)
        graph = scratch.table(nearest(edges if graph is None else edges.unionByName(graph), NEIGHBOURS), "graph")
        for _ in range(REFINEMENTS):
            before, graph = graph, scratch.table(nearest(graph.unionByName(refined(graph, units, NEIGHBOURS, FLOOR)), NEIGHBOURS), "graph")
            if graph.join(before, ["v", "u"], "left_anti").count() <= SETTLED * graph.count():
                break
        links = graph.filter(F.col("cosine") >= threshold).select(F.col("v").alias("a"), F.col("u").alias("b"))
        parts = scratch.table(components(scratch, links), "parts")
        full = scratch.table(links.groupBy("a").count().filter(F.col("count") >= NEIGHBOURS).select(F.col("a").alias("unit")), "full")
        if full.limit(1).count():
            parts = enlarged(scratch, units, parts, full, threshold)
        found, found_recall = audited()
        if found_recall >= recall:
            break
    else:
        parts = enlarged(scratch, units, parts, None, threshold)
        found, found_recall = audited()
    named = (
        units.select("grp", "embedding", "unit", "copies")
        .join(parts.withColumnRenamed("node", "unit"), "unit", "left")
        .join(found, "unit", "left")
        .select("grp", "embedding", F.coalesce("component", "unit").alias("component"), (F.coalesce("links", F.lit(0)) + F.when(F.col("links").isNull(), F.col("copies") - 1).otherwise(0)).alias("links"))
    )
    linked = good.select("vec_id", "key", "grp", "embedding").join(named, ["grp", "embedding"]).select("vec_id", "key", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter(~usable(F.col("embedding"), F.col("grp"))).select("vec_id", "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"), F.lit(float(found_recall)).alias("audited_recall"))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
