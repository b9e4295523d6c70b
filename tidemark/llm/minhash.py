"""Near-duplicate documents by DartMinHash signatures and a banded join with exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import blocks
from tidemark.llm.components import components
from tidemark.llm.names import unused
from tidemark.llm.skew import join_hot
from tidemark.llm.textvec import mix, multiset, shingles
from tidemark.scratch import Scratch

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair misses all of 24 bands of 5 with probability (1 - 0.8**5)**24 = 7e-5.
BANDS, ROWS = 24, 5
#: Texts compared with one pivot in one group.
TOGETHER = 128
#: Members of a crowded bucket that one task holds against its pivots.
DEALT = 1024
#: Pivots of a bucket in the rounds before it compares all that are outside its largest component.
PIVOTS = (8, 64)
# Poisson(1): a cell's uniform hash is compared with these to get its number of darts.
_CDF = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(17)])


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Darts that hit the elements' regions at ranks in [low, high): their document, coordinate, rank and name.

    Weight is divided into strips [0, 1), [1, 2), [2, 4), [4, 8) ... and each strip, along rank, into cells of area one.  A
    cell's darts (Poisson with mean one, placed uniformly) follow from a hash of (element, strip, cell), so all
    documents see the same darts.  A dart hits if it lies under the element's weight.
    """
    strips = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    e = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(e)) - np.repeat(np.cumsum(strips) - strips, strips)
    floor = np.where(strip > 0, 2.0 ** (strip - 1), 0.0)
    width = np.where(strip > 0, floor, 1.0)
    first = np.floor(low[e] * width).astype(np.int64)
    cells = np.ceil(high[e] * width).astype(np.int64) - first
    s = np.repeat(np.arange(len(e)), cells)
    cell = np.arange(len(s)) - np.repeat(np.cumsum(cells) - cells, cells) + first[s]
    name = mix(element[e[s]] + mix(strip[s].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cell.astype(np.uint64)))
    count = np.searchsorted(_CDF, unit(name))
    c = np.repeat(np.arange(len(s)), count)
    nth = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
    name = mix(name[c] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    s = s[c]
    rank = (cell[c] + unit(mix(name ^ np.uint64(0xA0761D6478BD642F)))) / width[s]
    e, height = e[s], floor[s] + unit(mix(name ^ np.uint64(0xE7037ED1A0B428DB))) * width[s]
    hit = (height < weight[e]) & (rank >= low[e]) & (rank < high[e])
    name, rank = name[hit], rank[hit]
    return doc[e[hit]], (mix(name ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(k)).astype(np.int64), rank, name


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """A row of ``k`` coordinates for each weighted set: in each coordinate the name of its earliest dart.

    Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.  k ln k + 2k darts are
    expected below the first rank bound, which leaves few coordinates empty; sets with empty ones raise their bound.  An empty set has zeros.
    """
    out = np.zeros((len(elements), k), np.uint64)
    sizes = np.array([len(x) for x in elements])
    totals = np.array([x.sum() for x in weights])
    low, high = np.zeros(len(elements)), (k * math.log(k) + 2 * k) / np.maximum(totals, 1e-300)
    todo = np.flatnonzero(sizes)
    while len(todo):
        doc = np.repeat(todo, sizes[todo])
        d, j, rank, name = darts(np.concatenate([elements[i] for i in todo]), np.concatenate([weights[i] for i in todo]).astype(np.float64), doc, low[doc], high[doc], k)
        order = np.lexsort((rank, d * k + j))
        at, first = np.unique((d * k + j)[order], return_index=True)
        flat = out.reshape(-1)
        empty = flat[at] == 0
        flat[at[empty]] = name[order[first[empty]]]
        todo = todo[(out[todo] == 0).any(1)]
        low[todo], high[todo] = high[todo], 2 * high[todo]
    return out


def parity(elements: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits an element: each bit is the parity of how many elements fall on it.

    The bits in which two bitmaps differ are at most as many as the elements that only one of the two sets has.  A bitmap is folded to half its length by an exclusive or of its halves.
    """
    bits = max(64, 1 << (2 * len(elements) - 1).bit_length()) if len(elements) else 64
    odd = np.bincount((mix(elements ^ np.uint64(0x94D049BB133111EB)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(a: Column, b: Column) -> Column:
    """A lower bound on the elements that only one of two sets has, from their bitmaps, whose lengths differ by a factor of two at most."""
    short = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) > short, F.zip_with(F.slice(x, 1, short), F.slice(x, short + 1, short), lambda u, v: u.bitwiseXOR(v))).otherwise(x)
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, x: n + x)


SKETCH = "doc_id long, key long, hash long, d1 long, d2 long, size long, parity array<long>, bands array<long>"


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """SKETCH of each document: 128 bits that name its weighted shingle set, the set's weight, a bitmap, and band values.

    A shingle weighs as many times as the text has it.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in blocks(batch, "text", 1 << 18):
                found = shingles(texts, SHINGLE)
                counted = [np.unique(x, return_counts=True) for x in found]
                sets = [multiset(x) for x in found]
                signed = signatures([x for x, _ in counted], [n for _, n in counted], bands * rows)
                value = np.zeros((len(texts), bands), np.uint64)
                for r in range(rows):
                    value = mix(value + signed[:, r::rows][:, :bands])
                name = np.array([[mix(x).sum(), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum()] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                maps = [parity(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(part.schema.get_field_index(c)) for c in ("doc_id", "key", "hash")],
                        pa.array(name[:, 0]),
                        pa.array(name[:, 1]),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(m) for m in maps])]), pa.int32()), pa.array(np.concatenate(maps))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(value.view(np.int64).reshape(-1))),
                    ],
                    names=[c.split()[0] for c in SKETCH.split(", ")],
                )

    return docs.select("doc_id", "key", "hash", "text").mapInArrow(run, SKETCH)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, hash, text); ``hash`` is the text's, ``key`` is doc_id, and a row without one is named by its text, with a negative number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), key_of(docs).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))


def key_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).bitwiseOR(F.lit(-(2**63))))


def compare(frame: pd.DataFrame, threshold: float) -> Iterator[tuple[int, int, float]]:
    """Links of one group, whose pivotal row is compared with the others."""
    frame = frame.sort_values("pivotal", ascending=False, kind="stable")
    sets = [multiset(x) for x in shingles(frame["text"].tolist(), SHINGLE)]
    units = frame["unit"].tolist()
    base = sets[0]
    for unit, other in zip(units[1:], sets[1:], strict=True):
        both = len(np.intersect1d(base, other, assume_unique=True))
        similarity = both / max(1, len(base) + len(other) - both)
        if similarity >= threshold:
            yield units[0], unit, similarity


def checked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (pivot, unit) whose weighted shingle sets have a Jaccard similarity of ``threshold`` or more.

    A pivot's partners are dealt into groups of about ``TOGETHER``; a group holds their texts and the pivot's, so
    that a pivot with very many partners is compared in many tasks and its text is sent once a group.
    """
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")))
    asked = dealt.select("unit", "pivot", "part", F.lit(False).alias("pivotal")).unionByName(
        dealt.select(F.col("pivot").alias("unit"), "pivot", "part", F.lit(True).alias("pivotal")).distinct()
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(compare(frame, threshold)), columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return asked.join(texts, "unit").groupBy("pivot", "part").applyInPandas(run, "a long, b long, similarity double")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each row's ``doc_id`` and ``key`` with ``hash``, ``class_id``, ``class_size`` and ``kept``, and one link of it: ``link_id`` and ``similarity``.

    Rows with one weighted shingle set are a unit.  Units that share a band value meet in a bucket.  A bucket's pivot is the member that meets most others over all
    its buckets.  At first every unit is compared with one pivot, that of most of its buckets, which joins large groups at the cost of one comparison a unit.  Then
    buckets whose members are in several components compare all members with ``PIVOTS`` pivots each, as far as they are in other components; and at last with all members outside the
    bucket's largest component, after which no pair of a bucket is left that is neither compared nor in one component.  A pair whose bitmaps differ in more
    bits than two sets as alike as the threshold can differ in elements does not leave the join: an exact bound, so what is compared by text is nearly all links.

    Links are checked exactly, classes are their connected components and ``class_id`` is the smallest key in one.  A null text is empty; texts without words
    are one unit; a text of fewer than five words has one shingle, the text.  A null doc_id is named by its text.  Rows that repeat a doc_id with another text are
    documents of their own.  Of a class, ``kept`` is true for the row with the smallest key, then the smallest ``hash``; rows that repeat both are one document and
    stay or go together.  ``link_id`` is the key of a document near this one: of an equal shingle set if there is another (1.0), else of the most similar one it was compared with,
    else null.  An empty table gives an empty table; other columns are not used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = keyed(docs)
    sketches = scratch.table(sketch(rows), "sketch")
    first = [F.first(c).alias(c) for c in ("size", "parity", "bands")]
    # Written once, so the numbers stay.
    units = scratch.table(sketches.groupBy("d1", "d2").agg(*first, F.min(F.struct("key", "hash")).alias("of"), F.max(F.struct("key", "hash")).alias("last")).withColumn("unit", F.monotonically_increasing_id()), "units")
    banded = scratch.table(units.filter("size > 0").select("unit", "size", F.posexplode("bands").alias("band", "value")), "banded")
    crowded = scratch.table(banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")
    total = banded.count()
    members = scratch.table(join_hot(banded, crowded, ["band", "value"], total), "several")
    meets = members.groupBy("unit").agg(F.sum("n").alias("meets"))
    # A crowded bucket is dealt over several tasks, to each of which its pivots are sent.
    members = members.join(meets, "unit").withColumns({"parts": F.ceil(F.col("n") / DEALT).cast("int"), "part": F.pmod(F.xxhash64("unit"), F.ceil(F.col("n") / DEALT)).cast("int")}).drop("n")
    members = scratch.table(members, "members")
    texts = rows.select(F.struct("key", "hash").alias("of"), "text").join(units.select("unit", "of").join(meets.select("unit"), "unit"), "of").dropDuplicates(["of"])
    texts = scratch.table(texts.select("unit", "text"), "texts")
    wide = (1 - threshold) / (1 + threshold) * (1 + 1e-9)
    tested = classes = links = None
    for turn, pivots_each in enumerate([1, *PIVOTS, None]):
        grouped = members.withColumn("component", F.col("unit")) if classes is None else members.join(classes, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
        several = grouped.groupBy("band", "value").agg(F.min("component").alias("__a"), F.max("component").alias("__b"), F.count(F.lit(1)).alias("__n")).filter("__a <> __b").drop("__a", "__b")
        several = scratch.table(several, "buckets")
        grouped = scratch.table(join_hot(grouped, several, ["band", "value"], total, "__n").drop("__n"), "open")
        if grouped.isEmpty():
            break
        told = ["size", "component"] + ["parity"] * (turn > 0)
        if pivots_each:
            best = F.max(F.struct("meets", (-F.col("unit")).alias("back"), *told, "parts")).alias("p")
            pivots = grouped.groupBy("band", "value", F.pmod(F.xxhash64("unit"), F.lit(pivots_each)).alias("salt")).agg(best).select("band", "value", (-F.col("p.back")).alias("unit"), "p.*")
        else:
            counts = grouped.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("n"))
            largest = counts.groupBy("band", "value").agg(F.max(F.struct("n", "component")).alias("l"), F.sum("n").alias("__n")).select("band", "value", F.col("l.component").alias("most"), "__n")
            pivots = join_hot(grouped, scratch.table(largest, "largest"), ["band", "value"], total, "__n").filter("component <> most")
        pivots = pivots.select(F.col("band").alias("p_band"), F.col("value").alias("p_value"), F.col("unit").alias("pivot"), *[F.col(c).alias(f"p_{c}") for c in ["meets", *told, "parts"]])
        pivots = scratch.table(pivots, "pivots")
        # Sets as alike as the threshold have sizes as alike.
        reachable = (F.col("component") != F.col("p_component")) & (F.least("size", "p_size") >= F.lit(threshold * (1 - 1e-9)) * F.greatest("size", "p_size"))
        if turn:
            reachable &= apart(F.col("parity"), F.col("p_parity")) <= F.lit(wide) * (F.col("size") + F.col("p_size"))
        sent = pivots.withColumn("p_part", F.explode(F.sequence(F.lit(0), F.col("p_parts") - 1)))
        met = grouped.join(sent, (F.col("band") == F.col("p_band")) & (F.col("value") == F.col("p_value")) & (F.col("part") == F.col("p_part")) & reachable)
        members = grouped.drop("component")
        if turn:
            pairs = met.select("pivot", "unit")
        else:
            shared = met.groupBy("unit", "pivot").agg(F.count(F.lit(1)).alias("bands"), F.max("p_meets").alias("p_meets"))
            pairs = shared.groupBy("unit").agg(F.max(F.struct("bands", "p_meets", "pivot")).alias("b")).select(F.col("b.pivot").alias("pivot"), "unit")
            members = members.join(units.select("unit", "parity"), "unit")
        pairs = pairs.withColumns({"low": F.least("pivot", "unit"), "high": F.greatest("pivot", "unit")}).dropDuplicates(["low", "high"])
        if tested is not None:
            pairs = pairs.join(tested, ["low", "high"], "left_anti")
        pairs = scratch.table(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = scratch.table(checked(pairs.select("pivot", "unit"), texts, threshold), "links")
        links = found if links is None else links.unionByName(found)
        found = found.select("a", "b")
        now = pairs.select("low", "high")
        tested = now if tested is None else tested.unionByName(now)
        joined = found if classes is None else found.unionByName(classes.select(F.col("unit").alias("a"), F.col("component").alias("b")))
        classes = components(scratch, joined).withColumnRenamed("node", "unit")
    named = units.select("d1", "d2", "unit", F.col("of").alias("first"), "last")
    named = named.withColumn("component", F.col("unit")) if classes is None else named.join(classes, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    named = named.join(closest(links, units), "unit", "left") if links is not None else named.withColumns({"other": F.lit(None).cast("long"), "similarity": F.lit(None).cast("double")})
    placed = scratch.table(sketches.select("doc_id", "key", "hash", "d1", "d2").join(named.drop("unit"), ["d1", "d2"]).drop("d1", "d2"), "placed")
    whole = placed.groupBy("component").agg(F.min(F.struct("key", "hash")).alias("of"), F.count(F.lit(1)).alias("class_size"))
    same = lambda of: (F.col("key") == F.col(f"{of}.key")) & (F.col("hash") == F.col(f"{of}.hash"))
    alone = F.col("first") == F.col("last")
    link = [F.when(~same("first"), F.col("first.key")).when(alone, F.col("other")).otherwise(F.col("last.key")).alias("link_id")]
    link += [F.when(same("first") & alone, F.col("similarity")).otherwise(1.0).alias("similarity")]
    return placed.join(whole, "component").select("doc_id", "key", "hash", F.col("of.key").alias("class_id"), "class_size", same("of").alias("kept"), *link)


def closest(links: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, other, similarity): of each unit's links that were found, the most similar, named by its first document."""
    both = links.select(F.col("a").alias("unit"), F.col("b").alias("to"), "similarity").unionByName(links.select(F.col("b").alias("unit"), F.col("a").alias("to"), "similarity"))
    best = both.groupBy("unit").agg(F.max(F.struct("similarity", (-F.col("to")).alias("back"))).alias("b")).select("unit", (-F.col("b.back")).alias("to"), "b.similarity")
    names = units.select(F.col("unit").alias("to"), F.col("of.key").alias("other"))
    return best.join(names, "to").select("unit", "other", "similarity")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents that represent their near-duplicate class, with the columns they came with; see :func:`near_groups`."""
    key, hashed = unused(["key", "hash"], docs.columns)
    kept = near_groups(docs).filter("kept").select(F.col("key").alias(key), F.col("hash").alias(hashed)).distinct()
    named = docs.withColumns({key: key_of(docs), hashed: F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
    return named.join(kept, [key, hashed], "left_semi").select(*docs.columns)


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).drop("key", "hash")
