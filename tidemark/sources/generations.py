"""Partitioned tables that are swapped from one whole version to the next.

``data/generation=g/key=value/...``  the rows of one write, never changed afterwards
``data/generation=g/packed_bucket=b/...``  the same of a packed write: keys are columns, and a bucket of the first key holds many partitions, so that files follow the rows and not the partitions
``schemas/v=n.json``                 the columns of version n
``live/v=n``                         the partitions of version n: (folder, generation, rows) and the keys as text; complete, it makes the version.  Packed partitions of a bucket share its folder

A write stages its rows in a generation of its own and then publishes a new list of live partitions, which takes over the partitions that were not touched as references.  A
reader has a version as a whole, old or new, whenever a write is killed.  Neither lists nor changes what it does not touch; :func:`expire` deletes what no kept version refers to.

Tables with few partitions (days, buckets) keep a folder for each, those whose partitions grow with the data (chunks or days of every model) are packed; a table may hold both kinds.

One writer a table is assumed.  An empty text in a key is read back as null where it names a folder, as of any partitioned table.  A reader's driver holds the folders that it asks for, as it does for any partitioned table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.ledger_store import delete_folder, names, path_exists, read_text, versions, write_text

#: How a null is written in a folder's name.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
SYSTEM = "folder string, generation string, rows long"
PACKED = "packed_bucket"
#: Buckets of a packed write, and so the most folders that it makes.
BUCKETS = 64
#: Up to this many asked partitions are sent to every executor that reads packed rows; more are joined by shuffle.
BROADCAST_PARTITIONS = 100_000


@dataclass(frozen=True)
class Staged:
    """A generation that no version refers to yet."""

    path: str
    generation: str
    schema: T.StructType
    keys: tuple[str, ...]
    packed: bool = False


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, oldest first."""
    return versions(spark, f"{path}/live")


_SHARED = f"/{PACKED}="


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _key_text(key: str) -> Column:
    raw = F.regexp_extract("folder", rf"/{key}=([^/]*)", 1)
    return F.when(raw != NULL_FOLDER, _decoded(raw))


def live(spark: SparkSession, path: str, keys: list[str], version: int | None = None) -> DataFrame:
    """(folder, generation, rows, *keys as text) of a version, by default the newest; no rows if there is none."""
    found = numbers(spark, path)
    if version is not None and version not in found:
        raise ValueError(f"no version {version} in {path}")
    if not found:
        return spark.createDataFrame([], SYSTEM + "".join(f", `{k}` string" for k in keys))
    return spark.read.parquet(f"{path}/live/v={found[-1] if version is None else version}")


def stage(df: DataFrame, path: str, keys: list[str], packed: bool = False) -> Staged:
    """Writes ``df`` by ``keys`` as a new generation; readers see nothing of it.  A partition of any size is written by several tasks.

    ``packed`` is for keys with many values: rows are sorted by them in the files of a bucket, in place of a folder for each.
    """
    known = numbers(df.sparkSession, path)
    staged = Staged(path, f"{known[-1] + 1 if known else 0:08d}-{uuid.uuid4().hex[:8]}", df.schema, tuple(keys), packed)
    at = f"{path}/data/generation={staged.generation}"
    if packed:
        laid = df.withColumn(PACKED, F.pmod(F.xxhash64(F.col(keys[0]).cast("string")), F.lit(BUCKETS)).cast("int"))
        laid.hint("rebalance", PACKED).sortWithinPartitions(PACKED, *keys).write.partitionBy(PACKED).parquet(at)
    else:
        df.hint("rebalance", *keys).write.partitionBy(*keys).parquet(at)
    return staged


def _with(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in more.items()]])


def staged_partitions(spark: SparkSession, staged: Staged) -> DataFrame:
    """(folder, generation, rows, *keys as text) of a staged generation, from its own files' footers; of packed ones from their key columns."""
    at = f"{staged.path}/data/generation={staged.generation}"
    if staged.packed:
        keys = [F.col(k).cast("string").alias(k) for k in staged.keys]
        counts = spark.read.schema(_with(staged.schema, **{PACKED: T.IntegerType()})).parquet(at).groupBy(PACKED, *keys).agg(F.count(F.lit(1)).alias("rows"))
        return counts.select(F.concat(F.lit(f"generation={staged.generation}/{PACKED}="), F.col(PACKED).cast("string")).alias("folder"), F.lit(staged.generation).alias("generation"), "rows", *staged.keys)
    # Spark gives a file's path as a URI, in which the signs of folder names are escaped once more.
    folder = F.regexp_extract(_decoded(F.col("_metadata.file_path")), f"(generation={staged.generation}/.*)/[^/]*$", 1)
    counts = spark.read.schema(staged.schema).parquet(at).select(folder.alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("folder", F.lit(staged.generation).alias("generation"), "rows", *[_key_text(k).alias(k) for k in staged.keys])


def _same(keys: list[str]) -> Column:
    """Equal keys as text, nulls included, the others' being called ``__key``."""
    return reduce(lambda a, b: a & b, [F.col(k).cast("string").eqNullSafe(F.col(f"__{k}")) for k in keys])


def publish(spark: SparkSession, staged: Staged, touched: Callable[[DataFrame], DataFrame] | None = None, notes: dict[str, DataFrame] | None = None) -> int:
    """Makes a staged generation part of the table: its partitions take the place of those with the same keys, and the new version's number comes back.

    ``touched`` picks, from the live partitions, the keys of those that this load covers: where it brings no rows for them they are gone.  ``notes`` are tables kept with the version
    (see :func:`note`), as whole or unseen as the version itself.
    """
    found = numbers(spark, staged.path)
    number = found[-1] + 1 if found else 0
    keys = list(staged.keys)
    columns = ["folder", "generation", "rows", *keys]
    old = live(spark, staged.path, keys).select(*columns)
    if touched is not None and found:
        gone = touched(old).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        old = old.join(gone, _same(keys), "left_anti")
    # Of partitions with the same keys the newest generation's stays; a null key is a key.
    both = old.unionByName(staged_partitions(spark, staged)).groupBy(*keys).agg(F.max_by(F.struct("folder", "generation", "rows"), "generation").alias("p"))
    for name, table in (notes or {}).items():
        table.write.mode("overwrite").parquet(f"{staged.path}/notes/{name}/v={number}")
    write_text(spark, f"{staged.path}/schemas/v={number}.json", staged.schema.json())
    both.select("p.*", *keys).write.mode("overwrite").parquet(f"{staged.path}/live/v={number}")
    return number


def replace_partitions(df: DataFrame, path: str, keys: list[str], touched: Callable[[DataFrame], DataFrame] | None = None, notes: dict[str, DataFrame] | None = None, packed: bool = False) -> int:
    """Stages and publishes ``df``: its partitions, and those ``touched``, are replaced; the others stay.  For ``packed`` see :func:`stage`."""
    return publish(df.sparkSession, stage(df, path, keys, packed), touched, notes)


def _within(held: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` from the least to the greatest value of every key that is asked for, as literals that reach the scan."""
    typed = [F.col(k).cast(held.schema[k].dataType) for k in keys]
    found = asked.agg(*[f(c) for c in typed for f in (lambda c: F.min(c).cast("string"), lambda c: F.max(c).cast("string"), lambda c: F.max(c.isNull()))]).first()
    for i, k in enumerate(keys):
        low, high, nulls = found[3 * i : 3 * i + 3]
        kind = held.schema[k].dataType
        inside = F.lit(False) if low is None else F.col(k).between(F.lit(low).cast(kind), F.lit(high).cast(kind))
        held = held.filter(inside | F.col(k).isNull() if nulls else inside)
    return held


def read_partitions(spark: SparkSession, path: str, where: Column | str | None = None, version: int | None = None, schema: T.StructType | None = None, among: DataFrame | None = None) -> DataFrame:
    """The rows of a version, by default the newest, in the partitions whose keys (as text) meet ``where``, or are ``among`` given ones; only their folders are listed and read.

    Of packed folders the rows of other partitions, and of those that a later generation has replaced, are left out by a join with the asked ones; where not all are asked for, the
    bounds of their keys reach the scan, and the files are sorted by them.

    Without any version there are no rows, of ``schema``.
    """
    found = numbers(spark, path)
    if not found and version is None and schema is not None:
        return spark.createDataFrame([], schema)
    rows = live(spark, path, [], version)
    kind = T.StructType.fromJson(json.loads(read_text(spark, f"{path}/schemas/v={found[-1] if version is None else version}.json")))
    if where is not None:
        rows = rows.filter(where)
    if among is not None:
        asked = among.select(*[F.col(k).cast("string").alias(k) for k in among.columns])
        rows = rows.alias("r").join(asked.alias("a"), [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in among.columns], "left_semi")
    folders = [r["folder"] for r in rows.select("folder").distinct().toLocalIterator()]
    read = lambda schema, some: spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in some])
    shared = [f for f in folders if _SHARED in f]
    own = [f for f in folders if _SHARED not in f]
    parts = [read(kind, own).select(*kind.names)] if own else []
    if shared:
        keys = [c for c in rows.columns if c not in ("folder", "generation", "rows")]
        asked = rows.filter(F.contains("folder", F.lit(_SHARED)))
        held = read(_with(kind, generation=T.StringType(), **{PACKED: T.IntegerType()}), shared)
        if where is not None or among is not None:
            held = _within(held, asked, keys)
        few = asked.limit(BROADCAST_PARTITIONS + 1).count() <= BROADCAST_PARTITIONS
        asked = asked.select(*[F.col(k).alias(f"__{k}") for k in ("generation", *keys)]).hint("broadcast" if few else "merge")
        parts.append(held.join(asked, _same(["generation", *keys]), "left_semi").select(*kind.names))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)


def note(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table that was kept with a version."""
    found = numbers(spark, path)
    at = f"{path}/notes/{name}/v={found[-1] if version is None and found else version}"
    return spark.read.parquet(at) if path_exists(spark, at) else None


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Forgets all but the newest ``keep`` versions and deletes the generations that none of those refers to; returns these generations.

    Versions go before the data they alone refer to, so that no reader finds a version without its data.  A generation staged for a version yet to come is left alone; one that
    was never published goes when a later version is there.
    """
    found = numbers(spark, path)
    kept = found[-max(keep, 1) :]
    if not kept:
        return []
    for number in found[: -len(kept)]:
        delete_folder(spark, f"{path}/live/v={number}")
        delete_folder(spark, f"{path}/schemas/v={number}.json")
        for name in names(spark, f"{path}/notes"):
            delete_folder(spark, f"{path}/notes/{name}/v={number}")
    # A row a generation: no more than there have been writes.
    used = {r["generation"] for number in kept for r in live(spark, path, [], number).select("generation").distinct().collect()}
    written = [name.removeprefix("generation=") for name in names(spark, f"{path}/data") if name.startswith("generation=")]
    gone = sorted(g for g in written if g not in used and int(g.split("-")[0]) <= kept[-1])
    for generation in gone:
        delete_folder(spark, f"{path}/data/generation={generation}")
    return gone

