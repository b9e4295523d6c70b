"""Tables written between the steps of one job, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, local mode gets a temporary folder (one machine, so it is shared) and a
    cluster gets a folder under the SQL warehouse, which is shared by definition.  The choice is
    stored in the session so that every operator agrees on it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Cuts lineage by writing parquet under the shared folder: survives lost executors, unlike cached blocks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{name}-{self._n}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return a frame that reads it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table of this job that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
