"""Written tables that cut the lineage of iterative jobs.

Every round of a graph loop is written as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and read back. A lost executor then costs one round, the plan stays
small, and the next round is planned with the real size of its inputs, so a side is only
broadcast when its files are under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as configured on the session."""
    configured = spark.conf.get(_DIR_KEY, None)
    if not configured:
        raise RuntimeError(f"set {_DIR_KEY} to a folder every executor can reach")
    return configured.rstrip("/")


class Grown:
    """A stored table in buckets of its keys, with as many buckets as a shuffle has partitions.

    Spark takes the buckets from the catalog, so the table has an entry there until :meth:`forget`; the
    files belong to the run's folder and outlive the entry, as do plans that were made from it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.name = f"tributary_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, df: DataFrame) -> None:
        """Append rows; rows that are not yet spread by the keys are, so that a task writes one bucket."""
        spread = df.repartition(self.buckets, *self.keys)
        spread.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.buckets, *self.keys).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        """All rows added so far."""
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Drop the catalog's entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Scratch:
    """One run's private folder of intermediate tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/tributary/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and return the stored table."""
        target = f"{self.path}/{name}"
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def save_by(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """As :meth:`save`, in buckets of ``keys``: joins and groupings on them read it without a shuffle."""
        grown = self.grown(name, *keys)
        grown.add(df)
        stored = grown.rows()
        grown.forget()
        return stored

    def grown(self, name: str, *keys: str) -> Grown:
        """A table in buckets of ``keys`` to which rounds add rows."""
        return Grown(self.spark, f"{self.path}/{name}", keys)

    def load(self, name: str, schema) -> DataFrame:
        """Read a folder of ``key=value`` tables written by :meth:`save`."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that a later round has replaced."""
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Delete the run's folder; only after its results have been written elsewhere."""
        self._delete(self.path)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        conf = self.spark._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
