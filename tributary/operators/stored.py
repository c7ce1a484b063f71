"""A stored graph of many projects, of which only new and changed ones are built again.

Below the store's folder, ``rows`` holds a folder for each project and build, and ``keys/<n>`` the keys
(mode, reason, model count, fingerprint) of all projects after the n-th refresh. A build is named by
its key, so rows of a changed project are written beside the old ones and count once the new keys
are complete. A refresh that fails half-way changes nothing that readers see; the next one writes
the same folders again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators import fingerprint
from tributary.scratch import Scratch

_KEYS = T.StructType(
    [T.StructField(n, T.LongType() if n == "model_count" else T.StringType()) for n in ("project_id", "mode", "reason", "model_count", "fingerprint")]
)


class StoredGraph:
    """``schema`` is that of the rows a build gives; it has ``project_id string``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = schema.fieldNames()
        own = [f for f in schema.fields if f.name != "project_id"]
        self.schema = T.StructType([*own, T.StructField("project_id", T.StringType()), T.StructField("build_id", T.StringType())])

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _version(self) -> int:
        """Number of the last complete refresh, 0 before the first."""
        files, keys = self._files(), self._at("keys")
        if not files.exists(keys):
            return 0
        names = [int(status.getPath().getName()) for status in files.listStatus(keys)]
        return max((n for n in names if files.exists(self._at(f"keys/{n}/_SUCCESS"))), default=0)

    def keys(self) -> DataFrame:
        """The projects of the last refresh: ``project_id, mode, reason, model_count, fingerprint``."""
        version = self._version()
        return self.spark.read.schema(_KEYS).parquet(f"{self.path}/keys/{version}") if version else self.spark.createDataFrame([], _KEYS)

    @staticmethod
    def _named(keys: DataFrame) -> DataFrame:
        parts = [F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256) for c in _KEYS.fieldNames()[1:]]
        return keys.select("project_id", F.sha2(F.concat(*parts), 256).alias("build_id"))

    def refresh(self, current: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Bring the store to ``current`` keys; returns ``project_id, change`` as it was found.

        ``build`` takes a table ``project_id`` and gives the rows of those projects. It gets new and changed
        projects only; when there are none it is not called. A project may have no rows.
        """
        scratch = Scratch(self.spark, "refresh")
        current = scratch.save(current.select(*_KEYS.fieldNames()), "current")
        changes = scratch.save(fingerprint.changed_projects(self.keys(), current), "changes")
        todo = changes.where("change IN ('new', 'changed')").select("project_id")
        version = self._version() + 1
        if not todo.isEmpty():
            rows = build(todo).join(self._named(current), "project_id").select(*self.schema.fieldNames())
            # rebalanced partitions are split where one project owns many rows and joined where they are small
            out = rows.hint("rebalance", "project_id").write.partitionBy("project_id", "build_id")
            out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")
        current.write.mode("overwrite").parquet(f"{self.path}/keys/{version}")
        return changes

    def rows(self) -> DataFrame:
        """Rows of all projects of the last refresh."""
        if not self._files().exists(self._at("rows")):
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return stored.join(self._named(self.keys()), ["project_id", "build_id"], "left_semi").select(*self.columns)

    def clean(self) -> int:
        """Delete builds and keys that no longer count; returns how many builds went. Not while others read or refresh.

        Outdated builds come to the driver one at a time.
        """
        files, version, gone = self._files(), self._version(), 0
        if files.exists(self._at("rows")):
            paths = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select(
                "project_id", "build_id", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
            )
            old = paths.join(self._named(self.keys()), ["project_id", "build_id"], "left_anti").select("folder").distinct()
            for row in old.toLocalIterator():
                uri = self.spark._jvm.java.net.URI(row.folder)
                gone += bool(files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(uri), True))
        for status in files.listStatus(self._at("keys")) if version else ():
            if int(status.getPath().getName()) < version:
                files.delete(status.getPath(), True)
        return gone
