"""SQL files and project folders as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import paths

# The file that marks a project root and folders never searched.
PROJECT_FILE = "dbt_project.yml"
SKIPPED_FOLDERS = ("target", "dbt_packages", "logs", "__pycache__", "node_modules")


def relative_to(spark: SparkSession, root: str, path: Column | str) -> Column:
    """A file's path below ``root``, whatever scheme and authority it was listed with."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    return F.when(F.startswith(plain, F.lit(base)), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)


def read_sql_files(spark: SparkSession, root: str, project_id: str | None = None) -> DataFrame:
    """All ``*.sql`` below ``root``: ``project_id, relative_path, raw_sql``.

    Spark's file sources pass over files of zero bytes and names that begin with ``_`` or ``.``, so
    such files are no models here; where they matter, hand a lister's table to :func:`assign_projects`.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", "*.sql").load(root)
    return files.select(
        F.lit(project_id or root).alias("project_id"),
        relative_to(spark, root, "path").alias("relative_path"),
        F.col("content").cast("string").alias("raw_sql"),
    )


def sql_models(files: DataFrame, roots: Sequence[str] | None = ("models",)) -> DataFrame:
    """The ``models`` table of projects without a manifest, from ``project_id, relative_path, raw_sql``.

    ``roots`` are the model folders; None takes all files.
    """
    path = F.col("relative_path")
    under = F.lit(roots is None)
    for root in roots or ():
        under = under | path.startswith(root.rstrip("/") + "/")
    text = lambda: F.lit(None).cast("string")
    return files.where(under & path.endswith(".sql")).select(
        "project_id",
        paths.stem_of(path).alias("name"),
        text().alias("unique_id"),
        "relative_path",
        paths.layer_of(path).alias("layer"),
        paths.group_of(path).alias("model_group"),
        "raw_sql",
        F.lit(False).alias("compiled"),
        text().alias("materialization"),
        text().alias("database"),
        text().alias("schema_name"),
        text().alias("alias"),
        text().alias("description"),
        F.array().cast("array<string>").alias("tags"),
        text().alias("owner"),
        F.lit(0).cast("bigint").alias("test_count"),
        F.lit("static").alias("mode"),
    )


def project_roots(inventory: DataFrame, max_depth: int = 4) -> DataFrame:
    """Project folders in a file inventory ``path`` (relative to the search root, ``/`` between).

    A folder counts when it holds the project file, lies at most ``max_depth`` levels down, has no
    hidden or skipped folder on the way and is not inside another project. Every candidate knows
    its few ancestors, so nesting is an equi anti join. A fleet has as many roots as projects, and file sizes tell
    nothing about paths made from them, so no join here or below hands a whole side to every task. With a ``content`` column the project's own
    ``name:`` line is used, else its folder name.
    """
    parts = F.split("path", "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    told = F.lit("")
    if "content" in inventory.columns:
        told = F.trim(F.regexp_extract(F.col("content").cast("string"), r"""(?m)^name:\s*['"]?([^'"#\r\n]*)""", 1))
    candidates = (
        inventory.where((F.element_at(parts, -1) == PROJECT_FILE) & (F.size(parts) - 1 <= max_depth))
        .select(folder.alias("segments"), told.alias("told"))
        .where(~F.exists("segments", lambda s: s.startswith(".") | s.isin(*SKIPPED_FOLDERS)))
        .select(F.array_join("segments", "/").alias("relative_path"), "segments", "told")
    )
    above = candidates.select(
        "relative_path",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("segments") - 1, F.lit(0)))).alias("n"),
        "segments",
    ).where(F.col("n") < F.size("segments"))
    above = above.select("relative_path", F.array_join(F.slice("segments", F.lit(1), F.col("n")), "/").alias("ancestor"))
    nested = above.join(
        candidates.select(F.col("relative_path").alias("ancestor")).hint("merge"), "ancestor", "left_semi"
    ).select("relative_path")
    return (
        candidates.join(nested.distinct().hint("merge"), "relative_path", "left_anti")
        .select(
            "relative_path", F.coalesce(F.nullif("told", F.lit("")), F.try_element_at("segments", F.lit(-1))).alias("name")
        )
        .orderBy("relative_path")
    )


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below ``root``, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(relative_to(spark, root, "path").alias("path"))


def yaml_files(inventory: DataFrame) -> DataFrame:
    """The YAML files of an inventory ``project_id, relative_path``, for the project summary."""
    return inventory.where(F.lower("relative_path").rlike(r"\.ya?ml$")).select("project_id", "relative_path")


def assign_projects(inventory: DataFrame, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """Files of a whole fleet with the project they belong to, in one job.

    ``inventory`` has ``path`` and any other columns, from any lister: what Spark's own file sources
    pass over (names that begin with ``_`` or ``.``, files of zero bytes) is kept if the lister has it.
    ``roots`` is the result of :func:`project_roots`. A file goes to the root that is one of its
    folders (roots are not nested, so there is one at most); others are left out. The result has
    ``project_id`` (the root's path), ``relative_path`` below it and the other columns.
    """
    parts = F.split("path", "/")
    lengths = F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(max_depth)))
    folders = inventory.withColumn("n_", F.explode(lengths)).withColumn("project_id", F.array_join(F.slice(parts, F.lit(1), F.col("n_")), "/"))
    known = roots.select(F.col("relative_path").alias("project_id")).distinct().hint("merge")
    below = F.array_join(F.slice(parts, F.col("n_") + 1, F.size(parts)), "/")
    rest = [c for c in inventory.columns if c != "path"]
    return folders.join(known, "project_id").select("project_id", below.alias("relative_path"), *rest)


def fleet_models(files: DataFrame, folders: DataFrame) -> DataFrame:
    """:func:`sql_models` of many projects, each with its own model folders ``project_id, model_root``.

    ``files`` is ``project_id, relative_path, raw_sql``, as :func:`assign_projects` gives it.
    """
    parts = F.split("relative_path", "/")
    above = files.withColumn("n_", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))))
    above = above.withColumn("model_root", F.array_join(F.slice(parts, F.lit(1), F.col("n_")), "/"))
    wanted = folders.select("project_id", F.rtrim(F.col("model_root"), F.lit("/")).alias("model_root")).distinct()
    inside = above.join(wanted.hint("merge"), ["project_id", "model_root"], "left_semi").select("project_id", "relative_path", "raw_sql").distinct()
    return sql_models(inside, roots=None)
