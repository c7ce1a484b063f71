"""Content fingerprints of projects and what changed between two sets of them.

A project's text may be too large for one row, so its digest is not the hash of one long string:
every model is hashed on its own (with its name) and the 32-bit words of the SHA-256 values are
summed. The sum does not depend on row order, is reduced before the shuffle, and changes with any
model; the eight sums and the model count are hashed once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = ["project_id"]


def _digest(models: DataFrame, text: Column) -> DataFrame:
    hashed = models.select(*_KEYS, F.sha2(text, 256).alias("h"))
    words = [
        F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint")).alias(f"w{i}") for i in range(8)
    ]
    sums = hashed.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("model_count"), *words)
    flat = F.concat_ws(":", "model_count", *[f"w{i}" for i in range(8)])  # numbers only, so the marks are unambiguous
    return sums.select(*_KEYS, "model_count", F.sha2(flat, 256).alias("fingerprint"))


def _fields(*parts: Column | str) -> Column:
    """One text of fixed-width digests, so that no text can move from one field to the next."""
    return F.concat(*(F.sha2(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")), 256) for p in parts))


def _with_status(digest: DataFrame, projects: DataFrame) -> DataFrame:
    empty = F.sha2(F.lit("0"), 256)
    return projects.select("project_id", "mode", "reason").join(digest, "project_id", "left").select(
        "project_id", "mode", "reason",
        F.coalesce("model_count", F.lit(0)).alias("model_count"),
        F.coalesce("fingerprint", empty).alias("fingerprint"),
    )


def lineage_fingerprint(models: DataFrame, projects: DataFrame) -> DataFrame:
    """Changes whenever a model of the project is added, removed, renamed or gets other SQL."""
    return _with_status(_digest(models, _fields("name", "raw_sql")), projects)


def dag_fingerprint(models: DataFrame, deps: DataFrame, projects: DataFrame) -> DataFrame:
    """As :func:`lineage_fingerprint`, and also with metadata and the set of ref targets.

    The refs enter as an order-free sum of their hashes, so a model with very many of them is
    reduced in parts as well.
    """
    ref_words = [
        F.sum(F.conv(F.substring(F.sha2("target_name", 256), 8 * i + 1, 8), 16, 10).cast("bigint")).alias(f"r{i}")
        for i in range(8)
    ]
    refs = deps.where("dependency_type = 'ref'").groupBy("project_id", F.col("model").alias("name")).agg(*ref_words)
    tags = F.array_join(F.transform(F.array_sort("tags"), lambda t: F.sha2(t, 256)), "")
    words = F.concat_ws(",", *[F.coalesce(F.col(f"r{i}"), F.lit(0)) for i in range(8)])
    text = _fields("name", "raw_sql", "materialization", "description", tags, "owner", F.col("test_count").cast("string"), words)
    return _with_status(_digest(models.join(refs, ["project_id", "name"], "left"), text), projects)


def changed_projects(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``project_id, change``: ``new``, ``changed``, ``removed`` or ``same``; only the first two need a rebuild."""
    parts = F.struct("mode", "reason", "model_count", "fingerprint")
    old = stored.select("project_id", parts.alias("old"))
    new = current.select("project_id", parts.alias("now"))
    return old.join(new, "project_id", "full_outer").select(
        "project_id",
        F.when(F.col("old").isNull(), "new")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("now")), "same")
        .otherwise("changed")
        .alias("change"),
    )
