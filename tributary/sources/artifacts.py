"""Which artifact each project is read from, and how that is reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Status reasons and the text shown for each.
MESSAGES = {
    "found": "Using compiled artifacts from target/manifest.json.",
    "not_generated": "target/manifest.json not found — using the static SQL parser.",
    "unsupported_manifest_schema_version": "manifest.json schema version is not supported — using the static SQL parser.",
    "manifest_parse_failed": "target/manifest.json could not be parsed — using the static SQL parser.",
}


def resolve_artifacts(accepted: DataFrame, quarantine: DataFrame, static_projects: DataFrame) -> DataFrame:
    """One row per project: ``project_id, mode, reason, message, name, adapter_type``.

    A readable manifest of a supported version wins; otherwise the SQL files are used and the
    reason says why. A project known only by its files has not generated a manifest.
    """
    manifests = accepted.select(
        "project_id",
        F.lit("found").alias("reason"),
        F.lit("").alias("message"),
        F.col("metadata.project_name").alias("manifest_name"),
        F.col("metadata.adapter_type").alias("adapter_type"),
    ).unionByName(
        quarantine.select(
            "project_id", "reason", "message",
            F.lit(None).cast("string").alias("manifest_name"), F.lit(None).cast("string").alias("adapter_type"),
        )
    )
    own_name = F.element_at(F.split("project_id", "/"), -1)
    return manifests.join(static_projects.select("project_id").distinct(), "project_id", "full_outer").select(
        "project_id",
        F.when(F.col("reason") == "found", "manifest").otherwise("static").alias("mode"),
        F.coalesce("reason", F.lit("not_generated")).alias("reason"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("manifest_name", own_name).alias("name"),
        "adapter_type",
    )


def choose_models(projects: DataFrame, manifest_models: DataFrame, static_models: DataFrame) -> DataFrame:
    """Models of every project from the artifact that was chosen for it."""
    by_mode = lambda mode: projects.where(F.col("mode") == mode).select("project_id")
    return manifest_models.join(by_mode("manifest"), "project_id", "left_semi").unionByName(
        static_models.join(by_mode("static"), "project_id", "left_semi")
    )


def status_messages(projects: DataFrame) -> DataFrame:
    """``project_id, level, message`` for display: fixed text plus the detail, if any."""
    fixed = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    headline = F.coalesce(
        F.try_element_at(fixed, F.col("reason")), F.format_string("%s mode (%s).", "mode", "reason")
    )
    return projects.select(
        "project_id",
        F.when(F.col("mode") == "manifest", "success")
        .when(F.col("reason") == "not_generated", "info")
        .otherwise("warning")
        .alias("level"),
        F.concat_ws(" ", headline, F.nullif("message", F.lit(""))).alias("message"),
    )
