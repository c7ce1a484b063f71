"""Model-level dependencies: profiles of SQL text, relation keys and the model graph.

Model names are unique inside one project only, so every key carries ``project_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import expressions as X
from tributary.functions import templates as Tm
from tributary.operators import graph

_MODEL = ["project_id", "model"]


def model_dependencies(models: DataFrame) -> DataFrame:
    """Dependencies read from SQL text: one row per call, repeats kept, with its position.

    The outer explodes keep the optimizer from adding a size test, which would run the pattern again.
    """
    refs = models.select(
        "project_id",
        F.col("name").alias("model"),
        F.posexplode_outer(Tm.refs_of(F.col("raw_sql"))).alias("position", "target_name"),
    ).where("position is not null").select(
        *_MODEL, "position", F.lit("ref").alias("dependency_type"),
        F.lit(None).cast("string").alias("source_name"), "target_name",
    )
    sources = models.select(
        "project_id",
        F.col("name").alias("model"),
        F.posexplode_outer(Tm.sources_of(F.col("raw_sql"))).alias("position", "call"),
    ).where("position is not null").select(
        *_MODEL, "position", F.lit("source").alias("dependency_type"),
        F.col("call.source_name").alias("source_name"), F.col("call.table_name").alias("target_name"),
    )
    return refs.unionByName(sources)


def clause_profile(models: DataFrame) -> DataFrame:
    """Text profile of every model: CTEs, joins, aggregates, windows and dependency calls."""
    cleaned = models.select(
        "project_id",
        F.col("name").alias("model"),
        F.size(Tm.refs_of(F.col("raw_sql"))).alias("ref_dependency_count"),
        F.size(Tm.sources_of(F.col("raw_sql"))).alias("source_dependency_count"),
        X.code_of(Tm.strip_templates(F.col("raw_sql"))).alias("code"),
    )
    return cleaned.select(
        *_MODEL,
        X.cte_names(F.col("code")).alias("cte_names"),
        X.join_types(F.col("code")).alias("join_types"),
        X.has_where(F.col("code")).alias("has_where_clause"),
        X.aggregate_functions(F.col("code")).alias("aggregate_functions"),
        X.has_window(F.col("code")).alias("has_window_functions"),
        "ref_dependency_count",
        "source_dependency_count",
    ).withColumn("join_count", F.size("join_types"))


def profile_metrics(profile: DataFrame, projections: DataFrame) -> DataFrame:
    """Counts per model: CTEs, joins, output columns, ref and source calls."""
    return profile.join(column_counts(projections), _MODEL, "left").select(
        *_MODEL,
        F.size("cte_names").alias("cte_count"),
        "join_count",
        F.coalesce("column_count", F.lit(0)).alias("output_column_count"),
        "ref_dependency_count",
        "source_dependency_count",
    )


def column_counts(projections: DataFrame) -> DataFrame:
    """Output columns per model, duplicates counted."""
    return projections.where("step_id = 'final_select'").groupBy(*_MODEL).agg(F.count(F.lit(1)).alias("column_count"))


def known_ref_edges(models: DataFrame, deps: DataFrame) -> DataFrame:
    """Ref dependencies whose target is a model of the same project: ``project_id, src, dst``."""
    known = models.select("project_id", F.col("name").alias("src"))
    return (
        deps.where("dependency_type = 'ref'")
        .select("project_id", F.col("target_name").alias("src"), F.col("model").alias("dst"))
        .distinct()
        .join(known, ["project_id", "src"], "left_semi")
    )


def cyclic_models(models: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models on a ref cycle as ``project_id, model, component``, and one warning per component."""
    keyed = known_ref_edges(models, deps).select(
        F.struct("project_id", F.col("src").alias("model")).alias("src"),
        F.struct("project_id", F.col("dst").alias("model")).alias("dst"),
    )
    members = graph.cycle_components(keyed).select(
        F.col("node.project_id").alias("project_id"),
        F.col("node.model").alias("model"),
        F.col("component.model").alias("component"),
    )
    warnings = (
        members.groupBy("project_id", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "project_id",
            F.lit("model_cycle").alias("kind"),
            F.col("component").alias("subject"),
            F.format_string(
                "Circular ref() dependency detected and excluded: %d model(s) on cycles through %s", "n", "component"
            ).alias("message"),
        )
    )
    return members, warnings


def drop_excluded(df: DataFrame, excluded: DataFrame, column: str = "model") -> DataFrame:
    """Rows whose model is not in ``excluded(project_id, model)``."""
    gone = excluded.select("project_id", F.col("model").alias(column)).distinct()
    return df.join(gone, ["project_id", column], "left_anti")


def relation_keys(models: DataFrame) -> DataFrame:
    """Every text a model can be addressed by, and the model it leads to.

    A model answers to its name, to ``schema.alias`` and, with a database, to all three parts. When
    two models claim a key the later one in name order has it.
    """
    schema_alias = F.concat_ws(".", "schema_name", "alias")
    placed = (F.col("schema_name") != "") & (F.col("alias") != "")
    keys = F.array_compact(
        F.array(
            F.col("name"),
            F.when(placed, schema_alias),
            F.when(placed & (F.col("database") != ""), F.concat_ws(".", "database", schema_alias)),
        )
    )
    return (
        models.select("project_id", F.col("name").alias("model"), F.explode(keys).alias("relation"))
        .groupBy("project_id", "relation")
        .agg(F.max("model").alias("model"))
    )


def model_dag(
    models: DataFrame,
    deps: DataFrame,
    projections: DataFrame,
    extra_warnings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model graph: ``(nodes, edges, warnings)`` without models on ref cycles."""
    cyclic, warnings = cyclic_models(models, deps)
    kept = drop_excluded(models, cyclic, "name")
    counts = column_counts(projections).withColumnRenamed("model", "name")
    nodes = kept.join(counts, ["project_id", "name"], "left").select(
        "project_id", "name", "layer", "materialization", "description", "tags", "test_count",
        "owner", "model_group", F.coalesce("column_count", F.lit(0)).alias("column_count"),
    )
    edges = drop_excluded(known_ref_edges(models, deps), cyclic, "src")
    edges = drop_excluded(edges, cyclic, "dst")
    if extra_warnings is not None:
        warnings = warnings.unionByName(extra_warnings)
    return nodes, edges, warnings


def scope_to_group(models: DataFrame, *others: DataFrame, group: str | None) -> tuple[DataFrame, ...]:
    """Models of one group and the rows of ``others`` that belong to them, before any build."""
    if group is None:
        return (models, *others)
    inside = models.where(F.col("model_group") == group)
    names = inside.select("project_id", F.col("name").alias("model"))
    return (inside, *[df.join(names, _MODEL, "left_semi") for df in others])
