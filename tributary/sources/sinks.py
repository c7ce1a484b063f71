"""Results as JSON records and summaries.

A chain can cover most of the graph, so a lineage result is written as one JSON record per chain
node, edge, warning and impact row instead of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import graph
from tributary.operators.impact import impacted_nodes, require_downstream
from tributary.scratch import Scratch


def lineage_payload(
    chain: DataFrame,
    edges: DataFrame,
    direction: str,
    warnings: DataFrame | None = None,
    impact: bool = False,
) -> DataFrame:
    """Records ``target, section, record`` for closures made by ``graph.upstream/downstream``.

    Sections are ``target``, ``chain``, ``edges``, ``lineage_warnings`` (these concern the whole
    graph, so their target is null) and, downstream, ``direct`` and ``all_impacted``.
    """
    require_downstream(direction, impact)

    def records(df: DataFrame, section: str, *fields) -> DataFrame:
        return df.select("target", F.lit(section).alias("section"), F.to_json(F.struct(*fields)).alias("record"))

    keyed = "node" in chain.schema["node"].dataType.names  # as graph.by_project makes them

    def parts(end: str, *names: str) -> list:
        project = [F.col(f"{end}.project_id").alias("project_id")] if keyed else []
        return project + [F.col(f"{end}.node.{n}" if keyed else f"{end}.{n}").alias(n) for n in names]

    scratch = Scratch(chain.sparkSession, "payload")
    chain = scratch.save(chain, "chain")  # read by nearly every section
    start = scratch.save(chain.where("depth = 0"), "start")
    out = records(start, "target", *parts("target", "column", "model", "layer"), F.lit(direction).alias("direction"))
    out = out.unionByName(records(chain, "chain", *parts("node", "model", "column", "layer")))
    inside = graph.closed_edges(edges, chain, direction)
    out = out.unionByName(
        records(inside, "edges", F.col("src").alias("source"), F.col("dst").alias("target"), "transformation_type", "expression_sql")
    )
    if warnings is not None:
        nobody = F.lit(None).cast(chain.schema["target"].dataType)
        out = out.unionByName(records(warnings.withColumn("target", nobody), "lineage_warnings", "message"))
    if impact:
        direct = impacted_nodes(graph.direct_successors(edges, start.select("target")))
        out = out.unionByName(records(direct, "direct", "model", "column"))
        out = out.unionByName(records(impacted_nodes(chain), "all_impacted", "model", "column"))
    return out


def write_payload(payload: DataFrame, path: str) -> None:
    """Store records as JSON lines, one folder per section."""
    payload.write.partitionBy("section").json(path)


def project_summary(models: DataFrame, sources: DataFrame, yaml_files: DataFrame | None = None) -> DataFrame:
    """Counts per project: models, source tables and YAML files."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))

    out = counted(models, "model_count").join(
        counted(sources.select("project_id", "source_name", "table_name").distinct(), "source_table_count"),
        "project_id",
        "full_outer",
    )
    if yaml_files is None:
        out = out.withColumn("yaml_file_count", F.lit(0).cast("bigint"))
    else:
        out = out.join(counted(yaml_files, "yaml_file_count"), "project_id", "full_outer")
    return out.na.fill(0, ["model_count", "source_table_count", "yaml_file_count"])


def models_view(models: DataFrame) -> DataFrame:
    """Models only, for listings and export."""
    return models.select("project_id", "name", "relative_path", "layer", "materialization", "description", "owner", "tags", "test_count")


def sources_view(sources: DataFrame) -> DataFrame:
    """Source tables only, for listings and export."""
    return sources.select("project_id", "source_name", "table_name", "identifier", "schema_name", "columns")
