"""Who is affected by a change: roll-ups of downstream chains.

Nodes are ``STRUCT<model, column, layer>``. Results are flat rows rather than one list per model,
because a widely used key can reach most of the graph and would not fit one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import graph


def impacted_nodes(chain: DataFrame) -> DataFrame:
    """The chain without its own target: ``target, model, column``.

    Nodes keyed by :func:`graph.by_project` are looked into.
    """
    node = "node.node" if "node" in chain.schema["node"].dataType.names else "node"
    return chain.where(F.col("node") != F.col("target")).select(
        "target", F.col(f"{node}.model").alias("model"), F.col(f"{node}.column").alias("column")
    )


def impact_by_model(nodes: DataFrame) -> DataFrame:
    """Affected columns counted per model, most affected first."""
    return (
        nodes.groupBy("target", "model")
        .agg(F.count(F.lit(1)).alias("column_count"))
        .orderBy("target", F.desc("column_count"), "model")
    )


def impact_columns(nodes: DataFrame) -> DataFrame:
    """One row per affected column with its model's count, in report order."""
    counts = nodes.groupBy("target", "model").agg(F.count(F.lit(1)).alias("column_count"))
    return nodes.join(counts, ["target", "model"]).orderBy(
        "target", F.desc("column_count"), "model", "column"
    )


def impact_totals(nodes: DataFrame) -> DataFrame:
    """Per target: distinct affected models and affected columns."""
    per_model = nodes.groupBy("target", "model").agg(F.count(F.lit(1)).alias("n"))
    return per_model.groupBy("target").agg(
        F.count(F.lit(1)).alias("affected_model_count"), F.sum("n").alias("affected_column_count")
    )


def impact_summary(
    edges: DataFrame, targets: DataFrame, chain: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(totals, by_model)`` for each target; ``by_model`` has scope ``direct`` or ``all``.

    A target that nothing consumes keeps its row of zeros in the totals.
    """
    chain = graph.downstream(edges, targets) if chain is None else chain
    everything = impacted_nodes(chain)
    direct = impacted_nodes(graph.direct_successors(edges, targets))
    totals = (
        targets.select("target")
        .distinct()
        .join(impact_totals(everything), "target", "left")
        .na.fill(0, ["affected_model_count", "affected_column_count"])
    )
    scoped = direct.withColumn("scope", F.lit("direct")).unionByName(
        everything.withColumn("scope", F.lit("all"))
    )
    by_model = (
        scoped.groupBy("target", "scope", "model")
        .agg(F.count(F.lit(1)).alias("column_count"))
        .orderBy("target", "scope", F.desc("column_count"), "model")
    )
    return totals, by_model


def require_downstream(direction: str, impact: bool) -> None:
    """Impact only has a meaning downstream."""
    if impact and direction != graph.DOWNSTREAM:
        raise ValueError("an impact summary needs the downstream direction")
