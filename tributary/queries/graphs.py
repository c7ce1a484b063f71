"""Graph operators on the record, cycle and conversation graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import graph, impact, windows
from tributary.queries import inputs as I
from tributary.queries.registry import node_text, plain, query
from tributary.scratch import Scratch
from tributary.sources import sinks


def _chain(df):
    return df.select(node_text("target").alias("target"), node_text("node").alias("node"), F.col("depth").cast("bigint").alias("depth"))


def _edges(df):
    return df.select(node_text("src").alias("src"), node_text("dst").alias("dst"))


@query("g2_upstream_chain", I.RECORD_SQL + "SELECT target, node, CAST(depth AS BIGINT) AS depth FROM chain_up")
def upstream_chain(spark, sf):
    return _chain(graph.upstream(I.record_edges(spark, sf), I.priority_targets(spark, sf)))


@query("g3_downstream_chain", I.RECORD_SQL + "SELECT target, node, CAST(depth AS BIGINT) AS depth FROM chain")
def downstream_chain(spark, sf):
    return _chain(graph.downstream(I.record_edges(spark, sf), I.region_targets(spark, sf)))


@query(
    "g4_direct_successors",
    I.RECORD_SQL + "SELECT DISTINCT target, dst AS node FROM regions JOIN e ON src = target",
)
def direct_successors(spark, sf):
    found = graph.direct_successors(I.record_edges(spark, sf), I.region_targets(spark, sf))
    return found.select(node_text("target").alias("target"), node_text("node").alias("node"))


@query(
    "g6_cyclic_nodes",
    """SELECT o_orderkey AS node, o_orderkey - o_orderkey % 10 AS component FROM orders
       WHERE o_orderkey % 10 < 5 AND o_orderkey - o_orderkey % 10 + 4 <= (SELECT max(o_orderkey) FROM orders)""",
)
def cyclic_nodes(spark, sf):
    return graph.cycle_components(I.cycle_edges(spark, sf)).select("node", "component")


_CYCLE_SQL = """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 10 AS r FROM orders),
e AS (SELECT k AS src, CASE WHEN r < 4 THEN k + 1 WHEN r = 4 THEN k - 4 ELSE k - 5 END AS dst FROM k
      UNION ALL SELECT k, k + 10 FROM k WHERE k % 20 = 0)
SELECT src, dst FROM e WHERE dst IN (SELECT k FROM k) AND """


@query("g7_edges_after_breaking_cycles", _CYCLE_SQL + "NOT (src % 10 = 4 AND dst = src - 4)")
def acyclic_edges(spark, sf):
    kept, _ = graph.break_cycles(I.cycle_edges(spark, sf))
    return kept.select("src", "dst")


@query("g7_dropped_edges", _CYCLE_SQL + "src % 10 = 4 AND dst = src - 4")
def dropped_edges(spark, sf):
    _, dropped = graph.break_cycles(I.cycle_edges(spark, sf))
    return dropped.select("src", "dst")


_TWO_WAY_SQL = """WITH k AS (SELECT o_orderkey AS k FROM orders),
e AS (SELECT k AS src, k + 1 AS dst FROM k WHERE k % 64 < 63 UNION SELECT k + 1, k FROM k WHERE k % 64 < 63
      UNION SELECT k + 7, k FROM k WHERE k % 64 < 57)
SELECT src, dst FROM e WHERE src IN (SELECT k FROM k) AND dst IN (SELECT k FROM k) AND """


@query("g7_many_cuts", _TWO_WAY_SQL + "src > dst")
def many_cuts(spark, sf):
    """Blocks of 64 nodes with edges both ways: more than a hundred edges of each component must go."""
    _, dropped = graph.break_cycles(I.two_way_edges(spark, sf))
    return dropped.select("src", "dst")


@query(
    "g8_terminal_nodes",
    I.RECORD_SQL + "SELECT node, node NOT IN (SELECT dst FROM e) AS is_source, node NOT IN (SELECT src FROM e) AS is_sink FROM nodes",
)
def terminal_nodes(spark, sf):
    flags = graph.terminal_nodes(I.record_nodes(spark, sf), I.record_edges(spark, sf))
    return flags.select(node_text("node").alias("node"), "is_source", "is_sink")


_CHAIN_SQL = """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations),
e AS (SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w(conv_id, target, node, depth) AS (SELECT conv_id, turn, turn, 0 FROM t
  UNION SELECT w.conv_id, target, e.dst, depth + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.src = w.node)
"""


@query("g10_multi_target_closure", _CHAIN_SQL + "SELECT conv_id, target, node, CAST(depth AS BIGINT) AS depth FROM w")
def multi_target_closure(spark, sf):
    turns = I.table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("target"))
    return graph.downstream(I.chain_edges(spark, sf), turns).select(
        "target.conv_id", F.col("target.turn").alias("target"), F.col("node.turn").alias("node"), F.col("depth").cast("bigint").alias("depth")
    )


@query("o1_topological_levels", I.RECORD_SQL + "SELECT target, node, CAST(level AS BIGINT) AS level FROM chain")
def topological_levels(spark, sf):
    chain = graph.ordered_chain(I.record_edges(spark, sf), I.region_targets(spark, sf))
    return chain.orderBy("target", "level", "node").select(
        node_text("target").alias("target"), node_text("node").alias("node"), F.col("level").cast("bigint").alias("level")
    )


@query(
    "o1_upstream_order",
    I.RECORD_SQL + """, lv(target, node, level) AS (
      SELECT target, node, 0 FROM chain_up
      UNION SELECT lv.target, e.dst, lv.level + 1 FROM lv JOIN e ON e.src = lv.node JOIN chain_up c ON c.target = lv.target AND c.node = e.dst)
    SELECT target, node, CAST(max(level) AS BIGINT) AS level FROM lv GROUP BY ALL""",
)
def upstream_order(spark, sf):
    chain = graph.ordered_chain(I.record_edges(spark, sf), I.priority_targets(spark, sf), graph.UPSTREAM)
    return chain.select(node_text("target").alias("target"), node_text("node").alias("node"), F.col("level").cast("bigint").alias("level"))


@query("o1_topological_levels_of_all", I.RECORD_SQL + "SELECT node, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY node")
def topological_levels_of_all(spark, sf):
    levels = graph.topological_levels(I.record_nodes(spark, sf), I.record_edges(spark, sf), by=())
    return levels.select(node_text("node").alias("node"), F.col("level").cast("bigint").alias("level"))


_INDUCED_SQL = I.RECORD_SQL + """SELECT a.target, src, dst FROM chain a JOIN e ON a.node = src JOIN chain b ON b.node = dst AND b.target = a.target"""


@query("u3_induced_edges", _INDUCED_SQL)
def induced_edges(spark, sf):
    edges = I.record_edges(spark, sf)
    chain = graph.downstream(edges, I.region_targets(spark, sf))
    inside = graph.induced_edges(edges, chain)
    return inside.select(node_text("target").alias("target"), node_text("src").alias("src"), node_text("dst").alias("dst"))


_IMPACT_SQL = I.RECORD_SQL + """, hit AS (SELECT target, split_part(node, '.', 1) AS model, substr(node, strpos(node, '.') + 1) AS column_name FROM chain WHERE node <> target)
"""


@query(
    "a5_impact_by_model",
    _IMPACT_SQL + "SELECT target, model, count(*) AS column_count FROM hit GROUP BY ALL",
)
def impact_by_model(spark, sf):
    """Flagship: everything downstream of each region, rolled up by model."""
    chain = graph.downstream(I.record_edges(spark, sf), I.region_targets(spark, sf))
    found = impact.impact_by_model(impact.impacted_nodes(chain))
    return found.select(node_text("target").alias("target"), "model", "column_count")


@query(
    "a5_impact_columns",
    _IMPACT_SQL + "SELECT target, model, count(*) OVER (PARTITION BY target, model) AS column_count, column_name FROM hit",
)
def impact_columns(spark, sf):
    chain = graph.downstream(I.record_edges(spark, sf), I.region_targets(spark, sf))
    found = impact.impact_columns(impact.impacted_nodes(chain))
    return found.select(node_text("target").alias("target"), "model", "column_count", F.col("column").alias("column_name"))


@query(
    "a6_impact_totals",
    _IMPACT_SQL + "SELECT target, count(DISTINCT model) AS affected_model_count, count(*) AS affected_column_count FROM hit GROUP BY target",
)
def impact_totals(spark, sf):
    chain = graph.downstream(I.record_edges(spark, sf), I.region_targets(spark, sf))
    found = impact.impact_totals(impact.impacted_nodes(chain))
    return found.select(node_text("target").alias("target"), "affected_model_count", "affected_column_count")


@query(
    "g9_impact_summary",
    _IMPACT_SQL + """SELECT target, scope, model, count(*) AS column_count FROM (
      SELECT target, 'all' AS scope, model, column_name FROM hit
      UNION ALL SELECT DISTINCT target, 'direct', split_part(dst, '.', 1), dst FROM regions JOIN e ON src = target) GROUP BY ALL""",
)
def impact_summary(spark, sf):
    _, by_model = impact.impact_summary(I.record_edges(spark, sf), I.region_targets(spark, sf))
    return by_model.select(node_text("target").alias("target"), "scope", "model", "column_count")


@query(
    "o2_impact_order",
    _IMPACT_SQL + """SELECT target, model, row_number() OVER (PARTITION BY target ORDER BY n DESC, model) AS place
      FROM (SELECT target, model, count(*) AS n FROM hit GROUP BY ALL)""",
)
def impact_order(spark, sf):
    """Report place of each model of a target."""
    chain = graph.downstream(I.record_edges(spark, sf), I.region_targets(spark, sf))
    found = impact.impact_by_model(impact.impacted_nodes(chain)).withColumn("target", node_text("target"))
    placed = windows.with_positions(found, ["target"], [F.desc("column_count"), "model"], name="place")
    return plain(placed.select("target", "model", "place"))


@query(
    "s11_lineage_payload",
    _IMPACT_SQL + """SELECT section, target, a, b FROM (
      SELECT 'target' AS section, target, split_part(target, '.', 2) AS a, 'downstream' AS b FROM regions
      UNION ALL SELECT 'chain', target, node, NULL FROM chain
      UNION ALL SELECT 'edges', c.target, src, dst FROM chain c JOIN e ON src = node
      UNION ALL SELECT 'all_impacted', target, model || '.' || column_name, NULL FROM hit
      UNION ALL SELECT DISTINCT 'direct', target, dst, NULL FROM regions JOIN e ON src = target)""",
)
def lineage_payload(spark, sf):
    edges = Scratch(spark, "record").save(I.record_edges(spark, sf), "edges")
    chain = graph.downstream(edges, I.region_targets(spark, sf), stored=True)
    edges = edges.select("*", F.lit("direct").alias("transformation_type"), F.lit("k").alias("expression_sql"))
    payload = sinks.lineage_payload(chain, edges, graph.DOWNSTREAM, impact=True)
    node = "model STRING, column STRING"
    # one pass over a record's text
    read = payload.withColumn("r", F.from_json("record", f"{node}, direction STRING, source STRUCT<{node}>, target STRUCT<{node}>"))
    pair = lambda at: F.concat(F.col(f"r.{at}model"), F.lit("."), F.col(f"r.{at}column"))
    section = F.col("section")
    return read.select(
        "section",
        node_text("target").alias("target"),
        F.when(section == "target", F.col("r.column")).when(section == "edges", pair("source.")).otherwise(pair("")).alias("a"),
        F.when(section == "target", F.col("r.direction")).when(section == "edges", pair("target.")).alias("b"),
    )
