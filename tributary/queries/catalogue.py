"""Projection profiles, column lineage and catalogue search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import catalog, columns
from tributary.operators import dependencies as D
from tributary.operators import graph, windows
from tributary.queries import inputs as I
from tributary.queries.registry import node_text, plain, query
from tributary.sources import files

_P = I.PROJECTION_SQL
_C = I.CORPUS_SQL


def _classified(spark, sf):
    return columns.classify_projections(I.raw_projections(spark, sf))


def _catalogue(spark, sf):
    return columns.relation_columns(I.projection_models(spark, sf), I.raw_projections(spark, sf), I.projection_sources(spark, sf))


def _column_edges(spark, sf):
    return columns.column_edges(
        _classified(spark, sf), I.projection_aliases(spark, sf), _catalogue(spark, sf), I.projection_models(spark, sf)
    )


@query("t7_transformation_types", _P + "SELECT model, output_name, transformation_type FROM p")
def transformation_types(spark, sf):
    return _classified(spark, sf).select("model", "output_name", "transformation_type")


@query("t8_referenced_columns", _P + "SELECT model, output_name, refs FROM p")
def referenced_columns(spark, sf):
    return plain(_classified(spark, sf).select("model", "output_name", F.col("referenced").alias("refs")))


@query("a4_column_counts", _P + "SELECT model, count(*) AS column_count FROM p GROUP BY model")
def column_counts(spark, sf):
    return D.column_counts(I.raw_projections(spark, sf)).select("model", "column_count")


@query(
    "j3_relation_keys",
    """SELECT name AS model, relation FROM (
      SELECT 'order_' || o_orderkey AS name, unnest(['order_' || o_orderkey, 'an.t_' || o_orderkey, 'db.an.t_' || o_orderkey]) AS relation FROM orders
      UNION ALL SELECT 'cust_' || c_custkey, 'cust_' || c_custkey FROM customer
      UNION ALL SELECT 'cust_' || c_custkey, 'an.c_' || c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def relation_keys(spark, sf):
    return D.relation_keys(I.projection_models(spark, sf)).select("model", "relation")


@query(
    "j4_resolved_leaves",
    """SELECT DISTINCT relation, CASE WHEN relation LIKE 'cust%' OR c_acctbal >= 0 THEN 'cust_' || c_custkey ELSE relation END AS owner,
        CASE WHEN relation LIKE 'cust%' OR c_acctbal >= 0 THEN 'model' ELSE 'orphan' END AS kind,
        CASE WHEN relation LIKE 'cust%' OR c_acctbal >= 0 THEN 'staging' ELSE 'unknown' END AS layer
      FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'an.c_' || o_custkey ELSE 'cust_' || o_custkey END AS relation FROM orders)
      JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT 'raw.rates', 'raw.rates', 'source', 'unknown'""",
)
def resolved_leaves(spark, sf):
    models = I.projection_models(spark, sf)
    leaves = I.projection_aliases(spark, sf).select("project_id", "relation").distinct()
    found = columns.resolve_leaves(leaves, D.relation_keys(models), models, _catalogue(spark, sf))
    return found.select("relation", "owner", "kind", "layer")


_EDGE_COLUMNS = """src_model || '.' || src_column AS src, src_layer, dst_model || '.' || dst_column AS dst, dst_layer"""


@query("j5_column_edges", _P + f"SELECT {_EDGE_COLUMNS}, transformation_type, expression AS expression_sql FROM edges")
def column_edges(spark, sf):
    return _column_edges(spark, sf).select(
        node_text("src").alias("src"), F.col("src.layer").alias("src_layer"),
        node_text("dst").alias("dst"), F.col("dst.layer").alias("dst_layer"), "transformation_type", "expression_sql",
    )


@query("g5_column_graph_edges", _P + f"SELECT {_EDGE_COLUMNS} FROM edges")
def column_graph_edges(spark, sf):
    _, edges, _ = columns.column_graph(
        _classified(spark, sf), I.projection_aliases(spark, sf), _catalogue(spark, sf), I.projection_models(spark, sf)
    )
    return edges.select(
        node_text("src").alias("src"), F.col("src.layer").alias("src_layer"), node_text("dst").alias("dst"), F.col("dst.layer").alias("dst_layer")
    )


_NODES = _P + """, nodes AS (SELECT src_model AS model, src_column AS column_name, src_layer AS layer FROM edges
  UNION SELECT p.model, output_name, layer FROM p JOIN o USING (model))
"""


def _graph_nodes(spark, sf):
    nodes, _, _ = columns.column_graph(
        _classified(spark, sf), I.projection_aliases(spark, sf), _catalogue(spark, sf), I.projection_models(spark, sf)
    )
    return nodes


@query("a2_search_index", _NODES + "SELECT project_id, column_name, model, layer FROM nodes, (VALUES ('shop'), ('lab')) v(project_id)")
def search_index(spark, sf):
    """Two projects whose nodes have equal names."""
    nodes = _graph_nodes(spark, sf)
    both = nodes.withColumn("project_id", F.explode(F.array(F.lit("shop"), F.lit("lab"))))
    return catalog.search_index(both).withColumnRenamed("column", "column_name")


@query(
    "p9_resolved_targets",
    _NODES + """, wanted AS (SELECT 'part_' || p_partkey AS column_name, NULL AS model FROM part
      UNION ALL SELECT 'part_' || p_partkey, 'raw.rates' FROM part)
    SELECT w.column_name, w.model, count(n.model) AS match_count,
      CASE WHEN count(n.model) = 0 THEN 'not_found' WHEN count(n.model) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
    FROM wanted w LEFT JOIN nodes n ON n.column_name = w.column_name AND (w.model IS NULL OR w.model = n.model) GROUP BY w.column_name, w.model""",
)
def resolved_targets(spark, sf):
    names = I.table(spark, sf, "part").select(F.format_string("part_%d", "p_partkey").alias("column"))
    wanted = names.withColumn("model", F.lit(None).cast("string")).unionByName(names.withColumn("model", F.lit("raw.rates")))
    status, _ = catalog.resolve_targets(_graph_nodes(spark, sf), wanted)
    return status.withColumnRenamed("column", "column_name")


@query(
    "u1_merged_edges",
    """SELECT o_custkey AS src, l_partkey AS dst, max(l_orderkey * 10 + l_linenumber) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def merged_edges(spark, sf):
    """Buyer to part, seen once per line item; the line with the largest key is kept."""
    lines = I.table(spark, sf, "lineitem").join(I.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spot = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    edges = lines.select(
        F.lit("shop").alias("project_id"), F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"),
        spot.alias("position"), F.lit("direct").alias("transformation_type"), spot.cast("string").alias("expression_sql"),
    )
    old = edges.withColumn("expression_sql", F.lit("older")).withColumn("position", F.col("position") * 2)
    return columns.merge_edges(old, edges).select("src", "dst", F.col("expression_sql").cast("bigint").alias("last"))


@query(
    "u4_relation_catalogue",
    _P + """SELECT DISTINCT 'an.t_' || l_orderkey AS relation, output_name AS column_name FROM p
      UNION SELECT 'raw.rates', 'part_' || p_partkey FROM part UNION SELECT 'raw.rates', 'amount_total'""",
)
def relation_catalogue(spark, sf):
    return _catalogue(spark, sf).select("relation", F.col("column").alias("column_name"))


@query(
    "q6_schema_warnings",
    """SELECT 'no_output_columns' AS kind, 'cust_' || c_custkey AS subject FROM customer
      UNION ALL SELECT 'no_output_columns', 'order_' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
      UNION ALL SELECT 'model_without_schema', 'cust_' || c_custkey FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT 'source_without_schema', 'loose.sup_' || s_suppkey FROM supplier""",
)
def schema_warnings(spark, sf):
    found = columns.schema_warnings(I.projection_models(spark, sf), I.raw_projections(spark, sf), I.projection_sources(spark, sf))
    return found.select("kind", "subject")


_STEP = "format_string('order_%d', o_orderkey)"


def _star_steps(spark, sf):
    """Per order: CTEs c0 <- c1 <- ... of stars, as many as its priority says, over real columns."""
    orders = I.table(spark, sf, "orders").select(
        F.lit("shop").alias("project_id"), F.format_string("order_%d", "o_orderkey").alias("model"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("hops"),
    )
    steps = orders.select("project_id", "model", F.explode(F.sequence(F.lit(0), "hops")).alias("n"), "hops")
    step = F.when(F.col("n") == F.col("hops"), "final_select").otherwise(F.format_string("cte:c%d", "n"))
    flow = steps.select(
        "project_id", "model", step.alias("step_id"),
        F.when(F.col("n") == 0, F.array(F.lit("source:raw.orders"))).otherwise(F.array(F.format_string("cte:c%d", F.col("n") - 1))).alias("upstream_step_ids"),
    )
    stars = steps.where("n > 0").select("project_id", "model", step.alias("step_id"), F.lit(0).alias("position"), F.lit("*").alias("output_name"), F.lit("*").alias("expression"))
    real = I.raw_projections(spark, sf).select("project_id", "model", F.lit("cte:c0").alias("step_id"), "position", "output_name", "expression")
    return flow, stars.unionByName(real)


_STAR_SQL = """WITH o AS (SELECT o_orderkey, 'order_' || o_orderkey AS model, CAST(left(o_orderpriority, 1) AS INT) AS hops FROM orders),
s AS (SELECT o.*, unnest(range(0, hops + 1)) AS n FROM o),
t AS (SELECT *, CASE WHEN n = hops THEN 'final_select' ELSE 'cte:c' || n END AS step_id FROM s),
p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
"""


@query(
    "j6_resolved_stars",
    _STAR_SQL + "SELECT model, step_id, coalesce(p.n, 1) AS column_count, p.n IS NULL AS still_star FROM t LEFT JOIN p ON l_orderkey = o_orderkey WHERE p.n IS NOT NULL OR t.n > 0",
)
def resolved_stars(spark, sf):
    flow, made = _star_steps(spark, sf)
    solved = columns.resolve_stars(made, flow)
    text = F.col("expression")  # the largest text is a star; two flags are grouped without sorting texts
    return solved.groupBy("model", "step_id").agg(
        F.count(F.lit(1)).alias("column_count"), (F.max(text == "*") & ~F.max(text > "*")).alias("still_star")
    )


@query("j7_flow_edges", _STAR_SQL + "SELECT model, CASE WHEN n = 0 THEN 'source:raw.orders' ELSE 'cte:c' || (n - 1) END AS src, step_id AS dst FROM t")
def flow_edges(spark, sf):
    return columns.flow_edges(_star_steps(spark, sf)[0]).select("model", "src", "dst")


_FEATURES = _P + """SELECT DISTINCT output_name AS column_name, p.model, layer, 'Order of ' || o_custkey AS description, 'team_' || o_custkey AS owner,
  'b,a' AS tags, o_orderkey AS test_count FROM p JOIN o USING (model)"""


@query("a3_feature_index", _FEATURES)
def feature_index(spark, sf):
    found = catalog.feature_index(I.raw_projections(spark, sf), I.projection_models(spark, sf)).withColumnRenamed("column", "column_name")
    return plain(found.select("column_name", "model", "layer", "description", "owner", "tags", "test_count"))


@query("j8_described_models", """SELECT 'cust_' || c_custkey AS model, 'name' AS column_name, '' AS tags, 0::BIGINT AS test_count, NULL::VARCHAR AS owner FROM customer""")
def described_models(spark, sf):
    """Columns of models without metadata, plus columns of unknown models, which are left out."""
    customers = I.table(spark, sf, "customer")
    made = customers.select(
        F.lit("shop").alias("project_id"),
        F.explode(F.array(F.format_string("cust_%d", "c_custkey"), F.format_string("ghost_%d", "c_custkey"))).alias("model"),
        F.lit("final_select").alias("step_id"),
        F.lit("name").alias("output_name"),
    )
    inner = made.withColumns({"step_id": F.lit("cte:draft"), "output_name": F.lit("draft")})
    found = catalog.feature_index(made.unionByName(made).unionByName(inner), I.projection_models(spark, sf))
    return plain(found.select("model", F.col("column").alias("column_name"), "tags", "test_count", "owner"))


@query("p8_ranked_names", _P + "SELECT DISTINCT output_name AS column_name FROM p WHERE lower(output_name) LIKE '%part!_1%' ESCAPE '!'")
def ranked_names(spark, sf):
    index = I.raw_projections(spark, sf).select(F.col("output_name").alias("column"))
    return catalog.search_names(index, "PART_1").withColumnRenamed("column", "column_name")


@query(
    "p7_filtered_columns",
    _P + "SELECT model, output_name FROM p WHERE transformation_type IN ('aggregate', 'conditional') AND (lower(output_name) LIKE '%status%' OR lower(expression) LIKE '%status%' OR lower(refs) LIKE '%status%')",
)
def filtered_columns(spark, sf):
    return catalog.filter_columns(_classified(spark, sf), " STATUS ", ["aggregate", "conditional"]).select("model", "output_name")


def _models(spark, sf):
    return files.sql_models(I.sql_files(spark, sf))


@query("p3_filtered_models", _C + "SELECT name FROM models WHERE lower(name) LIKE '%machinery/m%' OR lower(relative_path) LIKE '%machinery/m%'")
def filtered_models(spark, sf):
    return catalog.filter_models(_models(spark, sf), "  Machinery/M").select("name")


@query("p4_filtered_groups", _C + "SELECT name FROM models WHERE model_group IN ('building', 'furniture')")
def filtered_groups(spark, sf):
    return catalog.filter_groups(_models(spark, sf), ["building", "furniture"]).select("name")


@query("p5_distinct_groups", _C + "SELECT DISTINCT model_group FROM models WHERE model_group IS NOT NULL")
def distinct_groups(spark, sf):
    return catalog.distinct_groups(_models(spark, sf))


@query("p6_filtered_layers", _C + "SELECT name FROM models WHERE layer IN ('marts', 'unknown')")
def filtered_layers(spark, sf):
    return catalog.filter_layers(_models(spark, sf), ["marts", "unknown"]).select("name")


@query("p11_model_lookup", _C + "SELECT project_id, name, relative_path FROM models WHERE name = (SELECT max(name) FROM models)")
def model_lookup(spark, sf):
    models = _models(spark, sf)
    return catalog.lookup_model(models, models.agg(F.max("name")).first()[0]).select("project_id", "name", "relative_path")


@query("a7_layer_rollup", _C + "SELECT layer, project_id, name FROM models")
def layer_rollup(spark, sf):
    return catalog.layer_rollup(_models(spark, sf))


@query(
    "o3_sorted_models",
    _C + """SELECT layer, project_id, name, row_number() OVER (PARTITION BY layer ORDER BY name, project_id) AS place,
      count(*) OVER (PARTITION BY layer) AS model_count FROM models""",
)
def sorted_models(spark, sf):
    """Place of each model in the listing of its layer, and the layer's size."""
    models = _models(spark, sf)
    placed = windows.with_positions(models.select("layer", "project_id", "name"), ["layer"], ["name", "project_id"], name="place")
    return plain(placed.join(catalog.layer_counts(models), "layer").select("layer", "project_id", "name", "place", "model_count"))


@query("g8_column_terminals", _NODES + """SELECT model || '.' || column_name AS node FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst_model = n.model AND e.dst_column = n.column_name)""")
def column_sources(spark, sf):
    """Columns that nothing in the project feeds: raw sources and constants."""
    nodes, edges, _ = columns.column_graph(
        _classified(spark, sf), I.projection_aliases(spark, sf), _catalogue(spark, sf), I.projection_models(spark, sf)
    )
    return graph.terminal_nodes(nodes, edges).where("is_source").select(node_text("node").alias("node"))
