"""Text extraction, path features and model dependencies on the SQL corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions import paths, templates
from tributary.functions import expressions as X
from tributary.operators import dependencies as D
from tributary.queries import inputs as I
from tributary.queries.registry import plain, query
from tributary.sources import files

_C = I.CORPUS_SQL
_REFS = _C + """, refs AS (
  SELECT project_id, name AS model, 0 AS position, 'draft_' || k AS target_name FROM models WHERE kind = 'order'
  UNION ALL SELECT project_id, name, 1, 'cust_' || ck FROM models WHERE kind = 'order'
  UNION ALL SELECT project_id, name, 2, 'region_view' FROM models WHERE kind = 'order'),
srcs AS (
  SELECT project_id, name AS model, 0 AS position, CASE kind WHEN 'order' THEN 'raw_' || st ELSE 'crm' END AS source_name,
    CASE kind WHEN 'order' THEN 'orders' ELSE 'customers' END AS target_name FROM models)
"""


def _models(spark, sf):
    return files.sql_models(I.sql_files(spark, sf))


@query("s7_sql_models", _C + "SELECT project_id, name, relative_path, layer, model_group, md5(raw_sql) AS digest FROM corpus")
def sql_models(spark, sf):
    return _models(spark, sf).select("project_id", "name", "relative_path", "layer", "model_group", F.md5("raw_sql").alias("digest"))


@query("p1_layers", _C + "SELECT project_id, layer, count(*) AS n FROM models GROUP BY ALL")
def layers(spark, sf):
    found = I.sql_files(spark, sf).select("project_id", paths.layer_of(F.col("relative_path")).alias("layer"))
    return found.groupBy("project_id", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("p2_groups", _C + "SELECT relative_path, model_group FROM models")
def groups(spark, sf):
    return I.sql_files(spark, sf).select("relative_path", paths.group_of(F.col("relative_path")).alias("model_group"))


@query("t1_ref_calls", _REFS + "SELECT project_id, model, CAST(position AS BIGINT) AS position, target_name FROM refs")
def ref_calls(spark, sf):
    found = D.model_dependencies(_models(spark, sf)).where("dependency_type = 'ref'")
    return plain(found.select("project_id", "model", "position", "target_name"))


@query("t2_source_calls", _REFS + "SELECT project_id, model, CAST(position AS BIGINT) AS position, source_name, target_name FROM srcs")
def source_calls(spark, sf):
    found = D.model_dependencies(_models(spark, sf)).where("dependency_type = 'source'")
    return plain(found.select("project_id", "model", "position", "source_name", "target_name"))


_STRIPPED = """replace(replace(replace(replace(replace(raw_sql, '{{ ref( ''cust_' || coalesce(CAST(ck AS VARCHAR), '') || ''' ) }}', 'cust_' || coalesce(CAST(ck AS VARCHAR), '')),
  '{{ ref("region_view") }}', 'region_view'), '{{ source(''raw_' || coalesce(st, '') || ''', "orders") }}', 'raw_' || coalesce(st, '') || '__orders'),
  '{{ source(''crm'', ''customers'') }}', 'crm__customers'), '{{ var(''n'') }}', 'unknown_macro')"""


@query("t3_stripped_sql", _C + f"SELECT project_id, name, md5({_STRIPPED}) AS digest FROM corpus")
def stripped_sql(spark, sf):
    plain_sql = templates.strip_templates(F.col("raw_sql"))
    return _models(spark, sf).select("project_id", "name", F.md5(plain_sql).alias("digest"))


@query(
    "t4_placeholders",
    _C + """SELECT project_id, name, 'raw_' || st || '__orders' AS placeholder, '{{ source(''raw_' || st || ''', "orders") }}' AS call FROM models WHERE kind = 'order'
    UNION ALL SELECT project_id, name, 'cust_' || ck, '{{ ref( ''cust_' || ck || ''' ) }}' FROM models WHERE kind = 'order'
    UNION ALL SELECT project_id, name, 'region_view', '{{ ref("region_view") }}' FROM models WHERE kind = 'order'
    UNION ALL SELECT project_id, name, 'crm__customers', '{{ source(''crm'', ''customers'') }}' FROM models WHERE kind = 'customer'""",
)
def placeholder_rows(spark, sf):
    return _models(spark, sf).select("project_id", "name", F.explode(templates.placeholders(F.col("raw_sql"))).alias("placeholder", "call"))


@query("t5_restored_sql", _C + "SELECT project_id, name, md5(replace(raw_sql, '{{ var(''n'') }}', 'unknown_macro')) AS digest FROM corpus")
def restored_sql(spark, sf):
    """Stripping and restoring gives the text back, but for tags that are neither ref nor source."""
    raw = F.col("raw_sql")
    # The commented ref and the literals hold no placeholder, so the round trip is exact.
    again = templates.restore(templates.strip_templates(raw), templates.placeholders(raw))
    return _models(spark, sf).select("project_id", "name", F.md5(again).alias("digest"))


@query(
    "t6_relation_names",
    _C + """SELECT project_id, name, 'raw_' || st || '.orders' AS relation FROM models WHERE kind = 'order'
    UNION ALL SELECT project_id, name, 'cust_' || ck FROM models WHERE kind = 'order'
    UNION ALL SELECT project_id, name, 'region_view' FROM models WHERE kind = 'order'
    UNION ALL SELECT project_id, name, 'crm.customers' FROM models WHERE kind = 'customer'""",
)
def relation_names(spark, sf):
    return placeholder_rows(spark, sf).select("project_id", "name", templates.relation_name(F.col("call")).alias("relation"))


@query("t9_join_types", _C + "SELECT name, CASE kind WHEN 'order' THEN 'LEFT,INNER' ELSE '' END AS join_types FROM models")
def join_types(spark, sf):
    return plain(_models(spark, sf).select("name", X.join_types(X.code_of(F.col("raw_sql"))).alias("join_types")))


@query(
    "t10_clause_profile",
    _C + """SELECT project_id, name AS model, CASE kind WHEN 'order' THEN 'base,joined' ELSE '' END AS cte_names,
      CASE kind WHEN 'order' THEN 'SUM,COUNT' ELSE '' END AS aggregate_functions, TRUE AS has_where_clause,
      kind = 'order' AS has_window_functions, CASE kind WHEN 'order' THEN 2 ELSE 0 END::BIGINT AS join_count FROM models""",
)
def clause_profile(spark, sf):
    found = D.clause_profile(_models(spark, sf))
    return plain(found.select("project_id", "model", "cte_names", "aggregate_functions", "has_where_clause", "has_window_functions", "join_count"))


@query(
    "t11_profile_metrics",
    _C + """SELECT project_id, name AS model, (CASE kind WHEN 'order' THEN 2 ELSE 0 END)::BIGINT AS cte_count,
      (CASE kind WHEN 'order' THEN 2 ELSE 0 END)::BIGINT AS join_count, coalesce(n, 0)::BIGINT AS output_column_count,
      (CASE kind WHEN 'order' THEN 3 ELSE 0 END)::BIGINT AS ref_dependency_count, 1::BIGINT AS source_dependency_count
      FROM models LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON kind = 'order' AND k = l_orderkey""",
)
def profile_metrics(spark, sf):
    """Projections are those of the line items, keyed by the order's model and project."""
    models = _models(spark, sf)
    made = I.raw_projections(spark, sf).drop("project_id").join(models.select("project_id", F.col("name").alias("model")), "model")
    return plain(D.profile_metrics(D.clause_profile(models), made))


@query(
    "j1_known_ref_edges",
    _REFS + "SELECT DISTINCT project_id, target_name AS src, model AS dst FROM refs SEMI JOIN (SELECT project_id, name AS target_name FROM models) USING (project_id, target_name)",
)
def known_ref_edges(spark, sf):
    models = _models(spark, sf)
    return D.known_ref_edges(models, D.model_dependencies(models)).select("project_id", "src", "dst")


_CYCLE_MODELS = """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 10 AS r FROM orders),
e AS (SELECT k AS src, CASE WHEN r < 4 THEN k + 1 WHEN r = 4 THEN k - 4 ELSE k - 5 END AS dst FROM k
      UNION ALL SELECT k, k + 10 FROM k WHERE k % 20 = 0
      UNION ALL SELECT k, k + 1 FROM k WHERE r BETWEEN 5 AND 8),
cyc AS (SELECT k FROM k WHERE r < 5 AND k - r + 4 <= (SELECT max(k) FROM k))
"""


def _cycle_models(spark, sf):
    """Models named after order keys whose refs are the cycle graph and ladders among its tails."""
    name = lambda c: F.format_string("m_%d", c)
    none = F.lit(None).cast("string")
    orders = I.table(spark, sf, "orders")
    models = orders.select(
        F.lit("loop").alias("project_id"), name("o_orderkey").alias("name"), F.lit("marts").alias("layer"), none.alias("model_group"),
        F.lit("view").alias("materialization"), none.alias("description"), F.array().cast("array<string>").alias("tags"),
        F.lit(0).cast("bigint").alias("test_count"), none.alias("owner"),
    )
    k = F.col("o_orderkey")
    ladders = orders.where((k % 10).between(5, 8)).select(k.alias("src"), (k + 1).alias("dst"))
    refs = I.cycle_edges(spark, sf).unionByName(ladders.join(orders.select(k.alias("dst")), "dst", "left_semi"))
    deps = refs.select(
        F.lit("loop").alias("project_id"), name("dst").alias("model"), F.lit("ref").alias("dependency_type"),
        name("src").alias("target_name"),
    )
    return models, deps


@query("g6_cyclic_models", _CYCLE_MODELS + "SELECT 'm_' || k AS model FROM cyc")
def cyclic_models(spark, sf):
    return D.cyclic_models(*_cycle_models(spark, sf))[0].select("model")


@query(
    "u2_cycle_warnings",
    _CYCLE_MODELS + """SELECT 'model_cycle' AS kind, 'Circular ref() dependency detected and excluded: 5 model(s) on cycles through ' || min('m_' || k) AS message
      FROM cyc GROUP BY k - k % 10""",
)
def cycle_warnings(spark, sf):
    return D.cyclic_models(*_cycle_models(spark, sf))[1].select("kind", "message")


@query("j2_models_without_cycles", _CYCLE_MODELS + "SELECT 'm_' || k AS name FROM k WHERE k NOT IN (SELECT k FROM cyc)")
def models_without_cycles(spark, sf):
    models, deps = _cycle_models(spark, sf)
    return D.drop_excluded(models, D.cyclic_models(models, deps)[0], "name").select("name")


def _made(models):
    """One final output of each model, and a column of an earlier step that is no output."""
    steps = F.explode(F.array(F.lit("final_select"), F.lit("cte:draft"))).alias("step_id")
    return models.select("project_id", F.col("name").alias("model"), steps)


@query(
    "g1_cyclic_dag_nodes",
    _CYCLE_MODELS + "SELECT 'm_' || k AS name, 1::BIGINT AS column_count FROM k WHERE k NOT IN (SELECT k FROM cyc)",
)
def cyclic_dag_nodes(spark, sf):
    models, deps = _cycle_models(spark, sf)
    return D.model_dag(models, deps, _made(models))[0].select("name", "column_count")


@query(
    "g1_model_dag_edges",
    _CYCLE_MODELS + "SELECT 'm_' || src AS src, 'm_' || dst AS dst FROM e WHERE dst IN (SELECT k FROM k) AND src NOT IN (SELECT k FROM cyc) AND dst NOT IN (SELECT k FROM cyc)",
)
def cyclic_dag_edges(spark, sf):
    models, deps = _cycle_models(spark, sf)
    return D.model_dag(models, deps, _made(models))[1].select("src", "dst")


@query(
    "g1_model_dag_nodes",
    _C + """SELECT project_id, name, layer, model_group, coalesce(n, 0)::BIGINT AS column_count
      FROM models LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON kind = 'order' AND k = l_orderkey""",
)
def dag_nodes(spark, sf):
    models = _models(spark, sf)
    made = I.raw_projections(spark, sf).drop("project_id").join(models.select("project_id", F.col("name").alias("model")), "model")
    nodes, _, _ = D.model_dag(models, D.model_dependencies(models), made)
    return nodes.select("project_id", "name", "layer", "model_group", "column_count")


@query(
    "p10_group_scoped_dag_edges",
    _REFS + """SELECT project_id, target_name AS src, model AS dst FROM refs
      SEMI JOIN (SELECT project_id, name AS target_name FROM models WHERE model_group = 'machinery') USING (project_id, target_name)
      SEMI JOIN (SELECT project_id, name AS model FROM models WHERE model_group = 'machinery') USING (project_id, model)
      UNION ALL SELECT project_id, name, 'group:machinery' FROM models WHERE model_group = 'machinery'""",
)
def group_scoped(spark, sf):
    """Models of one group and the edges left inside it; refs that leave the group vanish."""
    models = _models(spark, sf)
    inside, deps = D.scope_to_group(models, D.model_dependencies(models), group="machinery")
    edges = D.known_ref_edges(inside, deps).select("project_id", "src", "dst")
    return edges.unionByName(inside.select("project_id", F.col("name").alias("src"), F.lit("group:machinery").alias("dst")))
