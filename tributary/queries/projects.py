"""Manifests, artifacts, project folders, fingerprints and contracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators import contracts, fingerprint, stored
from tributary.operators import dependencies as D
from tributary.queries import inputs as I
from tributary.queries.registry import plain, query
from tributary.scratch import Scratch
from tributary.sources import artifacts, files, manifest, sinks

_M = I.MANIFEST_SQL


def _parsed(spark, sf):
    return manifest.parse_manifests(I.manifest_documents(spark, sf))


def _accepted(spark, sf):
    return manifest.split_by_version(_parsed(spark, sf))[0]


def _nodes(spark, sf):
    return manifest.manifest_nodes(_accepted(spark, sf))


@query(
    "s1_manifest_nodes",
    _M + """SELECT project_id, name, resource_type FROM m, (VALUES ('stg_', 'model'), ('mart_', 'model'), ('t1', 'test'), ('t2', 'test')) t(prefix, resource_type),
      LATERAL (SELECT CASE resource_type WHEN 'model' THEN prefix || k ELSE prefix END AS name)""",
)
def manifest_nodes(spark, sf):
    return _nodes(spark, sf).select("project_id", "name", "resource_type")


@query(
    "s2_manifest_models",
    _M + """SELECT project_id, 'stg_' || k AS name, 'models/' || grp || '/staging/stg_' || k || '.sql' AS relative_path, 'staging' AS layer, grp AS model_group,
      'select raw ' || k AS raw_sql, FALSE AS compiled, 'view' AS materialization, 'db' AS database_name, 's_' || k AS alias, NULL AS description, '' AS tags, NULL AS owner, 1::BIGINT AS test_count FROM m
    UNION ALL SELECT project_id, 'mart_' || k, 'extra/marts/mart_' || k || '.sql', 'marts', NULL, 'select 1 from an.s_' || k, TRUE, 'table', NULL, 'm_' || k, 'order ' || k, 'b,a', 'cust_' || ck, 2 FROM m""",
)
def manifest_models(spark, sf):
    found = manifest.manifest_models(_nodes(spark, sf)).withColumnRenamed("database", "database_name")
    return plain(found.drop("unique_id", "schema_name", "mode"))


@query(
    "s3_manifest_dependencies",
    _M + """SELECT project_id, 'stg_' || k AS model, 0::BIGINT AS position, 'source' AS dependency_type, 'crm' AS source_name, 'customers' AS target_name FROM m
    UNION ALL SELECT project_id, 'stg_' || k, 1, 'source', 'crm', 'orders' FROM m
    UNION ALL SELECT project_id, 'mart_' || k, 0, 'ref', NULL, 'stg_' || k FROM m
    UNION ALL SELECT project_id, 'mart_' || k, 2, 'ref', NULL, 'ghost' FROM m""",
)
def manifest_dependencies(spark, sf):
    return plain(manifest.manifest_deps(_nodes(spark, sf)))


@query(
    "s4_manifest_sources",
    _M + """SELECT project_id, 'crm' AS source_name, 'db' AS database_name, 'raw_' || v AS schema_name, 'first' AS source_description, t.name AS table_name,
      CASE t.name WHEN 'orders' THEN 'orders_v' || v END AS identifier, CASE t.name WHEN 'customers' THEN 'buyers' END AS description,
      CASE t.name WHEN 'orders' THEN 'o_a,o_b' ELSE '' END AS columns FROM m, (VALUES ('orders'), ('customers')) t(name)""",
)
def manifest_sources(spark, sf):
    return plain(manifest.manifest_sources(_accepted(spark, sf)).withColumnRenamed("database", "database_name"))


@query(
    "s5_version_quarantine",
    _M + """SELECT project_id, CASE WHEN readable THEN 'unsupported_manifest_schema_version' ELSE 'manifest_parse_failed' END AS reason,
      CASE WHEN readable THEN 'Unsupported manifest schema version: ''https://schemas.example.com/manifest/v10.json''. Supported versions: [''v11'', ''v12'']'
        ELSE 'Failed to parse manifest JSON: ' || project_id END AS message FROM a WHERE NOT readable OR version = 'v10'""",
)
def version_quarantine(spark, sf):
    return manifest.split_by_version(_parsed(spark, sf))[1]


@query(
    "s6_model_roots",
    _M + "SELECT project_id, 'models/' || grp AS model_root FROM m UNION ALL SELECT project_id, 'extra/marts' FROM m",
)
def model_roots(spark, sf):
    return manifest.model_roots(_nodes(spark, sf))


@query("a1_test_counts", _M + "SELECT project_id, 'mart_' || k AS name, 2 AS test_count FROM m UNION ALL SELECT project_id, 'stg_' || k, 1 FROM m".replace("2 AS", "2::BIGINT AS"))
def test_counts(spark, sf):
    return manifest.test_counts(_nodes(spark, sf))


# Inventory: a project folder per customer, some hidden, skipped, nested or too deep.
_INVENTORY = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer)
"""


def _inventory(spark, sf):
    customers = I.table(spark, sf, "customer")
    where = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.format_string("n%d/.hidden/p%d", "c_nationkey", "c_custkey"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.format_string("n%d/target/p%d", "c_nationkey", "c_custkey"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.format_string("n%d/a/b/c/p%d", "c_nationkey", "c_custkey"))
        .otherwise(F.format_string("n%d/p%d", "c_nationkey", "c_custkey"))
    )
    names = F.array(*[F.lit(x) for x in ("dbt_project.yml", "models/a.sql", "dbt_packages/x/dbt_project.yml", "sub/inner/dbt_project.yml")])
    return customers.select(where.alias("folder"), F.explode(names).alias("file")).select(F.concat_ws("/", "folder", "file").alias("path"))


@query("s8_project_roots", _INVENTORY + "SELECT 'n' || n || '/p' || k AS relative_path, 'p' || k AS name FROM c WHERE s IN ('AUTOMOBILE', 'FURNITURE')")
def project_roots(spark, sf):
    return files.project_roots(_inventory(spark, sf))


@query(
    "s7_fleet_models",
    """SELECT 'f' || c_nationkey || '/p' || c_custkey AS project_id, f.name, f.layer FROM customer,
      (VALUES ('a', 'staging'), ('_b', 'staging'), ('c', 'unknown')) f(name, layer)""",
)
def fleet_models(spark, sf):
    """Files of one project per customer: model folders differ by customer, ``_`` names and empty files count, others don't."""
    customers = I.table(spark, sf, "customer")
    root = F.format_string("f%d/p%d", "c_nationkey", "c_custkey")
    folder = F.when(F.col("c_custkey") % 2 == 0, "models").otherwise("sql/core")
    found = [("dbt_project.yml", ""), ("@/staging/a.sql", "select 1"), ("@/staging/_b.sql", "select 2"), ("@/_base/c.sql", ""), ("other/d.sql", "select 3"), ("@/x.yml", "")]
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in found)))
    listed = customers.select(root.alias("root"), folder.alias("folder"), rows.alias("f"))
    inventory = listed.select(F.concat_ws("/", "root", F.replace("f.p", F.lit("@"), "folder")).alias("path"), F.col("f.t").alias("raw_sql"))
    assigned = files.assign_projects(inventory, files.project_roots(inventory.select("path")))
    folders = customers.select(root.alias("project_id"), folder.alias("model_root"))
    return files.fleet_models(assigned, folders).select("project_id", "name", "layer")


def _projects(spark, sf):
    accepted, rejected = manifest.split_by_version(_parsed(spark, sf))
    static = I.table(spark, sf, "orders").select(
        F.explode(F.array(F.format_string("shop_%d", "o_orderkey"), F.format_string("bare_%d", "o_orderkey"))).alias("project_id")
    )
    return artifacts.resolve_artifacts(accepted, rejected, static)


_PROJECTS = _M + """, pr AS (SELECT project_id, k, CASE WHEN readable AND version <> 'v10' THEN 'manifest' ELSE 'static' END AS mode,
    CASE WHEN NOT readable THEN 'manifest_parse_failed' WHEN version = 'v10' THEN 'unsupported_manifest_schema_version' ELSE 'found' END AS reason FROM a
  UNION ALL SELECT 'bare_' || k, k, 'static', 'not_generated' FROM a)
"""


@query("s9_resolved_artifacts", _PROJECTS + "SELECT project_id, mode, reason, CASE mode WHEN 'manifest' THEN 'postgres' END AS adapter_type FROM pr")
def resolved_artifacts(spark, sf):
    return _projects(spark, sf).select("project_id", "mode", "reason", "adapter_type")


@query(
    "s10_status_messages",
    _PROJECTS + """SELECT project_id, CASE WHEN mode = 'manifest' THEN 'success' WHEN reason = 'not_generated' THEN 'info' ELSE 'warning' END AS level,
      CASE reason WHEN 'found' THEN 'Using compiled artifacts from target/manifest.json.'
        WHEN 'not_generated' THEN 'target/manifest.json not found — using the static SQL parser.'
        WHEN 'manifest_parse_failed' THEN 'target/manifest.json could not be parsed — using the static SQL parser. Failed to parse manifest JSON: ' || project_id
        ELSE 'manifest.json schema version is not supported — using the static SQL parser. Unsupported manifest schema version: ''https://schemas.example.com/manifest/v10.json''. Supported versions: [''v11'', ''v12'']' END AS message
      FROM pr""",
)
def status_messages(spark, sf):
    return artifacts.status_messages(_projects(spark, sf))


@query(
    "s12_project_summary",
    _M + """, y AS (SELECT 'shop_' || l_orderkey AS project_id, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY ALL)
    SELECT project_id, CASE WHEN k IS NULL THEN 0 ELSE 2 END::BIGINT AS model_count, CASE WHEN k IS NULL THEN 0 ELSE 2 END::BIGINT AS source_table_count,
      coalesce(n, 0)::BIGINT AS yaml_file_count FROM m FULL JOIN y USING (project_id)""",
)
def project_summary(spark, sf):
    """Projects hold YAML files under both endings, files that only look like them, or nothing but YAML."""
    accepted = _accepted(spark, sf)
    ending = F.element_at(F.array(*map(F.lit, ("yml", "YAML", "yml.txt"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    inventory = I.table(spark, sf, "lineitem").select(
        F.format_string("shop_%d", "l_orderkey").alias("project_id"), F.format_string("models/_line_%d.%s", "l_linenumber", ending).alias("relative_path")
    )
    models = manifest.manifest_models(manifest.manifest_nodes(accepted))
    return sinks.project_summary(models, manifest.manifest_sources(accepted), files.yaml_files(inventory))


@query(
    "s9_chosen_models",
    _PROJECTS + """SELECT project_id, prefix || k AS name, CASE prefix WHEN 'stg_' THEN 'staging' ELSE 'marts' END AS layer, 'manifest' AS mode
      FROM pr, (VALUES ('stg_'), ('mart_')) t(prefix) WHERE mode = 'manifest'
    UNION ALL SELECT project_id, 'file_' || k, 'staging', 'static' FROM pr WHERE mode = 'static'""",
)
def chosen_models(spark, sf):
    """Models from the manifest where it can be used, from the SQL files elsewhere."""
    parsed = _parsed(spark, sf)
    accepted, rejected = manifest.split_by_version(parsed)
    found = I.table(spark, sf, "orders").select(
        F.explode(F.array(F.format_string("shop_%d", "o_orderkey"), F.format_string("bare_%d", "o_orderkey"))).alias("project_id"),
        F.format_string("models/staging/file_%d.sql", "o_orderkey").alias("relative_path"),
        F.lit("select 1").alias("raw_sql"),
    )
    static = files.sql_models(found)
    projects = artifacts.resolve_artifacts(accepted, rejected, static)
    from_manifests = manifest.manifest_models(manifest.manifest_nodes(accepted))
    return artifacts.choose_models(projects, from_manifests, static).select("project_id", "name", "layer", "mode")


def _corpus_projects(spark, sf):
    models = files.sql_models(I.sql_files(spark, sf))
    projects = I.table(spark, sf, "nation").select(
        F.format_string("nation_%d", "n_nationkey").alias("project_id"), F.lit("static").alias("mode"), F.lit("not_generated").alias("reason")
    )
    return models, projects


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(8))
_SUMS = " || ':' || ".join(["count(*)"] + [f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT)" for i in range(8)])


@query(
    "f1_lineage_fingerprint",
    I.CORPUS_SQL + f""", d AS (SELECT project_id, count(*) AS model_count, sha256({_SUMS}) AS fingerprint FROM (SELECT project_id, sha256(sha256(name) || sha256(raw_sql)) AS h FROM corpus) GROUP BY project_id)
    SELECT project_id, 'static' AS mode, 'not_generated' AS reason, model_count, fingerprint FROM d""",
)
def lineage_fingerprint(spark, sf):
    return fingerprint.lineage_fingerprint(*_corpus_projects(spark, sf))


_REF_WORDS = " || ',' || ".join(
    f"CAST(coalesce(sum(CAST('0x' || substr(sha256(t), {8 * i + 1}, 8) AS BIGINT)), 0) AS BIGINT)" for i in range(8)
)


@query(
    "f2_dag_fingerprint",
    I.CORPUS_SQL + f""", refs AS (SELECT project_id, name, unnest(CASE kind WHEN 'order' THEN ['draft_' || k, 'cust_' || ck, 'region_view'] ELSE [NULL] END) AS t FROM models),
    rw AS (SELECT project_id, name, {_REF_WORDS} AS r FROM refs GROUP BY ALL),
    h AS (SELECT project_id, sha256(sha256(name) || sha256(raw_sql) || repeat(sha256(''), 4) || sha256('0') || sha256(r)) AS h FROM corpus JOIN rw USING (project_id, name))
    SELECT project_id, count(*) AS model_count, sha256({_SUMS}) AS fingerprint FROM h GROUP BY project_id""",
)
def dag_fingerprint(spark, sf):
    models, projects = _corpus_projects(spark, sf)
    found = fingerprint.dag_fingerprint(models, D.model_dependencies(models), projects)
    return found.select("project_id", "model_count", "fingerprint")


@query(
    "f3_changed_projects",
    """SELECT 'nation_' || n_nationkey AS project_id, CASE WHEN n_regionkey = 0 THEN 'new' WHEN n_regionkey = 1 THEN 'removed' WHEN n_regionkey = 2 THEN 'changed' ELSE 'same' END AS change FROM nation""",
)
def changed_projects(spark, sf):
    """Stored and current keys differ by region: some projects are new, some gone, some edited."""
    models, projects = _corpus_projects(spark, sf)
    region = I.table(spark, sf, "nation").select(F.format_string("nation_%d", "n_nationkey").alias("project_id"), "n_regionkey")
    placed = models.join(region, "project_id")
    edited = placed.withColumn("raw_sql", F.when(F.col("n_regionkey") == 2, F.concat("raw_sql", F.lit(" -- v2"))).otherwise(F.col("raw_sql")))
    known = projects.join(region, "project_id")
    before = fingerprint.lineage_fingerprint(placed, known.where("n_regionkey <> 0"))
    current = fingerprint.lineage_fingerprint(edited, known.where("n_regionkey <> 1"))
    return fingerprint.changed_projects(before, current)


@query(
    "f3_rebuilt_graph",
    I.CORPUS_SQL + """SELECT project_id, 'cust_' || ck AS src, name AS dst FROM models JOIN nation ON project_id = 'nation_' || n_nationkey
      WHERE kind = 'order' AND n_regionkey <> 1 AND NOT (n_regionkey = 2 AND k % 2 = 0)""",
)
def rebuilt_graph(spark, sf):
    """A stored graph after a refresh: some projects are new, some gone, in some every other order lost its reference."""
    models, projects = _corpus_projects(spark, sf)
    region = I.table(spark, sf, "nation").select(F.format_string("nation_%d", "n_nationkey").alias("project_id"), "n_regionkey")
    placed, known = models.join(region, "project_id"), projects.join(region, "project_id")
    lost = (F.col("n_regionkey") == 2) & F.col("name").rlike("[02468]$")
    edited = placed.withColumn("raw_sql", F.when(lost, F.regexp_replace("raw_sql", r"ref\( 'cust_", "ref( 'gone_")).otherwise(F.col("raw_sql")))

    def builder(found):
        def build(todo):
            own = found.join(todo, "project_id", "left_semi")
            return D.known_ref_edges(own, D.model_dependencies(own))

        return build

    schema = T.StructType.fromDDL("project_id string, src string, dst string")
    store = stored.StoredGraph(spark, Scratch(spark, "rebuilt").path, schema)
    store.refresh(fingerprint.lineage_fingerprint(placed, known.where("n_regionkey <> 0")), builder(placed))
    store.refresh(fingerprint.lineage_fingerprint(edited, known.where("n_regionkey <> 1")), builder(edited))
    return store.rows()


@query("q1_not_null", "SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders) WHERE p IS NULL")
def not_null(spark, sf):
    orders = I.table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return contracts.not_null(orders, "p").select("o_orderkey")


@query("q2_unique", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique(spark, sf):
    return plain(contracts.unique(I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber"))


@query("q3_accepted_values", "SELECT event_type, count(*) AS occurrences FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY ALL")
def accepted_values(spark, sf):
    return contracts.accepted_values(I.table(spark, sf, "events"), "event_type", ["click", "view", "purchase"])


@query("q4_relationships", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT CASE WHEN p_size > 10 THEN p_partkey ELSE -p_partkey - 1 END FROM part)")
def relationships(spark, sf):
    """Line items whose part has no parent row once the keys of small parts are broken."""
    key = F.when(F.col("p_size") > 10, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1)
    parents = I.table(spark, sf, "part").select(key.alias("p_partkey"))
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return contracts.relationships(lines, "l_partkey", parents, "p_partkey").select("l_orderkey", "l_partkey")


@query(
    "q5_freshness",
    """SELECT event_type, CASE WHEN h > 48 THEN 'error' WHEN h > 24 THEN 'warn' ELSE 'pass' END AS status
      FROM (SELECT event_type, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600.0 AS h FROM events GROUP BY event_type)""",
)
def freshness(spark, sf):
    aged = contracts.freshness(I.table(spark, sf, "events"), "ts", dt.datetime(2024, 2, 1), by=("event_type",))
    return aged.select("event_type", "status")


@query(
    "q_contract_report",
    """SELECT 'orders.o_custkey has a customer' AS contract, count(*) AS failures FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'lineitem.l_orderkey has an order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'line keys are unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
      UNION ALL SELECT 'event types are known', count(*) FROM (SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view'))""",
)
def contract_report(spark, sf):
    orders, lines = I.table(spark, sf, "orders"), I.table(spark, sf, "lineitem")
    return contracts.report(
        [
            ("orders.o_custkey has a customer", contracts.relationships(orders, "o_custkey", I.table(spark, sf, "customer"), "c_custkey")),
            ("lineitem.l_orderkey has an order", contracts.relationships(lines, "l_orderkey", orders, "o_orderkey")),
            ("line keys are unique", contracts.unique(lines, "l_orderkey", "l_linenumber")),
            ("event types are known", contracts.accepted_values(I.table(spark, sf, "events"), "event_type", ["click", "error", "purchase", "signup", "view"])),
        ]
    )
