"""Operator inputs derived from the given tables; the SQL twins build the same rows in DuckDB."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF = dt.date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(model: str, key, layer: str):
    return F.struct(
        F.lit(model).alias("model"), F.col(key).cast("string").alias("column") if isinstance(key, str) else key.alias("column"), F.lit(layer).alias("layer")
    )


# --- record graph: regions down to order priorities -------------------------------------------

LAYER = {
    "region": "unknown", "nation": "unknown", "customer": "staging", "supplier": "staging",
    "part": "staging", "orders": "intermediate", "priority": "marts",
}


def record_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Key edges ``src, dst`` of ``STRUCT<model, column, layer>``."""

    def link(df: DataFrame, up: tuple[str, str], down: tuple[str, str]) -> DataFrame:
        return df.select(node(up[0], up[1], LAYER[up[0]]).alias("src"), node(down[0], down[1], LAYER[down[0]]).alias("dst"))

    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.explode(
            F.array(
                F.struct(F.lit("supplier").alias("model"), F.col("l_suppkey").alias("k")),
                F.struct(F.lit("part").alias("model"), F.col("l_partkey").alias("k")),
            )
        ).alias("up"),
    ).distinct()
    used = lines.select(
        F.struct(F.col("up.model").alias("model"), F.col("up.k").cast("string").alias("column"), F.lit("staging").alias("layer")).alias("src"),
        node("orders", "l_orderkey", LAYER["orders"]).alias("dst"),
    )
    edges = link(table(spark, sf, "nation"), ("region", "n_regionkey"), ("nation", "n_nationkey"))
    for part in (
        link(table(spark, sf, "customer"), ("nation", "c_nationkey"), ("customer", "c_custkey")),
        link(table(spark, sf, "supplier"), ("nation", "s_nationkey"), ("supplier", "s_suppkey")),
        link(orders, ("customer", "o_custkey"), ("orders", "o_orderkey")),
        link(orders, ("orders", "o_orderkey"), ("priority", "o_orderpriority")),
        used,
    ):
        edges = edges.unionByName(part)
    return edges


def record_nodes(spark: SparkSession, sf: str) -> DataFrame:
    edges = record_edges(spark, sf)
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def region_targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(node("region", "r_regionkey", "unknown").alias("target"))


def priority_targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(node("priority", "o_orderpriority", "marts").alias("target")).distinct()


RECORD_SQL = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'region' AS s_model, CAST(n_regionkey AS VARCHAR) AS s_key, 'nation' AS d_model, CAST(n_nationkey AS VARCHAR) AS d_key FROM nation
    UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), 'customer', CAST(c_custkey AS VARCHAR) FROM customer
    UNION ALL SELECT 'nation', CAST(s_nationkey AS VARCHAR), 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier
    UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), 'orders', CAST(o_orderkey AS VARCHAR) FROM orders
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'priority', o_orderpriority FROM orders
    UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), 'orders', CAST(l_orderkey AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), 'orders', CAST(l_orderkey AS VARCHAR) FROM lineitem)
), e AS (
  SELECT s_model || '.' || s_key AS src, d_model || '.' || d_key AS dst FROM edges
), nodes AS (
  SELECT src AS node FROM e UNION SELECT dst FROM e
), regions AS (SELECT 'region.' || r_regionkey AS target FROM region
), priorities AS (SELECT DISTINCT 'priority.' || o_orderpriority AS target FROM orders
), down(target, node, depth) AS (
  SELECT target, target, 0 FROM regions
  UNION SELECT d.target, e.dst, d.depth + 1 FROM down d JOIN e ON e.src = d.node
), up(target, node, depth) AS (
  SELECT target, target, 0 FROM priorities
  UNION SELECT u.target, e.src, u.depth + 1 FROM up u JOIN e ON e.dst = u.node
), walk(node, level) AS (
  SELECT node, 0 FROM nodes
  UNION SELECT e.dst, w.level + 1 FROM walk w JOIN e ON e.src = w.node
), chain AS (SELECT target, node, min(depth) AS depth, max(depth) AS level FROM down GROUP BY ALL
), chain_up AS (SELECT target, node, min(depth) AS depth FROM up GROUP BY ALL)
"""


# --- cycles and chains ---------------------------------------------------------------------------


def cycle_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys in blocks of ten: a 5-cycle, tails into it, and bridges from even blocks."""
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    r = k % 10
    own = keys.select(k.alias("src"), F.when(r < 4, k + 1).when(r == 4, k - 4).otherwise(k - 5).alias("dst"))
    bridges = keys.where((k % 20) == 0).select(k.alias("src"), (k + 10).alias("dst"))
    return own.unionByName(bridges).join(keys.select(k.alias("dst")), "dst", "left_semi").select("src", "dst")


def two_way_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys in blocks of 64: edges between neighbours both ways, and from the seventh key on back."""
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k, place = F.col("k"), F.col("k") % 64
    near = F.when(place < 63, F.array(F.struct(k.alias("src"), (k + 1).alias("dst")), F.struct((k + 1).alias("src"), k.alias("dst"))))
    back = F.when(place < 57, F.array(F.struct((k + 7).alias("src"), k.alias("dst"))))
    edges = keys.select(F.explode(F.concat(F.coalesce(near, F.array()), F.coalesce(back, F.array()))).alias("e")).select("e.*")
    for end in ("src", "dst"):
        edges = edges.join(keys.select(k.alias(end)), end, "left_semi")
    return edges.select("src", "dst")


def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation turn to the next one."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select(
        F.struct("conv_id", "turn").alias("src"), F.struct("conv_id", F.col("next").alias("turn")).alias("dst")
    )


# --- SQL corpus: a model per order and per customer -----------------------------------------------

_ORDER_SQL = """-- model of order %1$d, don't join ref('draft_%1$d') here
with base as (
    select * from {{ source('raw_%2$s', "orders") }} where note <> 'left join x'
),
joined as (
    select b.order_id, sum(b.total) as total, count(distinct c.id) as buyers
    from base as b
    left join {{ ref( 'cust_%3$d' ) }} as c on b.customer_id = c.id
    inner join {{ ref("region_view") }} as r on r.id = c.region_id
    group by b.order_id
)
select *, row_number() over (order by total) as rn from joined /* limit {{ var('n') }} */
"""
_CUSTOMER_SQL = "select id, name from {{ source('crm', 'customers') }} as s where s.id = %1$d"


def sql_files(spark: SparkSession, sf: str) -> DataFrame:
    """``project_id, relative_path, raw_sql``; the project is the customer's nation."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    layer = F.when(F.col("o_orderstatus") == "F", "staging").when(F.col("o_orderstatus") == "O", "intermediate").otherwise("marts")
    of_orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.format_string("nation_%d", "c_nationkey").alias("project_id"),
        F.format_string("models/%s/%s/order_%d.sql", F.lower("c_mktsegment"), layer, "o_orderkey").alias("relative_path"),
        F.format_string(_ORDER_SQL, "o_orderkey", F.lower("o_orderstatus"), "o_custkey").alias("raw_sql"),
    )
    folder = F.when(F.col("c_acctbal") < 0, "other").otherwise("staging")
    of_customers = customers.select(
        F.format_string("nation_%d", "c_nationkey").alias("project_id"),
        F.format_string("models/%s/cust_%d.sql", folder, "c_custkey").alias("relative_path"),
        F.format_string(_CUSTOMER_SQL, "c_custkey").alias("raw_sql"),
    )
    return of_orders.unionByName(of_customers)


_S = chr(39)
_SQ = lambda text: text.replace(_S, _S + _S)
CORPUS_SQL = f"""
WITH c AS (SELECT 'nation_' || c_nationkey AS project_id, c_custkey, lower(c_mktsegment) AS seg, c_acctbal FROM customer),
o AS (SELECT c.project_id, o_orderkey, o_custkey, lower(o_orderstatus) AS st, seg,
        CASE o_orderstatus WHEN 'F' THEN 'staging' WHEN 'O' THEN 'intermediate' ELSE 'marts' END AS layer
      FROM orders JOIN c ON o_custkey = c_custkey),
models AS (
  SELECT project_id, 'order_' || o_orderkey AS name, 'models/' || seg || '/' || layer || '/order_' || o_orderkey || '.sql' AS relative_path,
    layer, seg AS model_group, 'order' AS kind, o_orderkey AS k, o_custkey AS ck, st,
    '{_SQ(_ORDER_SQL).replace("%1$d", "@1").replace("%2$s", "@2").replace("%3$d", "@3")}' AS tpl
  FROM o
  UNION ALL
  SELECT project_id, 'cust_' || c_custkey, 'models/' || CASE WHEN c_acctbal < 0 THEN 'other' ELSE 'staging' END || '/cust_' || c_custkey || '.sql',
    CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'staging' END, NULL, 'customer', c_custkey, NULL, NULL,
    '{_SQ(_CUSTOMER_SQL).replace("%1$d", "@1")}'
  FROM c),
corpus AS (SELECT * EXCLUDE (tpl), replace(replace(replace(tpl, '@1', CAST(k AS VARCHAR)), '@2', coalesce(st, '')), '@3', coalesce(CAST(ck AS VARCHAR), '')) AS raw_sql FROM models)
"""


# --- projections: one output column per line item --------------------------------------------------

# Expression templates by kind; %1$d is the order key, %2$d the line number, %3$d the part key.
TEMPLATES = (
    ("constant", "'s.total + over (%3$d)'", "c_%2$d_%3$d", ""),
    ("window", "sum(s.amount) over (partition by s.owner_id order by s.day)", "w_%2$d_%3$d", "s.amount,s.owner_id,s.day"),
    ("conditional", "case when s.status = 'case' then s.amount else 0 end", "k_%2$d_%3$d", "s.status,s.amount"),
    ("cast", "cast(coalesce(s.amount, 0) as numeric(18, 2))", "n_%2$d_%3$d", "s.amount"),
    ("aggregate", "sum(s.amount * t.rate_%2$d)", "a_%2$d_%3$d", "s.amount,t.rate_%2$d"),
    ("direct", "s.part_%3$d", "part_%3$d", "s.part_%3$d"),
    ("rename", "t.part_%3$d", "r_%2$d_%3$d", "t.part_%3$d"),
    ("calculated", "(s.amount - t.amount) / nullif(amount_total, 0)", "m_%2$d_%3$d", "s.amount,t.amount,amount_total"),
    ("unknown", "note_%2$d || '-' || s.status", "u_%2$d_%3$d", "note_%2$d,s.status"),
)


def raw_projections(spark: SparkSession, sf: str) -> DataFrame:
    """``project_id, model, step_id, position, output_name, expression``, unclassified."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    kind = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(TEMPLATES)).cast("int")

    def pick(index: int):
        text = None
        for n, template in enumerate(TEMPLATES):
            made = F.format_string(template[index], *keys)
            text = F.when(kind == n, made) if text is None else text.when(kind == n, made)
        return text

    return lines.select(
        F.lit("shop").alias("project_id"),
        F.format_string("order_%d", "l_orderkey").alias("model"),
        F.lit("final_select").alias("step_id"),
        F.col("l_linenumber").alias("position"),
        pick(2).alias("output_name"),
        pick(1).alias("expression"),
    )


def projection_models(spark: SparkSession, sf: str) -> DataFrame:
    """One model per order and per customer in the project ``shop``."""
    orders = table(spark, sf, "orders")
    layer = F.when(F.col("o_orderstatus") == "F", "staging").when(F.col("o_orderstatus") == "O", "intermediate").otherwise("marts")
    none = F.lit(None).cast("string")
    of_orders = orders.select(
        F.lit("shop").alias("project_id"), F.format_string("order_%d", "o_orderkey").alias("name"), layer.alias("layer"),
        F.lower("o_orderpriority").alias("model_group"), F.format_string("Order of %s", F.col("o_custkey").cast("string")).alias("description"),
        F.format_string("team_%d", "o_custkey").alias("owner"), F.array(F.lit("b"), F.lit("a")).alias("tags"),
        F.col("o_orderkey").alias("test_count"),
        F.lit("view").alias("materialization"),
        F.lit("db").alias("database"), F.lit("an").alias("schema_name"), F.format_string("t_%d", "o_orderkey").alias("alias"),
        F.lit("manifest").alias("mode"),
    )
    of_customers = table(spark, sf, "customer").select(
        F.lit("shop").alias("project_id"), F.format_string("cust_%d", "c_custkey").alias("name"), F.lit("staging").alias("layer"),
        none.alias("model_group"), none.alias("description"), none.alias("owner"), F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast("bigint").alias("test_count"), F.lit("table").alias("materialization"),
        none.alias("database"), F.when(F.col("c_acctbal") >= 0, "an").alias("schema_name"),
        F.format_string("c_%d", "c_custkey").alias("alias"), F.lit("manifest").alias("mode"),
    )
    return of_orders.unionByName(of_customers)


def projection_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """``s`` is the buyer's model under its full or bare name, ``t`` a source table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    step = [F.lit("shop").alias("project_id"), F.format_string("order_%d", "o_orderkey").alias("model"), F.lit("final_select").alias("step_id")]
    buyer = F.when(F.col("o_orderstatus") == "F", F.format_string("an.c_%d", "o_custkey")).otherwise(F.format_string("cust_%d", "o_custkey"))
    s = orders.select(*step, F.lit("s").alias("alias"), buyer.alias("relation"))
    t = orders.select(*step, F.lit("t").alias("alias"), F.lit("raw.rates").alias("relation"))
    return s.unionByName(t)


def projection_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Declared source columns: the rates table per part, and one table without a schema."""
    none = F.lit(None).cast("string")
    parts = table(spark, sf, "part").select(
        F.lit("shop").alias("project_id"), F.lit("raw").alias("source_name"), F.lit("rates_table").alias("table_name"),
        F.lit("rates").alias("identifier"), F.lit("raw").alias("schema_name"),
        F.explode(F.array(F.format_string("part_%d", "p_partkey"), F.lit("amount_total"))).alias("column"),
        F.lit("manifest").alias("mode"),
    )
    loose = table(spark, sf, "supplier").select(
        F.lit("shop").alias("project_id"), F.lit("loose").alias("source_name"), F.format_string("sup_%d", "s_suppkey").alias("table_name"),
        none.alias("identifier"), none.alias("schema_name"), F.lit("id").alias("column"), F.lit("manifest").alias("mode"),
    )
    return parts.distinct().unionByName(loose)


def _case(index: int) -> str:
    arms = []
    for n, template in enumerate(TEMPLATES):
        text = template[index].replace(_S, _S + _S)
        for mark, column in (("%1$d", "l_orderkey"), ("%2$d", "l_linenumber"), ("%3$d", "l_partkey")):
            text = text.replace(mark, f"' || {column} || '")
        arms.append(f"WHEN {n} THEN '{text}'")
    return f"CASE (l_orderkey + l_linenumber) % {len(TEMPLATES)} " + " ".join(arms) + " END"


PROJECTION_SQL = f"""
WITH p AS (SELECT l_orderkey, l_linenumber AS position, l_partkey, 'order_' || l_orderkey AS model,
    {_case(0)} AS transformation_type, {_case(1)} AS expression, {_case(2)} AS output_name, {_case(3)} AS refs
  FROM lineitem),
o AS (SELECT o_orderkey, o_custkey, 'order_' || o_orderkey AS model, o_orderstatus, o_orderpriority,
    CASE o_orderstatus WHEN 'F' THEN 'staging' WHEN 'O' THEN 'intermediate' ELSE 'marts' END AS layer FROM orders),
r AS (SELECT p.*, unnest(string_split(refs, ',')) AS ref FROM p WHERE refs <> ''),
owned AS (SELECT r.*, o.layer AS own_layer, string_split(ref, '.')[-1] AS src_column,
    CASE WHEN ref LIKE 's.%' AND (o_orderstatus <> 'F' OR c_acctbal >= 0) THEN 'cust_' || o_custkey
         WHEN ref LIKE 's.%' THEN 'an.c_' || o_custkey
         WHEN ref LIKE 't.%' OR ref = 'amount_total' THEN 'raw.rates' END AS src_model
  FROM r JOIN o USING (model) JOIN customer ON o_custkey = c_custkey),
edges AS (SELECT src_model, src_column, CASE WHEN src_model LIKE 'cust%' THEN 'staging' ELSE 'unknown' END AS src_layer,
    model AS dst_model, output_name AS dst_column, own_layer AS dst_layer, transformation_type, expression
  FROM owned WHERE src_model IS NOT NULL GROUP BY ALL)
"""


# --- manifests: one project per order ---------------------------------------------------------------

_MANIFEST = """{"metadata": {"dbt_schema_version": "https://schemas.example.com/manifest/%2$s.json", "project_name": "shop_%1$d", "adapter_type": "postgres"},
"nodes": {
 "model.shop.stg_%1$d": {"resource_type": "model", "unique_id": "model.shop.stg_%1$d", "name": "stg_%1$d", "path": "staging/stg_%1$d.sql",
  "original_file_path": "models/%3$s/staging/stg_%1$d.sql", "database": "db", "schema": "an", "alias": "s_%1$d", "tags": [], "description": "",
  "config": {"materialized": "view"}, "raw_code": "select raw %1$d", "compiled_code": "", "compiled": false,
  "depends_on": {"macros": ["macro.m"], "nodes": ["source.shop.crm.customers", "source.shop.crm.orders"]}},
 "model.shop.mart_%1$d": {"resource_type": "model", "unique_id": "model.shop.mart_%1$d", "name": "mart_%1$d", "path": "mart_%1$d.sql",
  "original_file_path": "extra/marts/mart_%1$d.sql", "schema": "an", "alias": "m_%1$d", "tags": ["b", "a"], "description": "order %1$d",
  "meta": {"owner": "cust_%4$d", "level": 3}, "config": {"materialized": "table"}, "raw_code": "select x", "compiled_code": "select 1 from an.s_%1$d", "compiled": true,
  "depends_on": {"nodes": ["model.shop.stg_%1$d", "seed.shop.s", "model.shop.ghost"]}},
 "test.shop.t1": {"resource_type": "test", "name": "t1", "depends_on": {"nodes": ["model.shop.mart_%1$d"]}},
 "test.shop.t2": {"resource_type": "test", "name": "t2", "depends_on": {"nodes": ["model.shop.mart_%1$d", "model.shop.stg_%1$d"]}}},
"sources": {
 "source.shop.crm.orders": {"source_name": "crm", "name": "orders", "identifier": "orders_v%5$d", "database": "late", "schema": "late", "source_description": "late", "columns": {"o_b": {"name": "o_b"}, "o_a": {"name": "o_a"}}},
 "source.shop.crm.customers": {"source_name": "crm", "name": "customers", "database": "db", "schema": "raw_%5$d", "source_description": "first", "description": "buyers", "columns": {}}}%6$s"""


def manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``project_id, text``: status P has an old version, large orders a truncated document."""
    orders = table(spark, sf, "orders")
    version = F.when(F.col("o_orderstatus") == "F", "v12").when(F.col("o_orderstatus") == "O", "v11").otherwise("v10")
    end = F.when(F.col("o_totalprice") < 450000, "}").otherwise("")
    return orders.select(
        F.format_string("shop_%d", "o_orderkey").alias("project_id"),
        F.format_string(
            _MANIFEST, "o_orderkey", version, F.lower(F.regexp_replace("o_orderpriority", "[^A-Z]", "")), "o_custkey",
            F.pmod("o_custkey", F.lit(7)), end,
        ).alias("text"),
    )


MANIFEST_SQL = """
WITH a AS (SELECT o_orderkey AS k, 'shop_' || o_orderkey AS project_id, o_custkey AS ck, o_custkey % 7 AS v, lower(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g')) AS grp,
    CASE o_orderstatus WHEN 'F' THEN 'v12' WHEN 'O' THEN 'v11' ELSE 'v10' END AS version, o_totalprice < 450000 AS readable FROM orders),
m AS (SELECT * FROM a WHERE readable AND version <> 'v10')
"""
