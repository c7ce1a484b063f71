"""Compiled manifests as tables.

A manifest is one JSON document per project. Documents come from files (one each, or one per line
for a large fleet) or from a text column; a document that cannot be read is a row with
``readable = false``, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import paths
from tributary.scratch import Scratch

# Manifest versions that can be read, and where the version is written.
SUPPORTED_VERSIONS = ("v11", "v12")
VERSION_PATTERN = r"manifest/(v\d+)\.json"
DEFAULT_ROOT = "models"
TARGET_FOLDER, MANIFEST_FILE = "target", "manifest.json"

SCHEMA = """
metadata STRUCT<dbt_schema_version: STRING, dbt_version: STRING, project_name: STRING, adapter_type: STRING>,
nodes MAP<STRING, STRUCT<
  resource_type: STRING, unique_id: STRING, name: STRING, path: STRING, original_file_path: STRING,
  database: STRING, schema: STRING, alias: STRING, tags: ARRAY<STRING>, description: STRING,
  meta: MAP<STRING, STRING>, config: STRUCT<materialized: STRING>, raw_code: STRING,
  compiled_code: STRING, compiled: BOOLEAN, depends_on: STRUCT<nodes: ARRAY<STRING>>>>,
sources MAP<STRING, STRUCT<
  source_name: STRING, name: STRING, identifier: STRING, database: STRING, schema: STRING,
  description: STRING, source_description: STRING, columns: MAP<STRING, STRUCT<name: STRING>>>>,
_corrupt STRING
"""


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``project_id, text`` of every ``target/manifest.json`` below ``path``; the project is the folder above ``target``.

    Other JSON files of a target folder, and manifests elsewhere, are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", MANIFEST_FILE)
    files = reader.load(path).where(F.col("path").endswith(f"/{TARGET_FOLDER}/{MANIFEST_FILE}"))
    project = F.left("path", F.length("path") - F.lit(len(f"/{TARGET_FOLDER}/{MANIFEST_FILE}")))
    return files.select(project.alias("project_id"), F.col("content").cast("string").alias("text"))


def read_manifest_lines(spark: SparkSession, path: str, id_path: str = "$.project_id") -> DataFrame:
    """``project_id, text`` of JSON lines, one manifest each, as a fleet's collector writes them.

    The id is the text at ``id_path`` of a line, never the file: lines of one file are different
    projects. A line without it (or that is no JSON) is a project of its own, named by a hash.
    """
    lines = spark.read.text(path)
    told = F.nullif(F.get_json_object("value", id_path), F.lit(""))
    own = F.concat(F.lit("line:"), F.sha2("value", 256))
    return lines.select(F.coalesce(told, own).alias("project_id"), F.col("value").alias("text"))


def parse_manifests(documents: DataFrame) -> DataFrame:
    """Parse ``project_id, text`` rows into ``readable``, ``version``, ``metadata, nodes, sources``.

    The result is stored, since every other table is drawn from it: the JSON text is read once and
    later reads only touch the parts they need.
    """
    parsed = F.from_json("text", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    version = F.coalesce("doc.metadata.dbt_schema_version", F.lit(""))
    tables = documents.select("project_id", parsed.alias("doc")).select(
        "project_id",
        (F.col("doc").isNotNull() & F.col("doc._corrupt").isNull()).alias("readable"),
        version.alias("schema_version"),
        F.regexp_extract(version, VERSION_PATTERN, 1).alias("version"),
        "doc.metadata",
        "doc.nodes",
        "doc.sources",
    )
    return Scratch(documents.sparkSession, "manifests").save(tables, "parsed")


def split_by_version(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted manifests, quarantine)``; the quarantine gives ``project_id, reason, message``."""
    good = F.col("readable") & F.col("version").isin(*SUPPORTED_VERSIONS)
    rejected = parsed.where(~good).select(
        "project_id",
        F.when(F.col("readable"), "unsupported_manifest_schema_version").otherwise("manifest_parse_failed").alias("reason"),
        F.when(
            F.col("readable"),
            F.format_string("Unsupported manifest schema version: '%s'. Supported versions: %s", "schema_version", F.lit(str(sorted(SUPPORTED_VERSIONS)))),
        )
        .otherwise(F.format_string("Failed to parse manifest JSON: %s", "project_id"))
        .alias("message"),
    )
    return parsed.where(good), rejected


def manifest_nodes(manifests: DataFrame) -> DataFrame:
    """All nodes, one row each: ``project_id`` and the node's fields.

    Stored with a column for each field, so that readers of a few fields (test counts, dependencies,
    model folders) do not read the SQL text.
    """
    nodes = manifests.select("project_id", F.explode(F.map_values("nodes")).alias("node")).select("project_id", "node.*")
    return Scratch(manifests.sparkSession, "manifest-nodes").save(nodes, "nodes")


def _id_part(unique_id: Column | str, position: int) -> Column:
    return F.element_at(F.split(unique_id, r"\."), position)


def test_counts(nodes: DataFrame) -> DataFrame:
    """Tests per model short name; a test on two models counts for both."""
    return (
        nodes.where("resource_type = 'test'")
        .select("project_id", F.explode("depends_on.nodes").alias("on"))
        .where(_id_part("on", 1) == "model")
        .groupBy("project_id", _id_part("on", -1).alias("name"))
        .agg(F.count(F.lit(1)).alias("test_count"))
    )


def manifest_models(nodes: DataFrame) -> DataFrame:
    """The ``models`` table of manifest projects."""
    blank = lambda c: F.nullif(c, F.lit(""))
    path = F.col("original_file_path")
    return (
        nodes.where("resource_type = 'model'")
        .join(test_counts(nodes), ["project_id", "name"], "left")
        .select(
            "project_id", "name", "unique_id",
            path.alias("relative_path"),
            paths.layer_of(path).alias("layer"),
            paths.group_of(path).alias("model_group"),
            F.coalesce(blank("compiled_code"), blank("raw_code"), F.lit("")).alias("raw_sql"),
            F.coalesce("compiled", F.lit(False)).alias("compiled"),
            F.col("config.materialized").alias("materialization"),
            "database", F.col("schema").alias("schema_name"), "alias",
            blank("description").alias("description"),
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
            F.col("meta")["owner"].alias("owner"),
            F.coalesce("test_count", F.lit(0)).alias("test_count"),
            F.lit("manifest").alias("mode"),
        )
    )


def manifest_deps(nodes: DataFrame) -> DataFrame:
    """The ``model_deps`` table of manifest projects, in declared order."""
    deps = nodes.where("resource_type = 'model'").select(
        "project_id", F.col("name").alias("model"), F.posexplode("depends_on.nodes").alias("position", "on")
    )
    kind = _id_part("on", 1)
    return deps.where(kind.isin("model", "source")).select(
        "project_id", "model", "position",
        F.when(kind == "model", "ref").otherwise("source").alias("dependency_type"),
        F.when(kind == "source", _id_part("on", -2)).alias("source_name"),
        _id_part("on", -1).alias("target_name"),
    )


def manifest_sources(manifests: DataFrame) -> DataFrame:
    """Source tables, one row each, with sorted column names.

    Database, schema and description are those of the source's first table by unique id.
    """
    tables = manifests.select("project_id", F.explode("sources").alias("unique_id", "s"))
    first = tables.groupBy("project_id", F.col("s.source_name").alias("source_name")).agg(
        F.min_by(F.struct("s.database", "s.schema", F.col("s.source_description").alias("description")), "unique_id").alias("head")
    )
    return (
        tables.select("project_id", "s.*")
        .join(first, ["project_id", "source_name"])
        .select(
            "project_id", "source_name",
            F.col("head.database").alias("database"),
            F.col("head.schema").alias("schema_name"),
            F.col("head.description").alias("source_description"),
            F.col("name").alias("table_name"), "identifier", "description",
            F.array_sort(F.coalesce(F.map_keys("columns"), F.array().cast("array<string>"))).alias("columns"),
        )
        .orderBy("project_id", "source_name", "table_name")
    )


def source_columns(sources: DataFrame, mode: str = "manifest") -> DataFrame:
    """The ``source_columns`` table: one row per declared column; a table without any keeps one row with a null column."""
    return sources.select(
        "project_id", "source_name", "table_name", "identifier", "schema_name",
        F.explode_outer("columns").alias("column"), F.lit(mode).alias("mode"),
    )


def model_roots(nodes: DataFrame) -> DataFrame:
    """Folders models live in, per project; ``models`` where none can be told."""
    full, path = F.col("original_file_path"), F.col("path")
    root = F.rtrim(F.substring(full, F.lit(1), F.length(full) - F.length(path)), F.lit("/"))
    models = nodes.where("resource_type = 'model'")
    told = models.where((path != "") & full.endswith(path)).select("project_id", root.alias("model_root")).where("model_root <> ''")
    told = told.distinct()
    rest = nodes.select("project_id").distinct().join(told, "project_id", "left_anti")
    return told.unionByName(rest.withColumn("model_root", F.lit(DEFAULT_ROOT))).orderBy("project_id", "model_root")
