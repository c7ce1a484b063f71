"""Manifests, SQL files and project folders from real files."""

import json

import pytest
from pyspark.sql import functions as F

from tributary.operators import fingerprint, stored
from tributary.sources import artifacts, files, lister, manifest, sinks

V = "https://schemas.example.com/manifest/%s.json"


def model(name, path, **extra):
    return {"resource_type": "model", "unique_id": f"model.p.{name}", "name": name, "path": path.split("/", 1)[1], "original_file_path": path,
            "depends_on": {"nodes": []}, **extra}


def write_project(root, name, version="v12", nodes=None, sources=None, text=None):
    target = root / name / "target"
    target.mkdir(parents=True)
    body = {"metadata": {"dbt_schema_version": V % version, "project_name": name, "adapter_type": "postgres"}, "nodes": nodes or {}, "sources": sources or {}}
    (target / "manifest.json").write_text(json.dumps(body, indent=1) if text is None else text)


def test_manifest_tables_from_files(spark, tmp_path):
    nodes = {
        "model.p.a": model("a", "models/shop/staging/a.sql", compiled_code="", raw_code="raw a", description="", meta={"owner": "me", "deep": {"x": [1]}}),
        "model.p.b": model("b", "models/marts/b.sql", compiled_code="compiled b", raw_code="raw b", tags=["z", "y"], description="B", compiled=True,
                           config={"materialized": "table"}, depends_on={"nodes": ["model.p.a", "source.p.s.t", "seed.p.x"]}),
        "test.p.t": {"resource_type": "test", "name": "t", "depends_on": {"nodes": ["model.p.a", "model.p.b", "macro.x"]}},
        "test.p.u": {"resource_type": "test", "name": "u", "depends_on": {"nodes": ["model.p.b"]}},
    }
    sources = {
        "source.p.s.t": {"source_name": "s", "name": "t", "identifier": "tt", "schema": "late", "database": "late", "columns": {"b": {}, "a": {"name": "a"}}},
        "source.p.s.a": {"source_name": "s", "name": "a", "schema": "first", "database": "d", "source_description": "S"},
    }
    write_project(tmp_path, "good", nodes=nodes, sources=sources)
    write_project(tmp_path, "old", version="v9")
    write_project(tmp_path, "broken", text='{"metadata": {"dbt_schema')
    write_project(tmp_path, "empty", text="\n")
    write_project(tmp_path, "list", text="[1, 2]")
    documents = manifest.read_manifests(spark, str(tmp_path)).withColumn("project_id", F.element_at(F.split("project_id", "/"), -1))
    accepted, rejected = manifest.split_by_version(manifest.parse_manifests(documents))
    assert {(r.project_id, r.reason) for r in rejected.collect()} == {
        ("old", "unsupported_manifest_schema_version"), ("broken", "manifest_parse_failed"),
        ("empty", "manifest_parse_failed"), ("list", "manifest_parse_failed"),
    }
    rows = manifest.manifest_nodes(accepted)
    models = {r.name: r for r in manifest.manifest_models(rows).collect()}
    a, b = models["a"], models["b"]
    assert (a.raw_sql, a.description, a.tags, a.owner, a.test_count, a.model_group, a.compiled) == ("raw a", None, [], "me", 1, "shop", False)
    assert (b.raw_sql, b.description, b.tags, b.owner, b.test_count, b.layer, b.materialization) == ("compiled b", "B", ["z", "y"], None, 2, "marts", "table")
    deps = [(r.model, r.dependency_type, r.source_name, r.target_name) for r in manifest.manifest_deps(rows).orderBy("position").collect()]
    assert deps == [("b", "ref", None, "a"), ("b", "source", "s", "t")]
    tables = [(r.table_name, r.identifier, r.schema_name, r.database, r.columns) for r in manifest.manifest_sources(accepted).collect()]
    assert tables == [("a", None, "first", "d", []), ("t", "tt", "first", "d", ["a", "b"])]
    assert [r.model_root for r in manifest.model_roots(rows).collect()] == ["models"]

    static = spark.createDataFrame([(p,) for p in ("good", "old", "broken", "bare", "list", "empty")], "project_id string")
    projects = artifacts.resolve_artifacts(accepted, rejected, static)
    assert {(r.project_id, r.mode, r.reason) for r in projects.collect()} >= {
        ("good", "manifest", "found"), ("bare", "static", "not_generated"), ("broken", "static", "manifest_parse_failed")
    }
    told = {r.project_id: (r.level, r.message) for r in artifacts.status_messages(projects).collect()}
    assert told["good"] == ("success", "Using compiled artifacts from target/manifest.json.")
    assert told["bare"][0] == "info" and told["old"][0] == "warning"
    assert told["old"][1].endswith("Supported versions: ['v11', 'v12']")
    summary = sinks.project_summary(manifest.manifest_models(rows), manifest.manifest_sources(accepted)).first()
    assert (summary.model_count, summary.source_table_count, summary.yaml_file_count) == (2, 2, 0)


def test_one_manifest_per_line(spark, tmp_path):
    body = {"metadata": {"dbt_schema_version": V % "v11"}, "nodes": {}, "sources": {}}
    lines = [json.dumps(body | {"project_id": p}) for p in ("a", "b")] + [json.dumps(body), "no json"]
    (tmp_path / "all.json").write_text("\n".join(lines))
    parsed = manifest.parse_manifests(manifest.read_manifest_lines(spark, str(tmp_path)))
    accepted, rejected = manifest.split_by_version(parsed)
    ids = [r.project_id for r in accepted.collect()]
    assert len(set(ids)) == 3 and {"a", "b"} < set(ids) and rejected.count() == 1


def test_only_the_manifest_of_a_target_folder_is_read(spark, tmp_path):
    write_project(tmp_path, "shop")
    for name in ("run_results.json", "catalog.json"):
        (tmp_path / "shop" / "target" / name).write_text("{}")
    (tmp_path / "shop" / "manifest.json").write_text("{}")
    found = [r.project_id for r in manifest.read_manifests(spark, str(tmp_path)).collect()]
    assert [f.rsplit("/", 1)[1] for f in found] == ["shop"]


def test_only_the_leading_root_is_cut(spark):
    rows = spark.createDataFrame([("file:/data/shop/data/models/a.sql",), ("/other/data/b.sql",)], "path string")
    cut = [r.p for r in rows.select(files.relative_to(spark, "/data", "path").alias("p")).collect()]
    assert cut == ["shop/data/models/a.sql", "/other/data/b.sql"]


def test_fields_cannot_move_in_fingerprints(spark):
    projects = spark.createDataFrame([("p", "static", "not_generated")], "project_id string, mode string, reason string")
    deps = spark.createDataFrame([], "project_id string, model string, dependency_type string, target_name string")
    one = models_frame(spark, [("p", "a", "s", "view:x", "y", ["b,c"], None, 0)])
    two = models_frame(spark, [("p", "a", "s", "view", "x:y", ["b", "c"], None, 0)])
    digests = [fingerprint.dag_fingerprint(m, deps, projects).first().fingerprint for m in (one, two)]
    assert digests[0] != digests[1]


def test_inner_steps_are_no_outputs(spark):
    from tributary.operators import catalog, dependencies

    rows = [("p", "m", "cte:a", 1, "inner", "x.inner", "direct", ["x.inner"]), ("p", "m", "final_select", 1, "out", "a.out", "direct", ["a.out"])]
    kinds = "project_id string, model string, step_id string, position int, output_name string, expression string, transformation_type string, referenced array<string>"
    made = spark.createDataFrame(rows, kinds)
    models = spark.createDataFrame([("p", "m", "marts", None, None, None, None)], "project_id string, name string, layer string, description string, owner string, tags array<string>, test_count bigint")
    assert [r.column for r in catalog.feature_index(made, models).collect()] == ["out"]
    assert [r.output_name for r in catalog.filter_columns(made, "").collect()] == ["out"]
    assert [r.column_count for r in dependencies.column_counts(made).collect()] == [1]


def test_names_of_two_projects_stay_apart(spark):
    from tributary.operators import catalog

    kind = "project_id string, node struct<model:string,column:string,layer:string>"
    nodes = spark.createDataFrame([("p1", ("a", "id", "marts")), ("p2", ("a", "id", "marts"))], kind)
    assert catalog.search_index(nodes).count() == 2
    wanted = spark.createDataFrame([("id", "a")], "column string, model string")
    status, found = catalog.resolve_targets(nodes, wanted)
    assert status.first().status == "ambiguous" and {r.project_id for r in found.collect()} == {"p1", "p2"}


def test_copies_beyond_one_list(spark, monkeypatch):
    from tributary.plans import lending

    monkeypatch.setattr(lending, "_RUN", 3)
    rows = spark.createDataFrame([(1, 7), (2, 1), (3, 3)], "application_id long, copies long")
    assert sorted(r.application_id for r in lending.repeat_copies(rows).collect()) == [1] * 7 + [2] + [3] * 3


def test_sql_files(spark, tmp_path):
    for path in ("models/staging/a b.sql", "models/x/marts/b.sql", "other/c.sql", "models/staging/readme.md"):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("select 1\nfrom {{ ref('a') }}")
    found = files.sql_models(files.read_sql_files(spark, str(tmp_path), "p"))
    assert sorted((r.name, r.relative_path, r.layer, r.model_group) for r in found.collect()) == [
        ("a b", "models/staging/a b.sql", "staging", None), ("b", "models/x/marts/b.sql", "marts", "x")
    ]
    assert found.first().raw_sql == "select 1\nfrom {{ ref('a') }}"


def test_project_roots(spark, tmp_path):
    for path in ("a", "b/c", "b/c/d", "b/target/e", ".git/f", "1/2/3/4", "1/2/3/4b/5", "b/node_modules/x/y"):
        (tmp_path / path).mkdir(parents=True, exist_ok=True)
        (tmp_path / path / "dbt_project.yml").write_text("name: 'named'\n" if path == "a" else "version: 2\n")
    inventory = files.file_inventory(spark, str(tmp_path))
    assert [r.relative_path for r in files.project_roots(inventory).collect()] == ["1/2/3/4", "a", "b/c"]
    with_text = inventory.withColumn("content", F.when(F.col("path") == "a/dbt_project.yml", "version: 1\nname: 'named' # x"))
    assert {(r.relative_path, r.name) for r in files.project_roots(with_text).collect()} == {("1/2/3/4", "4"), ("a", "named"), ("b/c", "c")}
    shallow = files.project_roots(inventory, max_depth=1)
    assert [r.relative_path for r in shallow.collect()] == ["a"]
    at_root = inventory.unionByName(spark.createDataFrame([("dbt_project.yml",)], "path string"))
    assert [r.relative_path for r in files.project_roots(at_root).collect()] == [""]


def models_frame(spark, rows):
    schema = "project_id string, name string, raw_sql string, materialization string, description string, tags array<string>, owner string, test_count bigint"
    return spark.createDataFrame(rows, schema)


def test_fingerprints(spark):
    base = [("p", "a", "select 1", None, None, ["x", "y"], None, 0), ("p", "b", "select 2", "view", "d", [], "o", 1)]
    projects = spark.createDataFrame([("p", "static", "not_generated"), ("none", "static", "not_generated")], "project_id string, mode string, reason string")
    deps = spark.createDataFrame([("p", "b", "ref", "a"), ("p", "b", "ref", "c")], "project_id string, model string, dependency_type string, target_name string")

    def keys(rows, d=deps):
        m = models_frame(spark, rows)
        take = lambda df: {r.project_id: r.fingerprint for r in df.collect()}["p"]
        return take(fingerprint.lineage_fingerprint(m, projects)), take(fingerprint.dag_fingerprint(m, d, projects))

    first = keys(base)
    assert keys(base[::-1], deps.orderBy("target_name", ascending=False)) == first
    retagged = keys([("p", "a", "select 1", None, None, ["y", "x"], None, 0), base[1]])
    assert retagged == first
    owner = keys([("p", "a", "select 1", None, None, ["x", "y"], "new", 0), base[1]])
    assert owner[0] == first[0] and owner[1] != first[1]
    edited = keys([("p", "a", "select 1 ", None, None, ["x", "y"], None, 0), base[1]])
    assert edited[0] != first[0] and edited[1] != first[1]
    fewer_refs = keys(base, deps.where("target_name = 'a'"))
    assert fewer_refs[0] == first[0] and fewer_refs[1] != first[1]
    assert keys(base[:1])[0] != first[0]
    old = fingerprint.lineage_fingerprint(models_frame(spark, base), projects)
    new = fingerprint.lineage_fingerprint(models_frame(spark, base[:1]), projects.unionByName(projects.limit(1).withColumn("project_id", F.lit("q"))))
    assert {(r.project_id, r.change) for r in fingerprint.changed_projects(old, new).collect()} == {("p", "changed"), ("none", "same"), ("q", "new")}


def test_payload_round_trip(spark, tmp_path):
    from tributary.operators import graph

    kind = "struct<model:string,column:string,layer:string>"
    edges = spark.createDataFrame(
        [(("r", "id", "unknown"), ("s", "id", "staging"), "direct", "id")], f"src {kind}, dst {kind}, transformation_type string, expression_sql string"
    )
    goal = spark.createDataFrame([(("r", "id", "unknown"),)], f"target {kind}")
    chain = graph.downstream(edges, goal)
    notes = spark.createDataFrame([("careful",)], "message string")
    payload = sinks.lineage_payload(chain, edges, graph.DOWNSTREAM, notes, impact=True)
    sinks.write_payload(payload, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    counts = {r.section: r["count"] for r in back.groupBy("section").count().collect()}
    assert counts == {"target": 1, "chain": 2, "edges": 1, "lineage_warnings": 1, "direct": 1, "all_impacted": 1}


def test_a_payload_works_its_chain_out_once(spark):
    from tributary.operators import graph

    kind = "struct<model:string,column:string,layer:string>"
    edge = "src {0}, dst {0}, transformation_type string, expression_sql string".format(kind)
    raw, stg, mart = ("r", "id", "unknown"), ("s", "id", "staging"), ("m", "id", "marts")
    edges = spark.createDataFrame([(raw, stg, "direct", "id"), (stg, mart, "direct", "id")], edge)
    rows = spark.createDataFrame([(raw, [(raw, 0), (stg, 1), (mart, 2)])], f"target {kind}, reached array<struct<node:{kind},depth:int>>")
    chain = rows.select("target", F.explode("reached").alias("r")).select("target", "r.node", "r.depth")
    payload = sinks.lineage_payload(chain, edges, graph.DOWNSTREAM, impact=True)
    assert "Generate" not in payload._jdf.queryExecution().optimizedPlan().toString()
    counts = {r.section: r["count"] for r in payload.groupBy("section").count().collect()}
    assert counts == {"target": 1, "chain": 3, "edges": 2, "direct": 1, "all_impacted": 2}


def write_tree(root, paths):
    for path, text in paths.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_listed_files(spark, tmp_path):
    write_tree(tmp_path / "a", {
        "models/_hidden.sql": "select 1", "models/.dot.sql": "select 2", "models/empty.sql": "", "models/UP.SQL": "select 3",
        "models/_models.yml": "version: 2", ".ci/x.YAML": "", "models/x.yml.txt": "", "target/run/old.sql": "select 4", "readme.md": "é",
    })
    write_tree(tmp_path / "b", {"deep/er/m.sql": "select 'ü'"})
    roots = [str(tmp_path / "a"), str(tmp_path / "b") + "/", str(tmp_path / "missing")]
    listed = lister.listed_files(spark, roots)
    assert listed.rdd.getNumPartitions() == 3
    found = {(r.root, r.path): (r.bytes, r.content) for r in listed.collect()}
    assert set(p for _, p in found) == {
        "models/_hidden.sql", "models/.dot.sql", "models/empty.sql", "models/UP.SQL", "models/_models.yml", ".ci/x.YAML",
        "models/x.yml.txt", "readme.md", "deep/er/m.sql",
    }
    assert found[roots[0], "readme.md"] == (2, None)
    sql = {(r.project_id, r.relative_path): r.raw_sql for r in lister.sql_files(spark, roots).collect()}
    assert sql == {
        (roots[0], "models/_hidden.sql"): "select 1", (roots[0], "models/.dot.sql"): "select 2", (roots[0], "models/empty.sql"): "",
        (roots[0], "models/UP.SQL"): "select 3", (roots[1], "deep/er/m.sql"): "select 'ü'",
    }
    yaml = files.yaml_files(listed.selectExpr("root AS project_id", "path AS relative_path")).groupBy("project_id").count()
    assert [tuple(r) for r in yaml.collect()] == [(roots[0], 2)]
    assert lister.listed_files(spark, []).count() == 0


def test_only_changed_projects_are_built_again(spark, tmp_path):
    built = []

    def keys(**prints):
        rows = [(p, "static", "none", 1, f) for p, f in prints.items()]
        return spark.createDataFrame(rows, "project_id string, mode string, reason string, model_count bigint, fingerprint string")

    def builder(graphs):
        def build(todo):
            asked = sorted(r.project_id for r in todo.collect())
            built.append(asked)
            return spark.createDataFrame([(p, *e) for p in asked for e in graphs[p]], "project_id string, src string, dst string")

        return build

    def files_of(name):
        return {(str(f), f.stat().st_mtime_ns) for f in (tmp_path / "rows").glob(f"project_id={name}/**/*.parquet")}

    schema = spark.createDataFrame([], "project_id string, src string, dst string").schema
    store = stored.StoredGraph(spark, str(tmp_path), schema)
    assert store.rows().count() == 0 and store.keys().count() == 0 and store.clean() == 0
    first = {"same": [("a", "b")], "edited": [("a", "b"), ("b", "c")], "gone": [("x", "y")], "emptied": [("a", "b")]}
    store.refresh(keys(same="1", edited="1", gone="1", emptied="1"), builder(first))
    assert store.rows().count() == 5
    kept = files_of("same")
    second = {"edited": [("a", "c")], "emptied": [], "fresh/ö": [("p", "q")], "void": []}
    changes = store.refresh(keys(**{"same": "1", "edited": "2", "emptied": "2", "fresh/ö": "1", "void": "1"}), builder(second))
    assert {r.project_id: r.change for r in changes.collect()} == {
        "same": "same", "edited": "changed", "gone": "removed", "emptied": "changed", "fresh/ö": "new", "void": "new"
    }
    assert built == [["edited", "emptied", "gone", "same"], ["edited", "emptied", "fresh/ö", "void"]]
    after = [("edited", "a", "c"), ("fresh/ö", "p", "q"), ("same", "a", "b")]
    assert sorted(map(tuple, store.rows().collect())) == after
    assert files_of("same") == kept
    assert store.clean() == 3  # the old builds of edited and emptied, and the removed project
    assert sorted(map(tuple, store.rows().collect())) == after and not files_of("gone") and files_of("same") == kept
    store.refresh(keys(**{"same": "1", "edited": "2", "emptied": "2", "fresh/ö": "1", "void": "1"}), builder({}))
    assert len(built) == 2


def test_a_refresh_that_fails_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "project_id string, src string, dst string").schema
    store = stored.StoredGraph(spark, str(tmp_path), schema)
    keys = lambda f: spark.createDataFrame([("p", "static", "none", 1, f)], stored._KEYS)
    rows = lambda end: lambda todo: spark.createDataFrame([("p", "a", end)], schema)
    store.refresh(keys("1"), rows("b"))

    def broken(todo):
        raise RuntimeError("no build")

    with pytest.raises(RuntimeError):
        store.refresh(keys("2"), broken)
    assert [tuple(r) for r in store.rows().collect()] == [("p", "a", "b")]
    store.refresh(keys("2"), rows("c"))
    assert [tuple(r) for r in store.rows().collect()] == [("p", "a", "c")]


def test_a_fleet_is_assigned_without_broadcasts(spark):
    rows = [(f"f{i}/p{i}/{name}", "select 1") for i in range(50) for name in ("dbt_project.yml", "models/staging/a.sql", "other/b.sql")]
    inventory = spark.createDataFrame(rows, "path string, raw_sql string")
    assigned = files.assign_projects(inventory, files.project_roots(inventory.select("path")))
    folders = spark.createDataFrame([(f"f{i}/p{i}", "models") for i in range(50)], "project_id string, model_root string")
    found = files.fleet_models(assigned, folders).select("project_id", "name", "layer")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((f"f{i}/p{i}", "a", "staging") for i in range(50))
