"""Graph loops against brute force on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import graph, impact


def frame(spark, pairs):
    return spark.createDataFrame(pairs or [], "src long, dst long")


def targets(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "target long")


def reach(pairs, start):
    seen, todo = {start: 0}, [start]
    while todo:
        following = []
        for node in todo:
            for a, b in pairs:
                if a == node and b not in seen:
                    seen[b] = seen[node] + 1
                    following.append(b)
        todo = following
    return seen


def random_pairs(seed, n=12, m=22):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_match_brute_force_with_cycles_and_duplicates(spark, seed):
    pairs = random_pairs(seed)
    starts = [0, 3, 7, 99]
    down = graph.downstream(frame(spark, pairs + pairs[:3]), targets(spark, starts + [3])).collect()
    assert sorted(map(tuple, down)) == sorted((s, n, d) for s in starts for n, d in reach(pairs, s).items())
    up = graph.upstream(frame(spark, pairs), targets(spark, starts)).collect()
    back = [(b, a) for a, b in pairs]
    assert sorted(map(tuple, up)) == sorted((s, n, d) for s in starts for n, d in reach(back, s).items())


def test_diamonds_do_not_enumerate_paths(spark):
    pairs = [(2 * i, 2 * i + k) for i in range(12) for k in (1, 2)] + [(2 * i + 1, 2 * i + 2) for i in range(12)]
    found = graph.downstream(frame(spark, pairs), targets(spark, [0]))
    assert found.count() == 25


def test_levels_of_a_cycle_raise(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    with pytest.raises(graph.CycleFound):
        graph.topological_levels(nodes, frame(spark, [(1, 2), (2, 1), (2, 3)]), by=())


def longest(pairs, start):
    """Level of each node that ``start`` reaches, inside what it reaches."""
    inside, level = set(reach(pairs, start)), {}

    def of(node):
        if node not in level:
            level[node] = max([of(a) + 1 for a, b in pairs if b == node and a in inside], default=0)
        return level[node]

    return {node: of(node) for node in inside}


@pytest.mark.parametrize("seed", [3, 4])
def test_chains_of_many_targets_are_ordered(spark, seed):
    pairs = [(a, b) for a, b in random_pairs(seed, 24, 60) if a < b] + [(0, 1), (0, 1)]
    starts = list(range(24)) + list(range(200, 290))  # two blocks of targets
    down = graph.ordered_chain(frame(spark, pairs), targets(spark, starts)).collect()
    assert sorted(map(tuple, down)) == sorted((s, n, d) for s in starts for n, d in longest(pairs, s).items())
    up = {}
    back = [(b, a) for a, b in pairs]
    for s in starts:
        inside = set(reach(back, s))
        up[s] = {}
        for n in sorted(inside):  # edges run to larger numbers
            up[s][n] = max([up[s][a] + 1 for a, b in pairs if b == n and a in inside], default=0)
    found = graph.ordered_chain(frame(spark, pairs), targets(spark, starts), graph.UPSTREAM).collect()
    assert sorted(map(tuple, found)) == sorted((s, n, d) for s in starts for n, d in up[s].items())


@pytest.mark.parametrize("direction", [graph.DOWNSTREAM, graph.UPSTREAM])
@pytest.mark.parametrize("pairs", [[(1, 2), (2, 1)], [(0, 1), (1, 2), (2, 3), (3, 2), (3, 4)]])
def test_an_order_behind_a_cycle_raises(spark, pairs, direction):
    with pytest.raises(graph.CycleFound):
        graph.ordered_chain(frame(spark, pairs), targets(spark, [1, 2]), direction)


def test_a_round_shuffles_neither_edges_nor_what_was_visited(spark):
    scratch = graph.Scratch(spark, "round")
    n = 40_000
    hops = scratch.save_by(spark.range(n).selectExpr("id AS node", "id + 1 AS next"), "hops", "node")
    seen = scratch.save_by(spark.range(n).selectExpr("id AS node", "0L AS block", "1L AS mask", "0 AS depth"), "seen", "node", "block")
    front = scratch.save(spark.range(5).selectExpr("id AS node", "0L AS block", "2L AS mask"), "front")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reached = graph._next_reached(front, hops, seen)
        assert sorted(map(tuple, reached.collect())) == [(i, 0, 2) for i in range(1, 6)]
        plan = reached._jdf.queryExecution().sparkPlan().toString()
        final = reached._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Join" in plan
    final = final.split("== Initial Plan ==")[-1]  # AQE prints both
    assert final.count("Exchange hashpartitioning") == 2  # the frontier, and what it offers


def test_topological_levels_respect_every_edge(spark):
    pairs = [(a, b) for a, b in random_pairs(5) if a < b]
    edges = frame(spark, pairs)
    chain = graph.downstream(edges, targets(spark, [0, 1]))
    inside = graph.closed_edges(edges, chain, graph.DOWNSTREAM)
    levels = {(r.target, r.node): r.level for r in graph.topological_levels(chain, inside).collect()}
    assert set(levels) == {(r.target, r.node) for r in chain.collect()}
    for row in inside.collect():
        assert levels[(row.target, row.src)] < levels[(row.target, row.dst)]
    both = lambda df: sorted({(r.target, r.src, r.dst) for r in df.collect()})
    assert both(inside) == both(graph.induced_edges(edges, chain))


def components(pairs):
    nodes = {n for p in pairs for n in p}
    down = {n: set(reach(pairs, n)) for n in nodes}
    out = {}
    for n in nodes:
        mates = {m for m in nodes if m in down[n] and n in down[m]}
        if len(mates) > 1 or (n, n) in pairs:
            out[n] = min(mates)
    return out


@pytest.mark.parametrize(
    "pairs",
    [
        [],
        [(1, 1), (1, 2)],
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 6)],
        [(i, (i + 1) % 5 + 0) for i in range(5)] + [(10 + i, 10 + (i + 1) % 3) for i in range(3)] + [(2, 11)],
        random_pairs(11, 14, 24),
        random_pairs(12, 20, 26),
    ],
    ids=["empty", "self-loop", "bridged", "two-cycles", "dense", "sparse"],
)
def test_components_and_cycle_breaking(spark, pairs):
    edges = frame(spark, pairs)
    expected = components(pairs)
    assert {r.node: r.component for r in graph.cycle_components(edges).collect()} == expected
    kept, dropped = graph.break_cycles(edges)
    kept, dropped = [(r.src, r.dst) for r in kept.collect()], [(r.src, r.dst) for r in dropped.collect()]
    assert components(kept) == {}
    assert sorted(set(kept) | set(dropped)) == sorted(set(pairs))
    for a, b in dropped:
        assert expected[a] == expected[b]


def cut_by_rule(pairs):
    """The largest edge of each component, again and again."""
    left, gone = set(pairs), set()
    while found := components(sorted(left)):
        worst = {}
        for a, b in left:
            if a in found and found.get(b) == found[a]:
                worst[found[a]] = max(worst.get(found[a], (a, b)), (a, b))
        gone |= set(worst.values())
        left -= set(worst.values())
    return gone


def test_cuts_follow_the_rule(spark):
    pairs = []
    for n, (seed, nodes, edges) in enumerate([(1, 5, 9), (2, 8, 20), (3, 12, 30), (4, 20, 45), (5, 9, 40), (6, 30, 70)]):
        pairs += [(100 * n + a, 100 * n + b) for a, b in random_pairs(seed, nodes, edges)]
    pairs += [(600 + i, 600 + (i + 1) % 8) for i in range(8)] + [(600 + i, 600 + (i + 3) % 8) for i in range(8)]
    pairs = sorted(set(pairs))
    dropped = graph.break_cycles(frame(spark, pairs))[1].collect()
    assert {(r.src, r.dst) for r in dropped} == cut_by_rule(pairs)
    assert all(r.component == components(pairs)[r.src] for r in dropped)


def test_many_cuts_and_descending_ring(spark):
    pairs = [(i + 1, i) for i in range(5)] + [(0, 5)]
    for n in range(70):
        pairs += [(100 + 2 * n, 101 + 2 * n), (101 + 2 * n, 100 + 2 * n), (101 + 2 * n, 102 + 2 * n), (102 + 2 * n, 101 + 2 * n)]
    kept, dropped = graph.break_cycles(frame(spark, pairs))
    gone = [(r.src, r.dst) for r in dropped.collect()]
    assert len([e for e in gone if e[0] < 100]) == 1 and len(gone) == 141
    assert components([(r.src, r.dst) for r in kept.collect()]) == {}


def test_two_node_cycle_drops_one_edge(spark):
    kept, dropped = graph.break_cycles(frame(spark, [(1, 2), (2, 1), (2, 3)]))
    assert sorted(map(tuple, kept.collect())) == [(1, 2), (2, 3)]
    assert [(r.src, r.dst) for r in dropped.collect()] == [(2, 1)]


def test_impact_excludes_target_and_counts_models_once(spark):
    schema = "src struct<model:string,column:string,layer:string>, dst struct<model:string,column:string,layer:string>"
    n = lambda m, c: (m, c, "marts")
    rows = [(n("raw", "id"), n("stg", "id")), (n("stg", "id"), n("m1", "a")), (n("stg", "id"), n("m1", "b")), (n("stg", "id"), n("m0", "a"))]
    edges = spark.createDataFrame(rows, schema)
    goals = spark.createDataFrame([(n("raw", "id"),), (n("m1", "a"),)], "target struct<model:string,column:string,layer:string>")
    totals, by_model = impact.impact_summary(edges, goals)
    got = {r.target.column: (r.affected_model_count, r.affected_column_count) for r in totals.collect()}
    assert got == {"id": (3, 4), "a": (0, 0)}
    report = [(r.scope, r.model, r.column_count) for r in by_model.collect()]
    assert report == [("all", "m1", 2), ("all", "m0", 1), ("all", "stg", 1), ("direct", "stg", 1)]
    chain = graph.downstream(edges, goals)
    listed = [(r.model, r.column) for r in impact.impact_columns(impact.impacted_nodes(chain)).collect()]
    assert listed == [("m1", "a"), ("m1", "b"), ("m0", "a"), ("stg", "id")]
    with pytest.raises(ValueError):
        impact.require_downstream(graph.UPSTREAM, True)


def test_terminals(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    flags = graph.terminal_nodes(nodes, frame(spark, [(1, 2), (2, 3)]))
    assert {r.node: (r.is_source, r.is_sink) for r in flags.collect()} == {
        1: (True, False), 2: (False, False), 3: (False, True), 4: (True, True)
    }


def test_projects_do_not_mix(spark):
    kind = "struct<model:string,column:string,layer:string>"
    n = lambda m: (m, "id", "marts")
    rows = [("p", n("a"), n("b")), ("q", n("b"), n("c")), ("q", n("a"), n("d"))]
    edges = graph.by_project(spark.createDataFrame(rows, f"project_id string, src {kind}, dst {kind}"))
    goal = edges.where("src.project_id = 'p'").select(F.col("src").alias("target"))
    chain = graph.downstream(edges, goal)
    assert [(r.model, r.column) for r in impact.impacted_nodes(chain).collect()] == [("b", "id")]


def test_mixed_numbers_come_back(spark):
    numbers = [0, 1, -1, 7, 2**31, 2**32, -(2**32), 2**63 - 1, -(2**63)] + [i * 99_991 for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    rows = df.select("n", graph._mixed(F.col("n")).alias("m")).select("n", "m", graph._unmixed(F.col("m")).alias("back")).collect()
    assert all(r.n == r.back for r in rows) and len({r.m for r in rows}) == len(set(numbers))
    order = [r.n for r in sorted(rows, key=lambda r: r.m)]
    assert order != sorted(order)


@pytest.mark.parametrize("shared", [False, True])
def test_text_nodes_whose_hashes_are_shared(spark, monkeypatch, shared):
    if shared:
        monkeypatch.setattr(graph, "_hash_of", lambda name: F.length(name).cast("long"))
    pairs = [("a", "b"), ("b", "a"), ("a", "cc"), ("cc", "d"), ("d", "ee"), ("x", "y"), ("y", "zz"), ("zz", "x"), ("w", "w"), (None, "a")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    found = {(r.node, r.component) for r in graph.cycle_components(edges).collect()}
    assert found == {("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("zz", "x"), ("w", "w")}
    starts = spark.createDataFrame([("a",), ("x",)], "target string")
    down = graph.downstream(edges, starts).collect()
    real = [p for p in pairs if p[0]]
    assert sorted(map(tuple, down)) == sorted((s, n, d) for s in ("a", "x") for n, d in reach(real, s).items())


def test_a_round_of_an_edge_search_needs_no_join_to_number_text(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    scratch = graph.Scratch(spark, "numbers")
    plan = graph._Numbering(scratch, edges).encode(edges, "src", "dst")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def two_way_path(first, nodes):
    return [p for i in range(first, first + nodes - 1) for p in ((i, i + 1), (i + 1, i))]


def test_small_components_need_no_halving(spark, monkeypatch):
    halved = []
    search = graph._two_way_labels
    monkeypatch.setattr(graph, "_two_way_labels", lambda *args: halved.append(1) or search(*args))
    pairs = two_way_path(0, 64) + two_way_path(100, 100) + [(300, 301), (301, 302), (302, 300), (302, 310), (310, 311), (311, 310)]
    dropped = graph.break_cycles(frame(spark, pairs))[1].collect()
    assert {(r.src, r.dst) for r in dropped} == {p for p in pairs if p[0] > p[1]}
    assert {r.src: r.component for r in dropped}[163] == 100
    assert not halved


def test_parts_that_do_not_fit_a_row_are_halved(spark, monkeypatch):
    monkeypatch.setattr(graph, "_ROW_NODES", 5)
    monkeypatch.setattr(graph, "_PIECE_ROUNDS", 2)
    pairs = two_way_path(200, 9)
    for n, (seed, nodes, edges) in enumerate([(1, 5, 9), (4, 20, 45)]):
        pairs += [(100 * n + 300 + a, 100 * n + 300 + b) for a, b in random_pairs(seed, nodes, edges)]
    pairs = sorted(set(pairs))
    dropped = graph.break_cycles(frame(spark, pairs))[1].collect()
    assert {(r.src, r.dst) for r in dropped} == cut_by_rule(pairs)


def test_terminals_are_told_in_one_shuffle(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (None,), (4,)], "node long")
    edges = frame(spark, [(1, 2), (1, 2), (2, 3), (None, 4), (1, None)])
    flags = graph.terminal_nodes(nodes, edges)
    assert "Join" not in flags._jdf.queryExecution().optimizedPlan().toString()
    assert {r.node: (r.is_source, r.is_sink) for r in flags.collect()} == {
        1: (True, False), 2: (False, False), None: (True, True), 4: (False, True)
    }
