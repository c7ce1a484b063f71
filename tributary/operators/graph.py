"""Closures, orderings and cycles on edge tables.

An edge table has the columns ``src`` and ``dst`` of one orderable type (a string, a number or a
struct such as ``<model, column, layer>``); edges run from upstream to downstream. The loops keep
state in written tables (see ``scratch``); the driver only learns whether a round found anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators import windows
from tributary.scratch import Scratch

UPSTREAM = "upstream"
DOWNSTREAM = "downstream"

# Rounds of neighbour labels before labels start to jump: a jump shuffles all labels, a plain round only what moved.
_PLAIN_ROUNDS = 12
# Parts of at most so many nodes are settled in one row: the work there grows with the cube of the nodes, in words of 64.
_ROW_NODES = 128
# Rounds in which parts of a row's size are joined up; a part that takes more goes to the label search.
_PIECE_ROUNDS = 8


class CycleFound(RuntimeError):
    """An order was asked for in a graph that has a cycle."""


def by_project(edges: DataFrame) -> DataFrame:
    """Edges of many projects as one graph: both ends become ``STRUCT<project_id, node>``.

    Names repeat between projects, so a closure over several of them needs such keys.
    """
    key = lambda end: F.struct("project_id", F.col(end).alias("node"))
    return edges.withColumns({"src": key("src"), "dst": key("dst")})


def _hash_of(name: str) -> Column:
    return F.xxhash64(name)


class _Numbering:
    """Numbers for nodes that are not numbers themselves.

    Rounds shuffle the keys over and over, so text and struct nodes are replaced by one bigint each: the
    hash of the name, which needs no join. Where two names share a hash (all are compared), numbers
    are dealt and joined instead.
    """

    def __init__(self, scratch: Scratch, edges: DataFrame, *more: DataFrame):
        self.table, self.hashed = None, False
        if isinstance(edges.schema["src"].dataType, T.IntegralType):
            return
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("name_"))
        for column in more:
            nodes = nodes.unionByName(column.toDF("name_"))
        nodes = nodes.where("name_ is not null").distinct()
        self.table = scratch.save(nodes.withColumn("number_", _hash_of("name_")), "numbers")
        self.hashed = self.table.groupBy("number_").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if not self.hashed:
            self.table = scratch.save(self.table.withColumn("number_", F.monotonically_increasing_id()), "numbers-dealt")

    def encode(self, df: DataFrame, *columns: str) -> DataFrame:
        if self.table is None:
            return df
        for column in columns:
            if self.hashed:
                df = df.where(F.col(column).isNotNull()).withColumn(column, _hash_of(column))
                continue
            key = self.table.select(F.col("name_").alias(column), "number_")
            df = df.join(key, column).drop(column).withColumnRenamed("number_", column)
        return df

    def decode(self, df: DataFrame, *columns: str) -> DataFrame:
        if self.table is None:
            return df
        order = df.columns
        for column in columns:
            key = self.table.select(F.col("number_").alias(column), "name_")
            df = df.join(key, column).drop(column).withColumnRenamed("name_", column)
        return df.select(*order)


def _stored_hops(edges: DataFrame, targets: DataFrame, direction: str, scratch: Scratch, stored: bool = False):
    """``(numbering, hops, goals)`` with near and far end swapped for the upstream direction.

    ``goals(name, target, block, bit)`` deals the targets to blocks of 64 in the order of their names, so
    that targets of one neighbourhood share blocks: what they reach is one row with a mask of bits.
    """
    plain = edges.select("src", "dst").where("src is not null and dst is not null")
    if not stored and not isinstance(plain.schema["src"].dataType, T.IntegralType):
        plain = scratch.save(plain, "edges")
    names = targets.select(F.col("target").cast(plain.schema["src"].dataType)).where("target is not null").distinct()
    placed = names.repartitionByRange("target").sortWithinPartitions("target").select("target", F.monotonically_increasing_id().alias("place"))
    placed = scratch.save(placed, "places")
    numbers = _Numbering(scratch, plain, placed.select("target"))
    near, far = ("src", "dst") if direction == DOWNSTREAM else ("dst", "src")
    hops = numbers.encode(plain, "src", "dst").select(F.col(near).alias("node"), F.col(far).alias("next"))
    goals = numbers.encode(placed.withColumn("name", F.col("target")), "target")
    goals = goals.select("name", "target", F.shiftright("place", 6).alias("block"), F.col("place").bitwiseAND(63).cast("int").alias("bit"))
    return numbers, scratch.save_by(hops, "hops", "node"), scratch.save(goals, "goals")


def _next_reached(frontier: DataFrame, hops: DataFrame, seen: DataFrame) -> DataFrame:
    """What a round reaches for the first time: ``node, block, mask``.

    ``hops`` are bucketed by ``node`` and ``seen`` by ``node, block``, so only the frontier and what it offers
    are shuffled, however large the graph and the closure are by then.
    """
    known = seen.groupBy("node", "block").agg(F.bit_or("mask").alias("seen"))
    offers = frontier.join(hops, "node").groupBy(F.col("next").alias("node"), "block").agg(F.bit_or("mask").alias("mask"))
    fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
    return offers.join(known, ["node", "block"], "left").select("node", "block", fresh.alias("mask")).where("mask <> 0")


def _closure_of(hops: DataFrame, goals: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Closure of ``goals`` over stored ``hops(node, next)``: ``node, block, mask, depth``.

    A row says which targets of a block first reach a node at that depth, one bit each.
    """
    reached = goals.groupBy(F.col("target").alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    visited = scratch.grown(tag, "node", "block")
    for depth in count():  # every round adds nodes, so it ends
        visited.add(reached.withColumn("depth", F.lit(depth)))
        seen = visited.rows()
        frontier = seen.where(F.col("depth") == depth).select("node", "block", "mask")
        if frontier.isEmpty():
            visited.forget()
            return seen
        reached = _next_reached(frontier, hops, seen)
    raise AssertionError("unreachable")


def _listed(masks: DataFrame, goals: DataFrame, numbers: _Numbering, name: str) -> DataFrame:
    """``target, node, name`` by their own names, one row for each bit."""
    entry = F.struct("bit", F.col("name").alias("target"))
    blocks = goals.groupBy("block").agg(F.collect_list(entry).alias("targets"))  # 64 at most
    rows = numbers.decode(masks, "node").join(blocks, "block")
    held = F.expr("filter(targets, t -> shiftright(mask, t.bit) & 1 = 1)")
    return rows.select(F.explode(held).alias("t"), "node", name).select("t.target", "node", name)


def _mask_levels(chain: DataFrame, hops: DataFrame, direction: str, scratch: Scratch) -> DataFrame:
    """Longest-path levels of a closure's masks: ``node, block, mask, level``.

    Each node of a block has a counter of inputs. A node whose inputs have all been seen is ready: its
    levels are final and go on over its edges, once. Nodes with some inputs seen wait with what they
    have been offered. Targets of one block may give a node different levels; a row holds the
    targets of one level, at most 64 rows a node and block once it is ready.
    """
    kept = scratch.save_by(chain.groupBy("node", "block").agg(F.bit_or("mask").alias("mask")), "kept", "node", "block")
    if direction == DOWNSTREAM:  # edges of a closure of descendants never leave it
        ends = hops.withColumnRenamed("next", "end")
        inputs = kept.join(ends, "node").groupBy(F.col("end").alias("node"), "block").agg(F.count(F.lit(1)).alias("inputs"))
        need = kept.join(inputs, ["node", "block"])
    else:  # all inputs of a node are in a closure of ancestors; an edge may lead out of it
        ends = scratch.save_by(hops.select(F.col("next").alias("node"), F.col("node").alias("end")), "ends", "node")
        need = kept.join(hops.groupBy("node").agg(F.count(F.lit(1)).alias("inputs")), "node")
    need = scratch.save_by(need.select("node", "block", "inputs", F.col("mask").alias("limit")), "need", "node", "block")
    state = lambda seen, ready: [
        "node", "block", F.lit(0).alias("level"), "mask", F.lit(seen).cast("long").alias("seen"), F.lit(ready).alias("ready")
    ]
    step = kept.join(need, ["node", "block"], "left_anti").select(*state(1, True))
    # a target that others of its block reach waits for its inputs; for itself it is at level 0
    own = chain.where("depth = 0").join(need, ["node", "block"], "left_semi")
    step = step.unionByName(own.select(*state(0, False)))
    group = Window.partitionBy("node", "block")
    later = group.orderBy(F.desc("level"), F.desc("seen"), "mask")
    for turn in count():  # every round makes a node ready, so it ends
        step = scratch.save(step, f"steps/turn={turn}")
        if step.where("ready").isEmpty():
            break
        # one row of a ready node has counted its inputs; that row counts as the node's one arrival at each edge's end
        offers = (
            step.where("ready").join(ends, "node")
            .groupBy(F.col("end").alias("node"), "block", (F.col("level") + 1).alias("level"))
            .agg(F.bit_or("mask").alias("mask"), F.sum((F.col("seen") > 0).cast("long")).alias("seen"))
        )
        known = offers.unionByName(step.where("not ready").select(*offers.columns)).join(need, ["node", "block"])
        above = F.coalesce(F.bit_or("mask").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        known = known.withColumns({"above": above, "total": F.sum("seen").over(group), "row": F.row_number().over(later)})
        left = F.col("mask").bitwiseAND(F.bitwise_not("above")).bitwiseAND(F.col("limit"))
        step = known.select(
            "node", "block", "level", left.alias("mask"),
            F.when(F.col("row") == 1, F.col("total")).otherwise(F.lit(0)).alias("seen"),
            (F.col("total") == F.col("inputs")).alias("ready"),
        ).where("mask <> 0 or seen > 0")
    ready = scratch.load("steps", step.schema).where("ready")
    left = kept.count() - ready.where("seen > 0").count()
    if left:
        raise CycleFound(f"{left} places lie on or behind a cycle")
    return ready.where("mask <> 0").select("node", "block", "mask", "level")


def _levels_of(hops: DataFrame, nodes: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """Longest-path levels of ``nodes(by, node)`` and of all ends of ``hops(by, src, dst)``.

    A node's level is the round in which the last of its inputs has been seen. An edge is used once, in
    the round after its source is ready; only ready nodes and nodes that wait are shuffled.
    """
    key = [*by, "node"]
    links = scratch.save_by(hops.select(*by, F.col("src").alias("node"), F.col("dst").alias("end")).distinct(), "links", *key)
    need = links.groupBy(*by, F.col("end").alias("node")).agg(F.count(F.lit(1)).alias("inputs"))
    need = scratch.save_by(need, "need", *key)
    places = scratch.save_by(nodes.select(*key).unionByName(links.select(*key)).unionByName(need.select(*key)).distinct(), "places", *key)
    step = places.join(need, key, "left_anti").select(*key, F.lit(1).cast("long").alias("seen"), F.lit(True).alias("ready"))
    for level in count():  # every round makes a node ready, so it ends
        step = scratch.save(step, f"steps/level={level}")
        if step.where("ready").isEmpty():
            break
        arrived = step.where("ready").join(links, key).groupBy(*by, F.col("end").alias("node")).agg(F.count(F.lit(1)).alias("seen"))
        known = arrived.unionByName(step.where("not ready").select(*key, "seen")).groupBy(*key).agg(F.sum("seen").alias("seen"))
        step = known.join(need, key).select(*key, "seen", (F.col("seen") == F.col("inputs")).alias("ready"))
    schema = T.StructType([*step.schema.fields, T.StructField("level", T.IntegerType())])
    ready = scratch.load("steps", schema).where("ready")
    left = places.count() - ready.count()
    if left:
        raise CycleFound(f"{left} nodes lie on or behind a cycle")
    return ready.select(*key, "level")


def _closure(edges: DataFrame, targets: DataFrame, direction: str, stored: bool = False) -> DataFrame:
    scratch = Scratch(edges.sparkSession, f"closure-{direction}")
    numbers, hops, goals = _stored_hops(edges, targets, direction, scratch, stored)
    return _listed(_closure_of(hops, goals, scratch, "levels"), goals, numbers, "depth")


def downstream(edges: DataFrame, targets: DataFrame, stored: bool = False) -> DataFrame:
    """Every target with all its descendants: ``target, node, depth`` (the target has depth 0). ``stored`` edges are not written once more."""
    return _closure(edges, targets, DOWNSTREAM, stored)


def upstream(edges: DataFrame, targets: DataFrame, stored: bool = False) -> DataFrame:
    """Every target with all its ancestors: ``target, node, depth`` (the target has depth 0). ``stored`` edges are not written once more."""
    return _closure(edges, targets, UPSTREAM, stored)


def ordered_chain(edges: DataFrame, targets: DataFrame, direction: str = DOWNSTREAM) -> DataFrame:
    """A closure in source-first order: ``target, node, level``; order by ``target, level, node``."""
    scratch = Scratch(edges.sparkSession, f"ordered-{direction}")
    numbers, hops, goals = _stored_hops(edges, targets, direction, scratch)
    chain = _closure_of(hops, goals, scratch, "chain")
    return _listed(_mask_levels(chain, hops, direction, scratch), goals, numbers, "level")


def direct_successors(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Immediate consumers of each target: ``target, node``."""
    return (
        edges.join(targets.select("target").distinct(), F.col("src") == F.col("target"))
        .select("target", F.col("dst").alias("node"))
        .distinct()
    )


def induced_edges(edges: DataFrame, chain: DataFrame) -> DataFrame:
    """Edges with both ends in the chain of a target; keeps all edge columns, adds ``target``."""
    heads = chain.select("target", F.col("node").alias("src"))
    tails = chain.select("target", F.col("node").alias("dst"))
    return edges.join(heads, "src").join(tails, ["target", "dst"], "left_semi")


def closed_edges(edges: DataFrame, chain: DataFrame, direction: str) -> DataFrame:
    """:func:`induced_edges` for a full closure, with a single join.

    A downstream closure holds the head of every edge whose tail it holds (and the other way round
    upstream), so testing one end is enough.
    """
    end = "src" if direction == DOWNSTREAM else "dst"
    return edges.join(chain.select("target", F.col("node").alias(end)), end)


def topological_levels(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Longest-path level of every node; ordering by it puts each edge's source first.

    ``by`` names columns that separate independent graphs. Ends of edges count as nodes.
    """
    scratch = Scratch(nodes.sparkSession, "levels")
    by = list(by)
    edges = scratch.save(edges.select(*by, "src", "dst"), "edges")
    numbers = _Numbering(scratch, edges, nodes.select("node"))
    hops = numbers.encode(edges, "src", "dst")
    plain = numbers.encode(nodes.select(*by, "node"), "node")
    return numbers.decode(_levels_of(hops, plain, by, scratch), "node")


def terminal_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with flags: nothing feeds it (``is_source``), nothing consumes it (``is_sink``)."""
    rows = nodes.select("node", F.lit(True).alias("own"), F.lit(False).alias("fed"), F.lit(False).alias("used"))
    for end, fed in (("dst", True), ("src", False)):
        met = edges.where(F.col(end).isNotNull()).select(F.col(end).alias("node"), F.lit(False).alias("own"), F.lit(fed).alias("fed"), F.lit(not fed).alias("used"))
        rows = rows.union(met)
    flags = rows.groupBy("node").agg(*(F.max(c).alias(c) for c in ("own", "fed", "used")))
    return flags.where("own").select("node", (~F.col("fed")).alias("is_source"), (~F.col("used")).alias("is_sink"))


def _trimmed(edges: DataFrame, scratch: Scratch, tag: str, rounds: int = 20) -> DataFrame:
    """Drop edges that start at a pure source or end at a pure sink; they are on no cycle.

    Stops early after ``rounds``: what is left over is still handled by the component search.
    """
    current, size = edges, edges.count()
    for turn in range(rounds):
        if size == 0:
            break
        fed = current.select(F.col("dst").alias("src")).distinct()
        used = current.select(F.col("src").alias("dst")).distinct()
        kept = current.join(fed, "src", "left_semi").join(used, "dst", "left_semi")
        current = scratch.save(kept.select("src", "dst"), f"{tag}/trim-{turn}")
        left = current.count()
        if left == size:
            break
        size = left
    return current


def _between_inner(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct edges of which both ends have edges in and out, stored: a first trim.

    Only one small row for each end is shuffled; in a graph of few inner nodes the edges stay where they are.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("way")), F.struct(F.col("dst").alias("node"), F.lit(2).alias("way"))))
    ways = edges.select(ends.alias("end")).groupBy("end.node").agg(F.bit_or("end.way").alias("ways"))
    inner = scratch.save(ways.where("ways = 3").select("node"), "inner")
    if inner.isEmpty():
        return inner.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    for end in ("src", "dst"):
        edges = edges.join(inner.withColumnRenamed("node", end), end, "left_semi")
    return scratch.save(edges.select("src", "dst").distinct(), "keyed")


_HALF = 0xFFFFFFFF


def _mixed(number: Column) -> Column:
    """A bigint in a random-looking order: two Feistel rounds, so :func:`_unmixed` gives the number back."""
    high, low = F.shiftright(number, 32), number.bitwiseAND(_HALF)
    for _ in range(2):
        high, low = low, high.bitwiseXOR(F.hash(low).cast("long")).bitwiseAND(_HALF)
    return F.shiftleft(high, 32).bitwiseOR(low)


def _unmixed(label: Column) -> Column:
    high, low = F.shiftright(label, 32).bitwiseAND(_HALF), label.bitwiseAND(_HALF)
    for _ in range(2):
        high, low = low.bitwiseXOR(F.hash(high).cast("long")).bitwiseAND(_HALF), high
    return F.shiftleft(high, 32).bitwiseOR(low)


def _two_way_labels(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``node, above, below``: the least node that reaches it and the least one it reaches.

    Nodes are mixed first: in a random order a chain of components is split near its
    middle, so the number of outer passes grows with the logarithm of its length. Where short cycles
    have not settled it, a node also takes the label of its own label (what reaches that node
    reaches this one too), so a label crosses a long path in few rounds. Edges and labels are stored
    in buckets of the node, so a plain round shuffles only what nodes that moved offer.
    """
    src, dst = _mixed(F.col("src")), _mixed(F.col("dst"))
    ways = edges.select(src.alias("a"), dst.alias("b"), F.lit(True).alias("down"))
    links = scratch.save_by(ways.unionByName(edges.select(dst.alias("a"), src.alias("b"), F.lit(False).alias("down"))), f"{tag}/links", "a")
    state = (
        links.select(F.col("a").alias("node"))
        .distinct()
        .select("node", F.col("node").alias("above"), F.col("node").alias("below"), F.lit(True).alias("fresh"))
    )
    state = scratch.save_by(state, f"{tag}/label-0", "node")

    for turn in count(1):  # labels only fall, so it ends
        offers = (
            state.where("fresh")
            .select(F.col("node").alias("a"), "above", "below")
            .join(links, "a")
            .groupBy(F.col("b").alias("node"))
            .agg(
                F.min(F.when(F.col("down"), F.col("above"))).alias("from_above"),
                F.min(F.when(~F.col("down"), F.col("below"))).alias("from_below"),
            )
        )
        news = state.join(offers, "node", "left")
        above, below = ["above", "from_above"], ["below", "from_below"]
        if turn > _PLAIN_ROUNDS:
            over = state.where("above <> node").select(F.col("node").alias("via_above"), F.col("above").alias("jump_above"))
            under = state.where("below <> node").select(F.col("node").alias("via_below"), F.col("below").alias("jump_below"))
            news = news.join(over, F.col("above") == F.col("via_above"), "left")
            news = news.join(under, F.col("below") == F.col("via_below"), "left")
            above, below = [*above, "jump_above"], [*below, "jump_below"]
        best_above, best_below = F.least(*above), F.least(*below)
        moved = (best_above < F.col("above")) | (best_below < F.col("below"))
        state = scratch.save_by(
            news.select("node", best_above.alias("above"), best_below.alias("below"), moved.alias("fresh")),
            f"{tag}/label-{turn}", "node",
        )
        scratch.drop(f"{tag}/label-{turn - 1}")
        if state.where("fresh").isEmpty():
            return state.select(*(_unmixed(F.col(c)).alias(c) for c in ("node", "above", "below")))
    raise AssertionError("unreachable")


def _reaches(start: str, end: str) -> str:
    return f"getbit(reach[{start}][{end} div 64], {end} % 64) = 1"


def _found_in_rows(arcs: DataFrame, group: str, through: str, found: str) -> DataFrame:
    """The structs that ``found`` lists for each ``group`` of distinct ``arcs(group, a, b)``, by columns.

    A group is one row. Its nodes take places from 0 in their order (``names``); ``near`` has the places that
    their arcs lead to and ``reach`` what they reach, as bits in words of 64. Nodes ``k`` are let through in
    their order, ``through`` being what a node gets that reaches ``k``.
    """
    outs = arcs.groupBy(group, "a").agg(F.collect_list("b").alias("outs"))
    rows = outs.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("a", "outs"))).alias("nodes"))
    # bound in a lambda, so that it is worked out once a row
    let = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    # nodes without an arc have no place and lead nowhere
    near = "transform(nodes, node -> filter(transform(node.outs, b -> CAST(array_position(names, b) - 1 AS INT)), p -> p >= 0))"
    bits = "aggregate(own, 0L, (bits, p) -> IF(p div 64 = w, bits | shiftleft(1L, p % 64), bits))"
    first = f"transform(near, own -> transform(sequence(0, (size(names) - 1) div 64), w -> {bits}))"
    more = "transform(reach, bits -> IF(getbit(bits[k div 64], k % 64) = 1, zip_with(bits, more, (x, y) -> x | y), bits))"
    reach = f"aggregate(sequence(0, size(names) - 1), {first}, (reach, k) -> {let('more', through, more)})"
    listed = let("names", "nodes.a", let("near", near, let("reach", reach, found)))
    return rows.select(group, F.explode(F.expr(listed)).alias("found_")).select(group, "found_.*")


def _members_in_rows(arcs: DataFrame) -> DataFrame:
    """``node, root`` of all nodes on a cycle, ``root`` being the least of its component; see :func:`_found_in_rows`."""
    every = "sequence(0, size(names) - 1)"
    root = f"names[filter({every}, j -> {_reaches('i', 'j')} AND {_reaches('j', 'i')})[0]]"
    members = f"transform(filter({every}, i -> {_reaches('i', 'i')}), i -> struct(names[i] AS node, {root} AS root))"
    return _found_in_rows(arcs, "piece", "reach[k]", members).select("node", "root")


def _small_pieces(pairs: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``node, piece`` of the pieces, connected whatever the way of the edges, of at most :data:`_ROW_NODES` nodes.

    A node has a parent in its piece that is no greater. In each round its parent, and the node itself, take
    the least grandparent of a neighbour, so trees grow together in few rounds, however long a path is.
    """
    links = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(pairs.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    links = scratch.save_by(links, f"{tag}/links", "a")
    state = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("parent"), F.lit(True).alias("moved"))
    state = scratch.save_by(state, f"{tag}/parents-0", "node")
    for turn in range(1, _PIECE_ROUNDS + 1):
        above = state.join(state.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        offers = above.select(F.col("node").alias("a"), "grand").join(links, "a").groupBy(F.col("b").alias("node")).agg(F.min("grand").alias("low"))
        own = F.struct("node", F.least("grand", "low").alias("parent"), F.col("parent").alias("was"))
        hook = F.struct(F.col("parent").alias("node"), F.col("low").alias("parent"), F.lit(None).cast("long").alias("was"))
        moves = above.join(offers, "node").select(F.explode(F.array(own, hook)).alias("m")).select("m.*")
        news = moves.groupBy("node").agg(F.min("parent").alias("parent"), F.max("was").alias("was"))
        state = scratch.save_by(news.select("node", "parent", (F.col("parent") < F.col("was")).alias("moved")), f"{tag}/parents-{turn}", "node")
        scratch.drop(f"{tag}/parents-{turn - 1}")
        settled = state.where("moved").isEmpty()
        if settled:
            break
    few = state.groupBy(F.col("parent").alias("piece")).agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") <= _ROW_NODES).select("piece")
    if not settled:  # some pieces may be in parts yet: an edge leads out of those
        crossed = links.join(state.select(F.col("node").alias("a"), F.col("parent").alias("piece")), "a")
        crossed = crossed.join(state.select(F.col("node").alias("b"), F.col("parent").alias("other")), "b").where("piece <> other")
        few = few.join(crossed.select("piece").distinct(), "piece", "left_anti")
    return scratch.save(state.select("node", F.col("parent").alias("piece")).join(few, "piece"), f"{tag}/small")


def _components_of(pairs: DataFrame, scratch: Scratch, tag: str, trims: int = 20, trimmed: bool = False) -> DataFrame | None:
    """``node, root`` of each component of two nodes or more, ``root`` being one of them; None if there is none.

    ``pairs`` is a stored table of distinct numbered edges without loops (``trimmed``: by :func:`_trimmed`
    already). Small pieces of the graph are settled in rows. In the others, members of one component
    share both labels, and a node whose two labels agree is in the component of that label. Such
    components are taken out, edges between nodes of different labels are on no cycle and go as
    well, and the rest is searched again.
    """
    rest = pairs if trimmed else _trimmed(pairs, scratch, f"{tag}/pass-0", trims)
    if rest.isEmpty():
        return None
    small = _small_pieces(rest, scratch, f"{tag}/pieces")
    arcs = rest.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(small.withColumnRenamed("node", "a"), "a")
    scratch.save(_members_in_rows(arcs), f"{tag}/found/turn=0")
    rest = scratch.save(rest.join(small.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"), f"{tag}/large")
    for turn in count(1):  # every pass settles at least the component of the least node
        if rest.isEmpty():
            break
        labels = _two_way_labels(rest, scratch, f"{tag}/pass-{turn}")
        scratch.save(labels.where("above = below").select("node", F.col("above").alias("root")), f"{tag}/found/turn={turn}")
        open_nodes = labels.where("above <> below")
        heads = open_nodes.select(F.col("node").alias("src"), "above", "below")
        tails = open_nodes.select(F.col("node").alias("dst"), F.col("above").alias("above_"), F.col("below").alias("below_"))
        rest = scratch.save(
            rest.join(heads, "src").join(tails, "dst").where("above = above_ and below = below_").select("src", "dst"),
            f"{tag}/pass-{turn}/rest",
        )
        rest = _trimmed(rest, scratch, f"{tag}/pass-{turn}", trims)
    ends = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
    found = scratch.load(f"{tag}/found", ends).select("node", "root")
    several = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    return found.join(several, "root").select("node", "root")


def cycle_components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """Nodes that lie on a cycle, as ``node, component`` (the least node of the component).

    Memory stays linear in the edges: no reachability pairs are built. Text and struct nodes stand as
    their hashes while edges that are on no cycle are dropped: names that share a hash can only add
    cycles. Only what is left is numbered by name. ``stored`` edges are read again and again instead of
    being written once more.
    """
    scratch = Scratch(edges.sparkSession, "components")
    node = edges.schema["src"].dataType
    pairs = edges.select("src", "dst").where("src is not null and dst is not null")
    pairs = pairs if stored else scratch.save(pairs, "edges")
    whole = isinstance(node, T.IntegralType)
    key = (lambda end: F.col(end).cast("long")) if whole else _hash_of
    loops = pairs.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    pairs = pairs.where("src <> dst")
    keyed = pairs.select(key("src").alias("src"), key("dst").alias("dst"))
    rest = _trimmed(_between_inner(keyed, scratch), scratch, "trimmed")
    if rest.isEmpty():
        return loops
    if whole:
        named = _components_of(rest, scratch, "search", trimmed=True)
        named = None if named is None else named.withColumn("node", F.col("node").cast(node))
    else:
        ends = rest.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        left = pairs.withColumns({"a": key("src"), "b": key("dst")}).join(ends, ["a", "b"], "left_semi")
        left = scratch.save(left.select("src", "dst").distinct(), "left")
        numbers = _Numbering(scratch, left)
        if not numbers.hashed:
            rest = scratch.save(numbers.encode(left, "src", "dst").select("src", "dst"), "pairs")
        named = _components_of(rest, scratch, "search", trimmed=True)
        named = None if named is None else numbers.decode(named, "node")
    if named is None:
        return loops
    named = scratch.save(named, "named")
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    real = named.join(least, "root").select("node", "component")
    alone = loops.join(real, "node", "left_anti")
    return scratch.save(real.unionByName(alone), "components")


def on_cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges with both ends in one component: ``src, dst, component``."""
    head = components.select(F.col("node").alias("src"), "component")
    tail = components.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    return (
        edges.select("src", "dst")
        .join(head, "src")
        .join(tail, "dst")
        .where("component = other")
        .select("src", "dst", "component")
    )


def _gone_in_rows(arcs: DataFrame) -> DataFrame:
    """``lo, a, b`` of the arcs whose end ``b`` reaches their start ``a`` through nodes less than ``a``, ``a`` being above ``lo``.

    Distinct ``arcs(lo, a, b)`` are those of intervals of at most :data:`_ROW_NODES` nodes.
    """
    # through node k only what is greater than k is reached anew: what is less would pass a node greater than itself
    above = "transform(reach[k], (bits, w) -> CASE WHEN w > k div 64 THEN bits WHEN w = k div 64 THEN bits & shiftleft(-2L, k % 64) ELSE 0L END)"
    gone = f"transform(filter(own, p -> p < i AND {_reaches('p', 'i')}), p -> struct(names[i] AS a, names[p] AS b))"
    found = _found_in_rows(arcs, "lo", above, f"flatten(transform(near, (own, i) -> {gone}))")
    return found.where("a > lo")


def _cut_edges(todo: DataFrame, nodes: int, scratch: Scratch) -> DataFrame:
    """``s, d`` of the edges that go, from stored ``s, d, lo, hi, a, b``.

    Nodes are numbered in their order, 1 to ``nodes``. Node ``s`` joins the graph at time ``s``, and an
    edge is there once both its ends are. Its ends come to lie in one component at some time in
    ``(lo, hi]``; ``a`` and ``b`` are its ends with what is one component at ``lo`` drawn together. Intervals
    with few nodes are settled at once (:func:`_gone_in_rows`); each turn halves all others: one search
    finds the components at the middles, edges inside them go on with the earlier half, the others,
    drawn together, with the later one.
    """
    base = nodes + 1
    if base * base >= 1 << 63:
        raise ValueError("too many nodes on cycles to number their intervals")
    cut = T.StructType([T.StructField("s", T.LongType()), T.StructField("d", T.LongType())])
    for turn in count():  # intervals halve, so it ends
        scratch.save(todo.where("hi - lo = 1 and hi = s").select("s", "d"), f"cut/turn={turn}-of-one")
        todo = todo.where("hi - lo > 1")
        sizes = todo.select("lo", F.explode(F.array("a", "b")).alias("node")).distinct().groupBy("lo").agg(F.count(F.lit(1)).alias("nodes"))
        few = scratch.save(sizes.where(F.col("nodes") <= _ROW_NODES).select("lo"), f"few-{turn}")
        gone = _gone_in_rows(todo.select("lo", "a", "b").distinct().join(few, "lo", "left_semi"))
        own = todo.where("s = a and d < s")  # a greater end than the start joins after it
        scratch.save(own.join(gone, ["lo", "a", "b"], "left_semi").select("s", "d"), f"cut/turn={turn}-in-rows")
        open_ = todo.join(few, "lo", "left_anti").withColumn("mid", F.expr("(lo + hi) div 2"))
        open_ = scratch.save(open_, f"open-{turn}")
        if open_.isEmpty():
            return scratch.load("cut", cut).select("s", "d")
        there = F.greatest("s", "d") <= F.col("mid")
        # intervals of one turn are disjoint, so the low end keeps their nodes apart
        key = lambda end: F.col("lo") * base + F.col(end)
        pairs = scratch.save(open_.where(there).select(key("a").alias("src"), key("b").alias("dst")).distinct(), f"pairs-{turn}")
        found = _components_of(pairs, scratch, f"search-{turn}", trims=3)
        if found is None:
            todo = open_.select("s", "d", F.col("mid").alias("lo"), "hi", "a", "b")
            continue
        found = scratch.save(found.withColumn("root", F.col("root") % base), f"found-{turn}")
        for end in ("a", "b"):
            root = found.select(F.col("node").alias(f"key_{end}"), F.col("root").alias(f"root_{end}"))
            open_ = open_.withColumn(f"key_{end}", key(end)).join(root, f"key_{end}", "left")
        early = F.coalesce(there & (F.col("root_a") == F.col("root_b")), F.lit(False))
        drawn = lambda end: F.when(early, F.col(end)).otherwise(F.coalesce(f"root_{end}", end)).alias(end)
        lo, hi = F.when(early, F.col("lo")).otherwise(F.col("mid")), F.when(early, F.col("mid")).otherwise(F.col("hi"))
        todo = scratch.save(open_.select("s", "d", lo.alias("lo"), hi.alias("hi"), drawn("a"), drawn("b")), f"todo-{turn}")
    raise AssertionError("unreachable")


def break_cycles(edges: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Make the graph acyclic; returns ``(kept edges, dropped src/dst/component)``.

    The rule: of each component that has a cycle the largest edge (in node order) goes, again and
    again, until no cycle is left. That is: an edge goes exactly if it is a loop, or if its target
    reaches its source through nodes smaller than the source. The search for these edges halves
    the node order (:func:`_cut_edges`) until few nodes are left in a part, so the component searches
    grow with the logarithm of the largest component, not with the cuts, and no more than
    :data:`_ROW_NODES` nodes of a component are ever gathered in a row.
    ``component`` is the least node of the component that the edge was in. ``stored`` edges are not
    written once more.
    """
    scratch = Scratch(edges.sparkSession, "break-cycles")
    members = cycle_components(edges, stored)
    if members.isEmpty():
        # known to be empty when a plan is made, so that nothing is shuffled to meet it
        return edges, edges.select("src", "dst", F.col("src").alias("component")).limit(0)
    looped = scratch.save(on_cycle_edges(edges, members).distinct(), "looped")
    placed = scratch.save(windows.with_positions(members, [], ["component", "node"], "number"), "placed")
    spans = placed.groupBy("component").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    flat = looped.where("src <> dst").join(spans, "component")
    for end, number in (("src", "s"), ("dst", "d")):
        flat = flat.join(placed.select(F.col("node").alias(end), F.col("number").alias(number)), end)
    flat = scratch.save(flat.select("s", "d", "lo", "hi", F.col("s").alias("a"), F.col("d").alias("b")), "flat")
    cut = _cut_edges(flat, placed.count(), scratch)
    sources = placed.select(F.col("number").alias("s"), F.col("node").alias("src"), "component")
    named = cut.join(sources, "s").join(placed.select(F.col("number").alias("d"), F.col("node").alias("dst")), "d")
    dropped = scratch.save(named.select("src", "dst", "component").unionByName(looped.where("src = dst")), "dropped")
    return edges.join(dropped.select("src", "dst"), ["src", "dst"], "left_anti"), dropped
