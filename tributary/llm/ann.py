"""Nearest neighbours by inner product with a forest of random-projection trees.

The trees split at the median along the difference of two random vectors of the node. They are
fitted on a bounded sample; every vector is then routed to a leaf of each tree. To make the
largest inner product the nearest vector, all vectors get one more component that lifts them to
the same norm (queries get 0 there). A query walks all trees through one priority queue, the
branch with the largest margin next, and opens leaves until they hold ``SEARCH`` of all places
(vectors times trees), whatever the number of vectors, and in any case until ``k`` other vectors are
among them. Leaves are then scored exactly, in blocks of vectors and queries. A tree has the same
number of leaves on a table of any size, so a query opens about the same number of leaves.

The leaves opened first give each query a lower bound of its k-th score; the others only return
what reaches it. Blocks have at most about ``BLOCK`` rows on either side, also for a leaf that
holds many copies of one vector, and nothing depends on how many queries there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.scratch import Scratch

TREES = 16
#: Sample vectors in a leaf at least.
LEAF = 4
#: Vectors the trees are fitted on, at most.
SAMPLE = 20_000
DEPTH = 8
#: Places opened for a query, as a share of all places.
SEARCH = 1 / 16
FIRST_LEAVES = 8
BLOCK = 2_000
_SLACK = 1e-9


@dataclass
class Forest:
    """Complete trees in heap order: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    directions: np.ndarray  # trees x nodes x dimensions
    thresholds: np.ndarray  # trees x nodes
    norm: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.thresholds.shape[1] + 1))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through all trees."""
        x = self.lifted(x)
        out = np.empty((len(x), len(self.directions)), np.int64)
        for t, (directions, thresholds) in enumerate(zip(self.directions, self.thresholds, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, directions[node]) > thresholds[node])
            out[:, t] = (t << self.depth) + node - len(thresholds)
        return out

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]])

    def open_leaves(self, query: np.ndarray, sizes: np.ndarray, places: float) -> list[int]:
        """Leaves in the order in which one queue for all trees comes to them, until they hold ``places``."""
        q = np.append(query, 0.0) / max(np.sqrt(query @ query), 1e-300) * max(self.norm, 1e-300)
        margins = self.directions @ q - self.thresholds
        inner, depth = margins.shape[1], self.depth
        queue = [(-np.inf, t, 0) for t in range(len(margins))]
        found, held = [], 0
        while queue and held < places:
            worst, t, node = heapq.heappop(queue)
            if node >= inner:
                leaf = (t << depth) + node - inner
                if sizes[leaf]:
                    found.append(leaf)
                    held += sizes[leaf]
                continue
            m = margins[t, node]
            heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))
            heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))
        return found


def fit_forest(sample: np.ndarray, norm: float, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """A forest from a sample of the vectors; trees of fewer levels only where the sample cannot fill their leaves."""
    depth = min(depth, int(np.ceil(np.log2(max(len(sample) / LEAF, 1)))))
    nodes = (1 << depth) - 1
    forest = Forest(np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), norm)
    x, rng = forest.lifted(sample), np.random.default_rng(seed)
    for t in range(trees):
        members = [np.arange(len(x))]
        for node in range(nodes):
            own = members[node]
            line = np.zeros(x.shape[1])
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                line = x[a] - x[b]
            if not line.any():
                line = rng.normal(size=x.shape[1])
            line /= np.sqrt(line @ line)
            along = x[own] @ line
            cut = float(np.median(along)) if len(own) else 0.0
            forest.directions[t, node], forest.thresholds[t, node] = line, cut
            members += [own[along <= cut], own[along > cut]]
    return forest


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _indexed(vectors: DataFrame, forest: Forest) -> DataFrame:
    """``id, v, leaf`` for the leaf of every vector in every tree."""
    sent = vectors.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["leaves"] = list(sent.value.leaves_of(_matrix(batch["v"])))
            yield batch

    routed = vectors.mapInPandas(route, "id long, v array<double>, leaves array<long>")
    return routed.select("id", "v", F.explode("leaves").alias("leaf"))


def _probes(queries: DataFrame, forest: Forest, sizes: np.ndarray, places: float) -> DataFrame:
    """``query, q, leaf, turn`` for every leaf that a query opens."""
    sent = queries.sparkSession.sparkContext.broadcast((forest, sizes))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, size = sent.value
        for batch in batches:
            leaves = [known.open_leaves(np.asarray(v, np.float64), size, places) for v in batch["v"]]
            yield pd.DataFrame({"query": batch["id"], "q": batch["v"], "leaves": leaves})

    opened = queries.mapInPandas(walk, "query long, q array<double>, leaves array<long>")
    return opened.select("query", "q", F.posexplode("leaves").alias("turn", "leaf"))


def _scored(vectors: DataFrame, probes: DataFrame, splits: DataFrame, k: int) -> DataFrame:
    """``query, id, score``: the best ``k`` ids of each block for each query, if they reach the query's ``least``."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "id": [], "score": []})
        left = left.sort_values("id", kind="stable")
        x, q = _matrix(left["v"]), _matrix(right["q"])
        ids = left["id"].to_numpy()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ends, one_each = np.append(starts[1:], len(ids)), len(starts) == len(ids)
        ids = ids[starts]
        rough, least = q @ x.T, right["least"].to_numpy(dtype=float)
        if not one_each:
            rough = np.maximum.reduceat(rough, starts, axis=1)
        names, out = right["query"].to_numpy(), []
        reach = (rough >= (least - _SLACK)[:, None]) & (ids[None, :] != names[:, None])
        for i in np.flatnonzero(reach.any(1)).tolist():
            at = np.flatnonzero(reach[i])
            if len(at) > k:
                at = at[rough[i, at] >= np.partition(rough[i, at], len(at) - k)[len(at) - k] - _SLACK]
            if one_each:
                score = (x[at] * q[i]).sum(1)
            else:
                score = np.array([(x[a:b] * q[i]).sum(1).max() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            order = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(order), names[i]), ids[at][order], score[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query", "id", "score"), columns, strict=True)))

    salt = lambda c, n: F.pmod(F.xxhash64(c), n)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = vectors.join(splits, "leaf").withColumn("part", salt("id", F.col("parts"))).withColumn("turned", all_of("turns"))
    q = probes.join(splits, "leaf").withColumn("turned", salt("query", F.col("turns"))).withColumn("part", all_of("parts"))
    keys = ["leaf", "part", "turned"]
    grouped = x.select(*keys, "id", "v").groupBy(*keys).cogroup(q.select(*keys, "query", "q", "least").groupBy(*keys))
    return grouped.applyInPandas(best, "query long, id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; a vector found in several leaves counts once."""
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    search: float = SEARCH,
    depth: int = DEPTH,
) -> DataFrame:
    """``query_id, rank, id_col, score``: up to ``k`` vectors of ``rows`` with large inner products for each query, ties to smaller ids.

    Vectors that are null, zero, or hold null or non-finite components, rows without an id, and
    vectors of another length than most of the sample take no part on either side. A row with the
    query's own id is no candidate. Rows that repeat an id count as one, with its largest score;
    a query id given more than once is searched once, with one of its vectors. No rows on either
    side give no rows. Tables of any size are searched alike: ``search`` is a share of the places,
    1.0 compares all (exact), and each query gets ``k`` rows if there are so many other vectors.
    Where vectors lie in groups, less search and deeper trees find the same with less work.
    """
    scratch = Scratch(rows.sparkSession, "ann")
    vectors = _vectors(rows, id_col, vector_col)
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))  # no rows
    vectors = vectors.filter(F.size("v") == common["d"])
    asked = _vectors(queries, id_col, vector_col).filter(F.size("v") == common["d"]).dropDuplicates(["id"])
    share = min(1.0, SAMPLE / common["n"])
    sample = vectors.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").toPandas()
    if sample.empty:
        sample = vectors.select("v").limit(1).toPandas()
    forest = fit_forest(_matrix(sample["v"]), common["norm"], depth=depth)
    indexed = scratch.save(_indexed(vectors, forest), "index")
    sizes = np.zeros(TREES << forest.depth, np.int64)  # one number for each leaf, at most TREES * 2 ** depth
    for leaf, n in indexed.select("leaf", "id").distinct().groupBy("leaf").count().collect():  # repeats of an id don't fill the search
        sizes[leaf] = n
    least = TREES * (k + 1)  # an id has one place in each tree, so these are k others at least
    probes = scratch.save(_probes(asked, forest, sizes, max(search * float(sizes.sum()), least)), "probes")
    parts = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    turns = probes.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("turns"))
    splits = scratch.save(parts.join(turns, "leaf"), "splits")
    early = F.col("turn") < FIRST_LEAVES
    first = scratch.save(_scored(indexed, probes.filter(early).withColumn("least", F.lit(float("-inf"))), splits, k), "first")
    bars = _top(first, k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    later = probes.filter(~early).join(bars, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = first.unionByName(_scored(indexed, later, splits, k))
    return _top(found, k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
