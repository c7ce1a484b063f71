"""Connected components of links in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.scratch import Scratch


#: Links that are joined in one task at most; more take rounds of stars. Both ways give the same components.
LOCAL_LINKS = 500_000


def _directed(links: DataFrame) -> DataFrame:
    """Each link once, from the larger end to the smaller."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of a node are linked to the least of them instead (``large``: larger ones only)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
    around = both.join(least, both["a"] == least["u"])
    if large:
        moved = around.filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = around.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _directed(moved)


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in batch[["a", "b"]].itertuples(index=False, name=None):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        yield pd.DataFrame([(x, top(x)) for x in up], columns=["node", "root"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` for the nodes of ``a, b`` links: the least node of each component.

    More than ``LOCAL_LINKS`` links alternate large and small stars (logarithmically many rounds);
    neighbours are never gathered, so one node may hold any share of the links. Null ends and links of a node to itself don't count.
    """
    now = scratch.save(_directed(links.filter("a is not null and b is not null")), f"{name}-0")
    if now.count() <= LOCAL_LINKS:
        kind = now.schema["a"].dataType.simpleString()
        return scratch.save(now.coalesce(1).mapInPandas(_united, f"node {kind}, root {kind}"), f"{name}-roots")
    mark = None
    round_no = 0
    while True:
        size, digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (size, digest) == mark:
            break
        mark = (size, digest)
        round_no += 1
        now = scratch.save(_star(_star(now, True), False), f"{name}-{round_no}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
