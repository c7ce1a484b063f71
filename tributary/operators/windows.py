"""Row positions and rolling frames that stay parallel inside one huge group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.scratch import Scratch


def with_positions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    name: str = "position",
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, for a unique ``by + order``.

    Rows are range-partitioned by the full key, so a group of any size spreads over many tasks. The
    position is the rank inside the row's partition plus the group's rows in earlier partitions;
    ``sums`` adds running totals from the first row of the group in the same way.
    """
    by, order, sums = list(by), list(order), dict(sums or {})
    scratch = Scratch(df.sparkSession, "positions")
    placed = scratch.save(
        df.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id()), "placed"
    )
    totals = {"n_": F.count(F.lit(1)), **{f"{key}_": F.sum(value) for key, value in sums.items()}}
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "part_")
        .agg(*[total.alias(key) for key, total in totals.items()])
        .select(*by, "part_", *[F.sum(key).over(earlier).alias(key) for key in totals])
    )
    inside = Window.partitionBy(*by, "part_").orderBy(*order)
    ranked = placed.withColumn("rank_", F.row_number().over(inside))
    for key, value in sums.items():
        so_far = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = ranked.withColumn(key, so_far)
    ranked = ranked.join(offsets, [*by, "part_"]).withColumn(name, F.coalesce("n_", F.lit(0)) + F.col("rank_"))
    for key in sums:
        before, here = F.col(f"{key}_"), F.col(key)
        ranked = ranked.withColumn(key, F.when(here.isNull(), before).when(before.isNull(), here).otherwise(before + here))
    return ranked.drop("part_", "rank_", *totals)


def rolling(
    df: DataFrame,
    by: Sequence[str],
    size: int,
    aggregates: Mapping[str, Column],
    position: str = "position",
    block: int = 100_000,
) -> DataFrame:
    """Aggregates over each row and the ``size - 1`` rows before it in its group.

    A group is cut into blocks of positions; the last ``size - 1`` rows of a block are also sent to
    the next one, so every frame is complete and no task holds more than a block of a group.
    """
    block = max(block, size)
    spot = F.col(position) - 1
    own = F.floor(spot / block).cast("bigint")
    also_next = spot % block >= block - (size - 1)
    spread = df.withColumn("own_", own).withColumn(
        "block_", F.explode(F.when(also_next, F.array("own_", F.col("own_") + 1)).otherwise(F.array("own_")))
    )
    frame = Window.partitionBy(*by, "block_").orderBy(position).rowsBetween(-(size - 1), 0)
    for name, aggregate in aggregates.items():
        spread = spread.withColumn(name, aggregate.over(frame))
    return spread.where("block_ = own_").drop("own_", "block_")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in ``order``; only candidates are shuffled, not whole groups."""
    pick = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank_", pick).where("rank_ = 1").drop("rank_")
