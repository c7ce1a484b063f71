"""Shards by jump consistent hashing: no ring table, and few rows move when shards are appended.

The shard of a row follows from its stable key and the number of shards alone. Jump hashing (Lamping
and Veach) walks the shard counts at which a key would have moved, by a generator seeded with the
key; the last jump below the number of shards is its shard. One shard more leaves each row where it
is or takes it into the new shard, which gets its even part.

Keys are the first 60 bits of the MD5 of the id's text, so any engine finds them again. Places
within a shard are gapless. Their order is that of a hash of the whole entry, an order that spreads
over blocks of even size: places are counted within blocks, and blocks are added up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.texts import whole
from tributary.scratch import Scratch

#: Distinct entries of a block, about; how blocks are cut changes no place.
BLOCK_ROWS = 50_000
#: Equal entries that one row is written out to at once.
COPIES = 50_000
#: Bytes that a row takes beside its text.
OVERHEAD = 8

_STEP = np.uint64(2862933555777941757)  # fixed value of the published generator
_HASH_BITS = 60


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (from 0) of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = np.asarray(keys).astype(np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    moving = np.arange(len(key))
    while len(moving):
        with np.errstate(over="ignore"):
            key = key * _STEP + np.uint64(1)
        draw = ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        after = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        stays = after < shards
        moving, key = moving[stays], key[stays]
        shard[moving] = after[stays]
    return shard


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")


def stable_key(id_col: str | Column) -> Column:
    """The 60-bit key of an id; null ids have that of the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return _bits(F.coalesce(column.cast("string"), F.lit("")))


def shard_column(id_col: str | Column, shards: int) -> Column:
    """The shard of each row's id."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(T.IntegerType())
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return shard(stable_key(id_col))


def _written_out(groups: DataFrame) -> DataFrame:
    """Groups of equal entries as rows with a ``slot`` each; large groups in parts, dealt over the tasks."""
    few = groups.filter(F.col("n") <= COPIES).withColumns({"from_": F.lit(0).cast("long"), "to_": F.col("n")})
    parts = groups.filter(F.col("n") > COPIES).withColumn("from_", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")))
    many = parts.repartition("mix", "from_").withColumn("to_", F.least(F.col("n"), F.col("from_") + COPIES))
    return few.unionByName(many).withColumn("slot", F.explode(F.expr("sequence(start + from_, start + to_ - 1)")))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` of each row, under the law ``key``.

    ``size`` is the text's bytes in UTF-8 and ``OVERHEAD``; ``grown_shard`` is the shard with one more.
    Slots run from 0 without gaps in each shard, ordered by a hash of id, size and checksum.

    The text is read once; what is shuffled is a short entry for each row. Equal entries are counted
    before they are shuffled and written out at the end in parts, so neither copies nor a repeated id
    gather in one task. Null and empty texts have size ``OVERHEAD`` and checksum 0. Rows with null ids
    share a shard, as those of any other id do (that is the law); repeated rows each have a slot. Very
    long texts are checksummed whole. An empty table gives an empty result; other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = whole(text_col).cast("binary")
    entries = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc")
    )
    entries = entries.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    mix = _bits(F.concat_ws(",", F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "crc"))
    entries = entries.select("*", mix.alias("mix"), shard_column("id", shards).alias("shard"), shard_column("id", shards + 1).alias("grown"))
    entries = scratch.save(entries, "entries")
    # a power of two of blocks for each shard, by the leading bits of the order
    bits = min(max(entries.count() // (shards * block_rows), 1).bit_length(), _HASH_BITS // 2)
    entries = entries.withColumn("block", F.shiftright("mix", _HASH_BITS - bits))
    sums = entries.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("mix", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["shard", "block"])
    groups = placed.withColumn("start", F.col("base") + F.col("within"))
    return _written_out(groups).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", files: int = 1, shard_col: str = "shard") -> None:
    """Write whole rows as Parquet to one folder a shard, ``files`` files each, dealt by key.

    A column named as ``shard_col`` raises; everything else is as in :func:`assign`.
    """
    if shard_col in docs.columns:
        raise ValueError(f"the rows have a column {shard_col} already")
    salt = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
    dealt = docs.withColumn(shard_col, shard_column(id_col, shards)).repartition(shards * files, shard_col, salt)
    dealt.write.partitionBy(shard_col).parquet(path)


def append_shard(spark, path: str, grown_path: str, shards: int, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """Write only the rows that move when shard number ``shards`` is appended to a folder; returns their counts by old shard.

    ``grown_path`` gets the new shard's folder. The old folders still hold the moved rows: readers of a
    grown layout pass over rows whose shard, by :func:`shard_column`, is another folder's.
    """
    held = spark.read.parquet(path)
    moved = held.withColumn("to_", shard_column(id_col, shards + 1)).filter(F.col("to_") == shards)
    moved.drop(shard_col).withColumnRenamed("to_", shard_col).write.partitionBy(shard_col).parquet(grown_path)
    return moved.groupBy(shard_col).agg(F.count(F.lit(1)).alias("moved"))
