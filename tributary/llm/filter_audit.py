"""Audit of how filters interact: what each order of applying them keeps, removes and wastes.

Each document becomes a mask of the filters it fails. Everything asked of an order depends on the
mask alone, so the documents are added up to cells of one part and mask first. Each cell then folds
its mask across the array of all orders, with ``aggregate`` along an order and ``transform`` over
the orders, to structs weighted by its documents: five steps of 120 orders, 600 structs. A part's
cells (at most 32) are merged by sums element by element, and the structs become rows.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.texts import whole

#: Filters by the bit of a mask, and what fails them.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # of 100 words
MOST_CAPITALS = 5  # of 100 code points
SYMBOLS = b"#$%&*|"
TWIN = 1 << FILTERS.index("E")  # the text is also that of a smaller id

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER_BYTES = bytes(range(0x80, 0xC0))  # those of a code point in UTF-8 but its first

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: bytes) -> int:
    """The bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()
    return (
        (len(words) < LEAST_WORDS)
        + 2 * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
        + 4 * (100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text.translate(None, _INNER_BYTES)))
        + 8 * (len(text.translate(None, SYMBOLS)) < len(text))
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id, part, digest, failed, n``: equal rows counted, before anything is shuffled for long."""

    @F.arrow_udf(T.IntegerType())
    def failed(texts: pa.Array) -> pa.Array:
        return pa.array((text_mask(t.as_py()) for t in texts), pa.int32())

    text = whole(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        failed(text).alias("failed"),
    )
    return rows.groupBy("id", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("n"))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; an id has a mark if any of its label rows does."""
    mark = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    without = rows.filter("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    joined = rows.filter("id is not null").join(known, "id", "left")
    return joined.fillna(False, ["good", "toxic"]).unionByName(without)


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part and set of failed filters.

    Copies of a text meet as one row for each part, label and mask, however many they are, and say
    which of them has the least id.
    """
    rows = _labelled(_judged(docs, id_col, text_col, part_col), labels, id_col)
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = rows.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least")
    )
    first = texts.groupBy("digest").agg(F.min("least.id").alias("first"))
    texts = texts.join(first, "digest")
    single = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = texts.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("failed").alias("mask"), single.alias("n")),
            F.struct(F.col("failed").bitwiseOR(F.lit(TWIN)).alias("mask"), (F.col("n") - single).alias("n")),
        )).alias("cell"),
    ).select("part", "good", "toxic", "cell.*").filter("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _orders(spark: SparkSession) -> Column:
    """All orders as an array of arrays of filter bits; a constant that goes to the executors with the plan."""
    return F.array(*(F.array(*(F.lit(1 << f) for f in order)) for order in permutations(range(len(FILTERS)))))


def _fold(orders: Column) -> Column:
    """What a cell adds to each step of each order: one array of structs."""

    def step(state: Column, bit: Column) -> Column:
        fails, out = F.col("mask").bitwiseAND(bit) != 0, state["out"]
        weight = lambda when, n="n": F.when(when, F.col(n)).otherwise(F.lit(0)).cast("long")
        here = fails & ~out
        row = F.struct(
            bit.alias("bit"),
            weight(~fails & ~out).alias("kept"),
            weight(here).alias("removed"),
            weight(fails & out).alias("redundant"),
            weight(F.col("mask") == bit).alias("unique_fails"),
            weight(here, "good").alias("good_lost"),
            weight(here, "toxic").alias("toxic_lost"),
        )
        return F.struct((out | fails).alias("out"), F.concat(state["steps"], F.array(row)).alias("steps"))

    none = "array<struct<bit:int," + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("out"), F.array().cast(none).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x["bit"].alias("bit"), *((x[c] + y[c]).alias(c) for c in _COUNTS)))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step`` and the counts of each step of each order in each part.

    ``kept`` are documents left after the step, ``removed`` those it removes, ``redundant`` those that
    fail its filter but are gone already, ``unique_fails`` those that fail no other filter,
    ``good_lost`` and ``toxic_lost`` the labelled ones among ``removed``, ``shapley`` what the filter
    removes summed over all orders. Steps that nothing happens in have zeros.

    Null and empty texts are equal texts without words. A null part is the empty one. Rows of one id
    and one text are no twins of each other, but all count; rows with a null id fail E never and
    make no other row fail it. Ids labelled more than once have the marks of all their rows; labels
    other than 1 and null labels are no mark. A very long text is one task's work for one row. An
    empty table gives no rows. Other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    folded = cells(docs, labels, id_col, text_col, part_col).select("part", _fold(_orders(spark)).alias("steps"))
    lists = folded.groupBy("part").agg(F.collect_list("steps").alias("lists"))  # a list holds one array for each mask, so at most 32
    merged = lists.select("part", F.aggregate(F.slice("lists", 2, len(FILTERS) ** 3), F.get("lists", F.lit(0)), _plus).alias("steps"))
    total = lambda bit: F.aggregate("steps", F.lit(0).cast("long"), lambda s, x: s + F.when(x["bit"] == bit, x["removed"]).otherwise(0))
    shares = F.create_map(*(x for f in range(len(FILTERS)) for x in (F.lit(1 << f), total(1 << f))))
    names = F.array(*(F.lit("".join(order)) for order in permutations(FILTERS)))
    rows = merged.select("part", shares.alias("shares"), F.posexplode("steps").alias("place", "s"))
    return rows.select(
        "part",
        F.get(names, (F.col("place") / len(FILTERS)).cast("int")).alias("filter_order"),
        (F.col("place") % len(FILTERS) + 1).cast("int").alias("step"),
        *(F.col("s")[c].alias(c) for c in _COUNTS),
        F.col("shares")[F.col("s.bit")].alias("shapley"),
    )
