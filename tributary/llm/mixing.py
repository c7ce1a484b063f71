"""Mixing sources to target weights by temperature.

The weight of a source is its share of all tokens raised to an exponent, normalised. The exponent
is bisected: the largest with at least the target entropy, then raised as far as the repetition
limit asks. The weights are realised as block permutations: a keyed hash places every document of
a source on a circle of 2 ** 48 places, in each epoch the first 4096 arcs (blocks) are ordered
anew, and an epoch that the budget allows only in part ends at the place where the source's tokens
are used up. That place is found digit by digit (12 bits at a time) from token sums of at most
4096 cells for each source, so no source, however large, is sorted or gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.texts import free_names, whole
from tributary.scratch import Scratch

#: Target entropy as a share of the largest possible one (all sources alike).
ENTROPY = 0.97
#: No source is read more often than this.
REPEATS = 2.0
_BITS, _DIGITS = 12, 4
_POINTS, _PASSES = 32, 8


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def source_tokens(rows: DataFrame) -> DataFrame:
    """``source, docs, tokens`` of ``source, n_tokens``; added up in each task before the shuffle."""
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def _entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of the normalised weights at each exponent, in one pass over the sources."""
    sums = []
    for i, t in enumerate(exponents):
        w = F.pow("p", F.lit(t))
        sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log("p")).alias(f"s{i}")]
    row = shares.agg(*sums).first()
    return [math.log(row[f"z{i}"]) - t * row[f"s{i}"] / row[f"z{i}"] for i, t in enumerate(exponents)]


def exponent_for_entropy(shares: DataFrame, sources: int, target: float = ENTROPY) -> float:
    """The largest exponent in 0..1 whose weights have ``target`` times the largest entropy.

    ``shares`` has a column ``p`` of positive shares. Entropy falls as the exponent grows, so each
    pass cuts the interval to a 32nd. With one source the exponent is 1.
    """
    if sources < 2:
        return 1.0
    goal, low, high = target * math.log(sources), 0.0, 1.0
    if _entropies(shares, [1.0])[0] >= goal:
        return 1.0
    for _ in range(_PASSES):
        at = [low + (high - low) * i / _POINTS for i in range(1, _POINTS)]
        enough = [t for t, h in zip(at, _entropies(shares, at), strict=True) if h >= goal]
        low, high = (max(enough) if enough else low), min([t for t in at if t not in enough] + [high])
    return low


def exponent_for_repeats(largest: float, smallest: float, limit: float = REPEATS) -> float:
    """The smallest exponent in 0..1 at which the smallest source is read ``limit`` times while the largest is read once, bisected."""
    if limit < 1:
        raise ValueError("a repetition limit under 1 would leave documents out")
    low, high = 0.0, 1.0
    reads = lambda t: math.exp((1 - t) * math.log(largest / smallest))
    if reads(low) <= limit:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if reads(middle) <= limit else (middle, high)
    return high


def weights(tokens: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """``source, docs, tokens, weight, quota, exponent`` of each source with tokens.

    Without a budget the smallest one is taken that reads every source whole at least once, so
    nothing is left out. With a smaller budget large sources are read in part.
    """
    known = tokens.filter("tokens > 0")
    row = known.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count("*").alias("n")).first()
    if not row["n"]:
        return known.select("*", *(F.lit(0.0).alias(c) for c in ("weight", "quota", "exponent")))
    shares = known.withColumn("p", F.col("tokens") / F.lit(row["total"]))
    exponent = max(exponent_for_entropy(shares, row["n"], target), exponent_for_repeats(row["most"], row["least"], repeats))
    raised = F.pow("p", F.lit(exponent))
    norm = shares.agg(F.sum(raised)).first()[0]
    largest = (row["most"] / row["total"]) ** exponent / norm
    total = row["most"] / largest if budget is None else float(budget)
    out = shares.withColumn("weight", raised / F.lit(norm))
    quota = F.round(F.col("weight") * F.lit(total), 6)  # so that a whole epoch is not missed by a rounding error
    if budget is None:
        quota = F.greatest(quota, F.col("tokens").cast("double"))  # nor the first one, where the last place of a double is larger
    return out.withColumn("quota", quota).withColumn("exponent", F.lit(exponent)).drop("p")


def _place(seed: int, *columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - _BITS * _DIGITS)


def _ends(rows: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """``source, end``: documents placed before ``end`` fit into what is left of each source's quota."""
    state = plan.select("source", F.lit(0).cast("long").alias("prefix"), (F.col("quota") - F.floor(F.col("quota") / F.col("tokens")) * F.col("tokens")).alias("rest"))
    for digit in range(_DIGITS):
        below = _BITS * (_DIGITS - digit)
        same = rows.withColumn("prefix", F.shiftright("place", below) if digit else F.lit(0).cast("long"))
        cell = F.shiftright("place", below - _BITS).bitwiseAND((1 << _BITS) - 1)
        joined = same.join(state, [same["source"].eqNullSafe(state["source"]), same["prefix"] == state["prefix"]], "left_semi")
        cells = joined.groupBy("source", cell.alias("cell")).agg(F.sum("n_tokens").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("cell")) - F.col("n")
        cells = cells.withColumn("before", before)
        there = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        fits = there.filter("c.before <= s.rest").groupBy(F.col("s.source").alias("source"), "s.prefix", "s.rest")
        last = fits.agg(F.max_by("c.cell", "c.before").alias("cell"), F.max("c.before").alias("before"))
        state = scratch.save(
            last.select("source", F.shiftleft("prefix", _BITS).bitwiseOR(F.col("cell")).alias("prefix"), (F.col("rest") - F.col("before")).alias("rest")), f"digit-{digit}"
        )
    return state.select("source", F.col("prefix").alias("end"))


def mix(
    docs: DataFrame,
    target: float = ENTROPY,
    repeats: float = REPEATS,
    budget: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each reading of a document: ``id_col, source, n_tokens, weight, copies, epoch, block, place``.

    Reading in the order of ``epoch, place, block`` within a source gives the block permutation. Tokens are
    words split at white space. A null source is a source of its own. Null and empty texts have no
    tokens; they are read in whole epochs only, sources without any token once. Rows equal in id
    and text share a place and are read together; where they don't fit together, none is read
    again. Nothing is read more than ``repeats`` times, rounded up.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _words(text).alias("n_tokens"), text.alias("t"))
    rows = scratch.save(rows.select("id", "source", "n_tokens", _place(seed, "id", "t").alias("place")), "rows")
    tokens = scratch.save(source_tokens(rows), "tokens")
    plan = scratch.save(weights(tokens, target, repeats, budget), "weights")
    ends = _ends(rows.filter("n_tokens > 0"), plan, scratch)
    per_source = plan.join(ends, plan["source"].eqNullSafe(ends["source"])).select(plan["source"].alias("s"), "weight", "quota", "tokens", "end")
    read = rows.join(per_source, rows["source"].eqNullSafe(F.col("s")), "left").drop("s")
    whole_epochs = F.coalesce(F.floor(F.col("quota") / F.col("tokens")), F.lit(1))
    more = F.coalesce((F.col("place") < F.col("end")) & (F.col("n_tokens") > 0), F.lit(False)).cast("long")
    read = read.withColumn("copies", whole_epochs + more).filter("copies > 0")
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    block = F.shiftright("place", _BITS * (_DIGITS - 1))
    turn = F.when(F.col("epoch") < whole_epochs, F.xxhash64(F.lit(seed), "epoch", "block")).otherwise(F.col("block"))
    return read.withColumn("block", block).select(
        F.col("id").alias(id_col), F.col("source").alias("source"), "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), "copies", "epoch", "block", turn.alias("place")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every row repeated as often as :func:`mix` reads it; the columns stay as they are.

    Rows are matched by id, so rows that share an id are repeated as often as the first of them; those
    with a null id share one as well. An empty table stays empty, and no column name is taken.
    """
    id_, n = free_names(docs, "mix_id", "mix_copies")
    copies = mix(docs, id_col=id_col, **options).filter("epoch = 0").groupBy(F.col(id_col).alias(id_)).agg(F.max("copies").alias(n))
    rows = docs.join(copies, docs[id_col].eqNullSafe(F.col(id_)))
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*(docs[c] for c in docs.columns))
