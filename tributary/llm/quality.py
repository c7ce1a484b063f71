"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the measurements and one integer
whose bit ``i`` says that rule ``i`` failed. A policy is a named, versioned set of rules; applying
it is ``failed & mask``. What a rule costs is read from the ledger by bitwise aggregation, without
going back to the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.texts import whole

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CAPITALS = regex.compile(r"\p{Lu}+?")
_SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str  # SQL over the measurements; whole numbers only, so that it is exact


#: Bit i of the ledger belongs to rule i; new rules are appended, never reordered.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("capitals", "100 * n_capitals > 50 * word_chars"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: Versions of the keep decision, oldest first. ``base`` holds the two rules that every version has.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": BIT["few_words"] | BIT["repeated_windows"] | BIT["symbols"] | BIT["repeated_lines"],
    "v2": (1 << len(RULES)) - 1,
}
CURRENT = "v2"


def repeat_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more, first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total = reach = 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(_CAPITALS.findall(text)),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements (long) and ``failed``, the bitmask; one pass, no shuffle.

    Null and empty texts measure 0 everywhere (and fail ``few_words``). Repeated rows stay
    repeated, null ids pass through, other columns are not read.
    """

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t or "") for t in texts], columns=list(MEASURES), dtype="int64")

    bits = [F.when(F.expr(rule.failed), F.lit(BIT[rule.name])).otherwise(0) for rule in RULES]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return (
        docs.select(F.col(id_col), measures(whole(text_col)).alias("m"))
        .select(F.col(id_col), *(F.col(f"m.{m}") for m in MEASURES))
        .withColumn("failed", mask.cast("long"))
    )


def passes(policy: str = CURRENT) -> Column:
    """Whether a ledger row is kept under a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail only it, and that stay without it.

    The ledger is first counted by mask (at most ``2 ** len(RULES)`` rows), so the shuffle does not
    grow with the input and no group is hot. Also gives the union and intersection of all masks.
    """
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(POLICIES[policy])).alias("failed")).agg(F.count("*").alias("n"))
    names = [rule.name for rule in RULES if BIT[rule.name] & POLICIES[policy]]
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in names)))
    rows = masks.select("failed", "n", rules.alias("r")).select("failed", "n", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed") == F.col("bit")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(
        F.sum("n").alias("n_rows"),
        count(hit).alias("n_failed"),
        count(only).alias("n_only"),
        count((F.col("failed") == 0) | only).alias("n_kept_without"),
        F.bit_or("failed").alias("any_failed"),
        F.bit_and("failed").alias("all_failed"),
    )
