"""The example feature models: staging, intermediate and mart tables as DataFrame plans.

Money is ``DECIMAL(18,2)`` and sums stay exact; averages and ratios are doubles of exact sums. The
reference date ``as_of`` is a parameter, so a rerun gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(10,4)"


def tidy(column: str) -> Column:
    return F.lower(F.trim(column))


def shout(column: str) -> Column:
    return F.upper(F.trim(column))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def mean(amount: Column) -> Column:
    """Average as a double, from the exact sum; null without values."""
    return F.sum(amount).cast("double") / F.nullif(F.count(amount), F.lit(0)).cast("double")


def or_zero(*columns) -> Column:
    return F.coalesce(*[F.col(c) if isinstance(c, str) else c for c in columns], F.lit(0))
