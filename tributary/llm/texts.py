"""Small helpers shared by the text operators."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space, as a regular expression class body.
WHITE = "\t-\r \x85\xa0  -     　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column of ``df`` is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        free.append(name)
        taken.add(name.lower())
    return free


def whole(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def blocks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters, so that a batch's words never lie in memory at once."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def by_block(texts: pd.Series, work: Callable[[list[str]], list]) -> list:
    """``work`` over :func:`blocks`, results in the order of the texts."""
    return list(itertools.chain.from_iterable(map(work, blocks(texts))))


class Bounded(dict):
    """A cache that starts anew when it holds ``limit`` entries; it only saves work, results never depend on it."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self, entries: int) -> None:
        if len(self) + entries > self.limit:
            self.clear()
