"""Token counts by rank-synchronous array merging.

The pre-tokens of a block of texts lie in one ragged numpy array (symbols, and for each symbol
the number of its sequence). A round looks up the ranks of all neighbouring pairs, takes each
sequence's lowest rank and applies that pair everywhere in the sequence at once; where a pair
overlaps itself (``aaa``), the places are taken from the left, every second one of a run.
Sequences without a known pair leave the array with their number of symbols.

The merge list must be proper: a merge that uses a symbol comes after the merge that makes it.
Then applying one pair at all its places equals the usual order of one merge at a time.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.texts import WHITE, Bounded, by_block, whole

#: Distinct words whose counts a Python worker keeps.
CACHE_WORDS = 500_000

_CHUNK = re.compile(f"[^{WHITE}]+")
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """The merge table of a byte-level vocabulary with word ends, as numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, ids = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], dtype=np.int64)
        self.last = np.array([ids[x + end] for x in letters], dtype=np.int64)
        self.size = len(ids)
        keys, made = [], {x + e for x in letters for e in ("", end)}
        for rank, (a, b) in enumerate(model["merges"]):
            if a not in made or b not in made:
                raise ValueError(f"merge {rank} comes before its parts")
            made.add(a + b)
            keys.append((ids[a] * self.size + ids[b], rank, ids[a + b]))
        keys.sort()
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*keys, strict=True))
        self.by_rank = self.merged[np.argsort(self.ranks)]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        contents = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(contents)) if contents else None
        self.cache = Bounded(CACHE_WORDS)

    def _pair_ranks(self, symbols: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        key = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == key) & (sequence[:-1] == sequence[1:]), self.ranks[at], _NONE)
        return np.append(ranks, _NONE)

    def count_symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (not empty) when no pair can be merged."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        sequence = np.repeat(np.arange(len(words)), lengths)
        counts = np.zeros(len(words), dtype=np.int64)
        while len(symbols):
            ranks = self._pair_ranks(symbols, sequence)
            starts = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == _NONE
            counts[sequence[starts[done]]] = sizes[done]
            hits = np.flatnonzero((ranks == np.repeat(lowest, sizes)) & (ranks != _NONE))
            fresh = np.append(True, np.diff(hits) > 1)
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
            symbols[hits] = self.by_rank[ranks[hits]]
            keep = ~np.repeat(done, sizes)
            keep[hits + 1] = False
            symbols, sequence = symbols[keep], sequence[keep]
        return counts

    def _pieces(self, chunk: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [piece.encode() for piece in self.split(text)]

    def _learn(self, chunks: list[str]) -> None:
        words, owner = [], []
        for i, chunk in enumerate(chunks):
            pieces = self._pieces(chunk)
            words += pieces
            owner += [i] * len(pieces)
        totals = np.bincount(owner, self.count_symbols(words), len(chunks)) if words else np.zeros(len(chunks))
        self.cache.update(zip(chunks, totals.astype(int).tolist(), strict=True))

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count one each."""
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        chunks = [[c for part in p for c in _CHUNK.findall(part)] for p in parts]
        met = set().union(*chunks)
        new = [c for c in met if c not in self.cache]
        if new:
            self.cache.room(len(new))
            self._learn(new if self.cache else list(met))
        count = self.cache.__getitem__
        return [sum(map(count, c)) + len(p) - 1 for c, p in zip(chunks, parts, strict=True)]


@functools.cache
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of each row, in one pass without a shuffle.

    Null texts count as empty (0 bytes, 0 tokens, not over the limit). Repeated rows stay repeated,
    null ids pass through, other columns are not read. ``path`` must be readable on every executor.
    A very long text is counted whole, in a block of its own.
    """

    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(by_block(texts, merger(path).count_texts), dtype="int64")

    text = whole(text_col)
    return docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
