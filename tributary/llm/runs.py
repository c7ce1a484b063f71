"""Periodic runs of words: stretches that repeat themselves three times or more.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and
a length of at least ``max(LEAST, 3 * q)`` that no neighbouring word extends keeping period ``q``.

Method: a suffix automaton reads the words one by one, and its tree of suffix links is held as a
link-cut tree whose preferred paths have one colour each: the last word number at which the strings
of the path ended. Word ``i`` makes its state accessed; each path segment met on the way to the root
says where its strings ended last (its colour ``j``) and how long the longest of them is. If the
distance ``i - j`` is no more than that length, the two occurrences touch: a square of period
``i - j`` ends at ``i``, and that period is the smallest one, for a shorter one would have shown a
later end. The first square of each run is extended to both sides; then the path takes colour ``i``.

Only stretches that can hold a run are read by an automaton. A run equals itself ``q`` words on over
``max(16, 2 * q)`` words or more, so each of its words lies in a window of 16 words that occurs
again within the run. Windows are compared by hash for many texts at once; a stretch is given up
only where that is certain.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.texts import blocks, whole

#: Words of the shortest run.
LEAST = 24
#: Each word of a run lies in a window of so many words that occurs again within the run.
WINDOW = LEAST * 2 // 3
_FACTOR = 0x9E3779B97F4A7C15

RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), containsNull=False
)
_RUN_ARROW = pa.list_(pa.struct([pa.field(c, pa.int64(), nullable=False) for c in ("start", "length", "period")]))


class _Paths:
    """A link-cut tree without reversal: splay trees of preferred paths, nearer the root to the left."""

    def __init__(self, size: int):
        self.up, self.less, self.more = [0] * size, [0] * size, [0] * size
        #: Holds for a whole path; kept at the top of its splay tree.
        self.colour = [-1] * size

    def _rotate(self, x: int) -> None:
        up, less, more = self.up, self.less, self.more
        y = up[x]
        z = up[y]
        if less[z] == y:
            less[z] = x
        elif more[z] == y:
            more[z] = x
        up[x] = z
        if less[y] == x:
            inner = more[x]
            less[y], more[x] = inner, y
        else:
            inner = less[x]
            more[y], less[x] = inner, y
        if inner:
            up[inner] = y
        up[y] = x

    def splay(self, x: int) -> int:
        """Bring ``x`` to the top of its path's tree; returns the colour of the path."""
        up, less, more = self.up, self.less, self.more
        top = x
        above = up[top]
        while less[above] == top or more[above] == top:
            top = above
            above = up[top]
        if top == x:
            return self.colour[x]
        colour = self.colour[x] = self.colour[top]
        while x != top:
            y = up[x]
            if y == top:
                self._rotate(x)
                break
            last = up[y] == top
            self._rotate(y if (less[y] == x) == (less[up[y]] == y) else x)
            self._rotate(x)
            if last:
                break
        return colour

    def insert_above(self, x: int, node: int) -> None:
        """Put ``node`` between ``x`` and its parent, on the path of ``x``."""
        self.colour[node] = self.splay(x)
        ancestors = self.less[x]
        self.less[node], self.more[node] = ancestors, x
        self.up[node] = self.up[x]
        if ancestors:
            self.up[ancestors] = node
        self.less[x] = 0
        self.up[x] = node


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run in a list of word numbers (0 or more), by start and period."""
    n = len(words)
    size = 2 * n + 2  # state 0 is none, state 1 the empty string
    length, link = [0] * size, [0] * size
    word_of, target, others = [-1] * size, [0] * size, {}  # first arc of each state, further ones
    tree = _Paths(size)
    up, more, colour, splay = tree.up, tree.more, tree.colour, tree.splay
    last, states = 1, 2
    reached: dict[int, int] = {}  # end of the latest run of each period
    found = []
    for i, c in enumerate(words):
        new, p, q = states, last, 0
        states += 1
        length[new] = i + 1
        while p:
            if word_of[p] == c:
                q = target[p]
                break
            arcs = others.get(p)
            if word_of[p] < 0:
                word_of[p], target[p] = c, new
            elif arcs is None:
                others[p] = {c: new}
            elif c in arcs:
                q = arcs[c]
                break
            else:
                arcs[c] = new
            p = link[p]
        if not q:
            parent = 1
        elif length[p] + 1 == length[q]:
            parent = q
        else:
            parent = states
            states += 1
            length[parent], link[parent] = length[p] + 1, link[q]
            word_of[parent], target[parent] = word_of[q], target[q]
            if q in others:
                others[parent] = others[q].copy()
            tree.insert_above(q, parent)
            link[q] = parent
            while p:
                if word_of[p] == c:
                    if target[p] != q:
                        break
                    target[p] = parent
                elif others.get(p, {}).get(c) == q:
                    others[p][c] = parent
                else:
                    break
                p = link[p]
        link[new] = up[new] = parent
        last = below = new
        x = parent
        while x:
            before = splay(x)
            period = i - before
            if period <= length[x] and reached.get(period, -1) < i:
                start, end = i - 2 * period + 1, i + 1
                while end < n and words[end] == words[end - period]:
                    end += 1
                while start and words[start - 1] == words[start - 1 + period]:
                    start -= 1
                reached[period] = end - 1
                if end - start >= max(LEAST, 3 * period):
                    found.append((start, end - start, period))
            if more[x]:
                colour[more[x]] = before
            more[x] = below
            below, x = x, up[x]
        colour[below] = i
    return sorted(found, key=lambda r: (r[0], r[2]))


def _windows(words: np.ndarray) -> np.ndarray:
    """A hash of each window of ``WINDOW`` words, by doubling."""
    h, width = words, 1
    while width < WINDOW:
        with np.errstate(over="ignore"):
            h = h[:-width] * np.uint64(_FACTOR ^ width * 0x10001) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    return h


def _repeated(windows: np.ndarray, reach: int) -> np.ndarray:
    """Which windows occur again at most ``reach`` words away."""
    order = np.argsort(windows, kind="stable")
    near = (windows[order[1:]] == windows[order[:-1]]) & (order[1:] - order[:-1] <= reach)
    out = np.zeros(len(windows), dtype=bool)
    out[order[1:][near]] = True
    out[order[:-1][near]] = True
    return out


def _stretches(windows: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """Parts of the words ``first`` to ``last`` (exclusive) whose windows all occur again within a third of the part."""
    todo, done = [(first, last)], []
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        again = _repeated(windows[a : b - WINDOW + 1], (b - a) // 3)
        edge = np.zeros(b - a + 1, dtype=np.int64)
        at = np.flatnonzero(again)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        covered = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
        cuts = np.flatnonzero(covered[1:] != covered[:-1])
        parts = [(a + int(s), a + int(e)) for s, e in zip(cuts[::2], cuts[1::2], strict=True)]
        if parts == [(a, b)]:
            done.append((a, b))
        else:
            todo.extend(parts)
    return done


def _all_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several lists of words."""
    sizes = [len(words) for words in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    total = sum(sizes)
    if total < LEAST:
        return out
    hashes = np.fromiter((hash(w) for words in texts for w in words), dtype=np.int64, count=total).view(np.uint64)
    windows = _windows(hashes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(windows)] == owner[WINDOW - 1 :]
    with np.errstate(over="ignore"):
        own = windows + owner[: len(windows)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ordered = np.sort(own[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    suspects = np.unique(owner[: len(windows)][inside & np.isin(own, twice)]) if len(twice) else []
    ends = np.cumsum(sizes)
    for k in suspects:
        first, last = int(ends[k]) - sizes[k], int(ends[k])
        for a, b in _stretches(windows, first, last):
            numbers: dict[bytes, int] = {}
            words = [numbers.setdefault(w, len(numbers)) for w in texts[k][a - first : b - first]]
            out[k].extend((a - first + s, n, q) for s, n, q in runs_of(words))
        out[k].sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = list(compress(words, keep))
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, text_col: str = "text", out_col: str = "found") -> DataFrame:
    """``docs`` with ``out_col``: a struct of all ``runs(start, length, period)`` and the ``collapsed`` text.

    Words are what ASCII white space separates, numbered from 0; runs are sorted by start, then
    period; no two of them have the same start and period. The collapsed text joins the words that
    no run holds after its first period.

    One pass without a shuffle: all rows stay, repeated ones and those with null ids too, and all other
    columns (``out_col`` is replaced if it is there already). Null and empty texts, and
    texts without words, have no runs and an empty collapsed text. A very long text is read whole by
    one task; the automaton takes some 250 bytes a word of the stretches that can hold a run. An
    empty table gives an empty result.
    """
    kind = T.StructType([T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    @F.arrow_udf(kind)
    def found(texts: pa.Array) -> pa.Array:
        runs, short = [], []
        for block in blocks(texts.to_pylist()):
            words = [text.encode().split() for text in block]
            for one, its in zip(words, _all_runs(words), strict=True):
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in its])
                short.append(_collapsed(one, its))
        return pa.StructArray.from_arrays([pa.array(runs, _RUN_ARROW), pa.array(short, pa.string())], ["runs", "collapsed"])

    return docs.withColumn(out_col, found(whole(text_col)))


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period (ties: least start, then period); null without runs."""
    # a / b > c / d as a * d > c * b, in integers; runs come by start and period, so the first of equals stays
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))),
        F.get(runs, F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
