"""BPE encoding and decoding with an automaton over tokens.

Compilation goes through the merges in order and adds one gadget for each. The automaton's states
are the last tokens read. The gadget of a merge ``u v -> w`` adds a state ``w``:

* its outgoing arcs are a copy of those of ``v`` (what may follow ``v`` may follow ``w``),
* an arc ``w`` leads to it from every state that has an arc ``u`` (except from ``u`` itself if
  ``u = v``: runs are merged from the left),
* the arc ``v`` out of state ``u`` is taken away, for that pair is now always merged.

Of the tokenizations of a word, exactly the one that BPE makes is a path of this automaton. The
copied rows and columns are not written out (that would be states x tokens arcs); a gadget keeps
the pair it was made from, and an arc is looked up through the gadgets once, then kept in a table.
Encoding walks a table ``(node, byte) -> node`` of labels and follows the arcs, longest label
first; a prefix of a word has one path only, so each position is left behind at most once.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.texts import WHITE, Bounded, blocks, free_names, whole
from tributary.llm.token_counts import byte_letters

#: Distinct words and arcs that a Python worker keeps, some 200 and 150 bytes each.
CACHE_WORDS = 200_000
CACHE_ARCS = 400_000

#: Fixed value: how byte-level vocabularies of this kind split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPLIT = regex.compile(PATTERN.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]"))
_LAST = 1 << 40


class MergeAutomaton:
    """The automaton of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = 1 + max(*ids.values(), *special.values())
        self.left, self.right, self.made = [-1] * top, [-1] * top, [-1] * top
        self.labels: list[bytes] = [b""] * top
        self.shorter = [-1] * top
        self.pairs: dict[int, int] = {}
        self.nodes: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for letter, b in byte.items():
            self._label(ids[letter], bytes([b]))
        for rank, (a, b) in enumerate(merges):
            self._gadget(ids[a], ids[b], ids[a + b], rank)
        self._link()
        self.sizes = [len(label) for label in self.labels]
        for content, token in special.items():
            self.labels[token] = content.encode()
        self.specials = special
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.objects = np.array(self.labels, dtype=object)
        self.arcs, self.words = Bounded(CACHE_ARCS), Bounded(CACHE_WORDS)

    def _label(self, token: int, label: bytes) -> None:
        self.labels[token] = label
        node = 0
        for b in label:
            key = node << 8 | b
            node = self.nodes.setdefault(key, len(self.token_at))
            if node == len(self.token_at):
                self.token_at.append(-1)
        self.token_at[node] = token

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        if max(self.made[u], self.made[v]) >= rank or not self.labels[u] or not self.labels[v]:
            raise ValueError(f"merge {rank} comes before its parts")
        self.pairs[u << 20 | v] = rank
        if not self.labels[w]:
            self.left[w], self.right[w], self.made[w] = u, v, rank
            self._label(w, self.labels[u] + self.labels[v])

    def _link(self) -> None:
        """For each token the longest token that is a proper prefix of its label."""
        for token, label in enumerate(self.labels):
            node, before = 0, -1
            for b in label[:-1]:
                node = self.nodes[node << 8 | b]
                before = self.token_at[node] if self.token_at[node] >= 0 else before
            self.shorter[token] = before

    def follows(self, x: int, y: int) -> bool:
        """Whether state ``x`` has an arc ``y``."""
        key = x << 20 | y
        known = self.arcs.get(key)
        if known is None:
            self.arcs.room(1)
            known = self.arcs[key] = self._traced(x, y)
        return known

    def _traced(self, x: int, y: int) -> bool:
        left, right, made, pairs = self.left, self.right, self.made, self.pairs
        horizon = _LAST
        while True:
            if pairs.get(x << 20 | y, _LAST) < horizon:
                return False
            if made[x] < 0 and made[y] < 0:
                return True
            if made[x] > made[y]:
                horizon, x = made[x], right[x]
            elif made[y] > made[x]:
                if left[y] == right[y] == x:
                    return False
                horizon, y = made[y], left[y]
            else:
                horizon, x, y = made[x], right[x], left[x]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The one path of the automaton whose labels make up ``word``."""
        nodes, token_at, arcs, sizes, shorter = self.nodes.get, self.token_at, self.arcs.get, self.sizes, self.shorter
        path: list[int] = []
        at, size, left_behind, last, token = 0, len(word), set(), -1, -1
        while at < size:
            if token < 0:  # the longest label from here on
                node = 0
                for b in word[at:]:
                    node = nodes(node << 8 | b)
                    if node is None:
                        break
                    if token_at[node] >= 0:
                        token = token_at[node]
            end = at + sizes[token]
            if end not in left_behind:
                known = last < 0 or arcs(last << 20 | token)
                if known or (known is None and self.follows(last, token)):
                    path.append(token)
                    at, last, token = end, token, -1
                    continue
            token = shorter[token]
            while token < 0:
                left_behind.add(at)
                token = path.pop()
                at -= sizes[token]
                last = path[-1] if path else -1
                token = shorter[token]
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text; special strings become their own ids."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
        else:
            parts = [text]
        out: list[int] = []
        words = self.words
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            pieces = _SPLIT.findall(part)
            new = [c for c in set(pieces) if c not in words]
            if new:
                words.room(len(new))
                words.update((c, self.encode_word(c.encode())) for c in (new if words else set(pieces)))
            out.extend(itertools.chain.from_iterable(map(words.__getitem__, pieces)))
        return out

    def forget(self) -> None:
        """Empty the caches; a worker process outlives its task."""
        self.arcs.clear()
        self.words.clear()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: np.ndarray) -> str:
        """The text that the labels of ``ids`` make up; broken UTF-8 becomes replacement characters."""
        return b"".join(self.objects[ids].tolist()).decode("utf-8", "replace")


@functools.cache
def automaton(path: str) -> MergeAutomaton:
    machine = MergeAutomaton(path)
    gc.freeze()  # it stays; the collector need not walk it again and again
    return machine


def _encoded(texts: list[str], machine: MergeAutomaton) -> pa.Array:
    flat, offsets = [], [0]
    for text in texts:
        ids = machine.encode(text)
        flat.append(np.array(ids, dtype=np.int32))
        offsets.append(offsets[-1] + len(ids))
    values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _decoded(ids: pa.Array, machine: MergeAutomaton) -> pa.Array:
    values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array((machine.decode(values[a:b]) for a, b in itertools.pairwise(offsets)), pa.string())


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` in ``out_col`` (replaced if it is there already).

    One pass without a shuffle; all other columns and repeated rows stay. Null and empty texts
    give an empty list. Whole texts are encoded, however long.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        machine = automaton(path)
        return pa.concat_arrays([_encoded(run, machine) for run in blocks(t.as_py() for t in texts)] or [_encoded([], machine)])

    return docs.withColumn(out_col, ids(whole(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col`` in ``out_col``; null ids give the empty text. An id outside the vocabulary raises."""

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        return _decoded(ids, automaton(path))

    empty = F.array().cast(T.ArrayType(T.IntegerType()))
    return docs.withColumn(out_col, text(F.coalesce(F.col(ids_col), empty)))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: the ids go to the text's own Python worker only, not there and back.

    Rows and other columns stay; columns named ``ids_col`` and ``out_col`` are replaced. Null and empty
    texts give an empty list and the empty text.
    """
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    @F.arrow_udf(kind)
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(path)
        try:
            for texts in batches:
                ids, back = [], []
                for run in blocks(t.as_py() for t in texts):
                    ids.append(_encoded(run, machine))
                    back.append(_decoded(ids[-1], machine))
                if not ids:
                    ids, back = [_encoded([], machine)], [pa.array([], pa.string())]
                yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(back)], ["ids", "text"])
        finally:
            machine.forget()

    (made,) = free_names(docs, "made")
    rows = docs.withColumn(made, both(whole(text_col)))
    return rows.withColumns({ids_col: F.col(made)["ids"], out_col: F.col(made)["text"]}).drop(made)
