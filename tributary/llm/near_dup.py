"""Near-duplicates by order MinHash.

A text is the sequence of its five-word shingles, each labelled with its occurrence number. For
each of ``SKETCHES`` hash functions the ``LENGTH`` smallest labelled shingles are taken and kept in
text order; their hash is a bucket key. Texts of one bucket are candidates: equal keys need equal
shingles in equal order, so the chance grows with edit similarity. Candidates are verified by a
banded alignment of the labelled shingles: ``aligned / (n + m - aligned)`` must be ``SIMILARITY``
or more, and aligned places differ by no more than that leaves room for.

No group is expanded into pairs. Byte-equal texts are one node. In each bucket every text is first
compared with the bucket's leader, the text that shares most with all the others (of an original
and its copies, the original). Links are joined to components. What is left are buckets with more
than one component: there, the texts outside a bucket's largest component are compared with all of
it, in blocks, first by size, then by one-permutation MinHash values (the least shingle hash in each
of ``BINS`` ranges); only pairs of different components whose values let the threshold seem possible
leave a task. A true pair at the threshold is missed if its texts share none of the ``SKETCHES`` keys
(3 in a million), or if their values are ``DOUBT`` standard deviations off (3 in 100,000).

Both chances hold for long texts only. Texts of up to ``SHORT`` shingles are also keyed by their
least shingles, as many as differ at most between similar texts and one more, so that two similar
ones share such a key for certain, and their values are compared by a bound that no similar pair fails.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.components import components
from tributary.llm.texts import Bounded, blocks, free_names, whole
from tributary.scratch import Scratch

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
LENGTH = 5
BINS, FIRST_BINS = 256, 64
DOUBT = 4.0
#: Texts of so many shingles, and those similar to them, are found for certain.
SHORT = 40
#: Texts compared with a block at once, and texts in a block, of a bucket with several components.
ROWS_BLOCK, LEADERS_BLOCK = 2_000, 200

#: Shingles that a verifying task keeps, so that a text in many pairs is cut once.
_HELD = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.random.default_rng(20_240).integers(1, 2**63, (3, SKETCHES), dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(29)


class _Hashes(Bounded):
    def __missing__(self, word: str) -> int:
        self.room(1)
        data = word.encode()
        value = self[word] = zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)
        return value


_hashes = _Hashes(500_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Hashes of the labelled shingles in text order; one for a text of one to four words, none without words."""
    words = np.fromiter(map(_hashes.__getitem__, _WORD.findall(text.lower())), dtype=np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, dtype=np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = _mixed(out * np.uint64(0x100000001B3) + words[i : i + n])
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = np.append(False, ranked[1:] == ranked[:-1])
    if same.any():
        at = np.arange(n)
        label = at - np.maximum.accumulate(np.where(same, 0, at))
        out[order] = np.where(label > 0, _mixed(ranked + label.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), ranked)
    return out


def sketch(marks: np.ndarray) -> np.ndarray:
    """Bucket keys (signed 64 bits) of a text's shingles."""
    rows = (marks[None, :] ^ _MIX[0][:, None]) * _MIX[1][:, None]
    rows ^= rows >> _SHIFT
    rows *= _MIX[2][:, None]
    take = min(LENGTH, len(marks))
    at = np.argpartition(rows, take - 1, axis=1)[:, :take] if take < len(marks) else np.tile(np.arange(take), (SKETCHES, 1))
    at.sort(axis=1)
    keys = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(take << 8)
    for i in range(take):
        keys = _mixed(keys * np.uint64(0x100000001B3) + marks[at[:, i]])
    return keys.view(np.int64)


def prefix(marks: np.ndarray) -> np.ndarray:
    """More bucket keys of a short text (or one similar to a short text): its least shingles, one of which every similar text has among its own."""
    if len(marks) * SIMILARITY > SHORT:
        return np.zeros(0, np.int64)
    take = len(marks) - int(np.ceil(SIMILARITY * len(marks) - 1e-9)) + 1
    return _mixed(np.sort(marks)[:take] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def binned(marks: np.ndarray) -> np.ndarray:
    """16 bits of the least shingle hash in each of ``BINS`` equal ranges, 0 for a range without any."""
    ranked = np.sort(marks)
    first = np.searchsorted(ranked >> np.uint64(56), np.arange(BINS, dtype=np.uint64))
    inside = first < len(ranked)
    inside[inside] = (ranked[first[inside]] >> np.uint64(56)) == np.flatnonzero(inside)
    out = np.zeros(BINS, np.uint16)
    out[inside] = (ranked[first[inside]] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common order of two texts' labelled shingles, in the band the threshold allows."""
    band = (len(a) + len(b)) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1
    both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    at_b = at_b[near][np.argsort(at_a[near], kind="stable")]
    if np.all(at_b[1:] > at_b[:-1]):
        return len(at_b)
    ends: list[int] = []
    for j in at_b.tolist():
        k = bisect_left(ends, j)
        if k == len(ends):
            ends.append(j)
        else:
            ends[k] = j
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Aligned shingles over all; two texts without words are not alike."""
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    n = aligned(a, b)
    return n / (len(a) + len(b) - n)


def _node(text: Column) -> Column:
    """Byte-equal texts are one node."""
    return F.unhex(F.md5(text.cast("binary")))


def _sketches(nodes: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = 0
            for run in blocks(batch["text"]):
                found = [(i, shingles(t)) for i, t in enumerate(run, start)]
                start += len(run)
                kept = [(batch["node"].iat[i], len(m), sketch(m), prefix(m), binned(m).tobytes()) for i, m in found if len(m)]
                kept = [(node, n, np.append(keys, more), mins + keys.tobytes()) for node, n, keys, more, mins in kept]
                if not kept:
                    continue
                yield pd.DataFrame(
                    {"node": [k[0] for k in kept], "n": [k[1] for k in kept], "keys": [k[2] for k in kept], "mins": [k[3] for k in kept]}
                )

    return nodes.mapInPandas(work, "node binary, n long, keys array<long>, mins binary")


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The ``a, b`` pairs that the alignment confirms."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            good = []
            for a, b, text_a, text_b in batch[["a", "b", "text_a", "text_b"]].itertuples(index=False):
                if held > _HELD:
                    known.clear()
                    held = 0
                for node, text in ((a, text_a), (b, text_b)):
                    if node not in known:
                        known[node] = shingles(text)
                        held += len(known[node])
                good.append(similarity(known[a], known[b]) >= SIMILARITY)
            yield batch.loc[good, ["a", "b"]]

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return scratch.save(pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInPandas(check, "a binary, b binary"), name)


def _possible(a: np.ndarray, b: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` (bins of texts with ``sizes`` shingles) can be similar to ``a`` (``n`` shingles)."""
    apart = (a != b).sum(1)  # each such bin has a shingle of only one of both texts
    used = np.maximum(((a != 0) | (b != 0)).sum(1), 1)
    ratio = ((a == b) & (a != 0)).sum(1) / used
    union = (n + sizes) / (1 + SIMILARITY)
    spread = np.sqrt(SIMILARITY * (1 - SIMILARITY) / used * np.clip(1 - used / union, 0.1, 1))
    bound = apart <= (n + sizes) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9
    return np.where(np.minimum(n, sizes) <= SHORT, bound, ratio >= SIMILARITY - DOUBT * spread - 1 / used)


def _cross(rows: pd.DataFrame) -> list[tuple[bytes, bytes]]:
    """Pairs of different components in one block of a bucket whose sizes and bins can reach the threshold.

    A pair comes from the first of the sketch buckets it shares, and from one side of it, so it comes
    once from those; buckets of a short text's least shingles may bring it again.
    """
    key = rows["key"].iat[0]
    minor = rows["minor"].to_numpy(dtype=bool)
    leads = rows["lead"].to_numpy(dtype=bool)
    sizes, nodes, roots, mins = (rows[c].to_numpy() for c in ("n", "node", "root", "mins"))
    rest = np.flatnonzero(~leads)
    rest = rest[np.argsort(sizes[rest], kind="stable")]
    if not leads.any() or not len(rest):
        return []
    other = np.frombuffer(b"".join(m[: 2 * BINS] for m in mins[rest]), dtype=np.uint16).reshape(-1, BINS)
    keys = np.frombuffer(b"".join(m[2 * BINS :] for m in mins[rest]), dtype=np.int64).reshape(-1, SKETCHES)
    head = np.ascontiguousarray(other[:, :FIRST_BINS])
    size, pairs = sizes[rest], set()
    for i in np.flatnonzero(leads).tolist():
        node, n, root, own = nodes[i], sizes[i], roots[i], np.frombuffer(mins[i][: 2 * BINS], dtype=np.uint16)
        low, high = np.searchsorted(size, [SIMILARITY * n - 1e-9, n / SIMILARITY + 1e-9])
        at = np.arange(low, high)
        at = at[roots[rest[at]] != root]
        at = at[_possible(own[:FIRST_BINS], head[at], n, size[at])]
        at = at[_possible(own, other[at], n, size[at])]
        mine = np.frombuffer(mins[i][2 * BINS :], dtype=np.int64)
        if (mine == key).any():
            at = at[mine[(keys[at] == mine).argmax(1)] == key]
        pairs.update((min(node, nodes[j]), max(node, nodes[j])) for j in rest[at].tolist() if not minor[j] or node < nodes[j])
    return sorted(pairs)


def _crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """:func:`_cross` for each run of equal ``key, block, salt`` in sorted rows; a run may go over several batches."""
    held = pd.DataFrame()

    def runs(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        mark = rows[["key", "block", "salt"]].to_numpy()
        starts = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]).any(1)))
        ends = np.append(starts[1:], len(rows))
        done = len(starts) if last else len(starts) - 1
        pairs = [p for a, b in zip(starts[:done].tolist(), ends[:done].tolist(), strict=True) if b - a > 1 for p in _cross(rows.iloc[a:b])]
        return pd.DataFrame(sorted(set(pairs)), columns=["a", "b"], dtype=object), rows.iloc[starts[-1] :] if not last else rows.iloc[:0]

    for batch in batches:
        if len(batch):
            out, held = runs(pd.concat([held, batch], ignore_index=True) if len(held) else batch, False)
            if len(out):
                yield out
    if len(held):
        out, _ = runs(held, True)
        if len(out):
            yield out


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _left_over(rows: DataFrame, sketches: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs ``a, b`` in buckets that hold more than one component."""
    rows = scratch.save(_rooted(rows, roots), "rooted")
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.sum("c").alias("all"), F.max("c").alias("most"), F.count("*").alias("parts"))
    mixed = scratch.save(mixed.filter("parts > 1"), "mixed")
    rows = rows.join(mixed, "key").join(sketches.select("node", "n", "mins"), "node")
    rows = rows.withColumn("blocks", F.ceil((F.col("all") - F.col("most")) / LEADERS_BLOCK).cast("int")).withColumn("salts", F.ceil(F.col("all") / ROWS_BLOCK).cast("int"))
    place = F.xxhash64("node", F.lit(5))
    rows = rows.withColumn("minor", F.col("root") != F.col("major"))
    common = ("key", "node", "n", "mins", "root", "minor")
    every = rows.select(*common, F.lit(False).alias("lead"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(place, "salts").cast("int").alias("salt"))
    minor = rows.filter("minor")
    lead = minor.select(*common, F.lit(True).alias("lead"), F.pmod(place, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    place = ("key", "block", "salt")
    dealt = every.unionByName(lead).repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInPandas(_crossed, "a binary, b binary").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, node, class_id, first, class_rows, n_links`` of each row; ``first`` is the node of the class's least id."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    text = whole(text_col)
    rows = scratch.save(docs.select(F.col(id_col).alias("id"), _node(text).alias("node")), "nodes")
    nodes = scratch.save(rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "texts")
    source = docs.select(F.col(id_col).alias("id"), _node(text).alias("node"), text.alias("text"))
    picked = source.join(nodes.select("id", "node"), [source["node"] == nodes["node"], source["id"].eqNullSafe(nodes["id"])], "left_semi")
    sketches = scratch.save(_sketches(picked.select("node", "text")).dropDuplicates(["node"]), "sketches")
    keyed = sketches.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    keyed = scratch.save(keyed.join(sizes, "key"), "buckets")
    fame = keyed.groupBy("node").agg(F.sum(F.log2("size")).alias("fame"))
    famed = keyed.join(fame, "node")
    leaders = famed.groupBy("key").agg(F.max_by("node", F.struct("fame", "node")).alias("leader"))
    size = sketches.select("node", "n", "mins")
    pairs = keyed.join(leaders, "key").filter("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    ends = [size.select(*(F.col(c).alias(c if c == e else f"{c}_{e}") for c in size.columns)).withColumnRenamed(f"node_{e}", e) for e in ("a", "b")]
    pairs = pairs.join(ends[0], "a").join(ends[1], "b").filter(f"least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b)").select("a", "b")
    pairs = scratch.save(pairs, "led")
    wanted = keyed.select("node").distinct()
    texts = scratch.save(picked.select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "candidates")
    links = _verified(pairs, texts, scratch, "links")
    roots = components(links, scratch, "led-components")
    more = _left_over(keyed.select("key", "node"), sketches, roots, scratch).join(pairs, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(scratch.save(more, "left-over"), texts, scratch, "more-links"))
    roots = scratch.save(components(links, scratch, "components"), "roots")
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    member = _rooted(nodes, roots).join(degree, "node", "left")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "node")))["node"]
    total = member.groupBy("root").agg(F.min("id").alias("class_id"), first.alias("first"), F.sum("rows").alias("class_rows"))
    known = member.join(total, "root").select("node", "class_id", "first", "class_rows", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(known, "node")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, class_id, class_rows, n_links``.

    ``class_id`` is the least id of the class, ``class_rows`` its number of rows, ``n_links`` the
    confirmed links of the row's text to different texts. Null texts count as empty. Texts without
    words are alike only if byte-equal; texts of one to four words have one shingle, all their
    words. Null ids are kept; a class of null ids only has a null ``class_id``. Repeated rows stay.
    """
    return _classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_rows", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is the first of their class and whose id is its least, one row for each id and text.

    Columns stay as they are. Rows that share an id but not their text are told apart by the text.
    Rows without an id cannot be named as copies; they take no part and stay. Null and empty texts are
    equal texts, an empty table stays empty, and no column name is taken.
    """
    text, id_, node = free_names(docs, "near_text", "near_id", "near_node")
    named, nameless = docs.filter(F.col(id_col).isNotNull()), docs.filter(F.col(id_col).isNull())
    found = _classes(named, id_col, text_col).filter("id = class_id and node = first")
    keep = found.select(F.col("id").alias(id_), F.col("node").alias(node)).distinct()
    named = named.withColumn(text, _node(whole(text_col))).dropDuplicates([id_col, text])
    kept = named.join(keep, (F.col(text) == F.col(node)) & (F.col(id_col) == F.col(id_)), "left_semi")
    return kept.select(*docs.columns).unionByName(nameless)
