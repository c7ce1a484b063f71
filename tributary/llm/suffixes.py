"""Removal of repeated byte strings by sorted suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier is removed. Suffixes
are taken at anchors: places whose ``GRAM`` bytes have the smallest hash in some window of
``LENGTH`` bytes. Equal windows have equal anchors at equal offsets, so each repeated window is
found at an anchor, and there are only about two anchors for each 70 bytes.

1. Anchors whose bytes occur once are left out by two bitmaps of fixed size (they may let
   through some that occur once, never hold back others). The same pass samples leading bytes.
2. The suffixes of the rest (``LENGTH`` bytes from the anchor, and the bytes before it that a
   window may reach) are range-partitioned by their leading bytes; splitters are quantiles of a
   sample that grows with the input (``SAMPLED`` leads a bucket), found by a running total over a
   sorted table. Equal surroundings within a task are sent once; the later ones are removed where they are.
3. Each bucket sorts its suffixes by multikey quicksort (eight bytes at a time, only tied runs go
   on) and compares neighbours. For each offset, the rows of a run with enough common bytes to the
   right and equal bytes to the left hold one window; all but the earliest are removed.
4. Leading bytes that would fill ``HOT`` buckets or more (a passage that a large share of the
   documents have) would make one bucket too large. Their suffixes are dealt over as many buckets,
   and the windows are compared across the boundaries by a minimum for each distinct window.

Windows are told apart by exact bytes to the right and 64-bit hashes to the left within a bucket,
and by 128-bit hashes across buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.texts import whole
from tributary.operators.windows import with_positions
from tributary.scratch import Scratch

LENGTH = 100
GRAM = 32
_REACH = LENGTH - GRAM  # bytes before an anchor that a window around it may have
#: Bits of each of the two bitmaps. More bits keep out more anchors on larger inputs; the result is the same.
BITMAP_BITS = 27
_RANGE_BITS = 19
#: Anchors in a bucket, on average, before those that occur once have gone.
BUCKET_ROWS = 100_000
HOT = 8
#: Leading bytes sampled for the splitters, for each bucket on average.
SAMPLED = 50
#: Tasks of the comparison at most; beyond, a task takes several buckets, one after another.
TASKS = 20_000
_FLUSH_ANCHORS, _FLUSH_ROWS = 2_000_000, 150_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _sliding(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``size`` neighbours, by doubling."""
    width = 1
    out = x
    while 2 * width <= size:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(x) - size + 1], out[size - width : size - width + len(x) - size + 1])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of one text and the 64-bit hashes of their bytes; none under ``LENGTH`` bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM:
        h = h[:-width] * _power(_BASE, width) + h[width:]
        width *= 2
    rank = (_mixed(h) >> np.uint64(32)).astype(np.uint32)
    least = _sliding(rank, _REACH + 1, np.minimum)
    padded = np.concatenate([np.zeros(_REACH, np.uint32), least, np.zeros(_REACH, np.uint32)])
    places = np.flatnonzero(_sliding(padded, _REACH + 1, np.maximum) == rank)
    return places, _mixed(h[places] * _OTHER)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The slot of each hash in either bitmap."""
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    return [(hashes & mask).astype(np.uint32), ((hashes >> np.uint64(32)) & mask).astype(np.uint32)]


def _bytes(texts: pd.Series) -> Iterator[np.ndarray]:
    return (np.frombuffer((t or "").encode(), dtype=np.uint8) for t in texts)


def _packed(slots: np.ndarray) -> bytes:
    """Sorted slots as compressed steps."""
    return zlib.compress(np.diff(slots, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32), dtype=np.uint32)


def _surveyed(rows: DataFrame, scratch: Scratch) -> tuple[list[np.ndarray], DataFrame, int]:
    """Two bitmaps of the slots met twice or more, a stored sample of leading bytes (``lead, n``), and the number of anchors.

    The sizes of the bitmaps do not depend on the input, the sample grows with it: anchors are drawn by
    their number within the task, so that copies of one text are drawn at different places.
    """
    rate = np.uint64(max(1, BUCKET_ROWS // SAMPLED))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = total = 0
        picked: list[bytes] = []
        begin = TaskContext.get().partitionId() << 40

        mask = np.uint32((1 << _RANGE_BITS) - 1)

        def flush() -> Iterator[pd.DataFrame]:
            for which, x in enumerate(_slots(np.concatenate(held))):
                slot, n = np.unique(x, return_counts=True)
                parts = slot >> np.uint32(_RANGE_BITS)
                cuts = np.flatnonzero(np.diff(parts)) + 1
                runs = zip(np.split(slot, cuts), np.split(n, cuts), strict=True)
                packed = [(which << 16 | int(s[0] >> np.uint32(_RANGE_BITS)), _packed(s & mask), _packed(s[c > 1] & mask)) for s, c in runs if len(s)]
                yield pd.DataFrame(packed, columns=["part", "met", "again"])
            yield pd.DataFrame([(-1, lead, b"") for lead in picked], columns=["part", "met", "again"])

        for batch in batches:
            for data in _bytes(batch["text"]):
                places, hashes = anchors(data)
                held.append(hashes)
                turn = _mixed(_mixed(np.arange(begin + total, begin + total + len(places), dtype=np.uint64)) * _OTHER)
                drawn = places[(turn >> np.uint64(32)) % rate == 0]
                picked += [data[p : p + GRAM].tobytes() for p in drawn.tolist()]
                size += len(places)
                total += len(places)
                if size > _FLUSH_ANCHORS:
                    yield from flush()
                    held, size, picked = [], 0, []
        if size:
            yield from flush()
        yield pd.DataFrame([(-2, b"", total.to_bytes(8, "big"))], columns=["part", "met", "again"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, met, again in batch.itertuples(index=False):
                once, twice = state.setdefault(part, (np.zeros(1 << _RANGE_BITS, bool), np.zeros(1 << _RANGE_BITS, bool)))
                s = _unpacked(met)
                twice[s] |= once[s]
                once[s] = True
                twice[_unpacked(again)] = True
        yield pd.DataFrame([(p, np.packbits(t).tobytes()) for p, (_, t) in state.items()], columns=["part", "bits"])

    parts = scratch.save(rows.select("text").mapInPandas(slots, "part int, met binary, again binary"), "slots")
    leads = scratch.save(parts.filter("part = -1").groupBy(F.col("met").alias("lead")).agg(F.count("*").alias("n")), "leads")
    n = parts.filter("part = -2").agg(F.coalesce(F.sum(F.conv(F.hex("again"), 16, 10).cast("long")), F.lit(0))).first()[0]
    merged = parts.filter("part >= 0").repartition("part").mapInPandas(merge, "part int, bits binary").collect()  # at most 2 ** (BITMAP_BITS - 2) bytes
    scratch.drop("slots")
    maps = [np.zeros(1 << (BITMAP_BITS - 3), np.uint8) for _ in range(2)]
    width = 1 << (_RANGE_BITS - 3)
    for part, bits in merged:
        at = (part & 0xFFFF) * width
        maps[part >> 16][at : at + width] = np.frombuffer(bits, np.uint8)
    return maps, leads, n


@dataclass
class Splitters:
    """Where the buckets begin, and the leading bytes that are dealt over several buckets."""

    cuts: np.ndarray
    hot: dict[bytes, tuple[int, int]]  # first bucket and number of buckets

    @property
    def buckets(self) -> int:
        return len(self.cuts) + 1 + sum(n for _, n in self.hot.values())

    def bucket_of(self, leads: list[bytes], salt: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.cuts, np.array(leads, dtype=f"S{GRAM}"), side="right").astype(np.int64)
        if self.hot:
            for i, lead in enumerate(leads):
                if lead in self.hot:
                    first, n = self.hot[lead]
                    out[i] = first + salt[i] % n
        return out


def splitters(leads: DataFrame, buckets: int) -> Splitters:
    """Quantiles of sampled leading bytes (``lead, n``); a value that fills ``HOT`` buckets or more is a hot one.

    The sample stays in Spark; the driver gets the quantiles, 32 bytes a bucket.
    """
    sampled = leads.agg(F.sum("n")).first()[0]
    if not sampled or buckets < 2:
        return Splitters(np.zeros(0, f"S{GRAM}"), {})
    placed = with_positions(leads, [], ["lead"], sums={"upto": F.col("n")})
    ends = placed.select("lead", F.expr("upto - n").alias("before"), "upto")
    number = lambda c: F.expr(f"({c} * {buckets}L + {sampled - 1}L) div {sampled}L")  # noqa: E731  # quantiles before it
    times = ends.select("lead", (number("upto") - F.greatest(number("before"), F.lit(1))).alias("times")).filter("times > 0")
    cuts = sorted((bytes(r["lead"]), r["times"]) for r in times.collect())  # fewer than buckets
    hot, first = {}, len(cuts) + 1
    for cut, n in cuts:
        if n >= HOT:
            hot[cut] = (first, n)
            first += n
    return Splitters(np.array([cut for cut, _ in cuts], dtype=f"S{GRAM}"), hot)


def _is_set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint32(3)] >> (np.uint8(7) - (slots & np.uint32(7)).astype(np.uint8))) & np.uint8(1) == 1


_FOUND = "bucket int, id long, h long, at long, left binary, right binary, stop long"


def _surroundings(rows: DataFrame, maps: list[np.ndarray], cuts: Splitters) -> DataFrame:
    """Suffix rows (``stop`` null) with their bucket, and spans already known to be repeated (``at`` to ``stop``)."""
    sent = rows.sparkSession.sparkContext.broadcast((*maps, cuts))

    def settle(found: list[tuple]) -> pd.DataFrame:
        """Of equal surroundings the earliest is sent on, the others are spans."""
        out = pd.DataFrame(found, columns=["id", "h", "at", "left", "right"]).sort_values(["id", "h", "at"], kind="stable")
        again = out.duplicated(["left", "right"])
        left, right = out["left"].str.len(), out["right"].str.len()
        spans = out[again & (left + right >= LENGTH)]
        spans = pd.DataFrame({"id": spans["id"], "h": spans["h"], "at": spans["at"] - left[spans.index], "stop": spans["at"] + right[spans.index]})
        spans = _joined(spans).assign(left=None, right=None)
        spans["bucket"] = spans["at"] % sent.value[2].buckets  # spans only pass through
        out = out[~again].assign(stop=None)
        salt = (out["at"] + out["h"] % 1_000_003).to_numpy()
        out["bucket"] = sent.value[2].bucket_of([x[:GRAM] for x in out["right"]], salt)
        return pd.concat([out, spans])[["bucket", "id", "h", "at", "left", "right", "stop"]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second, _ = sent.value
        found: list[tuple] = []
        for batch in batches:
            for doc, h, data in zip(batch["id"], batch["h"], _bytes(batch["text"]), strict=True):
                places, hashes = anchors(data)
                a, b = _slots(hashes)
                raw = data.tobytes()
                found += [(doc, h, p, raw[max(0, p - _REACH) : p], raw[p : p + LENGTH]) for p in places[_is_set(first, a) & _is_set(second, b)].tolist()]
                if len(found) > _FLUSH_ROWS:
                    yield settle(found)
                    found = []
        if found:
            yield settle(found)

    return rows.mapInPandas(work, _FOUND)


def _joined(spans: pd.DataFrame) -> pd.DataFrame:
    """Spans of each document in order, touching ones as one."""
    spans = spans.sort_values(["id", "h", "at"], kind="stable")
    if spans.empty:
        return spans
    doc = spans.groupby(["id", "h"], sort=False).ngroup().to_numpy()
    reach = spans.groupby(doc)["stop"].cummax().to_numpy()
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (spans["at"].to_numpy()[1:] > reach[:-1]))
    return spans.groupby(np.cumsum(fresh), sort=False).agg({"id": "first", "h": "first", "at": "first", "stop": "max"})


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned words: sorted by the first word, then only tied runs by the next ones."""
    order = np.argsort(words[:, 0], kind="stable")
    for k in range(1, words.shape[1]):
        head = words[order, :k]
        tied = np.append(False, (head[1:] == head[:-1]).all(1))
        tied |= np.append(tied[1:], False)
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        run = np.cumsum(np.append(True, ~(head[at][1:] == head[at][:-1]).all(1)))
        order[at] = order[at][np.lexsort((words[order[at], k], run))]
    return order


def _matrix(values: list[bytes], width: int, reverse: bool = False) -> np.ndarray:
    padded = b"".join((v[::-1] if reverse else v).ljust(width, b"\0") for v in values)
    return np.frombuffer(padded, np.uint8).reshape(len(values), width)


_WIDE = -(-LENGTH // 8) * 8


def _sorted_bucket(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in suffix order, their bytes to the right, and the common bytes of each with the row before (capped by both ends)."""
    right = _matrix(rows["right"].tolist(), _WIDE)
    order = multikey_order(right.view(">u8").astype(np.uint64).reshape(len(rows), -1))
    rows, right = rows.iloc[order], right[order]
    size = rows["right"].str.len().to_numpy()
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(1), differ.argmax(1), _WIDE)
    return rows, right, np.append(0, np.minimum(common, np.minimum(size[1:], size[:-1])))


def _repeats_in(rows: pd.DataFrame, common: np.ndarray) -> pd.DataFrame:
    """Spans of the windows in sorted rows that an earlier row has as well."""
    left = _matrix(rows["left"].tolist(), _REACH, reverse=True)
    before, after = (rows[c].str.len().to_numpy() for c in ("left", "right"))
    place = np.lexsort((rows["at"], rows["h"], rows["id"]))
    earlier = np.empty(len(rows), np.int64)
    earlier[place] = np.arange(len(rows))
    low, high = np.full(len(rows), LENGTH), np.full(len(rows), -1)
    hashed = np.zeros(len(rows), np.uint64)
    for i in range(_REACH + 1):
        if i:
            hashed = hashed * _BASE + left[:, i - 1].astype(np.uint64) + np.uint64(1)
        run = np.cumsum(common < LENGTH - i)
        can = np.flatnonzero((before >= i) & (after >= LENGTH - i))
        if len(can) < 2:
            continue
        order = can[np.lexsort((earlier[can], hashed[can], run[can]))]
        same = np.append(False, (run[order][1:] == run[order][:-1]) & (hashed[order][1:] == hashed[order][:-1]))
        again = order[same]
        low[again] = np.minimum(low[again], i)
        high[again] = i
    hit = np.flatnonzero(high >= 0)
    at = rows["at"].to_numpy()[hit]
    return pd.DataFrame({"id": rows["id"].to_numpy()[hit], "h": rows["h"].to_numpy()[hit], "at": at - high[hit], "stop": at + LENGTH - low[hit]})


def _windows(rows: pd.DataFrame, right: np.ndarray) -> Iterator[pd.DataFrame]:
    """Every window of the rows with a 128-bit hash, for the comparison across buckets."""
    if rows.empty:
        return
    whole_row = np.hstack([_matrix(rows["left"].tolist(), _REACH, reverse=True)[:, ::-1], right[:, :LENGTH]]).astype(np.uint64) + np.uint64(1)
    before, after = (rows[c].str.len().to_numpy() for c in ("left", "right"))
    for i in range(_REACH + 1):
        can = np.flatnonzero((before >= i) & (after >= LENGTH - i))
        if not len(can):
            continue
        window = whole_row[can, _REACH - i : _REACH - i + LENGTH]
        keys = []
        for base in (_BASE, _OTHER):
            powers = np.cumprod(np.append(np.uint64(1), np.full(LENGTH - 1, base, np.uint64)), dtype=np.uint64)
            keys.append(_mixed((window * powers).sum(1, dtype=np.uint64)).view(np.int64))
        at = rows["at"].to_numpy()[can] - i
        yield pd.DataFrame({"id": rows["id"].to_numpy()[can], "h": rows["h"].to_numpy()[can], "at": at, "stop": None, "k1": keys[0], "k2": keys[1]})


def _buckets(found: DataFrame, cuts: Splitters) -> DataFrame:
    """Spans known before or found within buckets (``stop`` set), and the windows of dealt-out runs (``k1, k2`` set)."""
    plain, tasks = len(cuts.cuts) + 1, min(cuts.buckets, TASKS)
    shared = tasks < cuts.buckets

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            known = batch["stop"].notna()
            if known.any():
                yield batch[known][["id", "h", "at", "stop"]].astype("int64").assign(k1=None, k2=None)
            runs = [rows for _, rows in batch[~known].groupby("bucket")] if shared else [batch[~known]]
            for rows in runs:
                if shared and held and held[-1]["bucket"].iloc[0] != rows["bucket"].iloc[0]:
                    done, held = held, []
                    yield from compared(done)
                held.append(rows)
        yield from compared(held)

    def compared(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        held.clear()
        if rows.empty:
            return
        rows, right, common = _sorted_bucket(rows)
        dealt = rows["bucket"].to_numpy() >= plain
        yield from _windows(rows[dealt], right[dealt])
        run = np.cumsum(common < GRAM)
        several = ~dealt & (np.bincount(run)[run] > 1)
        inner = rows[several]
        if len(inner):
            spans = _joined(_repeats_in(inner, common[several]))
            yield spans.assign(k1=None, k2=None)

    dealt_out = found.repartitionById(tasks, F.col("bucket") % tasks)
    if shared:
        dealt_out = dealt_out.sortWithinPartitions("bucket")
    return dealt_out.mapInPandas(work, "id long, h long, at long, stop long, k1 long, k2 long")


def _across(windows: DataFrame) -> DataFrame:
    """Spans of windows that occur earlier in another place, by a minimum for each distinct window."""
    spot = F.struct("id", "h", "at")
    first = windows.groupBy("k1", "k2").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).filter("first != last")
    return windows.join(first, ["k1", "k2"]).filter(spot != F.col("first")).select("id", "h", "at", (F.col("at") + LENGTH).alias("stop"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, h, at, stop``: byte spans of each document (id and text hash) that repeat earlier bytes; they may overlap."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    rows = _keyed(docs, id_col, text_col).drop("out")
    maps, leads, n = _surveyed(rows, scratch)
    cuts = splitters(leads, max(1, -(-n // BUCKET_ROWS)))
    spans = scratch.save(_buckets(_surroundings(rows, maps, cuts), cuts), "buckets")
    known = spans.filter("stop is not null").select("id", "h", "at", "stop")
    return known.unionByName(_across(spans.filter("stop is null").select("id", "h", "at", "k1", "k2")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Null ids come before all others; rows of one id are told apart, and ordered, by a hash of the text."""
    text = whole(text_col)
    least = F.lit(-(2**63)).cast("long")
    key = F.coalesce(F.col(id_col).cast("long"), least)
    return docs.select(key.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), F.col(id_col).alias("out"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept`` (binary) of each row.

    Null texts count as empty. Rows equal in id and text are one document and get equal results;
    different texts of one id are ordered by a hash. What is kept may end inside a character.
    """
    rows = _keyed(docs, id_col, text_col)
    lists = repeated_spans(docs, id_col, text_col).groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("at", "stop"))).alias("spans"))
    kind = T.StructType().add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept", T.BinaryType())

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, known in zip(texts, spans, strict=True):
            data, kept, reach, removed, runs = text.encode(), [], 0, 0, 0
            for span in known if known is not None else ():
                at, stop = span["at"], span["stop"]
                if at > reach or not runs:
                    kept.append(data[reach:at])
                    runs += 1
                    removed += stop - at
                    reach = stop
                elif stop > reach:
                    removed += stop - reach
                    reach = stop
            out.append((removed, runs, b"".join([*kept, data[reach:]])))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    joined = rows.join(lists.hint("shuffle_hash"), ["id", "h"], "left").withColumn("cut", cut("text", "spans"))
    return joined.select(F.col("out").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", "cut.kept")
