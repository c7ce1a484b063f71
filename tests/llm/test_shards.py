"""Jump consistent hashing, gapless places and written shards."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tributary.llm import sharding


def published(key, shards):
    """The walk of the published algorithm for one key, in whole numbers and doubles."""
    last, following = -1, 0
    while following < shards:
        last = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


def test_jump_by_force():
    rng = random.Random(4)
    keys = [0, 1, 2**64 - 1, *(rng.getrandbits(64) for _ in range(3_000))]
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump(np.array(keys, dtype=np.uint64), shards).tolist() == [published(k, shards) for k in keys]
    assert sharding.jump(np.array([], dtype=np.uint64), 24).tolist() == []
    with pytest.raises(ValueError):
        sharding.jump(np.array([1], dtype=np.uint64), 0)


def test_appended_shards_take_their_part_only():
    keys = np.random.default_rng(3).integers(0, 1 << 60, 200_000)
    for shards in (1, 5, 24, 100):
        before, after = sharding.jump(keys, shards), sharding.jump(keys, shards + 1)
        moved = before != after
        assert (after[moved] == shards).all()
        assert moved.mean() == pytest.approx(1 / (shards + 1), rel=0.1)
        assert np.bincount(after, minlength=shards + 1).max() < 1.2 * len(keys) / (shards + 1)


@pytest.mark.parametrize("block_rows", [1, 7, 50_000])
def test_entries_by_force(spark, odd, block_rows):
    copies = spark.range(500).selectExpr("7 as doc_id", "'the same' as text").unionByName(
        spark.range(300).selectExpr("id + 100 as doc_id", "concat('text é ', id % 40) as text")
    ).unionByName(spark.range(90).selectExpr("cast(null as long) as doc_id", "concat('t', id) as text"))
    docs = odd.select("doc_id", "text").unionByName(copies)
    rows = sharding.assign(docs, block_rows=block_rows).collect()
    want = []
    for r in docs.collect():
        name, text = "" if r["doc_id"] is None else str(r["doc_id"]), (r["text"] or "").encode()
        size, crc = len(text) + 8, zlib.crc32(text)
        key = int(hashlib.md5(name.encode()).hexdigest()[:15], 16)
        mix = int(hashlib.md5(f"{name},{size},{crc}".encode()).hexdigest()[:15], 16)
        want.append((published(key, 24), mix, r["doc_id"], size, crc, published(key, 25)))
    slots, expected = collections.Counter(), []
    for shard, _, doc_id, size, crc, grown in sorted(want, key=lambda x: x[:2]):
        expected.append((doc_id, size, crc, "key", shard, slots[shard], grown))
        slots[shard] += 1
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)


def test_many_copies_are_written_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 10)
    docs = spark.range(1_003).selectExpr("id div 1000 as doc_id", "'same' as text")
    rows = sharding.assign(docs, shards=3).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 1_003 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table_and_any_id(spark, none):
    assert sharding.assign(none).collect() == []
    words = spark.createDataFrame([("a", "x"), ("b", None)], "name string, body string")
    assert {r["name"]: r["size"] for r in sharding.assign(words, 4, "name", "body").collect()} == {"a": 9, "b": 8}


def test_written_shards_grow_by_moved_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text").unionByName(spark.range(400).selectExpr("id as doc_id", "'t' as text"))
    sharding.write_shards(docs, str(tmp_path / "old"), 6, files=2)
    held = spark.read.parquet(str(tmp_path / "old"))
    assert held.count() == docs.count()
    at = {r["doc_id"]: r["s"] for r in docs.select("doc_id", sharding.shard_column("doc_id", 6).alias("s")).collect()}
    assert {r["doc_id"]: r["shard"] for r in held.collect()} == at
    moved = sharding.append_shard(spark, str(tmp_path / "old"), str(tmp_path / "new"), 6)
    fresh = spark.read.parquet(str(tmp_path / "new"))
    assert {r["shard"] for r in fresh.collect()} == {6}
    assert fresh.count() == sum(r["moved"] for r in moved.collect())
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(held, str(tmp_path / "again"), 6)
