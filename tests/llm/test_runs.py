"""Periodic runs against a search through all periods."""

import hashlib
import os
import random
import re
import zlib

import pytest

import __spark_entry__ as entry_point
from tributary.llm import queries, runs


def by_force(w):
    found = []
    for q in range(1, len(w) // 3 + 1):
        at = q
        while at < len(w):
            if w[at] != w[at - q]:
                at += 1
                continue
            start = at - q
            while at < len(w) and w[at] == w[at - q]:
                at += 1
            smaller = any(all(w[x] == w[x - d] for x in range(start + d, at)) for d in range(1, q) if q % d == 0)
            if at - start >= max(24, 3 * q) and not smaller:
                found.append((start, at - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def drawn(seed):
    rng = random.Random(seed)
    kinds, out = rng.choice([1, 2, 2, 3, 5, 30]), []
    while len(out) < rng.randint(0, 250):
        out += [rng.randrange(kinds) for _ in range(rng.randint(1, 14))] * rng.choice([1, 1, 2, 3, 5, 9])
    return out


@pytest.mark.parametrize("block", range(10))
def test_automaton_and_windows_by_force(block):
    lists = [drawn(100 * block + i) for i in range(60)]
    texts = [[b"%d" % x for x in w] for w in lists]
    want = [by_force(w) for w in lists]
    assert [runs.runs_of(w) for w in lists] == want
    assert runs._all_runs(texts) == want
    assert sum(map(len, want)) > 10


def test_runs_that_overlap_and_nest():
    inner = [0, 1] * 15  # a run of period 2 within each copy of a run of period 33
    w = (inner + [2, 3, 4]) * 3
    got = runs.runs_of(w)
    assert (0, 99, 33) in got and (0, 30, 2) in got and (33, 30, 2) in got and (66, 30, 2) in got
    assert got == by_force(w)


def test_long_stretches():
    words = [b"w%d" % (i % 20_000) for i in range(60_000)]
    assert runs._all_runs([words]) == [[(0, 60_000, 20_000)]]
    assert runs._all_runs([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    assert runs._all_runs([[b"w%d" % i for i in range(100_000)]]) == [[]]


def test_odd_rows(spark, odd, none):
    rows = runs.periodic_runs(odd).collect()
    assert len(rows) == odd.count() and rows[0]["kept"] == "x"
    texts = {r["doc_id"]: r for r in rows}
    assert texts[2]["found"]["runs"] == [] and texts[2]["found"]["collapsed"] == ""
    assert texts[4]["found"]["collapsed"] == ""
    assert [tuple(r) for r in texts[5]["found"]["runs"]] == [(0, 5_000, 1)]
    assert texts[5]["found"]["collapsed"] == "long " + "x" * 3_000
    assert runs.periodic_runs(none).collect() == []
    assert len(runs.periodic_runs(odd.withColumnRenamed("ids", "found")).columns) == len(odd.columns)


@pytest.mark.skipif(not os.path.isdir(entry_point.SMALL), reason="no test tables")
def test_query_by_force(spark):
    docs = spark.read.parquet(f"{entry_point.SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, "a " * 40), (30, None), (31, "")], "doc_id long, text string"), True)
    got = {}
    keep = queries.table
    queries.table = lambda *_: docs
    try:
        got = {(r["doc_id"], r["collapsed_sha256"]): r for r in queries.QUERIES["op12_periodic_runs"](spark, "").collect()}
    finally:
        queries.table = keep
    planted = 0
    for row in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        n, h = len(w), None if row["doc_id"] is None else zlib.crc32(str(row["doc_id"]).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = by_force(w) if len(set(w)) < n else []
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        r = got.pop((row["doc_id"], hashlib.sha256(text.encode()).hexdigest()))
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["n_runs"] == len(found) and r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
    assert planted > 10 and not got


def test_strongest(spark):
    rows = [([(0, 30, 10), (5, 24, 8), (7, 24, 8)],), ([(0, 24, 8), (0, 48, 16)],), ([],), ([(1, 60, 2), (2, 90, 3)],)]
    df = spark.createDataFrame(rows, "r array<struct<start:bigint,length:bigint,period:bigint>>")
    best = [r[0] and tuple(r[0]) for r in df.select(runs.strongest(df["r"])).collect()]
    assert best == [(0, 30, 10), (0, 24, 8), None, (1, 60, 2)]
