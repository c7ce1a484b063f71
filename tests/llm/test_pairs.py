"""Near-duplicates, repeated byte strings and nearest neighbours against brute force."""

import random

import numpy as np
import pytest

from tributary.llm import ann, near_dup, suffixes
from tributary.llm import components as module
from tributary.llm.components import components
from tributary.scratch import Scratch


def roots_by_force(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("rounds", [False, True])
def test_components(spark, monkeypatch, rounds):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, x) for x in range(501, 600)]
    df = spark.createDataFrame(links, "a long, b long")
    if rounds:
        monkeypatch.setattr(module, "LOCAL_LINKS", 10)
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark, "t"), "c").collect()}
    want = roots_by_force({x for link in links for x in link}, links)
    assert got == {n: r for n, r in want.items() if n in got} and all(n in got for n, r in want.items() if n != r)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_classes_by_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3_000)}"
    texts = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(60)]
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(10, 200))]) for _ in range(60)]
    original = [word() for _ in range(400)]
    texts += [" ".join(original)] + [" ".join(edited(rng, original, rng.randint(1, 9))) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[3].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = [near_dup.shingles(t) for t in texts]
    links = [
        (i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or near_dup.similarity(marks[i], marks[j]) >= 0.8
    ]
    want = roots_by_force(range(len(texts)), links)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()} == want
    kept = sorted(r["doc_id"] for r in near_dup.one_of_each(docs).collect())
    assert kept == sorted(set(want.values()))


def test_short_texts_by_force(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for n in list(range(5, 21)) * 3:
        own = [word() for _ in range(n)]
        texts += [" ".join(t) for t in (own, [*own, word()], [word(), *own], [*own, word(), word()], [*own[:-1], word()], [word(), *own, word()])]
    marks = [near_dup.shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near_dup.similarity(marks[i], marks[j]) >= 0.8]
    for i, j in links:
        assert set(near_dup.prefix(marks[i])) & set(near_dup.prefix(marks[j]))
        assert near_dup._possible(near_dup.binned(marks[i]), near_dup.binned(marks[j])[None], len(marks[i]), np.array([len(marks[j])])).all()
    want = roots_by_force(range(len(texts)), links)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == want


def test_one_of_each_with_clashing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (3, c), (3, b), (3, c)]
    kept = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (2, b), (3, c)]


def test_similarity_follows_order():
    a = near_dup.shingles(" ".join(map(str, range(100))))
    b = near_dup.shingles(" ".join(map(str, [*range(50, 100), *range(50)])))
    assert near_dup.similarity(a, a) == 1.0 and near_dup.similarity(a, b) < 0.5
    assert near_dup.similarity(near_dup.shingles("ha " * 40), near_dup.shingles("ha " * 42)) > 0.9


def test_near_dup_odd_rows(odd, none):
    rows = near_dup.classes(odd).collect()
    assert len(rows) == 7
    assert sorted(((r["doc_id"], r["class_id"], r["class_rows"]) for r in rows), key=str)[:2] == [(1, 1, 2), (1, 1, 2)]
    assert near_dup.classes(none).count() == 0
    kept = near_dup.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 5  # null and empty texts are equal


def cut_by_force(texts):
    seen, out = set(), []
    for text in texts:
        data = text.encode()
        hit = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        spans = sum(1 for i, f in enumerate(hit) if f and (i == 0 or not hit[i - 1]))
        out.append((len(data), sum(hit), spans, bytes(c for c, f in zip(data, hit, strict=True) if not f)))
    return out


@pytest.mark.parametrize(("bucket", "hot", "tasks"), [(25, 1, 20_000), (25, 3, 20_000), (25, 3, 4), (100_000, 8, 20_000)])
def test_repeats_by_force(spark, monkeypatch, bucket, hot, tasks):
    monkeypatch.setattr(suffixes, "TASKS", tasks)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(bucket)
    letters = lambda n: "".join(rng.choices("abcdeé", k=n))
    shared = [letters(rng.choice([99, 100, 101, 150, 400])) for _ in range(6)]
    texts = ["".join(rng.choice([letters(rng.randint(0, 120)), rng.choice(shared)]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    texts += ["a" * 350, "ab" * 200, "a" * 150, texts[5], shared[0][:99], ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in suffixes.remove_repeats(docs).collect())
    assert [g for _, g in got] == cut_by_force(texts)


def test_only_leads_that_fill_buckets_are_hot(spark):
    leads = spark.range(30_000).selectExpr("cast(substr(sha2(cast(id as string), 256), 1, 32) as binary) as lead", "5L as n")
    cuts = suffixes.splitters(leads, 3_000)  # 50 leads a bucket
    assert cuts.hot == {} and len(cuts.cuts) == 2_999 and cuts.buckets == 3_000
    often = leads.unionByName(spark.range(1).selectExpr("cast(repeat('7', 32) as binary) as lead", "150000L as n"))
    cuts = suffixes.splitters(often, 3_000)
    assert list(cuts.hot) == [b"7" * 32] and abs(cuts.hot[b"7" * 32][1] - 1_500) <= 1
    rows = [bytes(r["lead"]) for r in leads.collect()]
    sizes = np.bincount(cuts.bucket_of(rows, np.zeros(len(rows), np.int64)))
    assert sizes.max() <= 40


def test_multikey_order():
    words = np.random.default_rng(1).integers(0, 3, (500, 6)).astype(np.uint64)
    assert words[suffixes.multikey_order(words)].tolist() == sorted(words.tolist())


def test_suffixes_odd_rows(odd, none):
    rows = suffixes.remove_repeats(odd).collect()
    assert len(rows) == 7 and suffixes.remove_repeats(none).count() == 0
    assert [(r["n_bytes"], r["n_removed"]) for r in rows if r["doc_id"] in (2, 3)] == [(0, 0), (0, 0)]
    assert [r["n_removed"] for r in rows if r["doc_id"] == 5][0] > 27_000


def nearest_by_force(ids, x, query, k):
    score = (x * x[ids.index(query)]).sum(1)
    return sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != query)[:k]


def test_nearest_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.5, 3, (400, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [float("inf")] * 8), (1100, []), (1120, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as leaf")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), search=1.0).collect()  # exact
    ids = list(range(400))
    for q in range(0, 400, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = nearest_by_force(ids, x, q, 20)
        assert [m[1] for m in mine] == [i for _, i in want] and [m[2] for m in mine] == [-s for s, _ in want]
    assert {r["query_id"] for r in got} == set(range(0, 400, 20))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = ann.nearest(df.filter("vec_id < 4"), df.filter("vec_id = 0")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3]


def test_nearest_with_repeated_rows(spark):
    x = np.random.default_rng(5).normal(size=(30, 8))
    twice = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(0, x[0].tolist())] * 40
    df = spark.createDataFrame(twice, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id < 2"), search=1.0).collect()
    for q in (0, 1):
        mine = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == [i for _, i in nearest_by_force(list(range(30)), x, q, 20)]


def test_every_query_gets_k_rows_however_little_is_searched(spark):
    x = np.random.default_rng(6).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 40, "vec_id long, embedding array<double>")
    counts = ann.nearest(df, df, search=0.0).groupBy("query_id").count().collect()
    assert len(counts) == 60 and {r["count"] for r in counts} == {20}


def test_opened_leaves_do_not_grow_with_the_rows():
    rng = np.random.default_rng(7)
    opened = []
    for n in (3_000, 30_000):
        x = rng.normal(size=(n, 16))
        forest = ann.fit_forest(x[:3_000], np.sqrt((x * x).sum(1)).max())
        sizes = np.bincount(forest.leaves_of(x).ravel(), minlength=ann.TREES << forest.depth)
        opened.append(np.mean([len(forest.open_leaves(q, sizes, ann.SEARCH * sizes.sum())) for q in x[:20]]))
    assert 0.8 < opened[0] / opened[1] < 1.25


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    pdf = e.toPandas()
    ids, x = pdf["vec_id"].tolist(), np.stack(pdf["embedding"].to_numpy()).astype(float)
    got = {}
    for r in ann.nearest(e, e.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[q] & {i for _, i in nearest_by_force(ids, x, q, 20)}) / 20 for q in got]
    assert len(hits) == sum(i % 20 == 0 for i in ids) and np.mean(hits) >= 0.9
