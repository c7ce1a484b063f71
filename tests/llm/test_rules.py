"""License signatures, quality rules and toxicity."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tributary.llm import licenses, quality, toxicity

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_by_force(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    found = [
        (i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("seed", range(30))
def test_base_phrases_by_force(seed):
    rng = random.Random(seed)
    parts = ["GNU", "general", "Public", "License", "apache", "CC", "by", "MIT", "x", "é", "nc", "2.0", "İ"]
    text = "".join(rng.choice(parts) + rng.choice([" ", "-", "\n", ", "]) for _ in range(rng.randint(0, 80)))
    assert licenses.scanner().scan(text)[:5] == base_by_force(text)


def test_priority_and_containment():
    scan = licenses.scanner().scan
    assert scan("Licensed under the Apache License, Version 2.0.")[5] == "apache,apache-2.0"
    assert scan("SPDX-License-Identifier: GPL-3.0-or-later")[5:7] == ("gpl-3.0", 1.0)
    assert [s[2] for s in scan("x released under the terms of the MIT License y")[7]] == ["mit"]
    assert scan("Creative Commons Attribution-NonCommercial 4.0")[5] == "cc-by-nc"
    assert len(licenses.signatures()) > 300


def examples(tree):
    """Every alternative of a parsed pattern, without look-aheads."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "IN":
            parts = [chr(a) for _, a in arg]
        elif name == "BRANCH":
            parts = [e for t in arg[1] for e in examples(t)]
        elif name == "SUBPATTERN":
            parts = examples(arg[3])
        elif name == "MAX_REPEAT":
            parts = ["", *examples(arg[2])]
        else:
            assert name == "ASSERT_NOT"
            parts = [""]
        out = [a + b for a in out for b in parts]
    return out


def test_keywords_hide_no_detection():
    gated, free = licenses.Scanner(), licenses.Scanner()
    free.gate, free.by_word = re.compile(rb"^ "), {b" ": list(range(len(free.rules)))}
    patterns = [n[2] for n in licenses.NAMES] + [s[2] for s in licenses.SENTENCES]
    for text in {e for p in patterns for e in examples(re._parser.parse(p))}:
        line = f"x released under the {text} x".replace("  ", " ")
        assert gated.scan(line) == free.scan(line), line
    for label, _, pattern, weight in licenses.SENTENCES:
        for text in examples(re._parser.parse(pattern)):
            got = gated.scan(f"One; {text.upper()}. Two".replace(" and or ", " and/or "))
            assert label in got[5].split(",") and got[6] >= weight, text
    assert gated.scan("FreeBSD License")[5] == "bsd-2-clause" and gated.scan("zero clause BSD license")[5] == "0bsd"


def test_repeat_words_by_force():
    rng = random.Random(1)
    for _ in range(200):
        words = rng.choices("abc", k=rng.randint(0, 12))
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + s for i, w in enumerate(windows) if windows.count(w) > 1 for s in range(3)}
        assert quality.repeat_words(words) == len(hit)


def test_ledger_policies_and_ablations(spark, odd, none):
    book = quality.ledger(odd)
    assert quality.ledger(none).count() == 0
    rows = book.collect()
    assert len(rows) == 7 and {r["failed"] & 1 for r in rows if (r["n_words"] < 50)} == {1}
    assert [r["n_words"] for r in rows if r["doc_id"] == 5] == [5_001]
    for policy, mask in quality.POLICIES.items():
        kept = {str(r) for r in book.filter(quality.passes(policy)).collect()}
        assert kept == {str(r) for r in rows if not r["failed"] & mask}
        for a in quality.ablations(book, policy).collect():
            bit = quality.BIT[a["rule"]]
            masks = [r["failed"] & mask for r in rows]
            assert a["n_failed"] == sum(bool(m & bit) for m in masks) and a["n_only"] == sum(m == bit for m in masks)
            assert a["n_kept_without"] == sum(not m & ~bit for m in masks)


def prose(rng, n, lexicon, rate):
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    return " ".join(rng.choice(lexicon) if rng.random() < rate else rng.choice(common) for _ in range(n))


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    bad = ["grumpf", "zorkish", "blegh"]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 4 == 0
        rows.append((i, prose(rng, rng.randint(20, 120), bad, 0.06 if toxic else 0.0), "s"))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert 100 < len(out) < 260
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.95
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_toxicity_does_not_follow_the_class_ratio(spark):
    """The same ordinary texts once and seven times: the same model and curve."""
    rng = np.random.default_rng(6)
    x, y = np.append(rng.normal(2, 1, 90), rng.normal(0, 1, 90)), np.repeat([1.0, 0.0], 90)
    many = np.append(np.ones(90, int), np.full(90, 7))
    assert toxicity._fit_curve(np.repeat(x, many), np.repeat(y, many)) == pytest.approx(toxicity._fit_curve(x, y), rel=0.01)
    counts = [("", "a", 200, 8), ("", "b", 150, 150), ("a", "b", 120, 0), ("b", "b", 100, 110)]
    corpus = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1_000_000)], "word string, n long")
    gains = []
    for n in (1, 7):
        rows = spark.createDataFrame([(h, w, t, o * n) for h, w, t, o in counts], "first string, word string, toxic_n long, ordinary_n long")
        model = toxicity._models(rows, corpus, {"toxic_n": 300, "ordinary_n": 300 * n})
        gains.append([*(model.toxic.word - model.ordinary.word), *(model.toxic.gain - model.ordinary.gain)])
    assert gains[1] == pytest.approx(gains[0], rel=0.1)


def test_toxicity_keeps_every_word_apart(spark):
    """A frequent stranger with the crc32 of a toxic word modulo 2 ** 18 - 1 does not hide it."""
    rng = random.Random(7)
    bad = ["grumpf", "zorkish", "blegh"]
    slot = lambda w: zlib.crc32(w.encode()) % ((1 << 18) - 1)
    letters = (f"x{a}{b}{c}{d}{e}" for a, b, c, d, e in itertools.product("abcdefghijklmnopqrst", repeat=5))
    stranger = next(w for w in letters if slot(w) == slot("grumpf"))
    rows = [(i, prose(rng, 60, bad, 0.06 if i % 2 else 0.0)) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1_000 + i, f"{stranger} " * 5_000) for i in range(40)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert all(model.feature(f"wea {w} wfa") > 0.5 for w in bad) and model.feature(f"wea {stranger} wfa") < 0.5


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 1), (3, 0, None), (5, 1, 7)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 7 and {r["score"] for r in rows} == {0.5}
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0
    assert all(r["held_out"] is not None for r in rows)


def test_license_odd_rows(odd, none):
    rows = licenses.license_scan(odd).collect()
    assert len(rows) == 7 and licenses.license_scan(none).count() == 0
    assert [(r["n_words"], r["labels"], r["score"], r["first_word"]) for r in rows if r["doc_id"] in (2, 3, 4)] == [(0, "", 0.0, None)] * 3


def test_long_text_with_many_detections():
    got = licenses.scanner().scan("MIT license " * 50_000)
    assert got[:4] == (100_000, 50_000, 0, 99_998) and len(got[7]) == 50_000 and got[7][:2] == [(0, 2, "mit", 10), (2, 4, "mit", 10)]


@pytest.mark.parametrize("seed", range(20))
def test_containment_by_force(seed):
    rng = random.Random(seed)
    reach, taken = licenses._Reach(60), []
    for _ in range(80):
        a = rng.randrange(60)
        b = rng.randint(a + 1, 61)
        assert (reach.at(a) >= b) == any(x <= a and b <= y for x, y in taken)
        if rng.random() < 0.5:
            reach.add(a, b)
            taken.append((a, b))
