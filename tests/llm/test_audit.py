"""The filter audit by applying every order to every document."""

import collections
import itertools
import random
import re

from tributary.llm import filter_audit


def fails_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        letter
        for letter, failed in (
            ("A", len(words) < 50),
            ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
            ("D", re.search(r"[#$%&*|]", text) is not None),
        )
        if failed
    )


def audit_by_force(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = collections.defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            ids[text or ""].append(i)
    parts = collections.defaultdict(list)
    for i, text, part in rows:
        twin = i is not None and min(ids[text or ""]) < i
        parts[part or ""].append((fails_by_force(text or "") + "E" * twin, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f in d[0] for d in docs) - len(removed), sum(d[0] == f for d in docs),
                    sum(d[1] for d in removed), sum(d[2] for d in removed),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def collected(df):
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def drawn(n, seed=2):
    rng = random.Random(seed)
    texts = [None, "", "same text", "SAME TEXT"]
    for _ in range(40):
        words = [rng.choice(["a", "b", "C", "d", "word", "éa"]) + str(rng.randrange(400)) * rng.randint(0, 1) for _ in range(rng.randint(0, 120))]
        texts.append("\n".join(words) + rng.choice(["", "", "#", " |"]))
    ids = [rng.randrange(n) if rng.random() < 0.9 else None for _ in range(n)]
    return [(i, rng.choice(texts), rng.choice(["web", "", None, "code"])) for i in ids]


def test_audit_by_force(spark):
    rows = drawn(300)
    labels = [(i, random.Random(i).choice([0, 1, None, 2]), i % 3 % 2) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert collected(filter_audit.audit(docs, known)) == audit_by_force(rows, labels)


def test_masks_by_force():
    for i, text, _ in drawn(200, 9):
        mask = filter_audit.text_mask((text or "").encode())
        assert "".join(f for b, f in enumerate("ABCD") if mask >> b & 1) == fails_by_force(text or "")
    assert filter_audit.text_mask("ÀÉ É".encode()) == 1  # capitals beyond A-Z don't count


def test_odd_rows_and_clashing_columns(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clashing = odd.selectExpr("*", *(f"'x' as {c}" for c in ("id", "part", "digest", "failed", "n", "mask", "good", "toxic", "steps")))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert collected(filter_audit.audit(clashing, labels)) == audit_by_force(rows, [])
    assert filter_audit.audit(none, labels).collect() == []


def test_copies_meet_as_one_row(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'the hot text' as text", "if(id % 3 = 0, 'a', 'b') as source")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    cells = {(r["part"], r["mask"]): (r["n"], r["good"]) for r in filter_audit.cells(docs, labels).collect()}
    assert cells == {("a", 1): (1, 1), ("a", 17): (6_666, 0), ("b", 17): (13_333, 0)}
