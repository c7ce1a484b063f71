"""BPE encoding, decoding and token counts against the tokenizers library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tributary.llm import bpe, token_counts
from tributary.llm.queries import vocabulary
from tributary.llm.texts import by_block

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
FIXED = [
    "", "a" * 60, "aaa aaaa  \n\n  x \t y", "<|endoftext|>hi<|endoftext|>", "don't I'LL we've 'S", "ΣΑΣ İstanbul é é",
    "日本語テキスト 🎉🎉 ١٢٣ ²³", " " * 40 + "x", "\x00\x1c\x1d b\x85 c", "ab" * 2_000, "<|startoftext|>q",
]


def texts():
    rng = random.Random(3)
    letters = "abAB 'stlré\n\t😀1２.,!?é​Σσ"
    return FIXED + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1_500)]


def test_ids_and_texts_equal_the_library():
    machine, library = bpe.MergeAutomaton(BYTE), Tokenizer.from_file(BYTE)
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        ids = machine.encode(text)
        assert ids == want.ids
        assert machine.decode(np.array(ids, np.int32)) == library.decode(want.ids, skip_special_tokens=False)


def test_paths_hold_only_arcs():
    machine = bpe.MergeAutomaton(BYTE)
    for word in (b" the", b"aaaaaaa", b" unbelievable", "größer".encode()):
        path = machine.encode_word(word)
        assert b"".join(machine.labels[t] for t in path) == word
        assert all(machine.follows(a, b) for a, b in zip(path, path[1:], strict=False))


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_ARCS", 2)
    tiny, usual = bpe.MergeAutomaton(BYTE), bpe.automaton(BYTE)
    assert [tiny.encode(t) for t in texts()[:200]] == [usual.encode(t) for t in texts()[:200]]


def test_counts_equal_the_library():
    want = [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts(), add_special_tokens=False)]
    assert by_block(texts(), token_counts.merger(WORD).count_texts) == want


def test_merges_must_come_after_their_parts(tmp_path):
    import json

    spec = json.load(open(WORD))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "bad.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.RankMerger(str(path))


def test_odd_rows(odd, none):
    back = bpe.decode(bpe.encode(odd, BYTE), BYTE)
    rows = back.select("doc_id", "text", "ids", "decoded", "score").collect()
    assert len(rows) == 7 and all(r["decoded"] == (r["text"] or "") and r["score"] == "x" for r in rows)
    assert [r["ids"] for r in rows if not r["text"]] == [[], []]
    counted = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd, WORD).collect()}
    assert counted[2, 0] == counted[3, 0] == counted[4, 4] == (0, False)
    assert counted[5, 28_000][1] is True
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).count() == token_counts.token_counts(none, WORD).count() == 0


def test_round_trip_is_encode_and_decode(odd, none):
    apart = bpe.decode(bpe.encode(odd, BYTE), BYTE).select("doc_id", "text", "score", "ids", "decoded").collect()
    once = bpe.round_trip(odd.withColumnRenamed("kept", "made"), BYTE).select("doc_id", "text", "score", "ids", "decoded").collect()
    assert sorted(map(str, once)) == sorted(map(str, apart))
    assert bpe.round_trip(none, BYTE).collect() == []
