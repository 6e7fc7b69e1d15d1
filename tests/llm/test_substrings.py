"""Removal of passages that an earlier document holds, against all windows of all documents."""

import hashlib
import random
import re

import numpy as np
import pytest

from foliant.llm import substrings
from foliant.llm.substrings import WINDOW


def expected(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for at in range(len(w) - WINDOW + 1):
                key = tuple(w[at : at + WINDOW])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = {k for at in range(len(w) - WINDOW + 1) if i is not None and least[tuple(w[at : at + WINDOW])] < i for k in range(at, at + WINDOW)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    rows = substrings.drop_repeats(docs).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str)


def test_corpus(corpus):
    assert found(corpus) == expected([(r["doc_id"], r["text"]) for r in corpus.collect()])


@pytest.mark.parametrize("part", [1 << 17, 16])
def test_few_words_and_shared_passages(spark, monkeypatch, part):
    """Seeds that occur everywhere in different contexts, texts of one word, passages cut short by a word on either side."""
    monkeypatch.setattr(substrings, "_WORD_PART", part)
    rng = random.Random(part)
    passage = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["z " * n for n in (12, 13, 14, 60)] + ["a b c\x0bd\x1fe " * 20, "", None]
    for n in range(8, 20):
        lo = rng.randrange(20)
        texts.append(" ".join([f"x{n}", *passage[lo : lo + n], f"y{n}"]))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, "other version " + " ".join(passage)), (3, texts[3])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, key int, n int, runs int").repartition(5)
    assert found(docs) == expected(rows)


def test_kept_text_and_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {shared} b"), (2, f"c\n{shared}\td  e")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substrings.drop_repeats(docs, keep_text=True).collect()}
    assert rows[1]["repeats"] == [] and rows[1]["kept_text"] == f"a {shared} b"
    assert rows[2]["repeats"] == [[1, 21]] and rows[2]["kept_text"] == "c d e"


def test_repeats_are_maximal():
    runs = [{"first": 30, "n": 2}, {"first": 0, "n": 1}, {"first": 13, "n": 1}, {"first": 14, "n": 3}]
    assert substrings.maximal(runs).tolist() == [[0, 29], [30, 44]]
    assert substrings.maximal([{"first": 0, "n": 1}, {"first": 14, "n": 1}]).tolist() == [[0, 13], [14, 27]]


def test_every_window_has_one_seed():
    words = np.random.default_rng(1).integers(0, 6, 500).astype(np.uint64)
    begin = np.array([0, 0, 200, 212, 225, 500])  # an empty document, one too short, one of a single window
    spans = [(int(f), int(n)) for seed in substrings.seeds(words, begin) for f, n in zip(seed[2], seed[3])]
    want = [w for lo, hi in zip(begin, begin[1:]) for w in range(lo, hi - WINDOW + 1)]
    assert sorted(w for f, n in spans for w in range(f, f + n)) == want


def test_one_very_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(50_000)}" for _ in range(300_000))
    docs = spark.createDataFrame([(5, long), (4, long[1_000_000:1_010_000]), (6, long)], "doc_id long, text string")
    assert found(docs) == expected([(5, long), (4, long[1_000_000:1_010_000]), (6, long)])
    assert found(docs.limit(0)) == []
