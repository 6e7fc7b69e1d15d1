"""Importance resampling and CRCs of substrings, against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliant.llm import resampling
from foliant.llm.prefixcrc import RunningCrc, shifted


def test_shift_cancels_what_stands_before():
    rng = random.Random(3)
    for n in (0, 1, 2, 63, 64, 65, 1000, 70_001):
        a, b = rng.randbytes(17), rng.randbytes(n)
        crc = zlib.crc32(a + b) ^ int(shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0])
        assert crc == zlib.crc32(b)


def test_grams():
    words = [b"a", b"bc", b"\xc3\xa9" * 90, b"d", b"e" * 300]
    crc = RunningCrc(words)
    for n in (1, 2, 3):
        first = np.arange(len(words) - n + 1)
        assert crc.grams(first, n).tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in first]
    assert len(RunningCrc([]).at_end) == 0


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("scan", [1, 40, 1 << 22])
def test_buckets_at_any_scan_length(monkeypatch, scan):
    monkeypatch.setattr(resampling, "SCAN", scan)
    rng = random.Random(scan)
    for _ in range(100):
        text = "".join(rng.choice("abXY é日.,-09\n\t_") * rng.choice([1, 1, 70]) for _ in range(rng.randrange(60)))
        n, found = resampling.buckets(text.encode())
        words, features = terms(text)
        assert n == len(words) and Counter(found.tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in features)


def expected(rows, target, percent=25):
    profile = lambda texts: Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in terms(t)[1])
    s, t = profile([r[1] for r in rows]), profile(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 10_000) / ((s[b] + 1.0) * (total_t + 10_000))))
    out = []
    for doc_id, text, *_ in rows:
        words, features = terms(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, None if doc_id is None else weight + noise, None, len(words)])
    able = sorted((r for r in out if r[3] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resample(spark, corpus):
    rows = [tuple(r) for r in corpus.collect()]
    target = ["alpha1 beta2 gamma3 delta4 river5", None, "", "Alpha7, beta9!"]
    found = resampling.resample(corpus, spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()), key=str)
    # Rows that repeat an id tie, so which of them is drawn first is not defined; ranks are.
    assert [g[:4] for g in got] == [e[:4] for e in expected(rows, target)]
    assert sorted(g[4] for g in got if g[4]) == sorted(e[4] for e in expected(rows, target) if e[4])
    assert {g[0]: g[4] for g in got if g[0] != 3} == {e[0]: e[4] for e in expected(rows, target) if e[0] != 3}


def test_draw_keeps_texts_and_refuses_clashing_names(spark, corpus):
    target = spark.createDataFrame([("alpha1 beta2",)], "text string")
    by_id = {r["doc_id"]: r["text"] for r in corpus.collect()}
    drawn = resampling.drawn(corpus, target, percent=100).collect()
    assert drawn and all(by_id[r["doc_id"]] == r["text"] for r in drawn) and sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1))
    with pytest.raises(ValueError):
        resampling.resample(corpus, target, keep=("doc_id", "score"))


def test_empty_tables(spark, corpus):
    nothing = corpus.limit(0)
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(corpus, target).count() == corpus.count()
