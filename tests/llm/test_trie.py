"""The trie of conversation prefixes, against one built turn by turn."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from foliant.llm import prefixtrie
from foliant.llm.prefixtrie import SparseTable

FIELDS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        n_words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = (len(nodes[p]) - 1) * n_words + sum(saved[k] for k in kids.get(p, []))
    ends = lambda p: ",".join(map(str, sorted(c for c in nodes[p] if len(convs[c]) == len(p))))
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest())
        for p, m in nodes.items()
    )


def found(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in prefixtrie.prefix_trie(df).collect())


def conversations(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hello  you", "a\tb c", "", None])))
    return rows


@pytest.mark.parametrize("ranges", [200_000, 40])
def test_trie(spark, monkeypatch, ranges):
    """One range, or many: nodes that go on in the next ranges, long lists of equal conversations, unary chains."""
    monkeypatch.setattr(prefixtrie, "RANGE", ranges)
    rng = random.Random(ranges)
    rows = conversations(rng, 150) + [(c, 0, "system", "same") for c in range(1000, 1100)]
    rows += [(500, k, "user", f"turn {k % 7}") for k in range(60)] + [(520, k, "user", f"turn {k % 7}") for k in range(50)]
    rows += [(41, None, "user", "first"), (None, 0, "user", "nobody"), (63, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], FIELDS + ", part int, path binary").repartition(6)
    assert found(df) == expected(rows)


def test_ties_and_repeated_rows(spark):
    """Turns of one number are ordered by digest, so the result does not hang on the order of rows."""
    rows = [(20, 0, "user", "b"), (20, 0, "user", "a"), (20, 1, "user", "c"), (20, 1, "user", "c"), (60, 0, "user", "a"), (60, 0, "user", "b")]
    results = [found(spark.createDataFrame(rows[k:] + rows[:k], FIELDS)) for k in range(3)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 5


def test_empty_and_long(spark):
    assert found(spark.createDataFrame([], FIELDS)) == []
    rows = [(20, 0, "user", "word " * 200_000), (40, 0, "user", "word " * 200_000)]
    assert found(spark.createDataFrame(rows, FIELDS)) == expected(rows)


def test_sparse_table():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 9, 200)
    table = SparseTable(values)
    lo = rng.integers(0, 200, 300)
    hi = np.minimum(199, lo + rng.integers(0, 90, 300))
    assert table.least(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]
    at, bound = np.repeat(np.arange(200), 9), np.tile(np.arange(9), 200)
    for i, b, l, r in zip(at, bound, table.leftmost(at, bound), table.rightmost(at, bound)):
        assert (values[l + 1 : i + 1] >= b).all() and (l == 0 or values[l] < b)
        assert (values[i + 1 : r + 1] >= b).all() and (r == 199 or values[r + 1] < b)
