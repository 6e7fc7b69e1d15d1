"""Near duplicates of texts and vectors, and repeated strings, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import capfilter, components, minhash, repeats
from foliant.llm.suffixes import deep_shallow, wide_letters


def roots(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicates(corpus):
    rows = [r for r in corpus.collect() if r["doc_id"] is not None]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    found = minhash.near_duplicates(corpus).collect()
    assert len(found) == corpus.count()
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_large_buckets_lose_no_link(spark):
    """Hundreds of short texts around one passage: the same buckets, but many different components."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"w{i // 3}x{k}" for k in range(25)) + (" end" if i % 3 else "")) for i in range(900)]
    sets = {i: shingle_set(t) for i, t in rows}
    want = {i: i // 3 * 3 for i in sets}
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want


def test_near_copies_of_one_text(spark):
    """One very large group: every copy is near the first text, few are near each other; none is lost."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        words = list(base)
        for k in rng.choice(120, 1 + i % 4, replace=False).tolist():
            words[k] = f"c{i}x{k}"
        rows.append((i + 1, " ".join(words)))
    rows.append((5000, " ".join(base)))
    sets = {i: shingle_set(t) for i, t in rows}
    holders = {}
    for i, found in sets.items():
        for x in found:
            holders.setdefault(x, []).append(i)
    links = []
    for i, found in sets.items():
        both = Counter(j for x in found for j in holders[x] if j > i)
        links += [(i, j) for j, n in both.items() if 100 * n >= 75 * (len(found) + len(sets[j]) - n)]
    want = roots(sets, links)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert found == want


def test_blocks_confirm_and_give_a_forest():
    """The pairs of a block against all pairs: the same components, and fewer links than documents."""
    rng = np.random.default_rng(4)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(12):
            words = list(base)
            for at in rng.choice(60, k % 4, replace=False).tolist():
                words[at] = f"v{g}x{k}"
            texts.append(" ".join(words).encode())
    sets = [minhash.shingles(t, 5) for t in texts]
    signs = [minhash.minima(x) for x in sets]
    n = len(texts)
    columns = {"block": [1] * n, "doc_id": list(range(n)), "n_shingles": [len(x) for x in sets], "component": list(range(n)), "side": [0] * n}
    batch = pa.record_batch([*(pa.array(c, pa.int64()) for c in columns.values()), pa.array([x.tobytes() for x in signs])], names=[*columns, "minima"])
    open_ = pa.Table.from_batches(minhash._open_blocks(iter([batch.slice(0, 50), batch.slice(50)])))
    open_ = open_.append_column("text", pa.array([texts[i] for i in open_.column("doc_id").to_pylist()]))
    links = [x for b in minhash._join_blocks(iter(open_.to_batches())) for x in zip(*(b.column(c).to_pylist() for c in "ab"))]
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if minhash.similar(sets[i], sets[j])]
    assert len(links) < n and set(links) <= set(pairs) and roots(range(n), links) == roots(range(n), pairs)


def test_texts_of_two_letters_have_their_own_shingles():
    """A sequence that cancels in polynomials modulo powers of two, and its complement: as one word and as many."""
    bits = [i.bit_count() % 2 for i in range(4096)]
    left, right = ("".join("ab"[b ^ flip] for b in bits).encode() for flip in (0, 1))
    assert minhash.shingles(left, 5) != minhash.shingles(right, 5)
    cut = lambda t, n: b" ".join(t[i : i + n] for i in range(0, 5 * n, n))
    for n in (16, 64, 256, 800):
        assert minhash.shingles(cut(left, n), 5)[0] != minhash.shingles(cut(right, n), 5)[0]


def test_posterior_bound():
    """A pair at the threshold is given up with a probability near MISS only, an unlike one soon."""
    least = [minhash.least_matches(n) for n in range(minhash.BATCH, minhash.MINIMA + 1, minhash.BATCH)]
    assert least == sorted(least) and least[-1] < 0.75 * minhash.MINIMA
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**32, (500, minhash.MINIMA), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.75, left, left + 1)
    assert len(minhash.sequential(left, right)) == 500
    assert len(minhash.sequential(left, np.where(rng.random(left.shape) < 0.2, left, left + 1))) == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (5, None)]
    pairs = [p for p in links if None not in p and p[0] != p[1]]
    want = roots({x for p in pairs for x in p}, pairs)
    assert dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect())) == want


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 64))
    vectors = [v + rng.standard_normal(64) * s for v in base for s in (0, 0.02, 0.05, 0.1, 0.14, 0.18)]
    vectors += [base[0]] * 40 + [base[1] * 2.5, base[1] * 1e-200]
    rows = [(i, v.tolist(), 1 + (i % 11 == 0), "x") for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] * 64]
    rows += [(n + i, v, 1, "x") for i, v in enumerate(odd)] + [(n + 10, base[0].tolist(), None, "x"), (None, base[0].tolist(), 1, "x"), (n + 11, [1.0, 2.0], 1, "x"), (n + 12, [1.0, 2.001], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, links string").repartition(5)
    good = {r[0]: (r[2], np.array(r[1], float)) for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])}
    unit = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, (_, v) in good.items()}
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    want = roots([r[0] for r in rows if r[0] is not None], links)
    count = Counter(x for p in links for x in p)
    found = capfilter.near_vectors(table).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (count[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])


def test_suffix_order():
    rng = np.random.default_rng(2)
    data = np.frombuffer(b"".join(bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (300, 80)) * 3 + b"a" * 300, np.uint8)
    place = rng.permutation(len(data) - 200)
    group = rng.integers(0, 2, len(place))
    order, same = deep_shallow(wide_letters(data), place, group, 200)
    keys = [(g, data[p : p + 200].tobytes()) for g, p in zip(group[order].tolist(), place[order].tolist())]
    assert keys == sorted(keys) and same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(corpus, hot):
    rows = corpus.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.append((r["doc_id"], len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    found = [tuple(r) for r in repeats.remove_repeats(corpus, with_text=True, hot_contexts=hot).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_empty(corpus, spark):
    none = corpus.where("false")
    assert minhash.near_duplicates(none).count() == 0 and repeats.remove_repeats(none).count() == 0
    assert capfilter.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_small_tables_are_not_dealt_to_many_files(spark):
    most = 2 * spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 4 * most)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = components.components(spark.createDataFrame([(3 * i + 1, 3 * i) for i in range(3000)] + [(3 * i + 2, 3 * i + 1) for i in range(3000)], "a long, b long"))
        assert len(found.inputFiles()) <= most
        assert sorted(map(tuple, found.collect())) == [(i, i - i % 3) for i in range(9000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
