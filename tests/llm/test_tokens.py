"""Packing, token files and shards against plain Python on the same rows."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import packing, sharding, tokenfiles, tokens
from foliant.llm.tokens import Encoder, vocabulary

TEXTS = [
    "", "  a", " a b  c", "a   b", "x\n y", "x \ny", "a ", "a  ", "a \n", " ", "d　 e", "tab\t x\t", "<|endoftext|> it's", "é à ñññ, 12 3.4",
    "word " * 3000, None, "twin", "twin", "long " * 700 + "tail",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", -1) for i, t in enumerate(TEXTS * 6)] + [(None, "no id", "x", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, task int").repartition(5)


@pytest.fixture(scope="module")
def encode():
    tokenizer = Encoder(vocabulary()).tokenizer
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts(encode):
    ids, at = Encoder(vocabulary()).encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == encode(text)


def test_added_tokens_have_their_own_ids():
    tokenizer = Tokenizer.from_file(vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> it's", "<|endoftext |>", "plain text", "a  <|endoftext|>\n"]
    ids, at = Encoder(vocabulary()).encode(pa.array(texts))
    assert [ids[lo:hi].tolist() for lo, hi in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[: at[1]].tolist() == [64, 220, 50256, 275]


def test_units_of_letters_are_not_cut():
    tokenizer, encoder = Tokenizer.from_file(vocabulary()), Encoder(vocabulary())
    cut, found = [], encoder.words
    encoder.words = lambda unit: cut.append(unit) or found(unit)
    texts = ["Plain words, known: again plain words. End", "it's été a1 x,, ,x wor\u017f K\u212a d' s. . ? !a", "\u00e9. a_b,", None]
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[lo:hi].tolist() for lo, hi in zip(at, at[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert "it's" in cut and " \u00e9t\u00e9" in cut and not {"Plain", " words,", " known:", " again", " words.", " End", " s."} & set(cut)


def test_remembered_words_take_little_memory():
    rng = random.Random(3)
    words = {"".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(60_000)}
    encoder = Encoder(vocabulary())
    encoder.encode(pa.array(["warm up"]))
    texts = pa.array([" ".join(words)])
    tracemalloc.start()
    found = encoder.encode(texts)
    del found
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 100 * len(words)


def test_units_of_all_lengths_and_signs(monkeypatch):
    tokenizer, rng = Tokenizer.from_file(vocabulary()), random.Random(5)
    signs = ["a", "b", "Th", ".", "!", "9", "\0", "\u00e9", "\u00a0", "\u4e2d", "\U0001f600", "\t", "'s", "&&", "\u0142", "\u00c2"]
    units = ["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(3000)] + ["x" * n for n in range(15, 30)]
    units += ["a", "a\0", "a\0\0", "a" * 22, "a" * 23, "a" * 24, "q" * 300, "\u00a0", "b\u00a0", "\u00a0b", "\u00a0\u00a0"]
    texts = [" ".join(rng.choices(units, k=rng.randrange(1, 60))) for _ in range(300)] + units[-30:] + ["", None]
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = Encoder(vocabulary())
    for remembered in (1_000_000, 1_000_000, 50):  # the first time all are new, then known, then forgotten
        monkeypatch.setattr(tokens, "REMEMBERED", remembered, raising=False)
        for lo in range(0, len(texts), 70):
            ids, at = encoder.encode(pa.array(texts[lo : lo + 70], pa.string()))
            assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == expected[lo : lo + 70]


def test_pieces_and_places(docs, encode):
    rows = packing.pack(docs, with_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {r["doc_id"] for r in docs.collect()}
    for doc_id, found in by_doc.items():
        found.sort(key=lambda r: r["piece"])
        text = "no id" if doc_id is None else (TEXTS * 6)[doc_id]
        assert sum((r["ids"] for r in found), []) == encode(text) + [0]
        assert [r["piece"] for r in found] == list(range(len(found)))
        assert all(r["length"] == 2048 for r in found[1:])
        assert [r["start"] for r in found] == np.cumsum([0] + [r["length"] for r in found])[:-1].tolist()
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in found)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 120))
    lengths = sorted(rng.integers(1, capacity + 1, rng.integers(1, 400)).tolist(), reverse=True)
    bins = []
    for n in lengths:
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, capacity)
    packed = {}
    for n, count in counts.items():
        runs = [r for r in plan if r[0] == n]
        for rank in range(count):
            _, r0, b0, fit, offset = next(r for r in reversed(runs) if r[1] <= rank)
            packed.setdefault(b0 + (rank - r0) // fit, []).append((offset + (rank - r0) % fit * n, n))
    for parts in packed.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
    # Which of two bins with equal room is taken is free, so only the rooms must agree.
    assert sorted(sum(n for _, n in p) for p in packed.values()) == sorted(map(sum, bins))


def test_token_files(spark, docs, encode, tmp_path):
    tokenfiles.write_token_files(docs, f"{tmp_path}/t")
    expected, start = [], 0
    for doc_id, text in [(None, "no id"), *enumerate(TEXTS * 6)]:
        ids = encode(text) + [2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = tokenfiles.token_index(spark, f"{tmp_path}/t").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    meta = [pq.ParquetFile(p).metadata for p in (tmp_path / "t").glob("*.parquet")]
    group = next(m.row_group(0) for m in meta if m.num_rows)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index for c in columns.values())


def test_shards(spark, docs):
    size = lambda t: len((t or "").encode()) + 8
    rows = sharding.shard_by_bytes(docs, 5, range_bytes=4000).collect()
    assert len(rows) == 6 * len(TEXTS) + 1 and set(rows[0].asDict()) == {"doc_id", "text", "length", "task", "size", "shard", "slot"}
    for shard in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["size"] == size(r["text"]) for r in rows)
    total = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)]
    assert max(total) - min(total) <= max(r["size"] for r in rows)


def test_shards_split_a_hot_group_and_keep_small_ones(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    total = [sum(r["size"] for r in found if r["shard"] == s) for s in range(8)]
    assert max(total) - min(total) <= 0.05 * sum(total) / 8
    homes = {}
    for r in found:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(h) == 1 for t, h in homes.items() if t != "same text")


def test_empty_tables(spark, docs, tmp_path):
    none = docs.where("false")
    assert packing.pack(none).count() == 0 and sharding.shard_by_bytes(none).count() == 0
    tokenfiles.write_token_files(none, f"{tmp_path}/t")
    assert tokenfiles.token_index(spark, f"{tmp_path}/t").count() == 0


def test_shards_part_rows_that_repeat(spark):
    """Half of the rows are one row; columns called like the operator's own stay."""
    rows = [(7, "r" * 500, "k", 1)] * 3000 + [(i, f"text {i} " * (i % 40), "k", 1) for i in range(3000)] + [(None, "n" * 300, "k", 1)] * 200
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, key string, range int").repartition(6)).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == {"doc_id", "text", "key", "range", "size", "shard", "slot"}
    total = [sum(r["size"] for r in found if r["shard"] == s) for s in range(24)]
    assert max(total) - min(total) <= 0.05 * max(total)
    for shard in range(24):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
