"""Removal of passages that an earlier document holds: seeds from winnowing, extended both ways.

1. Seeds. Of the runs of ``SEED`` words in each window of ``WINDOW`` words, the one with the least hash is kept (the leftmost
   of equal ones), so equal windows have equal seeds in equal places. Documents are joined on seeds by way of each
   seed's smallest doc_id: a row per occurrence, never a row per pair.
2. Extension. An occurrence is extended left and right as far as its seed stands for windows: its context. Where all
   contexts of a seed are equal, all but the smallest document lose it. Else contexts meet as wholes, and the first document of
   each distinct context goes on, window by window, against the firsts of the other contexts.
3. What the matched windows cover joins to maximal repeats, none shorter than ``WINDOW`` words, which are cut out.

Keys are a seed's hash with a context's or a window's, 128 bits in all, over word hashes mixed in sequence. All
groupings are minima, so they are combined before they are shuffled, and no group of copies is gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import mix
from foliant.llm.staging import stage
from foliant.llm.tokens import slices

WINDOW = 13  # words of a passage that counts as repeated
SEED = 5  # words of a seed: of the 9 seeds of a window one is chosen
_PER_WINDOW = WINDOW - SEED + 1
_TEXT_PART = 1 << 20  # bytes cut into words at a time
_WORD_PART = 1 << 17  # words hashed in sequence at a time
_PLACE = np.uint64((1 << 20) - 1)
_STEP, _FIRST, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _WordHashes(dict):
    """64-bit hashes of words; the short ones are remembered, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 32:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (runs of bytes that are not white space), in lists of bounded size."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + _TEXT_PART)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    known = np.fromiter(map(_hashes.__getitem__, coded.dictionary.view(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    begin = np.append(0, np.cumsum(real))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return known[coded.indices.to_numpy()[real]], begin


def _runs(words: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of 1, 2, ... ``size`` words, each from the one before, the words in their order."""
    h = mix(words + _STEP)
    yield h
    for n in range(1, size):
        h = mix(h[:-1] * _STEP ^ words[n:])
        yield h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out = values[: len(values) - width + 1].copy()
    for shift in range(1, width):
        np.minimum(out, values[shift : len(out) + shift], out=out)
    return out


def seeds(words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, context, first window, number of windows) of all seeds of some documents, whose words stand in a row: document i
    has those from ``begin[i]`` on. Windows are numbered by their first word; none crosses documents. In parts of bounded size."""
    number = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    for base in range(0, len(words) - WINDOW + 1, _WORD_PART):
        end = base + _WORD_PART + WINDOW - 1
        by_size = dict(enumerate(_runs(words[base:end], WINDOW), 1))
        seed, window = by_size[SEED], by_size[WINDOW]
        at = np.arange(len(seed), dtype=np.uint64)
        held = _least((seed & ~_PLACE) | at, _PER_WINDOW) & _PLACE  # by window
        whole = np.flatnonzero(number[base : base + len(held)] == number[base + WINDOW - 1 : base + WINDOW - 1 + len(held)])
        if not len(whole):
            continue
        new = np.flatnonzero(np.diff(held[whole], prepend=_PLACE + np.uint64(1)) != 0)
        first, n = whole[new], np.diff(np.append(new, len(whole)))
        place = held[first]
        # Two windows cover a context: it is at most 2 * WINDOW - SEED words long.
        shape = (place - first.astype(np.uint64)) * np.uint64(64) + n.astype(np.uint64)
        context = mix(mix(window[first] * _FIRST + shape) ^ window[first + n - 1] * _LAST)
        yield seed[place.astype(np.int64)], context, first + base, n


def windows(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows from each ``first`` on, ``n`` of them: their hashes, and which of the entries each belongs to."""
    which = np.repeat(np.arange(len(first)), n)
    at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    h = mix(words[at] + _STEP)
    for i in range(1, WINDOW):
        h = mix(h * _STEP ^ words[at + i])
    return h, which


_SIGNED = np.int64


def _find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            words, begin = word_hashes(b.column("text"))
            doc_id, key = (b.column(c).to_numpy() for c in ("doc_id", "key"))
            for seed, context, first, n in seeds(words, begin):
                doc = np.searchsorted(begin, first, "right") - 1
                columns = [seed.view(_SIGNED), context.view(_SIGNED), doc_id[doc], key[doc], (first - begin[doc]).astype(np.int32), n.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["seed", "context", "doc_id", "key", "first", "n"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, begin = word_hashes(_unpacked(b.column("packed")))
        doc_id, key, opened = b.column("doc_id").to_numpy(), b.column("key").to_numpy(), b.column("open")
        runs = opened.flatten()
        seed, first, n = (runs.field(c).to_numpy().astype(np.int64) for c in ("seed", "first", "n"))
        doc = np.repeat(np.arange(b.num_rows), np.diff(opened.offsets.to_numpy()))
        h, which = windows(words, first + begin[doc], n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        columns = [seed[which], h.view(_SIGNED), doc_id[doc[which]], key[doc[which]], (first[which] + nth).astype(np.int32)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["seed", "window", "doc_id", "key", "first"])


_codec = pa.Codec("zstd", 1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that they take less in a shuffle; eight bytes before each give its size."""
    for b in batches:
        packed = [None if t is None else len(t).to_bytes(8, "little") + _codec.compress(t, asbytes=True) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("key"), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])


def _unpack(packed: bytes | None) -> bytes:
    return _codec.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True) if packed else b""


def _unpacked(packed: pa.Array) -> pa.Array:
    return pa.array([_unpack(p) for p in packed.to_pylist()], pa.binary())


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("key"))


def _travelling(source: DataFrame) -> DataFrame:
    return source.mapInArrow(_pack, "doc_id long, key long, packed binary")


def repeats(docs: DataFrame) -> DataFrame:
    """The windows of each document that also start in a document with a smaller doc_id: doc_id, key (a hash of the text)
    and ``runs``, an array of (first window, number of windows) in words from 0, unordered; runs may touch or overlap.

    Documents without such windows have no row. See ``drop_repeats`` for nulls, ties and repeated rows.
    """
    source = _source(docs).where("doc_id is not null and text is not null")
    found = source.mapInArrow(_find_seeds, "seed long, context long, doc_id long, key long, first int, n int")
    shared = found.groupBy("seed").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("context").alias("c0"), F.max("context").alias("c1")
    )
    shared = shared.where("least < most")
    matched = found.join(shared, "seed").where("doc_id > least or c0 != c1")
    matched = stage(matched.select("seed", "context", "doc_id", "key", "first", "n", (F.col("c0") == F.col("c1")).alias("settled")), "matched")
    run = ("doc_id", "key", "first", "n")

    contexts = matched.where("not settled")
    by_context = contexts.join(contexts.groupBy("seed", "context").agg(F.min("doc_id").alias("least")), ["seed", "context"])
    opened = by_context.where("doc_id = least").groupBy("doc_id", "key").agg(F.collect_set(F.struct("seed", "first", "n")).alias("open"))
    reopened = _travelling(source).join(opened, ["doc_id", "key"]).select("doc_id", "key", "packed", "open")
    extended = stage(reopened.mapInArrow(_extend, "seed long, window long, doc_id long, key long, first int"), "windows")
    by_window = extended.join(extended.groupBy("seed", "window").agg(F.min("doc_id").alias("least")), ["seed", "window"])
    runs = (
        matched.where("settled").select(*run)
        .unionByName(by_context.where("doc_id > least").select(*run))
        .unionByName(by_window.where("doc_id > least").select("doc_id", "key", "first", F.lit(1).alias("n")))
    )
    return runs.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias("runs"))


def maximal(runs: list[dict]) -> np.ndarray:
    """Rows (first word, word after the last) of the maximal repeats that runs of windows join to, ascending."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    lo = np.array([r["first"] for r in runs], np.int64)
    hi = lo + np.array([r["n"] for r in runs], np.int64) + WINDOW - 1
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    return np.stack([lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]], axis=1)


def _cut(keep_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "repeats": [], "kept_text": []}
            for packed, runs in zip(b.column("packed").to_pylist(), b.column("runs").to_pylist()):
                spans = maximal(runs or [])
                digest, n_words, kept, texts = hashlib.sha256(), 0, 0, []
                for words in word_parts(_unpack(packed)):
                    stays = np.ones(len(words), bool)
                    for lo, hi in spans - n_words:
                        stays[max(0, lo) : max(0, hi)] = False
                    left = list(compress(words, stays.tolist()))
                    if left:
                        piece = b" " * (kept > 0) + b" ".join(left)
                        digest.update(piece)
                        if keep_text:
                            texts.append(piece)
                    n_words += len(words)
                    kept += len(left)
                for name, value in zip(out, (n_words, n_words - kept, digest.hexdigest(), spans.tolist(), b"".join(texts).decode("utf-8", "replace"))):
                    out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
            n = 5 if keep_text else 4
            yield pa.record_batch([b.column("doc_id"), *columns[:n]], names=["doc_id", *list(out)[:n]])

    return rows


def drop_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and repeats, the cut (first word, word after the last); on
    demand kept_text, the kept words joined by single spaces.

    A word goes if a window of 13 words covers it that also starts in a document with a smaller doc_id. Windows are judged on the
    input. Repeats within a document, or among rows of one doc_id, are not cut, and a row without doc_id neither loses
    words nor makes others lose any. Null and empty texts have no words; their digest is that of the empty string. An empty
    table gives no rows, and other columns are not looked at.
    """
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<array<long>>" + ", kept_text string" * keep_text
    return _travelling(_source(docs)).join(repeats(docs), ["doc_id", "key"], "left").mapInArrow(_cut(keep_text), fields)
