"""Removal of long byte strings that occur more than once in a corpus.

1. Every 200-byte window of a text has an anchor (see ``anchors``) that depends on its bytes alone, so equal windows have
   equal anchors. Anchors travel in packs of arrays, one row per pack and slice of the hash space, and are counted
   there. An anchor seen once settles all its windows, some seventy, as unique. Anchors with equal contexts
   settle theirs as repeated; within a pack that is seen at once, so a text with very many copies sends one entry per pack.
2. Left are anchors whose contexts differ: the borders of repeated passages. Their contexts, one of each kind, are brought
   together by anchor, and all their windows are sorted as suffixes to depth 200, deep-shallow; equal neighbours
   are repeated. An anchor with very many different contexts is not gathered: its windows are counted by digest,
   through the packs of step 1 again.
3. The removed ranges of a text are the union of its repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.anchors import WINDOW, anchors
from foliant.llm.hashing import between, mix, prefix
from foliant.llm.staging import stage
from foliant.llm.suffixes import deep_shallow, wide_letters
from foliant.llm.tokens import slices

PACK_BYTES = 16 << 20  # text whose anchors travel together
SLICE_BYTES = 64 << 20  # text whose anchors a slice should gather
SORT_BYTES = 8 << 20  # text whose open contexts (a third of it or so) are sorted together
HOT = 20_000  # contexts of one anchor from which on they are not gathered
REPEATED, OPEN, OF_HOT = 1, 2, 4  # bits of a code: repeated, to be sorted, by digest

_ENTRY = np.dtype([("h", "<u8"), ("context", "<u8"), ("doc", "<u4"), ("lo", "<i8"), ("span", "<i4"), ("twice", "u1")])
_HIT = np.dtype([("lo", "<i8"), ("span", "<i4"), ("code", "u1")])
_PACKS = "slice int, keys binary, entries binary"
_HITS = "key binary, hits binary"


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the number of each sorted row's run, and where runs begin."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.cumsum(new) - 1, new


def _pack(keys: list[bytes], entries: np.ndarray, n_slices: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows of one pack: per slice, and what is settled within the pack under a negative number."""
    order, run, new = _runs(entries["h"], entries["context"])
    entries = entries[order]
    several = np.bincount(run)[run] > 1
    entries["twice"] |= several
    joined = b"".join(keys)
    settled, sent = entries[several & ~new], entries[new]
    if len(settled):
        yield -1 - int(mix(entries["h"][:1])[0] % np.uint64(1 << 20)), joined, settled.tobytes()
    at = (mix(sent["h"]) >> np.uint64(32)) % np.uint64(n_slices)
    for s in np.unique(at).tolist():
        yield int(s), joined, sent[at == s].tobytes()


def _anchor_packs(n_slices: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            packed = list(_pack(keys, np.concatenate(parts), n_slices))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*packed), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "keys", "entries"])

        keys, parts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                h, context, first, last = anchors(data)
                e = np.zeros(len(h), _ENTRY)
                e["h"], e["context"], e["doc"], e["lo"], e["span"] = h, context, len(keys), first, last - first
                keys.append(key)
                parts.append(e)
                size += len(data)
                if size >= PACK_BYTES:
                    yield from flush()
                    keys, parts, size = [], [], 0
        if parts:
            yield from flush()

    return rows


def _settle(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """What a slice tells about its entries: a row per document with the anchors that are not unique."""
    parts = [np.frombuffer(e, _ENTRY) for e in rows["entries"]]
    entries = np.concatenate(parts)
    pack = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    if rows["slice"].iloc[0] < 0:
        code = np.full(len(entries), REPEATED, np.uint8)
    else:
        order, run, new = _runs(entries["h"], entries["context"])
        h = entries["h"][order]
        anchor = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        contexts = np.bincount(anchor, weights=new)[anchor]
        repeated = (np.bincount(run)[run] > 1) | (np.bincount(run, weights=entries["twice"][order])[run] > 0)
        found = repeated * REPEATED + (new & (contexts > 1)) * OPEN + (new & (contexts > most)) * OF_HOT
        code = np.zeros(len(entries), np.uint8)
        code[order] = found
    hit = np.flatnonzero(code)
    doc = entries["doc"][hit]
    by = np.lexsort((doc, pack[hit]))
    hit, doc = hit[by], doc[by]
    out = np.zeros(len(hit), _HIT)
    out["lo"], out["span"], out["code"] = entries["lo"][hit], entries["span"][hit], code[hit]
    cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(pack[hit]) != 0)) + 1), len(hit)] if len(hit) else [0]
    keys = rows["keys"].tolist()
    made = [(keys[pack[hit[lo]]][16 * int(doc[lo]) : 16 * int(doc[lo]) + 16], out[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:])]
    return pd.DataFrame(made, columns=["key", "hits"])


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the bytes of windows first..last: starts and ends of the maximal runs."""
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], np.maximum.accumulate(last[order] + WINDOW) if len(first) else first
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:] - 1, len(hi) - 1)] if len(at) else hi


def cut(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the windows first..last, bytes removed, and the number of maximal runs."""
    starts, ends = _ranges(first, last)
    kept, at = [], 0
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return b"".join(kept), int((ends - starts).sum()), len(starts)


_DONE = "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(with_text: bool):
    """Cut texts by their hits, all of which count as repeated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                out = []
                for key, text, hits in zip(*(b.column(n).to_pylist() for n in ("key", "text", "hits"))):
                    found = np.frombuffer(b"".join(hits), _HIT)
                    found = found[found["code"] & REPEATED > 0]
                    kept, removed, spans = cut(text, found["lo"], found["lo"] + found["span"])
                    out.append((key, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows


def _first_cut(with_text: bool):
    """Cut the texts that have nothing open; hand on the others with their hits."""
    finish = _finish(with_text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            is_open = pa.array([any((np.frombuffer(h, _HIT)["code"] & OPEN).any() for h in hits) for hits in b.column("hits").to_pylist()], pa.bool_())
            settled, open_ = b.filter(pc.invert(is_open)), b.filter(is_open)
            none = lambda n, *kinds: [pa.nulls(n, t) for t in kinds]
            names = ["key", "n_removed", "n_spans", "kept_sha256", "kept", "open", "text", "hits"]
            for done in finish(iter([settled])):
                n = done.num_rows
                yield pa.record_batch([*done.columns, pa.array([False] * n), *none(n, pa.binary(), b.schema.field("hits").type)], names=names)
            n = open_.num_rows
            if n:
                head = [open_.column("key"), *none(n, pa.int64(), pa.int64(), pa.string(), pa.binary()), pa.array([True] * n)]
                yield pa.record_batch([*head, open_.column("text"), open_.column("hits")], names=names)

    return rows


def _contexts(n_slices: int, n_hot: int):
    """Packs of what is open: contexts by slices of anchors, and windows of hot anchors by slices of digests."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", PACK_BYTES // 4):
                keys, parts, bytes_, hot = [], [], [], []
                for key, text, hits in zip(*(b.column(n).to_pylist() for n in ("key", "text", "hits"))):
                    found = np.frombuffer(b"".join(hits), _HIT)
                    found = np.unique(found[found["code"] & OPEN > 0])
                    data = np.frombuffer(text, np.uint8)
                    by_first = dict(zip(*(x.tolist() for x in (lambda a: (a[2], a[0]))(anchors(data)))))
                    e = np.zeros(len(found), _ENTRY)
                    e["h"] = [by_first[x] for x in found["lo"].tolist()]
                    e["doc"], e["lo"], e["span"], e["twice"] = len(keys), found["lo"], found["span"], found["code"] & REPEATED
                    keys.append(key)
                    is_hot = found["code"] & OF_HOT > 0
                    for x in found[is_hot].tolist():
                        part = data[x[0] : x[0] + x[1] + WINDOW]
                        at = np.arange(x[1] + 1)
                        w = np.zeros(x[1] + 1, _ENTRY)
                        table = prefix(part)
                        w["h"] = between(table, at, at + WINDOW)
                        w["context"] = between(table, at, at + WINDOW // 2)  # with the digest of the whole: 128 bits
                        w["doc"], w["lo"], w["twice"] = len(keys) - 1, x[0] + at, x[2] & REPEATED
                        hot.append(w)
                    parts.append(e[~is_hot])
                    bytes_ += [text[lo : lo + span + WINDOW] for lo, span in zip(found["lo"][~is_hot].tolist(), found["span"][~is_hot].tolist())]
                entries, out = np.concatenate(parts), []
                at = (mix(entries["h"]) >> np.uint64(32)) % np.uint64(n_slices)
                for s in np.unique(at).tolist():
                    mine = np.flatnonzero(at == s)
                    out.append((int(s), b"".join(keys), entries[mine].tobytes(), b"".join([bytes_[k] for k in mine.tolist()]), False))
                if hot:
                    out += [(*row, b"", True) for row in _pack(keys, np.concatenate(hot), n_hot)]
                if out:
                    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["slice", "keys", "entries", "contexts", "hot"])

    return rows


def _sort(rows: pd.DataFrame) -> pd.DataFrame:
    """Sort all windows of the contexts of a slice, and tell per document which are repeated."""
    parts = [np.frombuffer(e, _ENTRY) for e in rows["entries"]]
    entries = np.concatenate(parts)
    pack = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    data = np.frombuffer(b"".join(rows["contexts"]), np.uint8)
    n = entries["span"].astype(np.int64) + 1
    size = n + WINDOW - 1
    context = np.repeat(np.arange(len(entries)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.cumsum(size) - size, n) + nth
    _, anchor = np.unique(entries["h"], return_inverse=True)
    order, same = deep_shallow(wide_letters(data), place, anchor[context], WINDOW)
    equal = np.zeros(len(place), bool)
    equal[order] = same | np.append(same[1:], False)
    hit = np.flatnonzero(equal)
    # Runs of windows of one context become one hit.
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(context[hit]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    out = np.zeros(len(first), _HIT)
    owner = context[hit[first]] if len(hit) else np.zeros(0, np.int64)
    out["lo"], out["span"], out["code"] = entries["lo"][owner] + nth[hit[first]], hit[last] - hit[first], REPEATED
    keys = rows["keys"].tolist()
    made: dict[tuple[int, int], list[bytes]] = {}
    for p, d, x in zip(pack[owner].tolist(), entries["doc"][owner].tolist(), out):
        made.setdefault((p, d), []).append(x.tobytes())
    return pd.DataFrame([(keys[p][16 * d : 16 * d + 16], b"".join(x)) for (p, d), x in made.items()], columns=["key", "hits"])


def _key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text)))


def remove_repeats(docs: DataFrame, with_text: bool = False, hot_contexts: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and on demand ``kept`` (the bytes left).

    Bytes covered by a 200-byte string that also starts anywhere else, in the same text or another, go. Null texts are
    empty. Repeated rows are copies of each other. Other columns are not looked at; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    source = source.select("doc_id", _key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    long_ = source.where(F.octet_length("text") >= WINDOW)
    n_slices = max(1, -(-total // SLICE_BYTES))
    settle = lambda rows: _settle(rows, hot_contexts)
    packs = long_.select("key", "text").mapInArrow(_anchor_packs(n_slices), _PACKS)
    hits = packs.groupBy("slice").applyInPandas(settle, _HITS).groupBy("key").agg(F.collect_list("hits").alias("hits"))
    with_hits = long_.select("key", "text").join(hits, "key")
    met = stage(with_hits.mapInArrow(_first_cut(with_text), _DONE + ", open boolean, text binary, hits array<binary>"), "cut")
    open_ = met.where("open").select("key", "text", "hits")
    n_sort = max(1, -(-(met.where("open").agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SORT_BYTES))
    contexts = open_.mapInArrow(_contexts(n_sort, n_slices), _PACKS + ", contexts binary, hot boolean")
    contexts = stage(contexts, "contexts")
    sorted_ = contexts.where("not hot").groupBy("slice").applyInPandas(_sort, _HITS)
    hot = contexts.where("hot").select("slice", "keys", "entries").groupBy("slice").applyInPandas(settle, _HITS)
    more = sorted_.unionByName(hot).groupBy("key").agg(F.collect_list("hits").alias("more"))
    last = open_.join(more, "key", "left").select("key", "text", F.concat("hits", F.coalesce("more", F.array().cast("array<binary>"))).alias("hits"))
    columns = ["key", "n_removed", "n_spans", "kept_sha256", "kept"]
    done = met.where("not open").select(columns).unionByName(last.mapInArrow(_finish(with_text), _DONE)).dropDuplicates(["key"])
    base = source.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *[F.col("text")] * with_text)
    result = base.join(done, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *[F.coalesce("kept", "text").alias("kept")] * with_text,
    )
    return result
