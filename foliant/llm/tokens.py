"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from foliant.llm.hashing import mix

# White space as the vocabulary's own pattern sees it, and the few more signs that Python counts as such.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A cut before a space is safe unless white space stands on both sides of it (the end of the text counts).
_UNSAFE = rf"{_SPACE} (?:{_SPACE}|\z)"
#: Units and words that a Python worker remembers at most; beyond that it forgets all and starts anew. One takes some 60 bytes.
REMEMBERED = 1_000_000
REMEMBERED_IDS = 8 * REMEMBERED
_LONGEST = 23  # bytes of a unit that is remembered


def _alphabet() -> dict[int, str]:
    """The sign of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)} | {b: chr(b) for b in printable}


_ALPHABET = _alphabet()
_SIGN_OF_SPACE = _ALPHABET[ord(" ")]
_ENDS = (".", ",", ";", ":", "!", "?")  # signs that end a word; the pattern makes each a word of its own

_encoders: dict[str, "Encoder"] = {}


_PLAIN = r"^ [A-Za-z]+\z"
# Where no token but of spaces and no-break spaces has a space later than first, words that begin with one are merged many at a time.
_SPACED = r"^ [^\s\x{a0}]+\z"
_BLANKS = {_SIGN_OF_SPACE, *(_ALPHABET[b] for b in "\xa0".encode())}
_TOGETHER = 64

def _is_word(unit: str) -> bool:
    """ASCII letters, behind a space or not: the pattern leaves such a unit whole."""
    return unit.isascii() and (unit[1:] if unit[:1] == " " else unit).isalpha()


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _keys(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Three numbers per string that hold its bytes and their count, and whether it is short enough for them."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.zeros(ends[-1] - ends[0] + 32, np.uint8)
    data[: ends[-1] - ends[0]] = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at, n = ends[:-1] - ends[0], np.diff(ends)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    key = np.zeros((len(n), 3), np.uint64)
    for k in range(3):
        bytes_ = np.clip(n - 8 * k, 0, 8)
        key[:, k] = eight[np.minimum(at + 8 * k, len(eight) - 1)] & _BYTES[bytes_]
    short = n <= _LONGEST
    key[:, 2] |= np.where(short, n, 0).astype(np.uint64) << np.uint64(56)
    return key, short


_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class _Known:
    """Ids of units, found for many at a time: keys in the order of their hashes, and where the ids of each begin."""

    def __init__(self):
        self.hash, self.key = np.zeros(0, np.uint64), np.zeros((0, 3), np.uint64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return mix(mix(mix(key[:, 0]) + key[:, 1]) + key[:, 2])

    def find(self, key: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each key begin, and how many they are (-1: not known)."""
        begin, size = np.zeros(len(key), np.int64), np.full(len(key), -1, np.int64)
        if len(self.hash):
            hashes = self._hash(key)
            order = np.argsort(hashes)
            at = np.minimum(np.searchsorted(self.hash, hashes[order]), len(self.hash) - 1)
            same = (self.key[at] == key[order]).all(axis=1) & short[order]
            begin[order[same]], size[order[same]] = self.begin[at[same]], self.size[at[same]]
        return begin, size

    def add(self, key: np.ndarray, short: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the ids begin. Long units are not found again, nor is one whose hash another one has."""
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        hashes = self._hash(key)
        order = np.argsort(hashes)
        order = order[short[order]]
        at = np.searchsorted(self.hash, hashes[order])
        if len(self.hash):
            new = self.hash[np.minimum(at, len(self.hash) - 1)] != hashes[order]
            order, at = order[new], at[new]
        self.hash, self.key = np.insert(self.hash, at, hashes[order]), np.insert(self.key, at, key[order], axis=0)
        self.begin, self.size = np.insert(self.begin, at, begin[order]), np.insert(self.size, at, size[order])
        return begin


def _gather(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, one after the other, and where each ends."""
    end = np.cumsum(size)
    return ids[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)], end


class Encoder:
    """Ids of many texts at once.

    A text is cut before each space. The pattern of the vocabulary never joins signs across such a cut,
    so the ids of the units, one after the other, are the ids of the text, and a unit that repeats is
    encoded once. A unit of ASCII letters is one word of the pattern. Any other new unit is cut by the pattern itself into words, of which
    most are known; new ones are merged alone. Texts with runs of white space around a cut, or with an added token of the vocabulary,
    are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # of signs, not cut by the pattern
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # found before the pattern cuts
        self.whole = "|".join([_UNSAFE, *(re.escape(t) for t in added)])
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        vocabulary_ = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary_.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary_.items() if t[:1] == _SIGN_OF_SPACE]] = True
        self.apart = all(set(t) <= _BLANKS for t in vocabulary_ if _SIGN_OF_SPACE in t[1:])
        self.known = _Known()

    def _words(self, unit: str) -> list[str]:
        if unit[:1] != " " and _is_word(unit):
            return [unit]
        if unit[-1:] in _ENDS and _is_word(unit[:-1]):
            return [unit[:-1], unit[-1]]
        return self.words(unit)

    def _signs(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(_ALPHABET)

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the pattern has cut, and how many each has: they go to the vocabulary's merges as they are, in its alphabet of bytes."""
        found = [[t.id for t in self.tokenizer.model.tokenize(self._signs(w))] for w in words.to_pylist()]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _merged_together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words behind a space: the ids of one end where the next token with a space at its head stands."""
        if not self.apart:
            return self._merged(words)
        found = words.to_pylist()
        rows = [self._signs("".join(found[k : k + _TOGETHER])) for k in range(0, len(found), _TOGETHER)]
        ids = np.array([i for e in self.merges.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids], "<u4")
        return ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))

    def _cut(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units by those of their words."""
        words = [self._words(u) for u in units.to_pylist()]
        coded = pa.array([w for found in words for w in found], pa.large_string()).dictionary_encode()
        begin, size = self._places(coded.dictionary, _SPACED, self._merged)
        codes, last = coded.indices.to_numpy(), np.cumsum([len(found) for found in words])
        ids, end = _gather(self.known.ids, begin[codes], size[codes])
        return ids, np.diff(np.append(0, np.append(0, end)[last]))

    def _places(self, units: pa.Array, together: str, learn) -> tuple[np.ndarray, np.ndarray]:
        """Where in the known ids those of each of some distinct units begin, and how many they are. New ones are learned, words like ``together`` at once."""
        key, short = _keys(units)
        begin, size = self.known.find(key, short)
        new = np.flatnonzero(size < 0)
        plain = pc.match_substring_regex(units.take(pa.array(new)), together).to_numpy(zero_copy_only=False).astype(bool)
        for part, ids_of in ((new[plain], self._merged_together), (new[~plain], learn)):
            if len(part):
                ids, size[part] = ids_of(units.take(pa.array(part)))
                begin[part] = self.known.add(key[part], short[part], ids, size[part])
        return begin, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one more entry than texts). Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts) == 0:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if len(self.known.hash) > REMEMBERED or len(self.known.ids) > REMEMBERED_IDS:
            self.known = _Known()
        whole = pc.match_substring_regex(texts, self.whole)
        pieces = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        first_at = pieces.offsets.to_numpy()[:-1]
        pieces = pieces.flatten()
        first = pieces.take(pa.array(first_at)).dictionary_encode()
        is_first = np.zeros(len(pieces), bool)
        is_first[first_at] = True
        coded = pc.if_else(pa.array(is_first), "", pieces).dictionary_encode()
        later = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string()))
        begin, size = self._places(pa.concat_arrays([later, first.dictionary]), _PLAIN, self._cut)
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[first_at] = len(later) + first.indices.to_numpy()
        ids = self.known.ids
        if pc.any(whole).as_py():
            at_start = [np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4") for t in texts.filter(whole).to_pylist()]
            codes[first_at[whole.to_numpy(zero_copy_only=False)]] = len(size) + np.arange(len(at_start))
            n = np.array([len(x) for x in at_start], np.int64)
            begin, size = np.append(begin, len(ids) + np.cumsum(n) - n), np.append(size, n)
            ids = np.concatenate([ids, *at_start])
        ids, end = _gather(ids, begin[codes], size[codes])
        return ids, np.append((end - size[codes])[first_at], end[-1])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """The batch in runs of rows of about so many bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
