"""Pages to tokens in a Python worker, by the rules of ``parse``.

The tokens of a page lie one after the other without gaps, so a cut is a list of places. Places of tags, scripts and comments are found on
the bytes of many pages at once; a page whose markup the quick rules do not settle (a tag with odd quotes, a comment without end) is cut by the
regular expression. Each distinct token of a run of pages is parsed once.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace
from functools import cached_property
from html.entities import html5

import numpy as np
import pyarrow as pa

from foliant.functions.text import CP1252, MONTHS
from foliant.operators.predicates import BIT, BY_KIND, BY_STRING, VOID_TAGS, Selection

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
_RAW = rf"<(?:script(?=[\s/>]){_ATTRIBUTES}(?<!/)>(?:.*?</\s*script\s*>|.*+)|style(?=[\s/>]){_ATTRIBUTES}(?<!/)>(?:.*?</\s*style\s*>|.*+))"
_COMMENT = r"<!--.*?--\s*>"


def _pattern(comments: bool, sections: bool) -> re.Pattern[str]:
    return re.compile(
        r"(?isa)(?:[^<]++|<(?![a-z!?/]))++|</\s*[a-z][^>]*+>" + rf"|{_RAW}|<[a-z]{_ATTRIBUTES}>" + r"|<[^>]*+\Z"
        + (r"|<!--(?:.*?--\s*>|.*+)" if comments else "")
        + (r"|<!\[cdata\[(?:.*?\]\s*\]\s*>|.*+)" if sections else "")
        + r"|<[!?/][^>]*+>|<"
    )


_PATTERNS = {(c, s): _pattern(c, s) for c in (True, False) for s in (True, False)}
_OPEN_COMMENT = re.compile(r"(?sa)<!--(?!.*--\s*>\Z)")
_SECTION = re.compile(r"(?isa)<!\[cdata\[(.*)\]\s*\]\s*>\Z")
_OPEN_SECTION = re.compile(r"(?isa)<!\[cdata\[(?!.*\]\s*\]\s*>\Z)")


def cut_page(html: str, comments: bool = True, sections: bool = True) -> list[str]:
    """The tokens of a text, by the regular expression. Only the last one can be a comment or section without end; it is cut again."""
    found = _PATTERNS[comments, sections].findall(html)
    if found and ">" in found[-1]:
        if sections and _OPEN_SECTION.match(found[-1]):
            found[-1:] = cut_page(found[-1], comments, False)
        elif comments and _OPEN_COMMENT.match(found[-1]):
            found[-1:] = cut_page(found[-1], False, sections)
    return found


# --- cutting many pages ------------------------------------------------------------------

_LETTER, _SLASH, _BANG, _QUERY = 1, 2, 4, 8
_AFTER = np.zeros(256, np.uint8)  # what stands after the less-than sign of a token that is no text
_AFTER[[c for b in (65, 97) for c in range(b, b + 26)]] = _LETTER
_AFTER[[ord("/"), ord("!"), ord("?")]] = _SLASH, _BANG, _QUERY
_GAP = np.zeros(256, bool)
_GAP[[*b" \t\n\x0b\f\r="]] = True
_SPECIAL = re.compile(rf"(?is){_RAW}".encode())
_CLOSED_COMMENT = re.compile(rf"(?s){_COMMENT}".encode())
_OPENS_RAW = re.compile(rb"(?i)<(?:script|style)[\s/>]")


def _specials(data: bytes, at: np.ndarray, until: np.ndarray, page: np.ndarray) -> tuple[list[int], list[int], set[int]]:
    """Where scripts and comments begin and end, of tokens that may be one; and the pages to be cut by the regular expression."""
    starts, ends, odd, done = [], [], set(), -1
    for start, end, p in zip(at.tolist(), until.tolist(), page.tolist()):
        if start < done or p in odd:
            continue
        if data[start + 1] != 33:
            if not _OPENS_RAW.match(data, start, end):
                continue
            found = _SPECIAL.match(data, start, end)
            if not found:  # a script tag that closes itself, or does not end
                continue
        else:
            found = _CLOSED_COMMENT.match(data, start, end) if data.startswith(b"<!--", start, end) else None
            if not found:
                odd.add(p)
                continue
        done = found.end()
        starts.append(start)
        ends.append(done)
    return starts, ends, odd


def cut(data: bytes, begin: np.ndarray) -> np.ndarray:
    """Places where tokens begin on pages that lie one after the other, and the end of the last one. ``begin``: where pages begin, and the end."""
    buf = np.frombuffer(data, np.uint8)
    n_pages, size = len(begin) - 1, len(buf)
    mask = np.zeros(size + 1, bool)
    mask[begin] = True
    if not size:
        return np.flatnonzero(mask)[: size + 1]
    odd = np.zeros(n_pages, bool)
    lt, gt = np.flatnonzero(buf == 60), np.flatnonzero(buf == 62)
    page = np.repeat(np.arange(n_pages), np.diff(np.searchsorted(lt, begin)))
    until = begin[1:][page]
    after = _AFTER[buf[np.minimum(lt + 1, size - 1)]] * (lt + 1 < until)
    kept = np.flatnonzero(after)
    lt, page, until, after = lt[kept], page[kept], until[kept], after[kept]
    end = np.append(gt, size)[np.searchsorted(gt, lt)] + 1

    second = buf[np.minimum(lt + 1, size - 1)] | 32
    third = buf[np.minimum(lt + 2, size - 1)]
    raw = (after == _LETTER) & (second == 115) & np.isin(third | 32, [99, 116])
    bang = after == _BANG
    is_comment = bang & (third == 45) & (buf[np.minimum(lt + 3, size - 1)] == 45)
    closed = is_comment & (end <= until) & (end - 3 >= lt + 4) & (buf[np.maximum(end - 2, 0)] == 45) & (buf[np.maximum(end - 3, 0)] == 45)
    may_be = np.flatnonzero(raw | (is_comment & ~closed) | (bang & (third == 91)))
    starts, ends, pages = _specials(data, lt[may_be], until[may_be], page[may_be])
    odd[list(pages)] = True
    keep = np.ones(len(lt), bool)
    if starts:
        first, last = np.array(starts), np.array(ends)
        which = np.searchsorted(first, lt, "right") - 1
        whole = (which >= 0) & (lt == first[which])
        keep = whole | (which < 0) | (lt >= last[which])
        end, after = np.where(whole, last[which], end), np.where(whole, 0, after)
    odd[page[keep & (end > until)]] = True
    keep &= end <= until
    # Of tokens that would end together only the first is one.
    lt, page, after, end = (x[keep] for x in (lt, page, after, end))
    new = np.ones(len(lt), bool)
    new[1:] = end[1:] != end[:-1]
    lt, page, after, end = (x[new] for x in (lt, page, after, end))
    odd[page[1:][lt[1:] < end[:-1]]] = True
    # The first greater-than sign ends a tag unless a quoted value holds it.
    if len(lt):
        for sign in (34, 39):
            quote = np.flatnonzero(buf == sign)
            tag = np.searchsorted(lt, quote, "right") - 1
            held = (tag >= 0) & (quote < end[tag]) & (after[tag] == _LETTER)
            quote, tag = quote[held], tag[held]
            if sign == 39:
                odd[page[tag[_GAP[buf[quote - 1]]]]] = True
            else:
                turn = np.arange(len(tag)) - np.searchsorted(tag, tag)
                odd[page[tag[(turn % 2 == 0) & (buf[quote - 1] != 61)]]] = True
                odd[page[np.flatnonzero(np.bincount(tag, minlength=1) % 2)]] = True
    good = ~odd[page]
    mask[lt[good]] = True
    mask[end[good]] = True
    for p in np.flatnonzero(odd).tolist():
        tokens = cut_page(data[begin[p] : begin[p + 1]].decode("utf-8", "surrogateescape"))
        mask[begin[p] + 1 : begin[p + 1]] = False
        mask[begin[p] + np.cumsum([0, *(len(t.encode("utf-8", "surrogateescape")) for t in tokens)])] = True
    return np.flatnonzero(mask)


# --- single tokens -------------------------------------------------------------------------

_NAME = re.compile(r"(?a)<(?:/\s*)?([a-zA-Z][^\s/>]*)")
_UNQUOTED_SLASH = re.compile(r"""(?a)=\s*[^\s"'>]*/>\Z""")
_HAS_MORE = re.compile(r"(?a)<[^>\s/]+[\s/]+[^>\s/]")
_ATTRIBUTE = re.compile(r"""(?a)([^\s/>][^\s/=>]*+)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|(?!['"])[^>\s]*+))?+""")
_ONE_ATTRIBUTE = re.compile(r'''(?a)<[a-zA-Z][^\s/>=]*+\s++([a-z][a-z0-9-]*+)="([^"]*+)"\s*+/?>\Z''')
_SIMPLE = re.compile(r'(?a)<([a-z][a-z0-9]*+) ([a-z][a-z0-9-]*+)="([^"]*+)"(/?)>\Z')
_START_TAG = re.compile(rf"(?isa)<[a-z][^\s/>]*+({_ATTRIBUTES})>")
_COMMENT_TEXT = re.compile(r"(?sa)<!--(.*?)--\s*>\Z")
_DOCTYPE = re.compile(r"(?isa)<!doctype\s?(.*)>\Z")
_DECLARATION = re.compile(r"(?sa)<[!?/](.*)>\Z")
_SCRIPT = re.compile(rf"(?isa)<(?:script|style){_ATTRIBUTES}>(.*)</\s*(?:script|style)\s*>\Z")
_BLANK = re.compile(r"[ \t\n\f\r]+[\x85  ]?\Z")
_DIGITS = re.compile(r"\d{4}")
_MONTH = re.compile(rf"(?i)(?:{'|'.join(MONTHS)})")
_DATED_ASCII = re.compile(rf"(?i)\d{{4}}|\b(?:{'|'.join(MONTHS)})\b")

_NUMERIC = r"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?"
_TEXT_PIECES = re.compile(rf"{_NUMERIC}|&[a-zA-Z][-.a-zA-Z0-9]*+;?|[^&]++|&")
_ATTRIBUTE_PIECES = re.compile(rf"{_NUMERIC}|&[a-zA-Z][a-zA-Z0-9]*+;?|[^&]++|&")
_OTHER_REFERENCE = re.compile("&(?!amp;)")
_NAMES = {name.rstrip(";"): char for name, char in html5.items()}
_SHORT_NAME = re.compile("&(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")(.*)", re.S)


def _code_point(reference: str) -> str:
    is_hex = reference[2] in "xX"
    digits = reference[3 if is_hex else 2 :].rstrip(";").lstrip("0") or "0"
    if len(digits) > (7 if is_hex else 9):
        return "�"
    n = int(digits, 16 if is_hex else 10)
    if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        return "�"
    return CP1252[n] if 128 <= n <= 159 else chr(n)


def _decoded(text: str, pieces: re.Pattern[str], named) -> str:
    if "&" not in text:
        return text
    if not _OTHER_REFERENCE.search(text):
        return text.replace("&amp;", "&")
    found = pieces.findall(text)
    return "".join([p if p[0] != "&" or len(p) == 1 else _code_point(p) if p[1] == "#" else named(p) for p in found])


def _named_in_text(reference: str) -> str:
    name = reference[1:].removesuffix(";")
    return _NAMES.get(name, "&" + name)


def _named_in_attribute(reference: str) -> str:
    if reference.endswith(";") and (char := _NAMES.get(reference[1:-1])) is not None:
        return char
    short = _SHORT_NAME.match(reference)
    return _NAMES[short[1]] + short[2] if short else reference


def decode_text(text: str) -> str:
    return _decoded(text, _TEXT_PIECES, _named_in_text)


def decode_attribute(text: str) -> str:
    return _decoded(text, _ATTRIBUTE_PIECES, _named_in_attribute)


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case and sorted; of a repeated name the last value counts."""
    if one := _ONE_ATTRIBUTE.match(raw):
        return {one[1]: decode_attribute(one[2])}
    body = _START_TAG.match(raw)
    found = {}
    for name, value in _ATTRIBUTE.findall(body[1]) if body else ():
        found[name.lower()] = decode_attribute(value[1:-1] if value[:1] in ('"', "'") else value)
    return dict(sorted(found.items(), key=lambda pair: pair[0].encode("utf-8", "surrogatepass")))


def _string(kind: str, raw: str) -> str:
    """Content of a text, comment, declaration or script node."""
    if kind == "text":
        section = _SECTION.match(raw) if raw.startswith("<!") else None
        return section[1] if section else decode_text(raw)
    if kind == "raw":
        found = _SCRIPT.match(raw)
    elif raw.startswith("<!--"):
        found = _COMMENT_TEXT.match(raw)
    elif raw[:9].lower() == "<!doctype":
        found = _DOCTYPE.match(raw)
    else:
        found = _DECLARATION.match(raw)
    return found[1] if found else ""


def parsed(raw: str) -> tuple[str, str, dict[str, str] | None, str | None]:
    """Kind, tag, attributes and string of a token."""
    if not raw.startswith("<") or ">" not in raw:
        return "text", "", None, decode_text(raw)
    if (one := _SIMPLE.match(raw)) and one[1] not in ("script", "style"):
        return "void" if one[4] or one[1] in VOID_TAGS else "open", one[1], {one[2]: decode_attribute(one[3])}, None
    name = _NAME.match(raw)
    tag = name[1].lower() if name else ""
    closes_itself = raw.endswith("/>") and not _UNQUOTED_SLASH.search(raw)
    if not tag:
        is_text = _OPEN_COMMENT.match(raw) or _SECTION.match(raw) or _OPEN_SECTION.match(raw) or raw[1] not in "!?/"
        kind = "none" if raw == "</>" else "text" if is_text else "comment"
    elif raw[1] == "/":
        kind = "close"
    elif tag in ("script", "style") and not closes_itself:
        kind = "raw"
    else:
        kind = "void" if closes_itself or tag in VOID_TAGS else "open"
    has_more = kind in ("open", "void", "raw") and len(raw) > len(tag) + 2 and _HAS_MORE.match(raw)
    return kind, tag, _attributes(raw) if has_more else None, _string(kind, raw) if kind in ("text", "comment", "raw") else None


def _is_word(char: str) -> bool:
    """As in Java's regular expressions: letters, marks, digits, connectors and joiners."""
    code = ord(char)
    return unicodedata.category(char) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc") or code in (0x200C, 0x200D) or 0x24B6 <= code <= 0x24E9 or any(
        lo <= code <= hi for lo, hi in ((0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
    )


def looks_dated(text: str) -> bool:
    """Four digits in a row, or a month abbreviation as a whole word."""
    if text.isascii():
        return _DATED_ASCII.search(text) is not None
    if _DIGITS.search(text):
        return True
    alone = lambda i: not 0 <= i < len(text) or not _is_word(text[i])
    return any(alone(m.start() - 1) and alone(m.end()) for m in _MONTH.finditer(text))


_KIND_BIT = {kind: BIT[name] for name, kind in BY_KIND.items()}
_TEXT = BIT["text"]
_VISIBLE, _DATED, _BLANK_BIT = (BIT[name] for name in ("visible", "dated", "blank"))
assert set(BY_STRING) == {"visible", "dated", "blank"}


def _string_bits(kind: str, string: str) -> int:
    if string and not string.isspace():
        return (_VISIBLE if kind == "text" else 0) | (_DATED if looks_dated(string) else 0)
    return _BLANK_BIT if kind != "raw" and _BLANK.match(string) else 0


_REMEMBERED = 20_000  # tags whose answers a worker keeps


_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


@dataclass
class Tag:
    """What is known of a token that is a tag, a comment, a script or a declaration."""

    bits: int
    tag: str
    kind: str
    attributes: dict[str, str] | None
    string: str | None

    @property
    def loads_diagrams(self) -> bool:
        return self.kind == "raw" and self.tag == "script" and "mermaid" in (self.attributes or {}).get("src", "")

    @cached_property
    def closing(self) -> str:
        """What its end tag writes where marks are on."""
        if self.kind != "open":
            return ""
        return f"]({(self.attributes or {}).get('href', '')})" if self.tag == "a" else _MARKS.get(self.tag, "")

    @cached_property
    def shown(self) -> str:
        """What it writes itself where marks are on."""
        if self.kind not in ("open", "void"):
            return self.string or ""
        opening = "[" if self.tag == "a" else "\n" if self.tag == "br" else _MARKS.get(self.tag, "")
        return opening if self.kind == "open" else opening + replace(self, kind="open").closing

    @cached_property
    def classes(self) -> list[str]:
        return (self.attributes or {}).get("class", "").split()

    @cached_property
    def titled(self) -> bool:
        return "text-transform" in (self.attributes or {}).get("style", "")

    @cached_property
    def mark(self) -> str:
        """By what it is told from another one."""
        if self.kind not in ("open", "void"):
            return f"{self.kind}:{self.string}"
        held = "" if self.attributes is None else "[" + ", ".join(f"{{{n}, {v}}}" for n, v in self.attributes.items()) + "]"
        return f"<{self.tag}{held} "


class Parser:
    """Answers for the distinct tokens of a run of pages. Those of tags are remembered, up to a fixed number."""

    def __init__(self, chosen: Selection):
        self.chosen = chosen
        self.tags: dict[bytes, Tag] = {}
        self.asked: dict[tuple, int] = {}

    def _tag(self, raw: bytes) -> Tag:
        kind, tag, attributes, string = parsed(raw.decode("utf-8", "replace"))
        bits = _KIND_BIT.get(kind, 0)
        if kind in ("open", "void", "raw") and tag:
            key = (tag, *((attributes or {}).get(name) for name in self.chosen.attributes))
            if key not in self.asked:
                if len(self.asked) >= _REMEMBERED:
                    self.asked.clear()
                self.asked[key] = self.chosen.answers(tag, dict(zip(self.chosen.attributes, key[1:])))
            bits |= self.asked[key]
        return Tag(bits if string is None else bits | _string_bits(kind, string), tag, kind, attributes, string)

    def tokens(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str | Tag]]:
        """Of distinct tokens their bits, a number for each tag name, and the string of a text or what is known of a tag."""
        bits, names, known = [], [], []
        numbers, tags = {"": 0}, self.tags
        for raw in values:
            if raw[0] != 60:
                string = raw.decode("utf-8", "replace")
                if "&" in string:
                    string = decode_text(string)
                known.append(string)
                names.append(0)
                bits.append(_TEXT | _string_bits("text", string))
                continue
            found = tags.get(raw)
            if found is None:
                found = self._tag(raw)
                if len(raw) <= 200:  # so that what is kept stays small
                    if len(tags) >= _REMEMBERED:
                        tags.clear()
                    tags[raw] = found
            known.append(found)
            bits.append(found.bits)
            names.append(numbers.setdefault(found.tag, len(numbers)))
        return np.array(bits, np.int64), np.array(names, np.int64), known


def distinct(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each token its number among the distinct ones, and these."""
    if len(bounds) < 2:
        return np.zeros(0, np.int64), []
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
