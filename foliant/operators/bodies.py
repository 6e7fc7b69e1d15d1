"""Whole pages to blocks with their bodies, in one Python stage: HTML in, arrays out.

The rules are those of ``render``, which states them as SQL for blocks of single kinds; ``tests/test_bodies.py`` holds one against the other. As there, an event is a
place, a subtree a range of places, and its text a slice of what events write, joined. Here these lists run over all pages of a slice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import cut, render
from foliant.operators import outline as tree
from foliant.operators.predicates import CALLOUT_CLASSES, CARD_PART_TAGS, KINDS, SELECTORS, Selection, selection

SLICE = 1 << 19  # bytes of pages that are worked on at a time; a longer page is worked on alone
#: What is rendered from: all arrays of events, and the blocks.
RENDERED = [*tree.EVENTS, *tree.BLOCKS]
_LISTED = ["tr", "a", "table", "p", "pre", "div"]
_LANGUAGE = re.compile(r"(?:language-|lang-)(.+)")


def _strip(text: str) -> str:
    return text.strip()


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _line(cells: list[str]) -> str:
    return "| " + " | ".join(cells) + " |"


def _pair_table(pairs: list[tuple[str, str]]) -> str:
    if not pairs:
        return ""
    return "\n".join([_line([v for v, _ in pairs]), _line(["---"] * len(pairs)), _line([label for _, label in pairs])])


def _table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    first, *others = (_line(r + [""] * (width - len(r))) for r in rows)
    return "\n".join([first, _line(["---"] * width), *others])


class _Events:
    """What the events of a slice are and write. Places are those in the slice."""

    def __init__(self, arrays: dict[str, tuple[np.ndarray, np.ndarray]], known: list[str | cut.Tag], n_pages: int):
        events, page = arrays["ev_tok"]
        begin = np.searchsorted(page, np.arange(n_pages))
        moved = lambda name: np.where(arrays[name][0] >= 0, arrays[name][0] + begin[arrays[name][1]], -1)
        flags, to, stop = arrays["ev_flags"][0], moved("ev_to"), arrays["ev_stop"][0]
        has = lambda bit: (flags & bit) != 0
        self.to, self.code, self.date = (x.tolist() for x in (to, moved("ev_code"), moved("ev_date")))
        self.blocks = {name: moved(f"b_{name}").tolist() for name in ("at", *tree.PLACES)}
        self.tokens = tokens = np.empty(len(known), object)
        tokens[:] = known
        self.tok = events.tolist()

        # What events write: the token itself, its end, a blank, or nothing.
        n = len(known)
        written = np.empty(3 * n + 1, object)
        written[:n] = [k if type(k) is str else k.shown for k in known]
        written[n : 2 * n] = ["" if type(k) is str else k.closing for k in known]
        written[2 * n : 3 * n] = ["\n" if "\n" in ((k if type(k) is str else k.string) or "") else " " for k in known]
        written[3 * n] = nothing = ""
        nothing = 3 * n
        is_text = np.array([type(k) is str or k.kind == "text" for k in known], bool)
        whole = np.where(has(tree.BLANK), 2 * n + events, events)
        plain = np.where(is_text[events] & ~has(tree.CLOSING | tree.HIDDEN), whole, nothing)
        self.plains = written[plain].tolist()
        loud = np.where(has(tree.CLOSING), n + events, whole)
        quiet = np.where(arrays["ev_quiet_stop"][0] == 1, nothing, plain)
        self.stopped = stop != -1
        self.pieces = written[loud].tolist()
        inlines = written[np.where(self.stopped, quiet, loud)]
        self.closing, self.badge = has(tree.CLOSING), has(tree.BADGE)
        for k in np.flatnonzero(self.badge & ~self.closing).tolist():
            self.pieces[k] = f"[{_strip(self.plain(k))}]"
            if not self.stopped[k]:
                inlines[k] = self.pieces[k]
        self.inlines = inlines.tolist()

        opening = np.flatnonzero(has(tree.OPENING))
        self.opens = has(tree.OPENING)
        names = np.array([None if type(k) is str or k.kind not in ("open", "void") else k.tag for k in known] + [None], object)
        tag = names[:-1][events]
        self.tag = tag.tolist()
        parent = moved("ev_parent")[opening]
        held = parent >= 0
        order = np.argsort(parent[held], kind="stable")
        self.child = opening[held][order].tolist()
        self.first_child = np.append(0, np.cumsum(np.bincount(parent[held], minlength=len(events)))).tolist()
        wanted = {name: i for i, name in enumerate([*_LISTED, "td", "th", "code"])}
        number = np.array([wanted.get(name, -1) for name in names[:-1]], np.int64)[events[opening]]
        self.listed = {name: opening[number == wanted[name]].tolist() for name in _LISTED}
        self.listed["cell"] = opening[(number == wanted["td"]) | (number == wanted["th"])].tolist()
        quiets = opening[(number == wanted["code"]) | self.badge[opening]]
        self.quiets = quiets.tolist()
        self.inside = (self.stopped | np.isin(np.arange(len(events)), quiets)).tolist()

    def plain(self, e: int) -> str:
        """Text of the subtree without marks, comments and scripts."""
        return "".join(self.plains[e + 1 : self.to[e] + 1])

    def inline(self, e: int) -> str:
        """Text of the subtree with inline marks."""
        return self._again(e) if self.inside[e] else "".join(self.inlines[e + 1 : self.to[e] + 1])

    def _again(self, root: int) -> str:
        """The same where code or a badge lies around the root, or is it: only those inside of it count."""
        parts, last = [], self.to[root]
        covers = bisect_right(self.quiets, root)
        around = -1  # the outermost code or badge that reaches the event
        for e in range(root + 1, last + 1):
            if around < 0 or self.to[around] < e:
                around = -1
                while covers < len(self.quiets) and self.quiets[covers] < e:
                    if self.to[self.quiets[covers]] >= e:
                        around = self.quiets[covers]
                        break
                    covers += 1
            parts.append(self.pieces[e] if around < 0 else "" if self.badge[around] else self.plains[e])
        return "".join(parts)

    def children(self, e: int, tags: Sequence[str]) -> list[int]:
        tag = self.tag
        return [c for c in self.child[self.first_child[e] : self.first_child[e + 1]] if tag[c] in tags]

    def below(self, e: int, name: str) -> list[int]:
        places = self.listed[name]
        return places[bisect_right(places, e) : bisect_right(places, self.to[e])]

    def of(self, e: int) -> cut.Tag:
        return self.tokens[self.tok[e]]

    # --- rules

    def rows(self, e: int) -> list[list[str]]:
        found = ([_squeeze(self.inline(c)).replace("|", "\\|") for c in self.below(r, "cell")] for r in self.below(e, "tr"))
        return [r for r in found if r]

    def pairs(self, cards: list[int], tags: Sequence[str]) -> list[tuple[str, str]]:
        """First and second part of every card that has two."""
        parts = (self.children(c, tags) for c in cards)
        return [(_strip(self.plain(p[0])), _strip(self.plain(p[1]))) for p in parts if len(p) >= 2]

    def callout(self, e: int) -> str:
        sign = next((render.CALLOUT_SIGNS[c] for c in self.of(e).classes if c in render.CALLOUT_SIGNS), render.CALLOUT_DEFAULT_SIGN)
        lines = [_strip(t) for t in _strip(self.inline(e)).split("\n")]
        return "\n".join([f"> {sign} {t}" if i == 0 else f"> {t}" for i, t in enumerate(lines) if t])

    def marks(self, e: int) -> str:
        """A subtree is told from another by its marks alone."""

        def mark(k: int) -> str:
            token = self.of(k)
            if type(token) is str:
                return f"text:{token}"
            return f"{token.mark}{self.to[k] - k}" if token.kind in ("open", "void") else token.mark

        return "\x01".join([mark(k) for k in range(e, self.to[e] + 1) if not self.closing[k]])

    def timeline(self, e: int) -> str:
        lines = []
        for item in self.children(e, ["div"]):
            date, classes = self.date[item], self.of(item).classes
            parts = self.children(item, ["div", "span", "p", "h3", "h4"])
            if date >= 0:
                own = self.marks(date)
                parts = [c for c in parts if c != date and self.marks(c) != own]
            texts = [t for t in (_strip(self.inline(c)) for c in parts) if t] + ["", ""]
            sign = next((s for name, s in render.TIMELINE_SIGNS.items() if name in classes), render.TIMELINE_DEFAULT_SIGN)
            lines.append(f"- {sign} **{_strip(self.plain(date)) if date >= 0 else ''}** — {texts[0]}")
            lines += [f"  {b}" for b in map(_strip, texts[1].split("\n")) if b]
            lines.append("")
        return "\n".join(lines)

    def comparison(self, e: int) -> str:
        parts = []
        for card in self.children(e, ["div"]):
            divs = self.below(card, "div")
            parts += [f"**{_strip(self.plain(d))}**" for d in divs if self.of(d).titled]
            parts += [_strip(self.inline(p)) for p in self.children(card, ["p"])]
            parts += [f"```\n{self.plain(self.code[p] if self.code[p] >= 0 else p)}\n```" for p in self.below(card, "pre")]
            parts += [self.callout(d) for d in divs if not set(CALLOUT_CLASSES).isdisjoint(self.of(d).classes)]
        return "\n\n".join([p for p in parts if p])

    def body(self, kind: str, i: int) -> str:
        """What a block contributes besides its image line."""
        e = self.blocks["at"][i]
        match kind:
            case "paragraph":
                return _strip(self.inline(e))
            case "heading":
                return f"{'#' * int(self.tag[e][1])} {_strip(self.inline(e))}"
            case "list":
                items = [_strip(self.inline(li)) for li in self.children(e, ["li"])]
                return "\n".join([f"{n}. {t}" for n, t in enumerate(items, 1)] if self.tag[e] == "ol" else [f"- {t}" for t in items])
            case "contents":
                return "\n".join(["## Table of Contents\n", *(f"{n}. {_strip(self.plain(a))}" for n, a in enumerate(self.below(e, "a"), 1))])
            case "footer":
                return f"---\n\n*{_strip(self.inline(e))}*"
            case "table":
                return _table(self.rows(e))
            case "callout":
                return self.callout(e)
            case "code":
                code = self.blocks["code"][i]
                hints = (_LANGUAGE.match(c) for at in (code, e) if at >= 0 for c in self.of(at).classes)
                return f"```{next((m[1] for m in hints if m), '')}\n{self.plain(code if code >= 0 else e)}\n```"
            case "mermaid":
                holder = self.blocks["pre"][i] if self.tag[e] == "div" else e
                return _strip(self.plain(holder)) if holder >= 0 else ""
            case "progress_bar":
                texts = (_strip(self.plain(s)) for s in self.children(e, ["span", "div"]))
                return f"`{' | '.join([t for t in texts if t])}`"
            case "stat_cards":
                return _pair_table([(v, _squeeze(label)) for v, label in self.pairs(self.children(e, ["div"]), CARD_PART_TAGS)])
            case "timeline":
                return self.timeline(e)
            case "hero":
                h1, p = self.blocks["h1"][i], self.blocks["p"][i]
                title = f"# {_strip(self.plain(h1))}" if h1 >= 0 else ""
                lead = f"\n*{_strip(self.plain(p))}*\n" if p >= 0 else ""
                return "\n".join([t for t in (title, lead, _pair_table(self.pairs(self.children(e, ["div"]), ["div", "span"]))) if t])
            case "comparison":
                return self.comparison(e)
            case "visual_component":
                parts = [_table(self.rows(t)) for t in self.below(e, "table")] + [_strip(self.inline(p)) for p in self.below(e, "p")]
                return "\n\n".join([p for p in parts if p])
        return ""


def _slices(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pages of about ``SLICE`` bytes, one page at least."""
    lo = 0
    while lo < len(begin) - 1:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + SLICE, "right")) - 1)
        yield lo, hi
        lo = hi


def converter(chosen: Selection) -> Callable[..., Iterator[pa.Array]]:
    """A function from pages, and the names of the arrays to work with, to arrays of their trees as a struct of lists (see ``type_of``): those asked for that
    do not run over events and, if events are asked for, the bodies of blocks."""

    def pages_of(html: pa.Array, asked: list[str], parser: cut.Parser) -> Iterator[pa.Array]:
        html = html.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(html.buffers()[1], np.int64)[html.offset : html.offset + len(html) + 1]
        held, text = pa.py_buffer(b"") if html.buffers()[2] is None else html.buffers()[2], "ev_tok" in asked
        for lo, hi in _slices(offsets):
            data = held.slice(int(offsets[lo]), int(offsets[hi] - offsets[lo])).to_pybytes()
            begin = offsets[lo : hi + 1] - offsets[lo]
            bounds = cut.cut(data, begin)
            which, values = cut.distinct(data, bounds)
            bits, names, known = parser.tokens(values)
            tokens = np.searchsorted(bounds, begin)
            arrays, _ = tree._outline(bits[which], names[which], tokens, which, chosen, asked)
            columns = []
            lists = lambda page: pa.array(np.searchsorted(page, np.arange(hi - lo + 1)).astype(np.int32))
            for name in asked_of(asked):
                found, page = arrays[name]
                columns.append(pa.ListArray.from_arrays(lists(page), pa.array(found.astype(np.int32), mask=found == -1)))
            is_loading = np.array([type(k) is not str and k.loads_diagrams for k in known], bool)
            loading = np.append(0, np.cumsum(is_loading[which]))[tokens]
            columns.append(pa.array(loading[1:] > loading[:-1]))
            if text:
                kinds, page = arrays["b_kind"]
                events = _Events(arrays, known, hi - lo)
                columns.append(pa.ListArray.from_arrays(lists(page), pa.array([events.body(KINDS[k], i) for i, k in enumerate(kinds.tolist())], pa.string())))
            yield pa.StructArray.from_arrays(columns, names=type_of(asked).names)

    def convert(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        parser = cut.Parser(chosen)
        for html, asked in batches:
            if len(html):
                yield from pages_of(html, asked[0].as_py().split(), parser)
            del html, asked  # they are gone before the next ones are read

    return convert


def asked_of(arrays: Sequence[str]) -> list[str]:
    """The arrays that are given back."""
    return [n for n in arrays if n in (*tree.NUMBERS, *tree.CANDIDATES)]


def type_of(arrays: Sequence[str]) -> T.StructType:
    lists = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in asked_of(arrays)]
    body = [T.StructField("b_body", T.ArrayType(T.StringType()))] if "ev_tok" in arrays else []
    return T.StructType([*lists, T.StructField("loads_diagrams", T.BooleanType()), *body])


def converted(html: str, arrays: Sequence[str], selectors: dict[str, str] = SELECTORS) -> Column:
    """Column: what ``converter`` gives of pages."""
    return F.arrow_udf(converter(selection(selectors)), type_of(arrays))(F.col(html), F.lit(" ".join(arrays)))


def rendered(pages: DataFrame, *carried: str, ix: str = "ix") -> DataFrame:
    """page_id, the columns carried along and ``blocks``, all with body and Markdown: one row a page, of one with the arrays ``ix``."""
    found = render.found_blocks(tree.NUMBERS, ix, f", {ix}.b_body[j] AS body")
    return render.marked(pages.select("page_id", *carried, F.expr(found).alias("blocks")), *carried)
