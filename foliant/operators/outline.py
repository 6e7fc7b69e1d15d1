"""The tree of a page as arrays: ends of subtrees, places of wanted nodes, answers, kinds and blocks.

Input are the texts of a page's tokens and, per distinct one, its kind, tag and those attributes that are asked for, and what a string is like; places
of tokens in the result are places among the distinct ones. Local questions are answered once per distinct tag with its attributes, as bits of a long. One pass over openings and closings gives each node its parent and the end of its subtree; nodes are numbered in document order, so a subtree is a range and

* "the first X below" is the next X in a sorted list of places, if it lies in the range (a binary search);
* "how many X below" is the difference of two prefix counts, "how many X among the children" a count by parent;
* "inside an X" is a running maximum over the ends of earlier X's.

All of it is arithmetic on whole arrays, over all pages of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from foliant.operators.predicates import (
    All, Any, BIT, BY_KIND, BY_STRING, Below, Has, KIND_CODES, KINDS, LOOKED_INTO, Local, NEEDED, Not, RULE_BIT, SILENT, Selection, Test,
)

SLICE = 1 << 16  # tokens that are worked on at a time; a longer page is worked on alone
#: Kinds whose blocks have an image; a diagram has one only if it has a source.
IMAGED = ["hero", "mermaid", "progress_bar", "stat_cards", "timeline", "comparison", "visual_component"]
CLOSING, OPENING, BLANK, HIDDEN, BADGE = 1, 2, 4, 8, 16  # what is known of an event
OUTSIDE = -2  # place of a node that encloses blocks, before all events

#: The arrays of a page, by what they run over.
NODES = ["tok", "pos", "end_pos", "parent", "parent_tok", "depth", "kind"]
EVENTS = ["ev_tok", "ev_flags", "ev_to", "ev_parent", "ev_stop", "ev_quiet_stop", "ev_code", "ev_date"]
BLOCKS = ["b_at", "b_pos", "b_end", "b_kind", "b_h1", "b_p", "b_pre", "b_code", "b_asset", "b_diagram", "b_callouts"]
PLACES = ["h1", "p", "pre", "code"]
NUMBERS = ["b_pos", "b_end", "b_kind", "b_asset", "b_diagram", "b_callouts"]  # what is known of blocks without their events
CANDIDATES = ["c_type", "c_ordinal", "c_pos"]
ARRAYS = [*NODES, *EVENTS, *BLOCKS, *CANDIDATES]
SCALARS = ["body_pos", "body_end"]


def type_of(arrays: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in arrays] + [T.StructField(n, T.IntegerType()) for n in SCALARS])


def _match_one(
    marks: np.ndarray, opens: list[bool], names: list[int], end: int, closer: np.ndarray, turn: np.ndarray, closes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same for the openings and closings of one page, whose end tags need not nest: writes ``closer``, ``turn`` and ``closes``, gives the
    innermost open element after each mark, and how many are open."""
    places = marks.tolist()
    closer[marks], turn[marks], closes[marks] = -1, 0, 0
    inner, height = [], []
    stack: list[int] = []  # places in ``marks``
    open_tags: dict[int, int] = {}
    for m, name in enumerate(names):
        if opens[m]:
            stack.append(m)
            open_tags[name] = open_tags.get(name, 0) + 1
        elif open_tags.get(name):
            place, k = places[m], 0
            while True:
                last = stack.pop()
                closer[places[last]], turn[places[last]] = place, k
                k += 1
                open_tags[names[last]] -= 1
                if names[last] == name:
                    break
            closes[place] = k
        inner.append(places[stack[-1]] if stack else -1)
        height.append(len(stack))
    for k, left in enumerate(reversed(stack)):
        closer[places[left]], turn[places[left]] = end, k
    return np.array(inner, np.int64), np.array(height, np.int64)


def _narrow(values: np.ndarray, limit: int) -> np.ndarray:
    """Numbers below a limit in a type that is sorted by digits, if there is one."""
    return values.astype(np.uint16) if limit <= 1 << 16 else values


def _match(bits: np.ndarray, tags: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By token: the opening around it (-1: the page) and how many are open; by opening: the token that closes it (the next
    page's first token: the end of the page) and its turn among those closed there; by closing: how many it closes."""
    n = len(bits)
    closer, turn, closes = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    marks = np.flatnonzero(bits & (BIT["opens"] | BIT["closes"]))
    opens = (bits[marks] & BIT["opens"]) != 0
    names = tags[marks]
    cuts = np.searchsorted(marks, begin)
    pages = np.repeat(np.arange(len(begin) - 1), np.diff(cuts))
    # Level of an element: how many are open with it. On a level openings and closings take turns if end tags nest.
    steps = np.append(0, np.cumsum(np.where(opens, 1, -1)))
    height = steps[1:] - steps[cuts[:-1]][pages]  # how many are open after each mark
    level = height + ~opens
    uneven = np.zeros(len(begin) - 1, bool)
    uneven[pages[height < 0]] = True
    base = level.max(initial=0) + 2
    row = pages * base + np.maximum(level, 0)
    order = np.argsort(_narrow(row, len(begin) * base), kind="stable")
    follows = np.zeros(len(order), bool)  # the next one in this order is on the same page and level
    follows[:-1] = row[order][1:] == row[order][:-1]
    first, second = order, np.roll(order, -1)
    pair = follows & opens[first] & ~opens[second]
    uneven[pages[first[follows & ~pair & (opens[first] == opens[second])]]] = True
    uneven[pages[first[pair & (names[first] != names[second])]]] = True
    uneven[pages[order[~np.roll(follows, 1) & ~opens[order]]]] = True  # a level that starts with a closing
    closer[marks[first[pair]]], closes[marks[second[pair]]] = marks[second[pair]], 1
    left = first[opens[first] & ~pair]  # open up to the end of their page
    ends = np.append(height, 0)[np.maximum(cuts[1:] - 1, 0)]
    closer[marks[left]], turn[marks[left]] = begin[1:][pages[left]], (ends[pages[left]] - level[left])
    # The innermost open element after each mark: itself, or after a closing the last one to open on the level reached.
    many = len(marks) + 1
    opened, inner = order[opens[order]], np.where(opens, marks, -1)
    after = np.flatnonzero(~opens & (height > 0))
    if len(opened):
        reached = np.searchsorted(row[opened] * many + opened, (pages[after] * base + height[after]) * many + after, "right") - 1
        inner[after] = marks[opened[reached]]
    for page in np.flatnonzero(uneven).tolist():
        here = slice(cuts[page], cuts[page + 1])
        inner[here], height[here] = _match_one(marks[here], opens[here].tolist(), names[here].tolist(), int(begin[page + 1]), closer, turn, closes)
    # A token stands where the mark before it has left off, if that is on the same page.
    before = np.full(n + 1, 0)
    before[marks + 1] = 1
    before = np.cumsum(before[:n]) - 1
    page_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    known = (before >= 0) & (before >= cuts[page_of])
    around = np.where(known, np.append(inner, -1)[before], -1)
    depth = np.where(known, np.append(height, 0)[before], 0)
    return around, depth, closer, turn, closes


class _Tree:
    """Nodes of all pages of a slice in document order, the page itself first; ``last`` is the last node of a subtree."""

    def __init__(self, bits: np.ndarray, tags: np.ndarray, begin: np.ndarray, place: np.ndarray):
        pages = len(begin) - 1
        around, depth, closer, turn, closes = _match(bits, tags, begin)
        page_of = np.repeat(np.arange(pages), np.diff(begin))
        is_node = (bits & (BIT["opens"] | BIT["void"] | BIT["raw"] | BIT["text"] | BIT["comment"])) != 0
        # Positions count nodes and closings; the page itself has position 0.
        steps = np.append(0, np.cumsum(np.where(is_node, 1, closes)))
        pos = steps[:-1] - steps[begin[:-1]][page_of] + 1
        n_before = np.append(0, np.cumsum(is_node))
        number = n_before[:-1] + page_of + 1  # of a token's node; a page takes one number more
        self.page = np.arange(pages) + n_before[begin[:-1]]  # numbers of the pages
        self.size = np.diff(np.append(self.page, n_before[-1] + pages))
        self.n = int(n_before[-1]) + pages
        tok = np.flatnonzero(is_node)
        at = number[tok]
        self.of_page = np.repeat(np.arange(pages), self.size)
        fill = lambda value, dtype=np.int64: np.full(self.n, value, dtype)
        self.tok, self.bits, self.pos, self.end_pos = fill(-1), fill(0), fill(0), fill(0)
        self.parent, self.depth, self.last = fill(-1), fill(0), np.arange(self.n)
        self.tok[at], self.bits[at], self.pos[at], self.depth[at] = place[tok], bits[tok], pos[tok], depth[tok] + 1
        self.parent[at] = np.where(around[tok] >= 0, number[around[tok]], self.page[page_of[tok]])
        # At the end of a page whatever is open is closed, the page last.
        page_steps = steps[begin[1:]] - steps[begin[:-1]] + 1
        opened = np.flatnonzero(bits & BIT["opens"])
        ends = np.append(pos, 0)[np.minimum(closer[opened], len(pos))]
        at_page_end = closer[opened] == begin[1:][page_of[opened]]
        self.end_pos[at] = self.pos[at]
        self.end_pos[number[opened]] = np.where(at_page_end, page_steps[page_of[opened]], ends) + turn[opened]
        self.last[number[opened]] = n_before[closer[opened]] + page_of[opened]
        self.last[self.page] = self.page + self.size - 1
        self.end_pos[self.page] = page_steps + np.bincount(page_of[opened][at_page_end], minlength=pages)

    def has(self, *names: str) -> np.ndarray:
        """Nodes with all of the bits."""
        need = sum(BIT[n] for n in names)
        return (self.bits & need) == need

    def any(self, *names: str) -> np.ndarray:
        return (self.bits & sum(BIT[n] for n in names)) != 0

    def first_below(self, wanted: np.ndarray) -> np.ndarray:
        """The first wanted node inside each node, or -1."""
        places = np.append(np.flatnonzero(wanted), self.n)
        found = places[np.cumsum(wanted)]
        return np.where(found <= self.last, found, -1)

    def inside(self, wanted: np.ndarray) -> np.ndarray:
        """Nodes inside a wanted node."""
        reach = np.maximum.accumulate(np.where(wanted, self.last, -1))
        return np.append(-1, reach[:-1]) >= np.arange(self.n)

    def children(self, wanted: np.ndarray) -> np.ndarray:
        """How many wanted children each node has."""
        return np.bincount(self.parent[wanted & (self.parent >= 0)], minlength=self.n)

    def below(self, wanted: np.ndarray) -> np.ndarray:
        """How many wanted nodes are inside each node."""
        counts = np.cumsum(wanted)
        return counts[self.last] - counts

    def meets(self, test: Test, asked: dict[Local, int]) -> np.ndarray:
        """Elements that a selector finds. ``asked``: the bits of its questions to single tags."""
        match test:
            case Local():
                return (self.bits & asked[test]) != 0
            case Below(outer):
                return self.inside(self.meets(outer, asked))
            case Has(inner):
                return self.first_below(self.meets(inner, asked)) >= 0
            case Not(t):
                return ~self.meets(t, asked)
            case All(ts):
                return np.logical_and.reduce([self.meets(t, asked) for t in ts])
            case Any(ts):
                return np.logical_or.reduce([self.meets(t, asked) for t in ts])


def _kinds(tree: _Tree, element: np.ndarray, first: dict[str, np.ndarray]) -> np.ndarray:
    """Places in ``KINDS`` of all elements, -1 for other nodes: the lowest rule of which a row is met."""
    at = np.flatnonzero(element)
    div = tree.has("div")
    bars = tree.children(tree.any("div", "span") & tree.has("style background", "style extent"))
    n_div, parts = tree.children(div), tree.children(tree.has("card part"))
    cards = tree.children(div & (parts >= 2))
    dated = tree.children(div & (first["date"] >= 0))
    answers = {
        "is mermaid": tree.any("pre", "div") & tree.has("class mermaid"), "two bars": bars >= 2, "only cards": (cards >= 2) & (cards == n_div),
        "mostly dated": (n_div >= 3) & (10 * dated >= 6 * n_div),
        **{f"has {name}": first[name] >= 0 for name in ("h1", "a", "mermaid", "table", "grid")},
    }
    facts, bits = np.zeros(len(at), np.int64), tree.bits[at]
    for name, bit in RULE_BIT.items():
        facts |= np.where(answers[name][at] if name in answers else bits & BIT[name], bit, 0)
    lowest = np.full(len(at), len(NEEDED))  # no rule: dropped
    for rule in reversed(range(len(NEEDED))):
        for need in NEEDED[rule]:
            lowest[(facts & need) == need] = rule
    kind = np.full(tree.n, -1)
    kind[at] = lowest
    return kind


def _running(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running count of the true values within each group of neighbours."""
    counts = np.cumsum(values)
    first = np.searchsorted(group, group)
    return counts - np.append(0, counts)[first]


def _events(tree: _Tree, heads: np.ndarray, first: dict[str, np.ndarray], hidden: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The arrays of events with the places of blocks among them, and the page of each event. Events are the nodes of blocks, and the
    closings that write a mark."""
    every = np.arange(tree.n)
    is_badge = tree.has("span", "class badge")
    owner = np.append(heads, -1)[np.searchsorted(heads, every, "right") - 1]
    kept = np.flatnonzero((owner >= 0) & (every <= tree.last[owner]))
    marked = kept[tree.has("mark", "opens")[kept]]
    n_pages = len(tree.page)
    page_begin = np.append(0, np.cumsum(tree.end_pos[tree.page] + 1))
    place = lambda page, pos: page_begin[page] + pos
    node_at, end_at = place(tree.of_page[kept], tree.pos[kept]), place(tree.of_page[marked], tree.end_pos[marked])
    holder = np.full(page_begin[-1], -1)
    holder[node_at], holder[end_at] = kept, marked
    closing = np.zeros(page_begin[-1], bool)
    closing[end_at] = True
    used = np.flatnonzero(holder >= 0)
    rank = np.cumsum(holder >= 0) - 1  # of the event at or before a position, over all pages
    ev_node, ev_close = holder[used], closing[used]
    ev_page = tree.of_page[ev_node]
    ev_begin = np.searchsorted(ev_page, np.arange(n_pages))
    at = np.full(tree.n + 1, -1)  # a node's event within its page; -1 for none
    at[kept] = rank[node_at] - ev_begin[tree.of_page[kept]]
    to = np.full(tree.n, -1)
    ends = np.where(tree.end_pos[kept] > tree.pos[kept], tree.end_pos[kept] - 1, tree.pos[kept])
    to[kept] = rank[place(tree.of_page[kept], ends)] - ev_begin[tree.of_page[kept]]
    # The outermost code or badge around a node: of the earlier ones the one that reaches furthest.
    quiet = tree.has("code") | is_badge
    reach = np.append(-1, np.maximum.accumulate(np.where(quiet, tree.last * (tree.n + 1) + (tree.n - every), -1))[:-1])
    stop = np.where(reach // (tree.n + 1) >= every, tree.n - reach % (tree.n + 1), -1)
    stop_at = np.where(stop < 0, -1, np.where(at[stop] < 0, OUTSIDE, at[stop]))
    shrinks = tree.has("blank") & ~tree.inside(tree.has("keeps space"))
    flags = CLOSING * ev_close + OPENING * (tree.any("opens", "void")[ev_node] & ~ev_close) + BLANK * shrinks[ev_node] + HIDDEN * hidden[ev_node] + BADGE * is_badge[ev_node]
    badge_stop = np.where(stop >= 0, is_badge[stop], False)
    event_of = lambda nodes: np.where(nodes >= 0, at[nodes], -1)
    arrays = {
        "ev_tok": tree.tok[ev_node], "ev_flags": flags, "ev_to": to[ev_node], "ev_parent": event_of(tree.parent[ev_node]), "ev_stop": stop_at[ev_node],
        "ev_quiet_stop": badge_stop[ev_node], "ev_code": event_of(first["code"][ev_node]), "ev_date": event_of(first["date"][ev_node]),
        "b_at": at[heads], **{f"b_{n}": event_of(first[n][heads]) for n in PLACES},
    }
    return arrays, ev_page


def _outline(bits: np.ndarray, tags: np.ndarray, begin: np.ndarray, place_of: np.ndarray, chosen: Selection, asked: Sequence[str]) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], dict[str, np.ndarray]]:
    """For each array asked for, at least, its values and the page of each; for each scalar its values. -1 stands for null."""
    tree = _Tree(bits, tags, begin, place_of)
    element = tree.any("opens", "void", "raw")

    wanted = {name: tree.has(name) for name in ("h1", "p", "pre", "code", "table", "a")}
    wanted["mermaid"] = tree.any("pre", "div") & tree.has("class mermaid")
    wanted["grid"] = tree.has("div", "style grid")
    renders = not {*EVENTS, *BLOCKS}.difference(NUMBERS).isdisjoint(asked)
    first = {name: tree.first_below(w) for name, w in wanted.items() if renders or name not in ("p", "code")}
    # An element has a string of its own if a chain of only children leads down to it.
    string = tree.any("text", "comment", "raw")
    at = np.flatnonzero(tree.has("date tag"))
    holds = tree.last[at]  # the only string is the last node of the subtree
    at, holds = at[string[holds] & (holds > at)], holds[string[holds] & (holds > at)]
    chain = (tree.depth[holds] - tree.depth[at] == holds - at) & tree.has("dated")[holds]
    dated = np.zeros(tree.n, bool)
    dated[at[chain]] = True
    first["date"] = tree.first_below(dated)
    kind = _kinds(tree, element, first)

    body = np.append(np.flatnonzero(tree.has("body", "opens")), tree.n)
    body = body[np.searchsorted(body, tree.page).clip(max=len(body) - 1)]
    body = np.where(body <= tree.last[tree.page], body, tree.page)
    every = np.arange(tree.n)
    in_body = (every > body[tree.of_page]) & (every <= tree.last[body][tree.of_page])
    stops = in_body & element & ~np.isin(kind, [KINDS.index(k) for k in LOOKED_INTO])
    heads = np.flatnonzero(stops & ~tree.inside(stops) & ~np.isin(kind, [KINDS.index(k) for k in SILENT]))

    # Blocks, with the numbers of their images.
    block_kind = kind[heads]
    of = lambda name: block_kind == KINDS.index(name)
    hidden = tree.inside(tree.has("hides text"))
    shown = tree.below(tree.has("visible") & ~hidden)
    source = np.where(tree.has("div")[heads], first["pre"][heads], heads)
    is_diagram = of("mermaid") & (source >= 0) & (shown[source] > 0)
    is_asset = is_diagram | (np.isin(block_kind, [KINDS.index(k) for k in IMAGED]) & ~of("mermaid"))
    block_page = tree.of_page[heads]
    cards = np.flatnonzero(tree.has("div") & (tree.parent >= 0))
    in_cards = np.bincount(tree.parent[cards], weights=tree.below(tree.has("div", "class callout"))[cards], minlength=tree.n).astype(np.int64)

    picks = [np.flatnonzero(element & tree.meets(test, chosen.bits)) for test in chosen.tests.values() if not set(CANDIDATES).isdisjoint(asked)]
    c_node = np.concatenate([*picks, every[:0]])
    c_type = np.repeat(np.arange(len(picks)), np.array([len(p) for p in picks], np.int64))
    c_ordinal = np.concatenate([*(_running(np.ones(len(p), bool), tree.of_page[p]) for p in picks), every[:0]])
    order = np.lexsort((c_ordinal, c_type, tree.of_page[c_node]))
    c_page = tree.of_page[c_node][order]

    pos_of = lambda nodes: np.where(nodes >= 0, tree.pos[nodes], -1)
    arrays = {
        "tok": tree.tok, "pos": tree.pos, "end_pos": tree.end_pos, "parent": pos_of(tree.parent), "parent_tok": np.where(tree.parent >= 0, tree.tok[tree.parent], -1), "depth": tree.depth, "kind": kind,
        "b_pos": tree.pos[heads], "b_end": tree.end_pos[heads], "b_kind": block_kind,
        "b_asset": np.where(is_asset, _running(is_asset, block_page), -1), "b_diagram": np.where(is_diagram, _running(is_diagram, block_page), -1),
        "b_callouts": np.where(of("callout"), 1, np.where(of("comparison"), in_cards[heads], 0)),
        "c_type": c_type[order], "c_ordinal": c_ordinal[order], "c_pos": tree.pos[c_node][order],
    }
    pages = {**{n: tree.of_page for n in NODES}, **{n: block_page for n in BLOCKS}, **{n: c_page for n in CANDIDATES}}
    if renders:
        found, ev_page = _events(tree, heads, first, hidden)
        arrays |= found
        pages |= {n: ev_page for n in EVENTS}
    scalars = {"body_pos": tree.pos[body], "body_end": tree.end_pos[body]}
    return {n: (values, pages[n]) for n, values in arrays.items()}, scalars


def _slices(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pages of about ``SLICE`` tokens, one page at least."""
    lo = 0
    while lo < len(begin) - 1:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + SLICE, "right")) - 1)
        yield lo, hi
        lo = hi


_KIND_BITS = np.array([next((BIT[name] for name, kind in BY_KIND.items() if kind == code), 0) for code in KIND_CODES], np.int64)


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Places in a list of distinct values, the last of which is null."""
    coded = column.dictionary_encode()
    values = coded.dictionary.to_pylist()
    return coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False).astype(np.int64), [*values, None]


def _values(attributes: list[pa.Array], names: list[str], n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, list[str | None]]]]:
    """Tokens that may have an attribute asked for, and for each of these attributes what ``_codes`` gives of their values. The attributes
    of tokens are a column for each name, or one of maps."""
    if len(attributes) != 1 or not pa.types.is_map(attributes[0].type):
        return np.arange(n), [_codes(a) for a in attributes]
    maps = attributes[0].drop_null()  # places of null maps need not be set
    offsets = maps.offsets.to_numpy() if len(maps) else np.zeros(1, np.int32)
    held = np.flatnonzero(attributes[0].is_valid().to_numpy(zero_copy_only=False))
    owner = np.repeat(held, np.diff(offsets))
    (key, keys), (code, values) = (_codes(c.slice(offsets[0], len(owner))) for c in (maps.keys, maps.items))
    asked = np.isin(key, [i for i, k in enumerate(keys) if k in names])
    some = np.unique(owner[asked])
    columns = []
    for name in names:
        mine = key == (keys.index(name) if name in keys else -1)
        column = np.full(len(some), len(values) - 1)
        column[np.searchsorted(some, owner[mine])] = code[mine]
        columns.append((column, values))
    return some, columns


def _answers(kinds: np.ndarray, strings: np.ndarray, tags: pa.Array, attributes: list[pa.Array], chosen: Selection) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all tokens, and a number for each tag name. What follows from the tag alone is asked once a tag."""
    tag_code, names = _codes(tags)
    none = dict.fromkeys(chosen.attributes)
    answered = np.array([chosen.answers(tag, none) if tag else 0 for tag in names], np.int64)[tag_code]
    some, columns = _values(attributes, chosen.attributes, len(tags))
    combined = tag_code[some]
    for code, values in columns:  # numbered anew each time, so that no product grows beyond a long
        combined = np.unique(combined * len(values) + code, return_inverse=True)[1].ravel()
    distinct, first, which = np.unique(combined, return_index=True, return_inverse=True)
    found = np.zeros(len(distinct), np.int64)
    for i, at in enumerate(first.tolist()):
        tag = names[tag_code[some[at]]]
        if tag:
            found[i] = chosen.answers(tag, {name: values[code[at]] for name, (code, values) in zip(chosen.attributes, columns)})
    answered[some] = found[which.ravel()]
    bits = _KIND_BITS[kinds]
    is_tag = (bits & (BIT["opens"] | BIT["void"] | BIT["raw"])) != 0
    bits = bits | np.where(is_tag, answered, 0)
    of_string = sum(np.where(strings & code, BIT[name], 0) for name, code in BY_STRING.items())
    return bits | np.where(bits & BIT["text"], of_string, of_string & ~BIT["visible"]), tag_code


def _starts(lists: pa.Array) -> np.ndarray:
    """Where the lists of a column begin in its flat values, and where the last one ends."""
    return np.append(0, np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))


def _first_places(cut: pa.Array, begin: np.ndarray) -> np.ndarray:
    """For each token the number of its text among the distinct ones of all pages, each page's in order of their first place."""
    codes, values = cut.dictionary_encode(), len(cut) + 1
    keys = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * values + codes.indices.fill_null(values - 1).to_numpy(zero_copy_only=False)
    return pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)  # numbers in order of first places


def outliner(chosen: Selection, asked: Sequence[str] = ARRAYS) -> Callable[..., Iterator[pa.Array]]:
    """A function from the tokens of pages (their texts; of each distinct one kind code, string code, tag and either its attributes as a map or the
    chosen ones, each an array per page) to the asked arrays of their trees, as a struct of lists (see ``type_of``). What it gives at a time is as small as what it works on."""

    def parts(cut: pa.Array, kinds: pa.Array, *others: pa.Array) -> Iterator[pa.Array]:
        begin, parsed = _starts(cut), _starts(kinds)
        texts, *flat = (column.flatten() for column in (cut, kinds, *others))
        for lo, hi in _slices(begin):
            first, tokens = parsed[lo], begin[lo : hi + 1] - begin[lo]
            which = _first_places(texts.slice(begin[lo], begin[hi] - begin[lo]), tokens)
            kind, string, tag, *values = (column.slice(first, parsed[hi] - first) for column in flat)
            bits, names = _answers(kind.to_numpy(zero_copy_only=False), string.to_numpy(zero_copy_only=False), tag, values, chosen)
            place = which - np.repeat(parsed[lo:hi] - first, np.diff(tokens))
            arrays, scalars = _outline(bits[which], names[which], tokens, place, chosen, asked)
            columns = []
            for name in asked:
                found, page = arrays[name]
                lists = np.searchsorted(page, np.arange(hi - lo + 1)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(lists), pa.array(found.astype(np.int32), mask=found == -1)))
            columns += [pa.array(scalars[name].astype(np.int32)) for name in SCALARS]
            yield pa.StructArray.from_arrays(columns, names=[*asked, *SCALARS])

    def outline(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from parts(*batch)
            del batch  # it is gone before the next one is read

    return outline
