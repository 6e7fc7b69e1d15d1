"""Blocks to Markdown.

A page is one row. The arrays ``ev_...`` of its outline hold the events of its blocks in document order: openings, strings, and closings that
write a mark. An event is a place in them and ``ev_to`` the last place of its subtree, so any subtree is a range and each rule below
reads exactly the events it renders. What events of the same token share is worked out once a page (``shapes``), and so is what each writes
(``plains``, ``inlines``): the text of a subtree is a slice of these, joined. ``bs`` holds the blocks: where they stand, their kind and the numbers of their images.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import sql
from foliant.functions.rows import numbered
from foliant.functions.text import collapse_blank_lines
from foliant.operators import outline as tree
from foliant.operators.parse import classes
from foliant.operators.predicates import CALLOUT_CLASSES, CARD_PART_TAGS, KINDS

# Signs for callout classes, for the state of a timeline entry, and image captions.
CALLOUT_SIGNS = {
    "success": "✅",
    "danger": "\U0001f6a8",
    "warning": "⚠️",
    "warn": "⚠️",
    "tip": "\U0001f4a1",
    "hint": "\U0001f4a1",
    "insight": "\U0001f4a1",
    "info": "ℹ️",
    "note": "\U0001f4cc",
}
CALLOUT_DEFAULT_SIGN = "\U0001f4cc"
TIMELINE_SIGNS = {"fail": "\U0001f534", "success": "\U0001f7e2", "fix": "\U0001f7e1"}
TIMELINE_DEFAULT_SIGN = "⚪"
CAPTIONS = {
    "hero": "Hero banner",
    "mermaid": "Diagram",
    "progress_bar": "Progress bar",
    "stat_cards": "Stat cards",
    "timeline": "Timeline",
    "comparison": "Comparison",
    "visual_component": "Visual component",
}


def _shape(rules: str) -> str:
    """What the events of one distinct token ``t`` share, as far as the rules read it."""
    opening = "CASE WHEN t.tag IN ('strong', 'b') THEN '**' WHEN t.tag IN ('em', 'i') THEN '*' WHEN t.tag = 'code' THEN '`' WHEN t.tag = 'a' THEN '[' WHEN t.tag = 'br' THEN '\n' ELSE '' END"
    closing = "CASE WHEN t.tag IN ('strong', 'b') THEN '**' WHEN t.tag IN ('em', 'i') THEN '*' WHEN t.tag = 'code' THEN '`' WHEN t.tag = 'a' THEN concat('](', coalesce(t.attrs['href'], ''), ')') ELSE '' END"
    fields = {
        "tag": "if(t.kind IN ('open', 'void'), t.tag, NULL)",
        "shown": f"CASE t.kind WHEN 'text' THEN coalesce(t.text, '') WHEN 'open' THEN {opening} WHEN 'void' THEN concat({opening}, {closing}) ELSE coalesce(t.text, '') END",
        "closing": f"if(t.kind = 'open', {closing}, '')", "is_text": "t.kind = 'text'", "blank": "if(contains(t.text, '\n'), '\n', ' ')",
        "classes": f"if(t.attrs IS NULL, cast(array() AS array<string>), {classes('t.attrs')})", "titled": "coalesce(contains(t.attrs['style'], 'text-transform'), false)",
    }
    return f"named_struct({', '.join(f"'{name}', {value}" for name, value in fields.items() if re.search(rf'\)\.{name}\b', rules))})"


def arrays_of(rules: str) -> list[str]:
    """The arrays of a page's outline that rules read, and those by which blocks are found and numbered."""
    events = [n for n in tree.EVENTS if f"ix.{n}" in rules]
    places = [f"b_{n}" for n in tree.PLACES if re.search(rf"\bb\.{n}\b", rules)]
    return [*events, "b_at", *tree.NUMBERS, *places]


def block_rows(outlined: DataFrame, carried: Sequence[str] = (), arrays: Sequence[str] = tree.BLOCKS) -> DataFrame:
    """page_id, ``tokens``, ``ix``, ``bs`` and the columns that are carried along. What is not used of them is not computed. ``arrays`` are those of
    the outline; without places of events, blocks can be counted and numbered, not rendered."""
    return outlined.select("page_id", *carried, "tokens", "ix", F.expr(found_blocks(arrays)).alias("bs"))


def found_blocks(arrays: Sequence[str], ix: str = "ix", more: str = "") -> str:
    """SQL: the blocks of a page, from the arrays of its outline."""
    kind = f"array({sql.strings(KINDS)})"
    name = f"{kind}[{ix}.b_kind[j]]"
    places = "".join(f"{ix}.b_{n}[j] AS {n}, " for n in ("at", *tree.PLACES) if f"b_{n}" in arrays)
    return f"""transform({ix}.b_pos, (a, j) -> struct({places} a AS pos, {ix}.b_end[j] AS end_pos, {name} AS kind, {ix}.b_asset[j] AS asset_index, {ix}.b_diagram[j] AS diagram_index,
        if({ix}.b_asset[j] IS NULL, NULL, format_string('%s_%02d.png', {name}, {ix}.b_asset[j])) AS asset_file, {ix}.b_callouts[j] AS n_callouts{more}))"""


# The rules below are SQL text over the arrays of events and a block ``b``; an "event" argument is the place of one.
# Text, because a rule nests a dozen lambdas: built call by call, planning took longer than running. Places, because a struct per
# event costs more than all that is read of it.


TOP = "b.at"


def _to(e: str) -> str:
    return f"get(ix.ev_to, {e})"


def _flag(e: str, bit: int) -> str:
    return f"((get(ix.ev_flags, {e}) & {bit}) <> 0)"


def _of_token(e: str, name: str) -> str:
    return f"get(shapes, get(ix.ev_tok, {e})).{name}"


def tag(e: str) -> str:
    """Of an opening."""
    return _of_token(e, "tag")


def _nodes(lo: str, hi: str, keep) -> str:
    """Openings between two places that meet a condition."""
    return sql.where(sql.span(lo, hi), lambda e: f"{_flag(e, tree.OPENING)} AND ({keep(e)})")


def below(e: str, keep) -> str:
    return _nodes(f"({e} + 1)", _to(e), keep)


def children(e: str, tags: list[str]) -> str:
    return below(e, lambda x: f"get(ix.ev_parent, {x}) = {e} AND {tag(x)} IN ({sql.strings(tags)})")


def _between(texts: str, e: str) -> str:
    """The texts of all events of the subtree in one."""
    return f"array_join(slice({texts}, {e} + 2, {_to(e)} - {e}), '')"


def plain(e: str) -> str:
    """Text of the subtree without marks, comments and scripts."""
    return _between("plains", e)


def _plains() -> str:
    """By event: its plain text."""

    def text(n: str, k: str) -> str:
        has_any = f"get(shapes, {n}).is_text AND NOT {_flag(k, tree.CLOSING | tree.HIDDEN)}"
        return f"if({has_any}, if({_flag(k, tree.BLANK)}, get(shapes, {n}).blank, get(shapes, {n}).shown), NULL)"

    return sql.transform("ix.ev_tok", text, 2)


def _piece(k: str) -> str:
    """What an event writes where marks are on."""
    return f"""CASE WHEN {_flag(k, tree.CLOSING)} THEN {_of_token(k, 'closing')} WHEN {_flag(k, tree.BADGE)} THEN concat('[', {sql.strip(plain(k))}, ']')
        WHEN {_flag(k, tree.BLANK)} THEN {_of_token(k, 'blank')} ELSE {_of_token(k, 'shown')} END"""


def _quiet(is_badge: str, e: str) -> str:
    return f"if({is_badge}, '', coalesce(get(plains, {e}), ''))"


def _inlines() -> str:
    """By event: what it writes, seen from outside of all code and badges."""
    return sql.transform("ix.ev_stop", lambda stop, k: f"if({stop} IS NULL, {_piece(k)}, {_quiet(f'get(ix.ev_quiet_stop, {k}) = 1', k)})", 2)


def inline(root: str) -> str:
    """Text of the subtree with inline marks.

    Inside code and badges marks are off. ``ev_stop`` names the outermost of them around an event on the page; only if that
    is the root or lies around it, which then holds for all its events, it is looked up anew.
    """

    def again(e: str) -> str:
        covers = lambda c: f"({tag(c)} = 'code' OR {_flag(c, tree.BADGE)}) AND {_to(c)} >= {e}"
        return sql.let(f"get({_nodes(f'({root} + 1)', f'({e} - 1)', covers)}, 0)", lambda c: f"if({c} IS NULL, {_piece(e)}, {_quiet(_flag(c, tree.BADGE), e)})")

    is_inside = f"get(ix.ev_stop, {root}) IS NOT NULL OR {tag(root)} = 'code' OR {_flag(root, tree.BADGE)}"
    return f"if({is_inside}, array_join({sql.transform(sql.span(f'({root} + 1)', _to(root)), again)}, ''), {_between('inlines', root)})"


def _filled(parts: str) -> str:
    return sql.where(parts, lambda p: f"{p} <> ''")


def _line(cells: str) -> str:
    return f"concat('| ', array_join({cells}, ' | '), ' |')"


def _table(rows: str) -> str:
    def grid(rs: str) -> str:
        def lines(width: str) -> str:
            padded = sql.transform(rs, lambda r: _line(f"concat({r}, array_repeat('', {width} - size({r})))"))
            rule = _line(f"array_repeat('---', {width})")
            return sql.let(padded, lambda ls: f"array_join(concat(slice({ls}, 1, 1), array({rule}), slice({ls}, 2, size({ls}))), '\n')")

        return sql.let(f"array_max({sql.transform(rs, lambda r: f'size({r})')})", lines)

    return sql.let(rows, lambda rs: f"if(size({rs}) > 0, {grid(rs)}, '')")


def table_rows(e: str = TOP) -> str:
    """Cell texts by row: every row and cell below the table, also those of nested tables."""
    cells = lambda tr: sql.transform(below(tr, lambda c: f"{tag(c)} IN ('td', 'th')"), lambda c: sql.escape_pipe(sql.squeeze(inline(c))))
    return sql.where(sql.transform(below(e, lambda r: f"{tag(r)} = 'tr'"), cells), lambda r: f"size({r}) > 0")


def contents_entries() -> str:
    return sql.transform(below(TOP, lambda a: f"{tag(a)} = 'a'"), lambda a: sql.strip(plain(a)))


def list_entries() -> str:
    return sql.transform(children(TOP, ["li"]), lambda li: sql.strip(inline(li)))


def badge_texts() -> str:
    return sql.transform(below(TOP, lambda e: _flag(e, tree.BADGE)), lambda e: f"concat('[', {sql.strip(plain(e))}, ']')")


def _callout(e: str) -> str:
    signs = sql.mapping(CALLOUT_SIGNS)
    found = sql.where(sql.transform(_of_token(e, "classes"), lambda c: f"element_at({signs}, {c})"), lambda s: f"{s} IS NOT NULL")
    sign = f"concat(coalesce(get({found}, 0), '{CALLOUT_DEFAULT_SIGN}'), ' ')"
    lines = sql.transform(f"split({sql.strip(inline(e))}, '\n')", sql.strip)
    signed = sql.transform(lines, lambda t, i: f"if({t} = '', '', concat('> ', if({i} = 0, {sign}, ''), {t}))", 2)
    return f"array_join({_filled(signed)}, '\n')"


def progress_entries() -> str:
    return _filled(sql.transform(children(TOP, ["span", "div"]), lambda s: sql.strip(plain(s))))


def _pairs(cards: str, tags: list[str]) -> str:
    """First and second part of every card that has two."""
    text = lambda parts, i: sql.let(f"{parts}[{i}]", lambda e: sql.strip(plain(e)))
    pair = lambda parts: f"if(size({parts}) >= 2, named_struct('value', {text(parts, 0)}, 'label', {text(parts, 1)}), NULL)"
    found = sql.transform(cards, lambda c: sql.let(children(c, tags), pair))
    return sql.where(found, lambda p: f"{p} IS NOT NULL")


def stat_entries() -> str:
    return sql.transform(
        _pairs(children(TOP, ["div"]), CARD_PART_TAGS),
        lambda p: f"named_struct('value', {p}.value, 'label', {sql.squeeze(f'{p}.label')})",
    )


def hero_entries() -> str:
    return _pairs(children(TOP, ["div"]), ["div", "span"])


def _pair_table(pairs: str) -> str:
    def lines(ps: str) -> str:
        values, labels = (sql.transform(ps, lambda p: f"{p}.{n}") for n in ("value", "label"))
        rows = f"array({values}, array_repeat('---', size({ps})), {labels})"
        return f"if(size({ps}) > 0, array_join({sql.transform(rows, _line)}, '\n'), '')"

    return sql.let(pairs, lines)


def timeline_entries() -> str:
    """sign, date, title and body of every entry."""

    def mark(k: str) -> str:
        # A subtree is told from another by its marks alone: the number of events below each opening gives the shape.
        opening = lambda t: f"concat('<', {t}.tag, coalesce(cast(map_entries({t}.attrs) AS string), ''), ' ', cast({_to(k)} - {k} AS string))"
        own = sql.let(f"get(tokens, get(ix.ev_tok, {k}))", lambda t: f"if({t}.kind IN ('open', 'void'), {opening(t)}, concat({t}.kind, ':', {t}.text))")
        return f"if({_flag(k, tree.CLOSING)}, NULL, {own})"

    def marks(e: str) -> str:
        return f"array_join({sql.transform(sql.span(e, _to(e)), mark)}, '\u0001')"

    def entry(item: str) -> str:
        signs = " ".join(f"WHEN array_contains({_of_token(item, 'classes')}, '{n}') THEN '{c}'" for n, c in TIMELINE_SIGNS.items())

        def fields(date: str) -> str:
            same = lambda c: f"{c} = {date} OR {marks(c)} = {marks(date)}"
            parts = sql.where(children(item, ["div", "span", "p", "h3", "h4"]), lambda c: f"{date} IS NULL OR NOT ({same(c)})")
            texts = _filled(sql.transform(parts, lambda c: sql.strip(inline(c))))
            return sql.let(
                texts,
                lambda ts: f"""named_struct('sign', CASE {signs} ELSE '{TIMELINE_DEFAULT_SIGN}' END,
                    'date', if({date} IS NULL, '', {sql.strip(plain(date))}),
                    'title', coalesce(get({ts}, 0), ''), 'body', coalesce(get({ts}, 1), ''))""",
            )

        return sql.let(f"get(ix.ev_date, {item})", fields)

    return sql.transform(children(TOP, ["div"]), entry)


def _timeline() -> str:
    def lines(t: str) -> str:
        body = sql.transform(_filled(sql.transform(f"split({t}.body, '\n')", sql.strip)), lambda b: f"concat('  ', {b})")
        return f"concat(array(concat('- ', {t}.sign, ' **', {t}.date, '** — ', {t}.title)), {body}, array(''))"

    return f"array_join(flatten({sql.transform(timeline_entries(), lines)}), '\n')"


def code_language() -> str:
    def hint(classes: str) -> str:
        found = sql.transform(classes, lambda c: f"regexp_extract({c}, '^(?:language-|lang-)(.+)$', 1)")
        return f"get({_filled(found)}, 0)"

    return f"coalesce({hint(_of_token('b.code', 'classes'))}, {hint(_of_token(TOP, 'classes'))}, '')"


def code_text() -> str:
    return plain(f"coalesce(b.code, {TOP})")


def mermaid_source() -> str:
    holder = f"if({tag(TOP)} = 'div', b.pre, {TOP})"
    return sql.let(holder, lambda h: f"if({h} IS NULL, '', {sql.strip(plain(h))})")


def _is_callout(e: str) -> str:
    return f"{tag(e)} = 'div' AND arrays_overlap({_of_token(e, 'classes')}, array({sql.strings(CALLOUT_CLASSES)}))"


def _comparison() -> str:
    def parts(card: str) -> str:
        titles = sql.transform(below(card, lambda e: f"{tag(e)} = 'div' AND {_of_token(e, 'titled')}"), lambda e: f"concat('**', {sql.strip(plain(e))}, '**')")
        texts = sql.transform(children(card, ["p"]), lambda p: sql.strip(inline(p)))
        code = lambda e: sql.let(f"coalesce(get(ix.ev_code, {e}), {e})", plain)
        codes = sql.transform(below(card, lambda e: f"{tag(e)} = 'pre'"), lambda e: f"concat('```\n', {code(e)}, '\n```')")
        callouts = sql.transform(below(card, _is_callout), _callout)
        return f"concat({titles}, {texts}, {codes}, {callouts})"

    return f"array_join({_filled(f'flatten({sql.transform(children(TOP, ["div"]), parts)})')}, '\n\n')"


def _visual() -> str:
    tables = sql.transform(below(TOP, lambda e: f"{tag(e)} = 'table'"), lambda t: _table(table_rows(t)))
    texts = sql.transform(below(TOP, lambda e: f"{tag(e)} = 'p'"), lambda p: sql.strip(inline(p)))
    return f"array_join({_filled(f'concat({tables}, {texts})')}, '\n\n')"


def _hero() -> str:
    text = lambda c: sql.strip(plain(c))
    title = f"if(b.h1 IS NULL, '', concat('# ', {text('b.h1')}))"
    lead = f"if(b.p IS NULL, '', concat('\n*', {text('b.p')}, '*\n'))"
    return f"array_join({_filled(f'array({title}, {lead}, {_pair_table(hero_entries())})')}, '\n')"


def _numbered(items: str) -> str:
    return sql.transform(items, lambda t, i: f"concat({i} + 1, '. ', {t})", 2)


def _bodies() -> dict[str, str]:
    """What a block of each kind contributes besides its image line."""
    text = sql.strip(inline(TOP))
    return {
        "paragraph": text,
        "heading": f"concat(repeat('#', int(substring({tag(TOP)}, 2, 1))), ' ', {text})",
        "list": f"array_join(if({tag(TOP)} = 'ol', {_numbered(list_entries())}, {sql.transform(list_entries(), lambda t: f"concat('- ', {t})")}), '\n')",
        "contents": f"array_join(concat(array('## Table of Contents\n'), {_numbered(contents_entries())}), '\n')",
        "footer": f"concat('---\n\n*', {text}, '*')",
        "table": _table(table_rows()),
        "callout": _callout(TOP),
        "code": f"concat('```', {code_language()}, '\n', {code_text()}, '\n```')",
        "mermaid": mermaid_source(),
        "progress_bar": f"concat('`', array_join({progress_entries()}, ' | '), '`')",
        "stat_cards": _pair_table(stat_entries()),
        "timeline": _timeline(),
        "hero": _hero(),
        "comparison": _comparison(),
        "visual_component": _visual(),
    }


def _markdown() -> str:
    """The body with its image line, for kinds that have one, of a rendered block ``b``."""
    image = f"concat('![', element_at({sql.mapping(CAPTIONS)}, b.kind), '](images/', b.asset_file, ')')"
    return f"""CASE
        WHEN b.kind = 'mermaid' THEN if(b.body = '', '', concat('```mermaid\n', b.body, '\n```\n\n*Fallback image: ', {image}, '*'))
        WHEN b.kind IN ('progress_bar', 'stat_cards') THEN concat({image}, '\n\n', b.body)
        WHEN b.kind IN ('hero', 'timeline') THEN concat({image}, '\n', if(b.body = '', '', concat('\n', b.body)))
        WHEN b.kind IN ('comparison', 'visual_component') THEN concat({image}, '\n', if(b.body = '', '', concat('\n\n', b.body)))
        ELSE b.body END"""


def _of(kinds: tuple[str, ...]) -> str:
    return f"filter(bs, b -> b.kind IN ({sql.strings(list(kinds))}))" if kinds else "bs"


_FIELDS = ["pos", "end_pos", "kind", "asset_index", "asset_file", "diagram_index", "n_callouts"]


def _with_events(body: str) -> str:
    """``body`` with the texts of tokens and events as variables: each computed once a page, and only if it is read."""
    for name, value in (("inlines", _inlines()), ("plains", _plains()), ("shapes", None)):
        if name in body:
            body = f"transform(array({value or f'transform(tokens, t -> {_shape(body)})'}), {name} -> {body})[0]"
    return body


def with_bodies(*kinds: str) -> str:
    """Rule: the blocks of some kinds, or all, with their bodies."""
    bodies = {kind: body for kind, body in _bodies().items() if not kinds or kind in kinds}
    body = f"CASE b.kind {' '.join(f"WHEN '{kind}' THEN {body}" for kind, body in bodies.items())} ELSE '' END"
    fields = ", ".join(f"b.{c} AS {c}" for c in _FIELDS)
    return _with_events(f"transform({_of(kinds)}, b -> struct({fields}, {body} AS body))")


def rendered(rows: DataFrame, *kinds: str, carried: Sequence[str] = ()) -> DataFrame:
    """page_id, the columns carried along and ``blocks``, those of some kinds, or all, with body and Markdown: one row a page."""
    return marked(rows.select("page_id", *carried, F.expr(with_bodies(*kinds)).alias("blocks")), *carried)


def marked(with_body: DataFrame, *carried: str) -> DataFrame:
    """``blocks`` that have bodies, with their Markdown."""
    fields = ", ".join(f"b.{c} AS {c}" for c in _FIELDS)
    return with_body.select("page_id", *carried, F.expr(f"transform(blocks, b -> struct({fields}, b.body AS body, {_markdown()} AS md))").alias("blocks"))


def listing(kind: str, listed: str) -> str:
    """Rule: the entries of all blocks of a kind."""
    return _with_events(f"transform({_of((kind,))}, b -> {listed})")


def entries(rows: DataFrame, kind: str, listed: str) -> DataFrame:
    """page_id, block_no, item_no (both from 1) and item: the entries of all blocks of a kind."""
    found = rows.select("page_id", F.expr(listing(kind, listed)).alias("found"))
    return numbered(numbered(found, F.col("found"), "block_no", "entries", "page_id"), F.col("entries"), "item_no", "item", "page_id", "block_no")


def blocks(rendered: DataFrame) -> DataFrame:
    """One row per rendered block: page_id, block_no (from 1, among those), pos, end_pos, kind, asset_index, asset_file,
    diagram_index, n_callouts, body, md."""
    return numbered(rendered, F.col("blocks"), "block_no", "b", "page_id").select("page_id", "block_no", "b.*")


def joined() -> Column:
    """The Markdown of a page: its non-empty blocks in order, with blank lines between."""
    parts = F.transform(F.filter("blocks", lambda b: b["md"] != ""), lambda b: b["md"])
    return collapse_blank_lines(F.array_join(parts, "\n\n"))
