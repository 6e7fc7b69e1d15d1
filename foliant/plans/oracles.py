"""What the queries must return, as SQL over the given tables.

None of these statements reads a rendered page: the expected Markdown is put together from the
orders themselves, and for the web pages and documents from patterns on the raw text.
"""

from __future__ import annotations

_ORDERS = """
WITH o AS (
  SELECT o_orderkey // 10 AS page_id, o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p,
         strftime(o_orderdate, '%Y-%m-%d') AS d,
         CAST(row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS INTEGER) AS rn,
         2 + max(o_orderkey % 3) OVER (PARTITION BY o_orderkey // 10) AS w
  FROM orders)
"""

_HEADING = "repeat('#', CAST(k % 6 + 1 AS INTEGER)) || ' Order **' || k || '**\nof ' || c"
_PARAGRAPH = (
    "'Order **' || k || '** is *' || s || '*, see [page *' || k || '*](/o?id=' || k || '&x=1), [none](), run `get '"
    " || k || '`\nnownote ' || c || ' [' || p || '] ' || d"
)
_PLAIN = "'Order ' || k || ' is ' || s || ', see page ' || k || ', none, run get ' || k || 'now  ' || p || '  ' || d"
_THIRD = "CASE WHEN k % 3 >= 1 THEN p || ' \\| ' || d ELSE '' END"
_ROW = (
    f"'| ' || k || ' | [' || s || '] |' || CASE WHEN w >= 3 THEN ' ' || {_THIRD} || ' |' ELSE '' END"
    " || CASE WHEN w >= 4 THEN '  |' ELSE '' END"
)
_SIGN = "CASE k % 5 WHEN 0 THEN '💡' WHEN 3 THEN '💡' WHEN 4 THEN '🚨' ELSE '📌' END"
_CALLOUT = f"'> ' || {_SIGN} || ' Order **' || k || '**\n> state **' || s || '**'"
_STATE = "CASE k % 4 WHEN 0 THEN '🔴' WHEN 1 THEN '🟢' WHEN 2 THEN '🟡' ELSE '⚪' END"
_BODY = "CASE WHEN rn > 1 THEN 'priority ' || p || '\ncustomer ' || c ELSE '' END"
_ENTRY = (
    f"'- ' || {_STATE} || ' **' || d || '** — Order **' || k || '**\n'"
    " || CASE WHEN rn > 1 THEN '  priority ' || p || '\n  customer ' || c || '\n' ELSE '' END"
)
_LANGUAGE = "CASE k % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'sh' ELSE '' END"
_CODE = f"""'```' || {_LANGUAGE} || '\nselect "' || k || '" < 1;\n\n\n\n  -- ' || s || '\n```'"""


def _all(expression: str, gap: str = "\n\n") -> str:
    return f"string_agg({expression}, '{gap}' ORDER BY k)"


def _count(status: str) -> str:
    return f"CAST(count(*) FILTER (s = '{status}') AS VARCHAR)"


def _image(caption: str, kind: str, n: int | str) -> str:
    """``n``: a number, or SQL for one; the reference stands inside a quoted string."""
    number = f"{n:02d}" if isinstance(n, int) else f"' || printf('%02d', {n}) || '"
    return f"![{caption}](images/{kind}_{number}.png)"


_F, _O, _P = map(_count, "FOP")
_HERO_TEXT = (
    f"\n\n# Batch ' || page_id || '\n\n*Orders of batch ' || page_id || ' & more*\n\n| ' || count(*) || ' | ' || {_F}"
    " || ' |\n| --- | --- |\n| orders | closed |'"
)
_CONTENTS = "'## Table of Contents\n\n' || " + _all("rn || '. Order ' || k", "\n")
_TABLE = "'| Order | St**at**us |' || repeat('  |', CAST(any_value(w) - 2 AS INTEGER)) || '\n|' || repeat(' --- |', CAST(any_value(w) AS INTEGER)) || '\n' || " + _all(_ROW, "\n")
_ORDERED = _all("rn || '. Order **' || k || '**'", "\n")
_DASHED = _all("'- ' || s || 'of ' || c", "\n")
_GRAPH = "'graph TD\n' || " + _all("'  B --> O' || k", "\n")
_FOOTER = "'---\n\n*Batch **' || page_id || '** © ' || count(*) || ' end*'"
_REFERENCES = "'![Order ' || k || '](./images/order_' || k || '.png) ![all](images/all.png) ![web](https://example.org/' || k || '.png)'"


def _hero(n: int | str) -> str:
    return f"'{_image('Hero banner', 'hero', n)}{_HERO_TEXT}"


def _progress(n: int | str) -> str:
    return f"'{_image('Progress bar', 'progress_bar', n)}\n\n`F ' || {_F} || ' | O ' || {_O} || ' | P ' || {_P} || '`'"


def _stats(n: int | str) -> str:
    return (
        f"'{_image('Stat cards', 'stat_cards', n)}\n\n| F | O | P |\n| --- | --- | --- |\n| count ' || {_F} || ' | count '"
        f" || {_O} || ' | count ' || {_P} || ' |'"
    )


def _cards(n: int | str) -> str:
    return (
        f"'{_image('Stat cards', 'stat_cards', n)}\n\n| all | 2 x | ' || {_all('d', ' | ')} || ' |\n| --- | --- |'"
        f" || repeat(' --- |', CAST(count(*) AS INTEGER)) || '\n| orders | all | ' || {_all(chr(39) + 'Order ' + chr(39) + ' || k', ' | ')} || ' |'"
    )


def _timeline(n: int | str) -> str:
    return f"'{_image('Timeline', 'timeline', n)}\n\n' || {_all(_ENTRY, chr(10))}"


def _diagram(source: str, n: int | str) -> str:
    return f"'```mermaid\n' || {source} || '\n```\n\n*Fallback image: {_image('Diagram', 'mermaid', n)}*'"


def _comparison(n: int | str) -> str:
    card = lambda s, c: f"'\n\n**{s}**\n\n' || {c} || ' **orders**\n\n```\nn = ' || {c} || '\n```\n\n> 📌 ' || {c} || ' open'"
    return f"'{_image('Comparison', 'comparison', n)}\n\n\nintro' || {card('F', _F)} || {card('O', _O)} || {card('P', _P)}"


def _visual(n: int | str) -> str:
    rows = (
        "'| Order ' || min_by(k, k) || ' | ' || min_by(s, k) || ' |\n| --- | --- |' || coalesce("
        "string_agg('\n| Order ' || k || ' | ' || s || ' |', '' ORDER BY k) FILTER (rn > 1), '')"
    )
    texts = _all("'Order ' || k")
    return f"'{_image('Visual component', 'visual_component', n)}\n\n\n' || {rows} || '\n\n' || {texts} || '\n\nafter'"


# --- full pages: which sections there are, and what follows from that --------------------------

# The sections in order. A page lacks those whose number has the same remainder as the page's by 7.
_SECTIONS = [
    "hero", "contents", "headings", "paragraphs", "tables", "callouts", "progress", "stats", "timeline", "code",
    "lists", "mermaid", "comparison", "visual", "images", "footer", "kept_or_lost", "timeline_as_cards",
]
_PAGES = f"""{_ORDERS}, pg AS (SELECT page_id, count(*) AS n, min_by(s, k) = 'F' AS closed, count(*) FILTER (k % 4 = 1) AS n_success,
    count(*) FILTER (k % 4 <> 3) AS n_coloured FROM o GROUP BY page_id)"""


def _here(section: str) -> str:
    """SQL: does the page have the section? What ``kept_or_lost`` holds shows only where the first order is not closed."""
    there = f"page_id % 7 <> {_SECTIONS.index(section) % 7}"
    return f"({there} AND NOT closed)" if section == "kept_or_lost" else f"({there})"


_SOURCE_KEPT = f"(page_id % 7 <> {_SECTIONS.index('kept_or_lost') % 7})"  # in the source, shown or not
_IMAGED = {"hero": "hero", "progress": "progress_bar", "stats": "stat_cards", "timeline": "timeline", "mermaid": "mermaid",
           "comparison": "comparison", "visual": "visual_component", "kept_or_lost": "mermaid", "timeline_as_cards": "stat_cards"}


def _sum(sections: list[str]) -> str:
    return " + ".join([f"CAST({_here(x)} AS INTEGER)" for x in sections] or ["0"])


def _number(section: str, kind: str | None = None) -> str:
    """SQL: the number of a section's image among all of the page, or among those of a kind."""
    earlier = [x for x in list(_IMAGED)[: list(_IMAGED).index(section)] if kind in (None, _IMAGED[x])]
    return f"(1 + {_sum(earlier)})"


_KEPT = (
    "'" + "{0}" + "\n\n| [a] | [b] |\n| --- | --- |\n\n> 💡 x\n\n> ✅ x\n\n> 🚨 x\n\n> ⚠️ x'"
).format(_diagram("'graph'", _number("kept_or_lost"))[1:-1])
_SHOWN = {
    "hero": _hero(_number("hero")), "contents": _CONTENTS, "headings": _all(_HEADING), "paragraphs": _all(_PARAGRAPH), "tables": _TABLE,
    "callouts": _all(_CALLOUT), "progress": _progress(_number("progress")), "stats": _stats(_number("stats")),
    "timeline": _timeline(_number("timeline")), "code": _all(_CODE), "lists": f"{_ORDERED} || '\n\n' || {_DASHED}",
    "mermaid": _diagram(_GRAPH, _number("mermaid")), "comparison": _comparison(_number("comparison")), "visual": _visual(_number("visual")),
    "images": _all(_REFERENCES), "footer": _FOOTER, "kept_or_lost": _KEPT, "timeline_as_cards": _cards(_number("timeline_as_cards")),
}
_WHOLE = (
    "regexp_replace(concat_ws('\n\n', " + ", ".join(f"CASE WHEN {_here(x)} THEN {md} END" for x, md in _SHOWN.items()) + "), '\n{3,}', '\n\n', 'g')"
)


def _of_pages(columns: str) -> str:
    return f"{_PAGES} SELECT page_id, {columns} FROM pg"


def _of_whole(columns: str) -> str:
    """Columns that may use the Markdown, ``md``."""
    whole = f"SELECT page_id, any_value(n) AS n, any_value(closed) AS closed, any_value(n_coloured) AS n_coloured, {_WHOLE} AS md FROM o JOIN pg USING (page_id) GROUP BY page_id, closed"
    return f"{_PAGES} SELECT page_id, {columns} FROM ({whole})"


def _each_image(columns: str, where: str = "TRUE") -> str:
    """One row per image of a page: {type}, {number} and {ordinal} are filled in."""
    rows = []
    for section, kind in _IMAGED.items():
        filled = columns.format(type=kind, number=_number(section), ordinal=_number(section, kind), found=str(section != "timeline_as_cards").upper())
        rows.append(f"SELECT page_id, {filled} FROM pg WHERE {_here(section)} AND {where.format(found=str(section != 'timeline_as_cards').upper())}")
    return " UNION ALL ".join(rows)


def _kinds(name: str, counted: dict[str, dict[str, str]], always: dict[str, str]) -> str:
    """Per page and kind: the sum over the page's sections of SQL counts. ``kept_or_lost`` counts by its own conditions."""
    rows = ["SELECT page_id, '' AS kind, 0 AS c FROM pg WHERE FALSE", *(f"SELECT page_id, '{kind}', {n} FROM pg" for kind, n in always.items())]
    for section, kinds in counted.items():
        there = "TRUE" if section == "kept_or_lost" else _here(section)
        rows += [f"SELECT page_id, '{kind}', {n} FROM pg WHERE {there}" for kind, n in kinds.items()]
    return f"{_PAGES} SELECT page_id, kind AS {name}, CAST(sum(c) AS BIGINT) AS n FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL HAVING sum(c) > 0"


_ELEMENTS = {
    "hero": {"hero": "1", "heading": "1", "paragraph": "1"}, "contents": {"contents": "1", "list": "1", "section": "1"}, "headings": {"heading": "n"},
    "paragraphs": {"paragraph": "n", "section": "1"}, "tables": {"table": "1"}, "callouts": {"callout": "n", "paragraph": "n", "section": "1"},
    "progress": {"progress_bar": "1"}, "stats": {"stat_cards": "1", "paragraph": "6", "section": "1"},
    # The class of a timeline entry may be "success", which is also a callout's.
    "timeline": {"timeline": "1", "paragraph": "n - 1", "callout": "n_success"}, "code": {"code": "n", "section": "1"}, "lists": {"list": "2 + n"},
    "mermaid": {"mermaid": "6", "section": "1"}, "comparison": {"comparison": "1", "paragraph": "4", "code": "3", "callout": "3", "list": "3"},
    "visual": {"visual_component": "1", "table": "1", "paragraph": "n + 1", "section": "1"}, "images": {"paragraph": "n"},
    "footer": {"footer": "1", "section": "1"}, "timeline_as_cards": {"stat_cards": "1", "paragraph": "n", "section": "1"},
    "kept_or_lost": {kind: f"{n} * CAST({_SOURCE_KEPT} AS INTEGER)" for kind, n in (("mermaid", 2), ("table", 1), ("callout", 4))}
    | {"section": f"CAST({_here('kept_or_lost')} AS INTEGER)"},
}
_BLOCKS = {
    "hero": {"hero": "1"}, "contents": {"contents": "1"}, "headings": {"heading": "n"}, "paragraphs": {"paragraph": "n"}, "tables": {"table": "1"},
    "callouts": {"callout": "n"}, "progress": {"progress_bar": "1"}, "stats": {"stat_cards": "1"}, "timeline": {"timeline": "1"}, "code": {"code": "n"},
    "lists": {"list": "2"}, "mermaid": {"mermaid": "1"}, "comparison": {"comparison": "1"}, "visual": {"visual_component": "1"},
    "images": {"paragraph": "n"}, "footer": {"footer": "1"}, "timeline_as_cards": {"stat_cards": "1"},
    "kept_or_lost": {kind: f"{n} * CAST({_here('kept_or_lost')} AS INTEGER)" for kind, n in (("mermaid", 1), ("table", 1), ("callout", 4))},
}
# How many elements selectors find: per type, SQL.
_CANDIDATES = {
    "hero": _sum(["hero"]), "stat_cards": _sum(["stats"]), "progress_bar": _sum(["progress"]), "timeline": _sum(["timeline", "timeline_as_cards"]),
    "mermaid": f"5 * CAST({_here('mermaid')} AS INTEGER) + 2 * CAST({_SOURCE_KEPT} AS INTEGER)", "comparison": _sum(["comparison"]),
    "visual_component": _sum(["visual"]),
}
_DIAGRAMS = f"({_sum(['mermaid', 'kept_or_lost'])})"


def _any(*sections: str) -> str:
    return "(" + " OR ".join(_here(x) for x in sections) + ")"


# A diagram's arrows look like quotations, and the colours of a timeline share a unit with the signs of callouts.
_QUOTED = _any("callouts", "comparison", "kept_or_lost", "mermaid")
_SIGNED = f"({_any('callouts', 'comparison', 'kept_or_lost')} OR {_here('timeline')} AND n_coloured > 0)"
_PIPED = _any("hero", "tables", "progress", "stats", "visual", "kept_or_lost", "timeline_as_cards")
_DRAWN = _any("mermaid", "kept_or_lost")


def _per_order(columns: str) -> str:
    return f"{_ORDERS} SELECT page_id, {columns} FROM o"


def _per_page(columns: str, rest: str = "") -> str:
    return f"{_ORDERS} SELECT page_id, {columns} FROM o GROUP BY page_id {rest}"


def _one(markdown: str, number: int = 1) -> str:
    return _per_page(f"CAST({number} AS INTEGER) AS block_no, {markdown} AS md")


def _rows(values: list[tuple[str, str]], columns: str) -> str:
    """One row per page and listed value."""
    listed = ", ".join(f"({', '.join(v)})" for v in values)
    return f"{_ORDERS} SELECT page_id, {columns} FROM (SELECT page_id, count(*) AS n FROM o GROUP BY page_id), (VALUES {listed}) AS v(a, b)"



# --- web pages -----------------------------------------------------------------------------

_DECODED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TRIMMED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_LINKS = "regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1)"
_LINK = _TRIMMED.format(_DECODED.format("t"))
_ENTRIES = f"(SELECT page_id, unnest({_LINKS}) AS t, CAST(generate_subscripts({_LINKS}, 1) AS INTEGER) AS i FROM pages)"
_WEB_CONTENTS = f"SELECT page_id, '## Table of Contents\n\n' || string_agg(i || '. ' || {_LINK}, '\n' ORDER BY i) AS md FROM {_ENTRIES} GROUP BY page_id"
_WEB_FOOTER = "SELECT page_id, '---\n\n*' || " + _TRIMMED.format(_DECODED.format("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")) + " || '*' AS md FROM pages"
_CLEAN = "regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'), '(?s)<!--.*?-->', '', 'g')"
_TIMES = "CAST(len(regexp_extract_all({0}, '{1}')) AS BIGINT)"


def _holds(*marks: str) -> str:
    return " AND ".join(f"contains(html, '{m}')" for m in marks)


_MONTH = "(^|[^\\p{L}\\p{M}\\p{N}_])(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)($|[^\\p{L}\\p{M}\\p{N}_])"

ORACLES = {
    "pages_scan": "SELECT page_id, url, length(html) AS n_chars, md5(html) AS digest FROM pages",
    "node_counts": f"""SELECT page_id, {_TIMES.format(_CLEAN, '<[a-zA-Z]')} AS n_elements,
        {_TIMES.format(_CLEAN, '<(script|style)[ >]')} AS n_raw, {_TIMES.format('html', '<!--\\s*ad ')} AS n_ad_comments,
        {_TIMES.format(_CLEAN, '<a[ >]')} AS n_links, {_TIMES.format(_CLEAN, '<p[ >]')} AS n_paragraphs,
        {_TIMES.format(_CLEAN, '<br[ />]')} AS n_breaks FROM pages""",
    "node_edges": f"""{_ORDERS}, deep AS (SELECT page_id, k, rn, s, rn + min(if(rn = 1, 0, c % 5) - rn + 1) OVER (PARTITION BY page_id ORDER BY rn) AS d FROM o),
        tags AS (SELECT *, lower(s) || d AS tag FROM deep),
        parents AS (SELECT t.page_id, t.k, any_value(t.tag) AS tag, coalesce(arg_max(p.tag, p.rn), 'body') AS parent_tag
            FROM tags t LEFT JOIN tags p ON p.page_id = t.page_id AND p.rn < t.rn AND p.d = t.d - 1 GROUP BY t.page_id, t.k),
        edges AS (SELECT page_id, parent_tag, tag FROM parents UNION ALL SELECT page_id, tag, 'br' FROM parents WHERE k % 3 = 0
            UNION ALL SELECT DISTINCT page_id, '[document]', 'html' FROM o UNION ALL SELECT DISTINCT page_id, 'html', 'body' FROM o)
        SELECT page_id, parent_tag, tag, count(*) AS n FROM edges GROUP BY ALL""",
    "root_nodes": "SELECT page_id, 'nav div article footer' AS root_tags FROM pages",
    "entity_text": "SELECT doc_id, text || ' © — 😀 · –' AS text FROM documents",
    "mermaid_pages": _of_pages("closed AS has_mermaid"),
    "source_census": f"""SELECT page_id, strlen(html) > 500 AS is_long, {_holds('<header class="hero">')} AS has_hero,
        {_holds('<pre class="mermaid">', 'mermaid-wrapper')} AS has_diagram,
        {_holds('<table>', 'badge green', 'badge red')} AS has_table,
        {_holds('callout insight', 'callout success', 'callout danger', 'callout warn')} AS has_callout,
        {_holds('progress-bar', 'background-color')} AS has_progress_bar,
        {_holds('stats-row')} AND {_TIMES.format('html', 'stat-card')} >= 4 AS has_stat_cards,
        {_holds('class="timeline"', 'timeline-item success', 'timeline-item fail', 'timeline-item fix')} AS has_timeline,
        {_holds('<pre><code', 'language-python')} AS has_code,
        {_holds('comparison-grid')} AND {_TIMES.format('html', 'comparison-card')} >= 2 AS has_comparison,
        {_holds('mermaid', 'cdn.jsdelivr.net')} AS has_diagram_script,
        {_TIMES.format('html', 'stat-card')} AS n_stat_cards, {_TIMES.format('html', 'comparison-card')} AS n_comparison_cards
        FROM pages""",
    "report_census": _of_pages(f"""{_here('hero')} AS has_hero, {_here('mermaid')} OR {_SOURCE_KEPT} AS has_diagram, {_SOURCE_KEPT} AS has_table,
        {_SOURCE_KEPT} AS has_callout, {_here('progress')} AS has_progress_bar, FALSE AS has_stat_cards, FALSE AS has_timeline, FALSE AS has_code,
        FALSE AS has_comparison, closed AS has_diagram_script, CAST(0 AS BIGINT) AS n_stat_cards, CAST(0 AS BIGINT) AS n_comparison_cards"""),
    "toc_entries": f"SELECT page_id, CAST(1 AS INTEGER) AS block_no, i AS item_no, {_LINK} AS item FROM {_ENTRIES}",
    "toc_blocks": f"SELECT page_id, CAST(1 AS INTEGER) AS block_no, md FROM ({_WEB_CONTENTS})",
    "footers": f"SELECT page_id, CAST(1 AS INTEGER) AS block_no, md FROM ({_WEB_FOOTER})",
    "page_markdown": f"SELECT page_id, c.md || '\n\n' || f.md AS md FROM ({_WEB_CONTENTS}) c JOIN ({_WEB_FOOTER}) f USING (page_id)",
    "markup_escape": "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM documents",
    "paragraphs": f"SELECT doc_id AS page_id, {_TRIMMED.format('text')} AS md FROM documents WHERE {_TRIMMED.format('text')} <> ''",
    "plain_text": _per_order(f"rn AS block_no, {_PLAIN} AS text"),
    "inline_markdown": _per_order(f"rn AS block_no, {_PARAGRAPH} AS md"),
    "headings": _per_order(f"rn AS block_no, {_HEADING} AS md"),
    "link_pieces": f"""{_ORDERS} SELECT page_id, CAST(2 * rn - 1 AS INTEGER) AS link_no, '/o?id=' || k || '&x=1' AS href FROM o
        UNION ALL SELECT page_id, CAST(2 * rn AS INTEGER), '' FROM o""",
    "badge_text": _per_order("rn AS block_no, CAST(1 AS INTEGER) AS item_no, '[' || p || ']' AS item"),
    "date_like": f"SELECT doc_id, regexp_matches(text, '(?i)\\p{{Nd}}{{4}}|{_MONTH}') AS dated FROM documents",
    "table_cells": f"""{_ORDERS}, t AS (SELECT page_id, rn, unnest([CAST(k AS VARCHAR), '[' || s || ']', p || ' \\| ' || d, '']) AS text,
        generate_subscripts([1, 2, 3, 4], 1) - 1 AS i, k % 3 + 2 AS cells FROM o)
        SELECT page_id, CAST(rn AS INTEGER) AS row_idx, CAST(i AS INTEGER) AS col_idx, text FROM t WHERE i < cells
        UNION ALL SELECT DISTINCT page_id, CAST(0 AS INTEGER), CAST(0 AS INTEGER), 'Order' FROM o
        UNION ALL SELECT DISTINCT page_id, CAST(0 AS INTEGER), CAST(1 AS INTEGER), 'St**at**us' FROM o""",
    "table_gfm": _one(_TABLE),
    "callouts": _per_order(f"rn AS block_no, {_CALLOUT} AS md"),
    "progress_bars": _one(_progress(1)),
    "stat_cards": f"{_per_page(f'CAST(1 AS INTEGER) AS block_no, {_stats(1)} AS md')} UNION ALL SELECT page_id, CAST(2 AS INTEGER), {_cards(2)} FROM o GROUP BY page_id",
    "timeline_items": _per_order(f"rn AS item_no, {_STATE} AS sign, d AS date, 'Order **' || k || '**' AS title, {_BODY} AS body"),
    "timeline_blocks": _one(_timeline(1)),
    "code_blocks": _per_order(f"rn AS block_no, {_CODE} AS md"),
    "list_items": f"""{_ORDERS} SELECT page_id, CAST(1 AS INTEGER) AS block_no, rn AS item_no, 'Order **' || k || '**' AS item FROM o
        UNION ALL SELECT page_id, CAST(2 AS INTEGER), rn, s || 'of ' || c FROM o""",
    "list_blocks": f"{_one(_ORDERED)} UNION ALL SELECT page_id, CAST(2 AS INTEGER), {_DASHED} FROM o GROUP BY page_id",
    "mermaid_blocks": f"""{_per_page(f'CAST(1 AS INTEGER) AS diagram_index, {_diagram(_GRAPH, 1)} AS md')}
        UNION ALL SELECT page_id, CAST(2 AS INTEGER), {_diagram("'pie ' || count(*)", 2)} FROM o GROUP BY page_id""",
    "mermaid_sources": f"""{_per_page(f"CAST(1 AS INTEGER) AS idx, 'mermaid_01.mmd' AS name, {_GRAPH} AS source")}
        UNION ALL SELECT page_id, CAST(2 AS INTEGER), 'mermaid_02.mmd', 'pie ' || count(*) FROM o GROUP BY page_id""",
    "mermaid_png_names": _rows([("'mermaid_01.mmd'", "'mermaid_01.png'"), ("'mermaid_02.mmd'", "'mermaid_02.png'")], "a AS name, b AS filename"),
    "mermaid_name_gaps": _rows([("'mermaid_01.png'", "FALSE"), ("'mermaid_03.png'", "TRUE")], "a AS filename, b AS referenced, NOT b AS rendered"),
    "hero_blocks": _one(_hero(1)),
    "comparison_blocks": _one(_comparison(1)),
    "visual_components": _one(_visual(1)),
    "block_kinds": _kinds("block_kind", _ELEMENTS, {"paragraph": "1"}),
    "blocks": _kinds("kind", _BLOCKS, {}),
    "report_markdown": _of_whole("md"),
    "manifest": f"""{_PAGES} {_each_image("'{type}' AS type, CAST({number} AS INTEGER) AS index, '{type}_' || printf('%02d', {number}) || '.png' AS filename, CAST(NULL AS VARCHAR) AS selector")}""",
    "manifest_json": f"""{_PAGES}, images AS ({_each_image("{number} AS i, '{type}' AS type")}) SELECT page_id, '[' || coalesce(string_agg('{{"type":"' || type
        || '","index":' || i || ',"filename":"' || type || '_' || printf('%02d', i) || '.png","selector":null}}', ',' ORDER BY i), '') || ']' AS manifest
        FROM pg LEFT JOIN images USING (page_id) GROUP BY page_id""",
    "page_stats": _of_pages(f"""CAST({_DIAGRAMS} AS BIGINT) AS mermaid_count, CAST({_sum(list(_IMAGED))} AS BIGINT) AS screenshot_count,
        CAST({_sum(["tables", "kept_or_lost"])} AS BIGINT) AS table_count,
        CAST(n * CAST({_here("callouts")} AS INTEGER) + 3 * CAST({_here("comparison")} AS INTEGER) + 4 * CAST({_here("kept_or_lost")} AS INTEGER) AS BIGINT) AS callout_count"""),
    "capture_candidates": f"""{_PAGES}, found AS ({' UNION ALL '.join(f"SELECT page_id, '{t}' AS type, {n} AS n FROM pg" for t, n in _CANDIDATES.items())})
        SELECT page_id, type, CAST(unnest(range(1, n + 1)) AS INTEGER) AS ordinal FROM found""",
    "capture_plan": f"""{_PAGES} {_each_image("'{type}' AS type, CAST({ordinal} AS INTEGER) AS ordinal, '{type}_' || printf('%02d', {number}) || '.png' AS filename, CASE WHEN {found} THEN 'found' ELSE 'missing' END AS status")}""",
    "capture_summary": _of_pages(f"""CAST({_sum([x for x in _IMAGED if x != 'timeline_as_cards'])} AS BIGINT) AS success, CAST({_sum(['timeline_as_cards'])} AS BIGINT) AS failed"""),
    "bundle_index": f"""{_PAGES}, drawn AS (SELECT page_id, unnest(range(1, {_DIAGRAMS} + 1)) AS i FROM pg)
        SELECT page_id, unnest(['output.md', 'screenshot_manifest.json', 'images/full_page.png']) AS path, unnest(['markdown', 'manifest', 'image']) AS kind FROM pg
        UNION ALL SELECT page_id, 'mermaid_sources/mermaid_' || printf('%02d', i) || '.mmd', 'mermaid' FROM drawn
        UNION ALL SELECT page_id, path, 'image' FROM (SELECT page_id, 'images/mermaid_' || printf('%02d', i) || '.png' AS path FROM drawn
            UNION {_each_image("'images/{type}_' || printf('%02d', {number}) || '.png'", "{found}")})""",
    "image_refs": f"""{_ORDERS} SELECT page_id, 'Order ' || k AS alt, './images/order_' || k || '.png' AS ref, s <> 'F' AS is_missing FROM o
        UNION ALL SELECT page_id, 'all', 'images/all.png', TRUE FROM o
        UNION ALL SELECT DISTINCT page_id, 'Hero banner', 'images/hero_01.png', TRUE FROM o""",
    "missing_images": f"""{_ORDERS} SELECT page_id, 'Order ' || k AS alt, './images/order_' || k || '.png' AS ref FROM o WHERE s <> 'F'
        UNION ALL SELECT page_id, 'all', 'images/all.png' FROM o
        UNION ALL SELECT DISTINCT page_id, 'Hero banner', 'images/hero_01.png' FROM o""",
    "missing_image_count": _per_page("1 + count(*) + count(*) FILTER (s <> 'F') AS missing_count"),
    "output_checks": _of_whole(f"""length(md) > 100 AS is_long, {_DRAWN} AS has_diagram, {_PIPED} AS has_table, {_QUOTED} AS has_callout,
        {_any(*_IMAGED, 'images')} AS has_image, {_SIGNED} AS has_callout_sign, TRUE AS manifest_is_array"""),
    "lost_components": f"""{_PAGES} SELECT page_id, 'diagram' AS component FROM pg WHERE ({_here('mermaid')} OR {_SOURCE_KEPT}) AND NOT {_DRAWN}
        UNION ALL SELECT page_id, 'table' FROM pg WHERE {_SOURCE_KEPT} AND NOT {_PIPED}
        UNION ALL SELECT page_id, 'callout' FROM pg WHERE {_SOURCE_KEPT} AND NOT ({_QUOTED} AND {_SIGNED})""",
    "asset_names": "SELECT o_orderkey, printf('hero_%02d.png', o_orderkey) AS filename FROM orders",
}
