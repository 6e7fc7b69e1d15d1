"""Pages to outlines, and outlines to node rows.

A page stays one row: regular expressions cut it into tokens, of which each distinct one is parsed once a page, and ``outline`` turns the
kinds, tags and attributes of these into the arrays of the page's tree. Nothing is shuffled, sorted or joined.
Positions count openings *and* closings, so ``pos < other < end_pos`` says "inside".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import sql
from foliant.functions.text import DATED, NON_SPACE, decode_attribute, decode_text, let
from foliant.operators import outline as tree
from foliant.operators.predicates import BY_STRING, KIND_CODES, KINDS, SELECTORS, VOID_TAGS, selection

# The runs are possessive, so neither long values nor long texts recurse in the regex engine.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""


def _token_pattern(comments: bool, sections: bool) -> str:
    """One token. A comment or marked section that never ends takes the rest of the page, to be cut again.

    So the search for its end fails once, not at each later opening. The same holds for a rest without any ``>``. Tags, by far the most
    tokens, are tried first; they end in a ``>``, so none of them is such a rest.
    """
    return (
        r"(?is)"
        r"(?:[^<]++|<(?![a-z!?/]))++"  # text, with any bare less-than sign
        r"|</\s*[a-z][^>]*+>"
        rf"|<(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>(?:.*?</\s*\1\s*>|.*+)"
        rf"|<[a-z]{_ATTRIBUTES}>"
        r"|<[^>]*+\z"
        + (r"|<!--(?:.*?--\s*>|.*+)" if comments else "")
        + (r"|<!\[cdata\[(?:.*?\]\s*\]\s*>|.*+)" if sections else "")
        + r"|<[!?/][^>]*+>"  # declaration, instruction, malformed comment
        r"|<"
    )


_OPEN_COMMENT = r"(?s)^<!--(?!.*--\s*>$)"
_SECTION = r"(?is)^<!\[cdata\[(.*)\]\s*\]\s*>$"
_OPEN_SECTION = r"(?is)^<!\[cdata\[(?!.*\]\s*\]\s*>$)"
_ATTRIBUTE = r"""([^\s/>][^\s/=>]*+)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|(?!['"])[^>\s]*+))?+"""
# A single attribute in double quotes, its name in lower case.
_ONE_ATTRIBUTE = r'''^<[a-zA-Z][^\s/>=]*+\s++([a-z][a-z0-9-]*+)="([^"]*+)"\s*+/?>\z'''
_START_TAG = rf"(?is)^<[a-z][^\s/>]*+({_ATTRIBUTES})>"


def _lower(name: Column) -> Column:
    """Lower case, by the tables of Unicode only where there is something to change."""
    return let(name, lambda n: F.when(n.rlike("^[a-z0-9_-]*+$"), n).otherwise(F.lower(n)))


def _token(t: Column) -> Column:
    """Kind and tag of one token."""

    def tagged(tag: Column) -> Column:
        # A slash that ends an unquoted value does not close the tag.
        self_closing = F.endswith(t, F.lit("/>")) & ~t.rlike(r"""=\s*[^\s"'>]*/>$""")
        kind = (
            F.when(tag == "", F.when(t == "</>", F.lit("none")).when(t.rlike(_OPEN_COMMENT), F.lit("text"))  # never closed: stays text
                   .when(t.rlike(_SECTION) | t.rlike(_OPEN_SECTION), F.lit("text"))
                   .when(t.rlike("^<[!?/]"), F.lit("comment")).otherwise(F.lit("text")))
            .when(F.startswith(t, F.lit("</")), F.lit("close"))
            .when(tag.isin("script", "style") & ~self_closing, F.lit("raw"))
            .when(tag.isin(VOID_TAGS) | self_closing, F.lit("void"))
            .otherwise(F.lit("open"))
        )
        return F.struct(kind.alias("kind"), tag.alias("tag"), t.alias("raw"))

    text = F.struct(F.lit("text").alias("kind"), F.lit("").alias("tag"), t.alias("raw"))
    name = _lower(F.regexp_extract(t, r"^<(?:/\s*)?([a-zA-Z][^\s/>]*)", 1))
    return F.when(~F.startswith(t, F.lit("<")) | ~F.contains(t, F.lit(">")), text).otherwise(let(name, tagged))


def _attributes(raw: Column) -> Column:
    """Attributes as a map, names in lower case and sorted; of a repeated name the last value counts."""
    body = F.regexp_extract(raw, _START_TAG, 1)
    names = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(2))
    quoted = lambda v: F.startswith(v, F.lit('"')) | F.startswith(v, F.lit("'"))
    unquoted = lambda v: F.when(quoted(v), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    pairs = F.zip_with(
        names, values, lambda n, v: F.struct(_lower(n).alias("name"), decode_attribute(unquoted(v)).alias("value"))
    )
    last = lambda ps, name: F.element_at(F.filter(ps, lambda p: p["name"] == name), -1)

    def settled(ps: Column) -> Column:
        distinct = F.sort_array(F.array_distinct(F.transform(ps, lambda p: p["name"])))
        return let(distinct, lambda ns: F.map_from_entries(F.when(F.size(ns) == F.size(ps), F.sort_array(ps)).otherwise(F.transform(ns, lambda n: last(ps, n)))))

    several = let(pairs, lambda ps: F.when(F.size(ps) == 1, F.map_from_entries(ps)).otherwise(settled(ps)))
    single = lambda name: F.create_map(name, let(F.regexp_extract(raw, _ONE_ATTRIBUTE, 2), decode_attribute))
    return let(F.regexp_extract(raw, _ONE_ATTRIBUTE, 1), lambda name: F.when(name != "", single(name)).otherwise(several))


def _string(kind: Column, raw: Column) -> Column:
    """Content of a text, comment, declaration or script node."""
    comment = (
        F.when(F.startswith(raw, F.lit("<!--")), F.regexp_extract(raw, r"(?s)^<!--(.*?)--\s*>$", 1))
        .when(raw.rlike("(?i)^<!doctype"), F.regexp_extract(raw, r"(?is)^<!doctype\s?(.*)>$", 1))
        .otherwise(F.regexp_extract(raw, r"(?s)^<[!?/](.*)>$", 1))
    )
    script = F.regexp_extract(raw, rf"(?is)^<(?:script|style){_ATTRIBUTES}>(.*)</\s*(?:script|style)\s*>$", 1)
    section = F.regexp_extract(raw, _SECTION, 1)
    string = F.when(F.startswith(raw, F.lit("<!")) & raw.rlike(_SECTION), section).otherwise(decode_text(raw))
    return F.when(kind == "text", string).when(kind == "comment", comment).when(kind == "raw", script)


def _cut_raw(html: Column, comments: bool = True, sections: bool = True) -> Column:
    """The tokens of a text. Only the last one can be a comment or section without end; it is cut again."""
    found = F.regexp_extract_all(html, F.lit(_token_pattern(comments, sections)), F.lit(0))
    rests = []
    if comments:
        rests.append((_OPEN_COMMENT, (False, sections)))
    if sections:
        rests.append((_OPEN_SECTION, (comments, False)))

    def settled(tokens: Column) -> Column:
        last = F.try_element_at(tokens, F.lit(-1))
        again = F.filter(F.array(last), lambda t: t.isNotNull())
        for opening, kept in rests:
            again = F.when(F.contains(last, F.lit(">")) & last.rlike(opening), _cut_raw(last, *kept)).otherwise(again)
        return F.concat(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), again)

    return let(found, settled) if rests else found


def _content(token: Column) -> Column:
    """Attributes of a tag, and the string of a text, comment or script."""
    kind, tag, raw = token["kind"], token["tag"], token["raw"]
    has_more = (F.length(raw) > F.length(tag) + 2) & raw.rlike(r"^<[^>\s/]+[\s/]+[^>\s/]")
    attrs = F.when(kind.isin("open", "void", "raw") & has_more, _attributes(raw))
    return F.struct(kind.alias("kind"), tag.alias("tag"), attrs.alias("attrs"), F.when(~kind.isin("open", "close", "void"), _string(kind, raw)).alias("text"))


def _parsed(raw: Column) -> Column:
    """Texts of tokens as an array of (kind, tag, attrs, text)."""
    return F.transform(F.transform(raw, _token), _content)


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, html, ``cut``, the texts of a page's tokens, and ``tokens``, the distinct ones in order of their first place, as (kind, tag, attrs, text)."""
    cut = pages.select("page_id", "html", _cut_raw(F.col("html")).alias("cut"))
    return cut.select("page_id", "html", "cut", _parsed(F.array_distinct("cut")).alias("tokens"))


def tags(pages: DataFrame, name: str) -> DataFrame:
    """page_id and ``tokens``: all tags of a name (a word of ASCII letters), in order. No other token is parsed."""
    opening = lambda t: t.rlike(rf"(?i)^<{name}[\s/>]")
    found = _parsed(F.filter(_cut_raw(F.col("html")), opening))
    return pages.select("page_id", F.filter(found, lambda t: t["tag"] == name).alias("tokens"))


_STRING = f"""transform(tokens, t -> CASE WHEN t.text IS NULL THEN 0 WHEN rlike(t.text, r'{NON_SPACE}')
    THEN {BY_STRING['visible']} + if(rlike(t.text, r'{DATED}'), {BY_STRING['dated']}, 0)
    WHEN t.kind <> 'raw' AND rlike(t.text, r'^[ \t\n\f\r]+$') THEN {BY_STRING['blank']} ELSE 0 END)"""


def outlines(pages: DataFrame, selectors: dict[str, str] = SELECTORS, arrays: Sequence[str] = tree.ARRAYS) -> DataFrame:
    """page_id, html, ``tokens`` and ``ix``, some arrays of the page's tree (see ``outline``). One Python stage."""
    chosen = selection(selectors)
    outline = F.arrow_udf(tree.outliner(chosen, arrays), tree.type_of(arrays))
    common_first = sorted(enumerate(KIND_CODES), key=lambda code: code[1] not in ("text", "open", "close"))
    kinds = F.expr(f"transform(tokens.kind, k -> CASE k {' '.join(f"WHEN '{kind}' THEN {i}" for i, kind in common_first)} END)")
    return tokens(pages).select("page_id", "html", "tokens", outline("cut", kinds, F.expr(_STRING), F.col("tokens.tag"), F.col("tokens.attrs")).alias("ix"))


def classes(attrs: str) -> str:
    """SQL: the class names in a map of attributes."""
    return f"coalesce(regexp_extract_all({attrs}['class'], r'{NON_SPACE}+', 0), cast(array() AS array<string>))"


def nodes_of(outlined: DataFrame) -> DataFrame:
    """Node table: page_id, pos, end_pos, parent, parent_tag, depth, kind, tag, attrs, classes, style, text, block_kind, body extent.

    ``kind`` is document, element, text, comment or raw (a script or style element with its body as ``text``); ``block_kind``
    is set on elements. ``body_pos``/``body_end`` span the first body, or the document if there is none.
    """
    kinds = sql.strings(KINDS)
    node = f"""transform(ix.tok, (k, i) -> struct(ix.pos[i] AS pos, ix.end_pos[i] AS end_pos, ix.parent[i] AS parent,
        CASE WHEN ix.parent_tok[i] IS NOT NULL THEN tokens[ix.parent_tok[i]].tag WHEN k IS NOT NULL THEN '[document]' END AS parent_tag, ix.depth[i] AS depth,
        CASE WHEN k IS NULL THEN 'document' WHEN tokens[k].kind IN ('open', 'void') THEN 'element' ELSE tokens[k].kind END AS kind,
        CASE WHEN k IS NULL THEN '[document]' WHEN tokens[k].kind IN ('open', 'void', 'raw') THEN tokens[k].tag END AS tag,
        tokens[k].attrs AS attrs, tokens[k].text AS text, get(array({kinds}), ix.kind[i]) AS block_kind))"""
    # A page has one node at least; the plain form would make Catalyst filter on the size, parsing twice.
    rows = outlined.select("page_id", F.col("ix.body_pos").alias("body_pos"), F.col("ix.body_end").alias("body_end"), F.expr(f"inline_outer({node})"))
    style = F.coalesce(F.col("attrs")["style"], F.lit(""))
    return rows.select("*", F.expr(classes("attrs")).alias("classes"), style.alias("style"))


def nodes(pages: DataFrame) -> DataFrame:
    return nodes_of(outlines(pages))
