"""String functions: strip, squeeze, escapes, character references, date test, file names."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode strings see it (Java's \s alone is ASCII only).
SPACE = r"[\s\x0B\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # the same characters one by one
NON_SPACE = SPACE.replace("[", "[^", 1)

# The abbreviations that make a string look like a date.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Characters that Windows-1252 gives to the code points 128 to 159.
CP1252 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def span(lo: Column, hi: Column) -> Column:
    """The integers lo..hi, or nothing if hi < lo (``sequence`` would count down)."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def escape_markup(c: Column) -> Column:
    """Replace & < > " by character references, the ampersand first."""
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


# Four digits in a row, or a month abbreviation as a whole word.
DATED = r"(?iU)\d{4}|\b(" + "|".join(MONTHS) + r")\b"


def looks_dated(c: Column) -> Column:
    return c.rlike(DATED)


def asset_name(kind: Column, number: Column, suffix: str = "png") -> Column:
    return F.format_string(f"%s_%02d.{suffix}", kind, number)


# --- character references -------------------------------------------------------------


def _named() -> Column:
    """Names of the HTML 5 table by first letter: one small map per letter, so a look-up stays short."""
    buckets: list[dict[str, str]] = [{} for _ in range(ord("z") - ord("A") + 1)]
    for name, char in html5.items():
        buckets[ord(name[0]) - ord("A")][name.rstrip(";")] = char
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")


def _lookup(name: Column) -> Column:
    return F.element_at(F.get(_named(), F.ascii(name) - ord("A")), name)


def _code_point(n: Column) -> Column:
    """Character of a code point. ``chr`` is modulo 256, so decode four UTF-32 bytes."""
    cp1252 = F.create_map(*[F.lit(x) for n_, ch in CP1252.items() for x in (n_, ch)])
    valid = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return (
        F.when(n.isNull() | ~valid, F.lit("�"))
        .when(n.between(128, 159), F.element_at(cp1252, n.cast("int")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _numeric(ref: Column) -> Column:
    """``&#8212;`` or ``&#x2014;``, with or without the semicolon."""
    digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+);?$", 1)
    base16 = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(
        ref.rlike("^&#[xX]"),
        F.when(F.length(base16) <= 7, F.conv(base16, 16, 10).cast("bigint")),
    ).otherwise(F.when(F.length(base16) <= 9, F.conv(base16, 10, 10).cast("bigint")))
    return let(number, _code_point)


def _decode(c: Column, pieces: str, named) -> Column:
    return F.when(~F.contains(c, F.lit("&")), c).when(~c.rlike("&(?!amp;)"), F.replace(c, F.lit("&amp;"), F.lit("&"))).otherwise(
        F.array_join(
            F.transform(
                F.regexp_extract_all(c, F.lit(pieces), F.lit(0)),
                lambda p: F.when(p.rlike("^&#[0-9xX]"), _numeric(p))
                .when(p.rlike("^&[a-zA-Z]"), named(p))
                .otherwise(p),
            ),
            "",
        )
    )


_NUMERIC = r"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?"


def decode_text(c: Column) -> Column:
    """References in running text. An unknown name keeps its ampersand and loses its semicolon."""

    def named(p: Column) -> Column:
        name = F.regexp_replace(F.substring(p, F.lit(2), F.length(p)), ";$", "")
        return let(name, lambda n: F.coalesce(_lookup(n), F.concat(F.lit("&"), n)))

    return _decode(c, rf"{_NUMERIC}|&[a-zA-Z][-.a-zA-Z0-9]*+;?|[^&]++|&", named)


# The names that HTML accepts without a semicolon, longest first.
_SHORT_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def decode_attribute(c: Column) -> Column:
    """References in attribute values. Unknown names stay; old names need no semicolon."""
    short = "^&(" + "|".join(_SHORT_NAMES) + ")(.*)$"

    def named(p: Column) -> Column:
        full = F.when(F.endswith(p, F.lit(";")), _lookup(F.regexp_extract(p, "^&(.*);$", 1)))
        prefix = F.regexp_extract(p, short, 1)
        legacy = F.when(prefix != "", F.concat(_lookup(prefix), F.regexp_extract(p, short, 2)))
        return F.coalesce(full, legacy, p)

    return _decode(c, rf"{_NUMERIC}|&[a-zA-Z][a-zA-Z0-9]*+;?|[^&]++|&", named)
