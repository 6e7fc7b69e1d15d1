"""What is asked of single nodes, as data: one bit per question, rules over bits, and selectors.

A local question looks at one tag: its name, its classes, another attribute. It is answered once for each distinct combination of
these. Questions about the tree ("a heading below", "two such children") are answered from the local ones by ``outline``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

# Elements without content, elements whose text is not part of the plain text or keeps its white space.
VOID_TAGS = [
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image",
    "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source",
    "spacer", "track", "wbr",
]
HIDDEN_TEXT_TAGS = ["rt", "rp", "template"]
KEEP_SPACE_TAGS = ["pre", "textarea"]
# Class names that mark a callout.
CALLOUT_CLASSES = [
    "callout", "alert", "admonition", "notice", "warning",
    "note", "tip", "info", "danger", "success", "hint",
]
# Tags that count as parts of a card, tags that may carry a date, tags without content, headings.
CARD_PART_TAGS = ["div", "span", "p", "h2", "h3", "h4"]
DATE_TAGS = ["time", "span", "div"]
SKIPPED_TAGS = ["script", "style", "head", "link", "meta"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Tags that put marks around their text.
MARK_TAGS = ["strong", "b", "em", "i", "code", "a"]

# --- local questions --------------------------------------------------------------------

BY_TAG = {
    "h1": ["h1"], "p": ["p"], "pre": ["pre"], "code": ["code"], "table": ["table"], "a": ["a"], "div": ["div"], "span": ["span"],
    "section": ["section"], "header": ["header"], "nav": ["nav"], "footer": ["footer"], "body": ["body"], "list": ["ul", "ol"],
    "heading": HEADING_TAGS, "skipped": SKIPPED_TAGS, "card part": CARD_PART_TAGS, "date tag": DATE_TAGS,
    "keeps space": KEEP_SPACE_TAGS, "hides text": HIDDEN_TEXT_TAGS, "mark": MARK_TAGS,
}


@dataclass(frozen=True)
class Local:
    """A question to one tag: ``tag`` and ``class`` ask for a name; ``has`` for an attribute, ``is`` and ``part`` for its value or a part of
    it, ``class part`` for a part of a single class; ``every`` is always met."""

    asks: str
    name: str = ""
    value: str = ""

    def holds(self, tag: str, attributes: Mapping[str, str | None]) -> bool:
        held = attributes.get("class" if self.asks.startswith("class") else self.name)
        match self.asks:
            case "every":
                return True
            case "tag":
                return tag == self.name
            case "class":
                return self.name in SPACES.split(held or "")
            case "class part":
                return any(self.name in c for c in SPACES.split(held or ""))
            case "has":
                return held is not None
            case "is":
                return held == self.value
            case _:
                return self.value in (held or "")


SPACES = re.compile(r"[\s\x0B\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_part = lambda part: Local("part", "style", part)
#: Questions by name; one of the listed is to hold.
BY_ATTRIBUTE = {
    "class mermaid": [Local("class part", "mermaid")], "class timeline": [Local("class part", "timeline")],
    "class callout": [Local("class", name) for name in CALLOUT_CLASSES], "class badge": [Local("class", "badge")],
    "style gradient": [_part("gradient")], "style background": [_part("background")], "style border": [_part("border")],
    "style extent": [_part("width"), _part("flex")], "style grid": [_part("grid")], "style columns": [_part("grid-template-columns")],
}
#: What a token is, and what a string is like; SQL gives both as one number each.
KIND_CODES = ["none", "open", "close", "void", "raw", "text", "comment"]
BY_KIND = {"opens": "open", "closes": "close", "void": "void", "raw": "raw", "text": "text", "comment": "comment"}
BY_STRING = {"blank": 1, "visible": 2, "dated": 4}

# --- rules ------------------------------------------------------------------------------

# Answers from the tree, which ``outline`` gives: has h1, has a, has mermaid, has table, has grid, two bars, only cards,
# mostly dated, is mermaid.
_FRAMED = ("style border", "style background")
#: The kinds of elements in order: the first with a row of bits that are all set decides. ``section`` and ``container`` are
#: looked into; ``skipped`` and whatever meets no rule give nothing.
RULES: list[tuple[str, list[tuple[str, ...]]]] = [
    ("skipped", [("skipped",)]),
    ("hero", [("header",), *[(tag, style, "has h1") for tag in ("div", "section") for style in ("style gradient", "style background")]]),
    ("contents", [("nav", "has a")]),
    ("section", [("section",)]),
    ("heading", [("heading",)]),
    ("paragraph", [("p",)]),
    ("list", [("list",)]),
    ("mermaid", [("is mermaid",), ("div", "has mermaid")]),
    ("callout", [("div", "class callout")]),
    ("progress_bar", [("div", "two bars")]),
    ("stat_cards", [("div", "only cards")]),
    ("timeline", [("div", "class timeline"), ("div", "mostly dated")]),
    ("code", [("pre",)]),
    ("table", [("table",)]),
    ("footer", [("footer",)]),
    ("comparison", [("div", "style columns")]),
    ("visual_component", [("div", frame, below) for frame in _FRAMED for below in ("has table", "has grid")]),
    ("container", [("div",)]),
]
DROPPED = "dropped"
KINDS = [kind for kind, _ in RULES] + [DROPPED]
LOOKED_INTO = ["section", "container"]
SILENT = ["skipped", DROPPED]

# --- selectors ----------------------------------------------------------------------------

# The selectors by which the images of a type are found on a page.
SELECTORS = {
    "hero": 'header, .hero, [class*="hero"]',
    "stat_cards": '.stats-row, .stat-cards, [class*="stats"]',
    "progress_bar": '.progress-bar, .progress, [class*="progress"]',
    "timeline": '.timeline, [class*="timeline"]',
    "mermaid": ".mermaid-wrapper, .mermaid, pre.mermaid",
    "comparison": 'div[style*="grid-template-columns"]:not(.stats-row)',
    "visual_component": 'div[style*="border"][style*="border-radius"][style*="padding"]:has(table):not([style*="grid-template-columns"] *)',
}
_TOKEN = re.compile(r'\s*(,)\s*|(\s+)|\.([\w-]+)|\[([\w-]+)(?:(\*=|=)"([^"]*)")?\]|:(not|has)\(|(\))|(\*)|([a-zA-Z][\w-]*)')


@dataclass(frozen=True)
class Below:
    """Inside an element that meets ``outer``."""

    outer: "Test"


@dataclass(frozen=True)
class Has:
    """Around an element that meets ``inner``."""

    inner: "Test"


@dataclass(frozen=True)
class Not:
    test: "Test"


@dataclass(frozen=True)
class All:
    tests: tuple["Test", ...]


@dataclass(frozen=True)
class Any:
    tests: tuple["Test", ...]


Test = Local | Below | Has | Not | All | Any


def compile_selector(text: str) -> Test:
    """A list of selectors as a test: tags, ``*``, classes, ``[a]``, ``[a="x"]``, ``[a*="x"]``, ``:not()``, ``:has()`` and descent by a blank."""
    found = list(_TOKEN.finditer(text))
    if "".join(m[0] for m in found) != text:
        raise ValueError(f"not a selector that is known here: {text!r}")
    at = 0

    def alternatives(nested: bool) -> Test:
        nonlocal at
        options, outer, here, closed = [], None, [], False

        def finished() -> Test:
            if not here and outer is None:
                raise ValueError(f"empty selector in {text!r}")
            own = All(tuple(here))
            return own if outer is None else All((*here, Below(outer)))

        while at < len(found) and not closed:
            m = found[at]
            at += 1
            comma, blank, name, attribute, operator, value, function, closing, star, tag = m.groups()
            if comma:
                options.append(finished())
                outer, here = None, []
            elif blank:
                if here:
                    outer, here = finished(), []
            elif name:
                here.append(Local("class", name))
            elif attribute:
                here.append(Local({"*=": "part", "=": "is", None: "has"}[operator], attribute.lower(), value or ""))
            elif function:
                inner = alternatives(nested=True)
                here.append(Not(inner) if function == "not" else Has(inner))
            elif closing:
                closed = True
            elif star:
                here.append(Local("every"))
            else:
                here.append(Local("tag", tag.lower()))
        if closed != nested:
            raise ValueError(f"unbalanced selector {text!r}")
        options.append(finished())
        return options[0] if len(options) == 1 else Any(tuple(options))

    return alternatives(nested=False)


def _locals(test: Test) -> list[Local]:
    match test:
        case Local():
            return [test]
        case Below(t) | Has(t) | Not(t):
            return _locals(t)
        case All(ts) | Any(ts):
            return [c for t in ts for c in _locals(t)]


# --- bits ----------------------------------------------------------------------------------

BIT = {name: 1 << i for i, name in enumerate([*BY_KIND, *BY_STRING, *BY_TAG, *BY_ATTRIBUTE])}


@dataclass(frozen=True)
class Selection:
    """Selectors as tests, the bit of each question that they put to single tags, and the attributes that are asked for."""

    tests: dict[str, Test]
    bits: dict[Local, int]
    attributes: list[str]

    def answers(self, tag: str, attributes: Mapping[str, str | None]) -> int:
        """All local questions to a tag, as one long."""
        bits = sum(BIT[name] for name, tags in BY_TAG.items() if tag in tags)
        if any(v is not None for v in attributes.values()):
            bits |= sum(BIT[name] for name, asked in BY_ATTRIBUTE.items() if any(q.holds(tag, attributes) for q in asked))
        return bits | sum(bit for q, bit in self.bits.items() if q.holds(tag, attributes))


def selection(selectors: dict[str, str]) -> Selection:
    tests = {kind: compile_selector(text) for kind, text in selectors.items()}
    asked = dict.fromkeys(q for test in tests.values() for q in _locals(test))
    if len(BIT) + len(asked) > 63:
        raise ValueError("more questions than a long has bits")
    attributes = ["class", "style", *(q.name for q in asked if q.asks in ("has", "is", "part"))]
    return Selection(tests, {q: 1 << len(BIT) + i for i, q in enumerate(asked)}, list(dict.fromkeys(attributes)))


#: The answers that rules ask for, as bits of a second long, and what each row of a rule needs.
RULE_BIT = {name: 1 << i for i, name in enumerate(dict.fromkeys(name for _, rows in RULES for row in rows for name in row))}
NEEDED = [[sum(RULE_BIT[name] for name in row) for row in rows] for _, rows in RULES]
