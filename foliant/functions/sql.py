"""SQL text for expressions that nest lambdas."""

from __future__ import annotations

from itertools import count

from foliant.functions.text import SPACE, SPACES

_serial = count()
_SPACES = "".join(f"\\u{ord(c):04x}" for c in SPACES)


def _lambda(body, arguments: int) -> str:
    names = [f"x{next(_serial)}" for _ in range(arguments)]
    head = names[0] if arguments == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def transform(array: str, body, arguments: int = 1) -> str:
    return f"transform({array}, {_lambda(body, arguments)})"


def where(array: str, condition) -> str:
    return f"filter({array}, {_lambda(condition, 1)})"


def let(value: str, body) -> str:
    """Evaluate ``value`` once and name it inside ``body``."""
    return f"transform(array({value}), {_lambda(body, 1)})[0]"


def span(lo: str, hi: str) -> str:
    """The integers lo..hi, or nothing if hi < lo (``sequence`` would count down)."""
    return f"if({hi} >= {lo}, sequence({lo}, {hi}), cast(array() AS array<int>))"


def strings(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def mapping(pairs: dict[str, str]) -> str:
    return f"map({strings([x for pair in pairs.items() for x in pair])})"


def strip(text: str) -> str:
    return f"btrim({text}, '{_SPACES}')"


def squeeze(text: str) -> str:
    """Strip, then turn every run of white space into one blank."""
    return f"regexp_replace({strip(text)}, r'{SPACE}+', ' ')"


def escape_pipe(text: str) -> str:
    return f"replace({text}, '|', r'\\|')"
