"""Corpus checks: what a page's source holds, whether its output is sound, and what got lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.rows import numbered

# The marks by which a source is said to hold a component (all marks must occur).
SOURCE_MARKS = {
    "hero": ['<header class="hero">'],
    "diagram": ['<pre class="mermaid">', "mermaid-wrapper"],
    "table": ["<table>", "badge green", "badge red"],
    "callout": ["callout insight", "callout success", "callout danger", "callout warn"],
    "progress_bar": ["progress-bar", "background-color"],
    "stat_cards": ["stats-row"],
    "timeline": ['class="timeline"', "timeline-item success", "timeline-item fail", "timeline-item fix"],
    "code": ["<pre><code", "language-python"],
    "comparison": ["comparison-grid"],
    "diagram_script": ["mermaid", "cdn.jsdelivr.net"],
}
# The least sizes and the marks of sound output.
MIN_SOURCE_BYTES, MIN_OUTPUT_CHARS, MIN_STAT_CARDS, MIN_COMPARISON_CARDS = 500, 100, 4, 2
CALLOUT_SIGNS = "💡✅🚨⚠️"
OUTPUT_MARKS = {"diagram": "```mermaid", "table": "| ", "callout": "> ", "image": "!["}


def _holds(text: str, marks: list[str]) -> Column:
    found = F.lit(True)
    for mark in marks:
        found = found & F.contains(F.col(text), F.lit(mark))
    return found


def _has_callout_sign() -> Column:
    """Does the output hold one of the signs? As in the check that this follows, any UTF-16 unit of a sign counts as one."""
    units = CALLOUT_SIGNS.encode("utf-16-be").hex().upper()
    one = "|".join(sorted({units[i : i + 4] for i in range(0, len(units), 4)}))
    return F.hex(F.encode("md", "UTF-16BE")).rlike(f"^(?:.{{4}})*?(?:{one})")


def source_census(pages: DataFrame) -> DataFrame:
    """Which components each page's source holds."""
    stat_cards = F.regexp_count("html", F.lit("stat-card"))
    comparison_cards = F.regexp_count("html", F.lit("comparison-card"))
    extra = {"stat_cards": stat_cards >= MIN_STAT_CARDS, "comparison": comparison_cards >= MIN_COMPARISON_CARDS}
    return pages.select(
        "page_id",
        (F.octet_length("html") > MIN_SOURCE_BYTES).alias("is_long"),
        *[(_holds("html", m) & extra.get(n, F.lit(True))).alias(f"has_{n}") for n, m in SOURCE_MARKS.items()],
        stat_cards.cast("bigint").alias("n_stat_cards"),
        comparison_cards.cast("bigint").alias("n_comparison_cards"),
    )


def output_checks(table: DataFrame) -> DataFrame:
    """Soundness of each page's Markdown (``md``) and manifest."""
    entry = "array<struct<type: string, index: int, filename: string, selector: string>>"
    return table.select(
        "page_id",
        (F.length("md") > MIN_OUTPUT_CHARS).alias("is_long"),
        *[F.contains("md", F.lit(mark)).alias(f"has_{n}") for n, mark in OUTPUT_MARKS.items()],
        _has_callout_sign().alias("has_callout_sign"),
        (F.col("manifest").rlike(r"^\s*\[") & F.from_json("manifest", entry).isNotNull()).alias("manifest_is_array"),
    )


def lost_components(pages: DataFrame) -> DataFrame:
    """Components that a source (``html``) holds and the output (``md``) lacks: page_id, component."""
    source = {n: _holds("html", SOURCE_MARKS[n]) for n in ("diagram", "table", "callout")}
    output = {n: F.contains("md", F.lit(OUTPUT_MARKS[n])) for n in source}
    output["callout"] = output["callout"] & _has_callout_sign()
    lost = F.array_compact(F.array(*[F.when(held & ~output[n], F.lit(n)) for n, held in source.items()]))
    return numbered(pages, lost, "number", "component", "page_id").drop("number")
