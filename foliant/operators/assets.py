"""Side tables of a conversion: manifest, diagram sources, counts, image references, capture plan, listing.

Most of them are read off one row per page (see ``Conversion.table``): ``bs`` are its blocks with the numbers of their images,
``blocks`` the same with their Markdown, ``candidates`` the elements that selectors find. Nothing of that is joined or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import sql
from foliant.functions.rows import spread
from foliant.functions.text import asset_name
from foliant.operators.outline import IMAGED

# The image reference of Markdown.
IMAGE_REFERENCE = r"!\[([^\]]*)\]\(([^)]+)\)"

_ENTRY = "named_struct('type', b.kind, 'index', b.asset_index, 'filename', b.asset_file, 'selector', cast(NULL AS string))"
_entries = lambda blocks: f"transform(filter({blocks}, b -> b.asset_index IS NOT NULL), b -> {_ENTRY})"
_SOURCES = """transform(filter(blocks, b -> b.diagram_index IS NOT NULL),
    b -> named_struct('idx', b.diagram_index, 'name', format_string('mermaid_%02d.mmd', b.diagram_index), 'source', b.body))"""


def candidates(types: list[str]) -> Column:
    """Elements that a capture by selector would find: an array of (type, ordinal within the type, node_pos). ``types`` are those of the
    selectors with which the page was outlined. An element may be a candidate for several types.
    """
    types = sql.strings(types)
    return F.expr(f"transform(ix.c_type, (t, i) -> struct(array({types})[t] AS type, ix.c_ordinal[i] AS ordinal, ix.c_pos[i] AS node_pos))")


def loads_diagrams() -> Column:
    """Does a page load the diagram script?"""
    return F.exists("tokens", lambda t: F.coalesce((t["kind"] == "raw") & (t["tag"] == "script") & F.contains(t["attrs"]["src"], F.lit("mermaid")), F.lit(False)))


def manifest(table: DataFrame) -> DataFrame:
    """One row per image that a page's Markdown refers to, numbered over all types in page order."""
    return spread(table, F.expr(_entries("bs")), "page_id")


def manifest_json(blocks: str = "bs") -> Column:
    """The manifest of a page as one JSON array; a page without images has an empty one."""
    return F.to_json(F.expr(_entries(blocks)), {"ignoreNullFields": "false"})


def mermaid_sources(table: DataFrame) -> DataFrame:
    return spread(table, F.expr(_SOURCES), "page_id")


def stats() -> dict[str, Column]:
    """The counts of a page, from kinds and numbers alone: nothing is rendered for them."""
    count = lambda condition: F.expr(f"cast(size(filter(bs, b -> {condition})) AS bigint)")
    return {
        "mermaid_count": count("b.diagram_index IS NOT NULL"), "screenshot_count": count("b.asset_index IS NOT NULL"),
        "table_count": count("b.kind = 'table'"), "callout_count": F.expr("aggregate(bs, 0L, (n, b) -> n + b.n_callouts)"),
    }


def page_stats(table: DataFrame) -> DataFrame:
    return table.select("page_id", *[count.alias(name) for name, count in stats().items()])


def resolved(path: Column) -> Column:
    """A path without empty and ``.`` parts, each ``..`` taken with the part before it. It stays relative or absolute."""
    root = F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = F.when(F.coalesce(last != "..", F.lit(False)), F.slice(done, 1, F.size(done) - 1)).when(root, done).otherwise(F.array_append(done, part))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(root, "/").otherwise(""), F.array_join(parts, "/"))


def image_refs(markdown: DataFrame, files: DataFrame) -> DataFrame:
    """Local image references of every page, one row per occurrence, and whether the file is missing.

    ``files`` has page_id and path, relative to the page's Markdown. A left join on (page, resolved path) with the
    distinct paths keeps one row per reference however often a path is listed.
    """
    ref = lambda i: F.regexp_extract_all("md", F.lit(IMAGE_REFERENCE), F.lit(i))
    found = spread(markdown, F.arrays_zip(ref(1).alias("alt"), ref(2).alias("ref")), "page_id")
    local = found.filter(~F.col("ref").rlike("^https?://"))
    known = files.groupBy("page_id", resolved(F.col("path")).alias("path")).agg(F.lit(True).alias("_known"))
    matched = local.withColumn("path", resolved(F.col("ref"))).join(known, ["page_id", "path"], "left")
    return matched.select("page_id", "alt", "ref", F.col("_known").isNull().alias("is_missing"))


def missing_images(refs: DataFrame) -> DataFrame:
    return refs.filter("is_missing").select("page_id", "alt", "ref")


def missing_image_count(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Counts for every page, zero where nothing is missing."""
    counts = refs.groupBy("page_id").agg(F.count_if("is_missing").alias("missing_count"))
    return pages.select("page_id").distinct().join(counts, "page_id", "left").na.fill(0)


def plan() -> Column:
    """The n-th manifest entry of a type takes the n-th candidate of that type, if there is one: an array of (type, ordinal,
    filename, node_pos, status)."""

    def of_type(found: str) -> str:
        entry = f"""struct(b.kind AS type, i + 1 AS ordinal, b.asset_file AS filename, get({found}, i).node_pos AS node_pos,
            if(get({found}, i) IS NULL, 'missing', 'found') AS status)"""
        return f"transform(filter(bs, b -> b.kind = ty AND b.asset_index IS NOT NULL), (b, i) -> {entry})"

    each = sql.let("filter(candidates, c -> c.type = ty)", of_type)
    return F.expr(f"flatten(transform(array({sql.strings(IMAGED)}), ty -> {each}))")


def capture_candidates(table: DataFrame) -> DataFrame:
    return spread(table, F.col("candidates"), "page_id")


def capture_plan(table: DataFrame) -> DataFrame:
    return spread(table, F.col("plan"), "page_id")


def capture_summary(table: DataFrame) -> DataFrame:
    """Counts for every page, zero where there was nothing to capture."""
    count = lambda status: F.size(F.filter("plan", lambda p: p["status"] == status)).cast("bigint")
    return table.select("page_id", count("found").alias("success"), count("missing").alias("failed"))


def png_names() -> Column:
    """Diagram images are numbered by the sorted source name, not by the manifest: an array of (name, filename)."""
    names = F.sort_array(F.transform(F.expr("filter(bs, b -> b.diagram_index IS NOT NULL)"), lambda b: asset_name(F.lit("mermaid"), b["diagram_index"], "mmd")))
    return F.transform(names, lambda n, i: F.struct(n.alias("name"), asset_name(F.lit("mermaid"), i + 1).alias("filename")))


def mermaid_png_names(table: DataFrame) -> DataFrame:
    return spread(table, F.col("png_names"), "page_id")


def mermaid_name_gaps(table: DataFrame) -> DataFrame:
    """Diagram images referred to but not drawn under that name, and the other way round."""
    names = table.select(
        "page_id", F.expr("transform(filter(bs, b -> b.diagram_index IS NOT NULL), b -> b.asset_file)").alias("referred"),
        F.transform("png_names", lambda p: p["filename"]).alias("drawn"),
    )
    one_way = lambda a, b, referred: F.transform(
        F.array_except(a, b), lambda f: F.struct(f.alias("filename"), F.lit(referred).alias("referenced"), F.lit(not referred).alias("rendered"))
    )
    return spread(names, F.concat(one_way("referred", "drawn", True), one_way("drawn", "referred", False)), "page_id")


def files() -> Column:
    """Files of a page's export: an array of (path, kind)."""
    file = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("kind"))
    below = lambda folder, name, kind: file(F.concat(F.lit(folder), name), kind)
    fixed = F.array(file(F.lit("output.md"), "markdown"), file(F.lit("screenshot_manifest.json"), "manifest"), file(F.lit("images/full_page.png"), "image"))
    diagrams = F.transform("png_names", lambda p: below("mermaid_sources/", p["name"], "mermaid"))
    found = F.transform(F.filter("plan", lambda p: p["status"] == "found"), lambda p: below("images/", p["filename"], "image"))
    drawn = F.transform("png_names", lambda p: below("images/", p["filename"], "image"))
    return F.concat(fixed, diagrams, F.array_union(found, drawn))


def bundle_index(table: DataFrame) -> DataFrame:
    return spread(table, files(), "page_id")
