"""The conversion as a plan: pages in, Markdown and side tables out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliant.operators import assets, bodies, outline, parse, quality, render
from foliant.operators.predicates import SELECTORS


@dataclass(frozen=True)
class Conversion:
    """Lazy tables of one corpus. Nothing runs until one of them is used, and then only what that one needs.

    Every table asked for comes from one scan of the pages and one Python stage; blocks of single kinds are rendered by SQL rules. A page stays one row up to the table.
    """

    pages: DataFrame
    #: How the images of a type are found on a page.
    selectors: Mapping[str, str] = field(default_factory=lambda: dict(SELECTORS))

    @cached_property
    def outlined(self) -> DataFrame:
        return parse.outlines(self.pages, dict(self.selectors))

    @property
    def nodes(self) -> DataFrame:
        return parse.nodes_of(self.outlined)

    def rows(self, rules: str) -> DataFrame:
        """page_id, tokens, ix and bs: what blocks are rendered from. Only the arrays that the rules read are asked for."""
        arrays = render.arrays_of(rules)
        return render.block_rows(parse.outlines(self.pages, dict(self.selectors), arrays), arrays=arrays)

    def blocks(self, *kinds: str) -> DataFrame:
        if not kinds:
            return render.blocks(bodies.rendered(self._converted(ix=bodies.RENDERED)))
        return render.blocks(render.rendered(self.rows(render.with_bodies(*kinds)), *kinds))

    def entries(self, kind: str, listed: str) -> DataFrame:
        return render.entries(self.rows(render.listing(kind, listed)), kind, listed)

    def _converted(self, **arrays: list[str]) -> DataFrame:
        """page_id, html and under each name what a Python stage gives that works with these arrays."""
        return self.pages.select("page_id", "html", *[bodies.converted("html", found, dict(self.selectors)).alias(name) for name, found in arrays.items()])

    def _numbered(self, found: DataFrame, *carried: str) -> DataFrame:
        """One row per page with ``ix``: page_id, html, bs, candidates, loads_diagrams and the columns carried along."""
        loads = F.when(F.col("html").isNotNull(), F.col("ix.loads_diagrams"))
        blocks = F.expr(render.found_blocks(outline.NUMBERS))
        return found.select("page_id", "html", *carried, assets.candidates(list(self.selectors)).alias("candidates"), loads.alias("loads_diagrams"), blocks.alias("bs"))

    @cached_property
    def numbers(self) -> DataFrame:
        """One row per page, for what needs no text of blocks: page_id, html, bs, manifest, candidates, plan, png_names, loads_diagrams."""
        found = self._numbered(self._converted(ix=[*outline.NUMBERS, *outline.CANDIDATES]))
        return found.select("*", assets.manifest_json().alias("manifest"), assets.png_names().alias("png_names"), assets.plan().alias("plan"))

    def _shown(self, found: DataFrame, texts: str) -> DataFrame:
        carried = ["html", "candidates", "loads_diagrams", "bs"]
        shown = bodies.rendered(self._numbered(found, texts), *carried, ix=texts)
        whole = shown.select("*", render.joined().alias("md"), assets.manifest_json("blocks").alias("manifest"), assets.png_names().alias("png_names"))
        return whole.select("*", assets.plan().alias("plan"))

    @cached_property
    def table(self) -> DataFrame:
        """One row per page: page_id, html, bs, blocks, md, manifest, candidates, plan, png_names, loads_diagrams. Blocks, md and manifest come from one
        Python stage and all else from another, which renders nothing; of these only what is used runs."""
        return self._shown(self._converted(ix=[*outline.NUMBERS, *outline.CANDIDATES], texts=bodies.RENDERED), "texts")

    @cached_property
    def whole(self) -> DataFrame:
        """The same from one Python stage, for those who use all of it."""
        return self._shown(self._converted(ix=[*bodies.RENDERED, *outline.CANDIDATES]), "ix")

    @property
    def markdown(self) -> DataFrame:
        return self.table.select("page_id", "md")


def export(spark: SparkSession, pages: DataFrame, out: str) -> dict[str, int]:
    """Convert a corpus and write all its tables below ``out``, a shared folder. Returns the corpus totals, observed while writing.

    The pages are parsed and rendered once, into ``pages``, one row per page; that table cuts the lineage, and all others
    are read off it. Written files survive the loss of executors, and a re-run replaces them whole.
    """
    converted = Conversion(pages).whole.drop("html")
    totals = Observation("totals")
    counts = {name: F.sum(count) for name, count in assets.stats().items()}
    observed = converted.observe(totals, F.count(F.lit(1)).alias("pages"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()])
    observed.write.mode("overwrite").parquet(f"{out}/pages")
    table = spark.read.schema(converted.schema).parquet(f"{out}/pages")
    table.select("page_id", "md").write.mode("overwrite").parquet(f"{out}/markdown")
    assets.manifest(table).write.mode("overwrite").json(f"{out}/manifest")
    table.select("page_id", "manifest").write.mode("overwrite").parquet(f"{out}/manifest_arrays")
    assets.mermaid_sources(table).write.mode("overwrite").parquet(f"{out}/mermaid_sources")
    assets.page_stats(table).write.mode("overwrite").json(f"{out}/page_stats")
    assets.capture_plan(table).write.mode("overwrite").parquet(f"{out}/capture_plan")
    assets.capture_summary(table).write.mode("overwrite").json(f"{out}/capture_summary")
    assets.bundle_index(table).write.mode("overwrite").parquet(f"{out}/bundle")
    refs = assets.image_refs(table, assets.bundle_index(table))
    refs.write.mode("overwrite").parquet(f"{out}/image_refs")
    assets.missing_image_count(table, refs).write.mode("overwrite").json(f"{out}/missing_images")
    quality.output_checks(table).write.mode("overwrite").parquet(f"{out}/checks")
    return totals.get
