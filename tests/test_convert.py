"""Literal expectations for single rules and their order, converted in one job."""

import json
from array import array

import pytest
from foliant.functions.text import decode_text
from foliant.operators.quality import lost_components, output_checks, source_census
from pyspark.sql import functions as F

from foliant.operators import assets
from foliant.operators.predicates import compile_selector
from foliant.plans.convert import Conversion, export
from foliant.sources.folders import PageFolders, list_files, write_folders
from foliant.sources.pages import read_html_files, read_pages

IMAGE = "![{}](images/{}_01.png)"
CARDS = "<div><div><p>v</p><p>a  b</p></div><div><p>w</p><p>c</p></div></div>"

CASES = {
    # scope
    "no body": ("<p>a</p><article><p>lost</p></article>", "a"),
    "html without body": ("<html><p>lost</p></html>", ""),
    "first body only": ("<p>out</p><body><p>in</p></body>", "in"),
    "loose text and unknown tags are lost": ("<body>x<main><p>y</p></main><blockquote>z</blockquote><hr><p>k</p></body>", "k"),
    "nav without links": ("<body><nav><p>x</p></nav><p>k</p></body>", "k"),
    # inline text
    "marks": ("<p><strong>a</strong> <i>b</i> <a href='u'>c</a> <a>d</a><br>e</p>", "**a** *b* [c](u) [d]()\ne"),
    "no marks in code": ("<p><code>a <b>b</b></code></p>", "`a b`"),
    "badge": ("<p><span class='badge x'> <b>a</b> </span><span class='badges'>b</span></p>", "[a]b"),
    "code in badge": ("<p><span class='badge'><code>a</code></span></p>", "[a]"),
    "badge in code": ("<p><code><span class='badge'> a </span></code></p>", "` a `"),
    "root inside a badge": (
        "<div style='border:0'><span class='badge'><p><b>x</b><code>y<b>z</b></code></p></span><table><tr><td>t</td></tr></table></div>",
        IMAGE.format("Visual component", "visual_component") + "\n\n| t |\n| --- |\n\n**x**`yz`",
    ),
    "comments leak": ("<p>a<!--b--></p><ul><li>c<!-- d --></li></ul>", "ab\n\n- c d"),
    "blank text shrinks": ("<p>a<b> \n\t </b>c</p>", "a**\n**c"),
    "hard space is space": ("<p>  a </p>", "a"),
    "image has no text": ("<p>a<img alt='x'>b</p>", "ab"),
    # blocks
    "headings": ("<h1>a</h1><h6></h6>", "# a\n\n###### "),
    "empty paragraph": ("<p> </p><p>a</p>", "a"),
    "nested lists flatten": ("<ol start=4><li>a<ul><li>b</li></ul></li><li>c</li></ol>", "1. ab\n2. c"),
    "contents": ("<nav><a href=x> a <b>b</b></a><p><a>c</a></p></nav>", "## Table of Contents\n\n1. a b\n2. c"),
    "footer": ("<footer>a <b>b</b></footer>", "---\n\n*a **b***"),
    "code keeps space": ("<pre class='lang-b'><code class='x language-a+'> a\n\n\n b </code></pre>", "```a+\n a\n\n b \n```"),
    "code language of pre": ("<pre class='lang-b'><code class='x'>a</code></pre>", "```b\na\n```"),
    "bare pre": ("<pre>a<b>b</b></pre>", "```\nab\n```"),
    "table without rows": ("<table></table><p>a</p>", "a"),
    "ragged table": ("<table><tr></tr><tr><td>a|b</td></tr><tr><td>c \n d</td><th><b>e</b></th></tr></table>",
                     "| a\\|b |  |\n| --- | --- |\n| c d | **e** |"),
    "nested table": ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", "| ab | b |\n| --- | --- |\n| b |  |"),
    # callouts
    "callout": ("<div class='tip warn'>a\n\n <b>b</b></div>", "> 💡 a\n> **b**"),
    "callout default sign": ("<div class='alert'>a</div>", "> 📌 a"),
    "warn alone is no callout": ("<div class='warn'><p>a</p></div>", "a"),
    "empty callout": ("<div class='note'> </div><p>a</p>", "a"),
    # diagrams
    "diagram": ("<pre class='x-mermaid'> a\nb </pre>", "```mermaid\na\nb\n```\n\n*Fallback image: ![Diagram](images/mermaid_01.png)*"),
    "wrapper swallows": ("<div><p>lost</p><pre>first</pre><pre class='mermaid'>b</pre></div>",
                         "```mermaid\nfirst\n```\n\n*Fallback image: ![Diagram](images/mermaid_01.png)*"),
    "diagram without source": ("<div class='mermaid'>x</div><pre class='mermaid'> </pre><p>a</p>", "a"),
    # components and their order
    "progress": ("<div><span style='background:x;width:1'>a</span><div style='background-color:x;flex:2'> b </div><span>c</span></div>",
                 IMAGE.format("Progress bar", "progress_bar") + "\n\n`a | b | c`"),
    "stat cards": (CARDS, IMAGE.format("Stat cards", "stat_cards") + "\n\n| v | w |\n| --- | --- |\n| a b | c |"),
    "cards before timeline": (CARDS.replace("<div>", "<div class='timeline'>", 1),
                              IMAGE.format("Stat cards", "stat_cards") + "\n\n| v | w |\n| --- | --- |\n| a b | c |"),
    "timeline by dates": ("<div><div><time>2024</time></div><div><span>a</span><p>5 may</p><time>May 5</time></div><div>x</div></div>",
                          IMAGE.format("Timeline", "timeline") + "\n\n- ⚪ **2024** — \n\n- ⚪ **May 5** — a\n  5 may\n\n- ⚪ **** — \n"),
    "timeline skips parts equal to the date": (
        "<div class='timeline'><div class='fix success'><span>1999</span><span>1999</span><p>a</p><p>b<br>c</p><p>d</p></div></div>",
        IMAGE.format("Timeline", "timeline") + "\n\n- 🟢 **1999** — a\n  b\n  c\n"),
    "dates need a string of their own": ("<div><div><span>2024<b>x</b></span></div><div><p>2024</p></div><div>2025 <i>a</i></div></div>", "2024"),
    "hero": ("<header><p>l</p><div><span>1</span><div>2</div></div><h1>t <b>u</b></h1><div><span>3</span></div></header>",
             IMAGE.format("Hero banner", "hero") + "\n\n# t u\n\n*l*\n\n| 1 |\n| --- |\n| 2 |"),
    "hero section": ("<section style='background: x'><h2>lost</h2><h1>t</h1><ul><li>lost</li></ul></section>",
                     IMAGE.format("Hero banner", "hero") + "\n\n# t"),
    "empty hero": ("<header></header>", IMAGE.format("Hero banner", "hero") + "\n"),
    "comparison": (
        "<div style='grid-template-columns:1fr'><div><div style='text-transform:x'>T</div><p>a</p><ul><li>lost</li></ul>"
        "<pre><code class='language-x'>c</code></pre><p> </p><b><div class='info'>n</div></b></div></div>",
        IMAGE.format("Comparison", "comparison") + "\n\n**T**\n\na\n\n```\nc\n```\n\n> ℹ️ n"),
    "styled": ("<div style='border:1'><table><tr><td><p>a</p></td></tr></table><h2>lost</h2><p>b</p></div>",
               IMAGE.format("Visual component", "visual_component") + "\n\n| a |\n| --- |\n\na\n\nb"),
    "styled without table is a container": ("<div style='border:1'><p>a</p></div>", "a"),
    "upper case and stray ends": ("<DIV></b><P>a</DIV></p>", "a"),
}


@pytest.fixture(scope="module")
def converted(spark):
    rows = [(name, html) for name, (html, _) in CASES.items()]
    conversion = Conversion(spark.createDataFrame(rows, "page_id string, html string"))
    markdown = {r.page_id: r.md for r in conversion.markdown.collect()}
    stats = {r.page_id: r for r in assets.page_stats(conversion.table).collect()}
    return markdown, stats


@pytest.mark.parametrize("name", CASES)
def test_markdown(converted, name):
    assert converted[0][name] == CASES[name][1]


def test_counts(converted):
    counts = lambda name: tuple(converted[1][name])[1:]  # noqa: E731  diagrams, images, tables, callouts
    assert counts("html without body") == (0, 0, 0, 0)
    assert counts("table without rows") == (0, 0, 1, 0)
    assert counts("empty callout") == (0, 0, 0, 1)
    assert counts("comparison") == (0, 1, 0, 1)
    assert counts("styled") == (0, 1, 0, 0)
    assert counts("diagram") == (1, 1, 0, 0)
    assert counts("diagram without source") == (0, 0, 0, 0)


def test_hundredth_asset_and_positional_capture(spark):
    html = "<body>" + "<header class='a-hero'></header>" * 101 + "<div class='hero-stats'><p>x</p></div>" + CARDS + "</body>"
    c = Conversion(spark.createDataFrame([(1, html)], "page_id long, html string"))
    names = [r.filename for r in assets.manifest(c.table).orderBy("index").collect()]
    assert names[0] == "hero_01.png" and names[99] == "hero_100.png" and names[101] == "stat_cards_102.png"
    plan = {(r.type, r.ordinal): r for r in assets.capture_plan(c.table).collect()}
    # "hero-stats" holds "stats", so it takes the place of the first row of stat cards.
    assert plan["stat_cards", 1].status == "found"
    marked = c.nodes.filter(F.array_contains("classes", "hero-stats")).first()
    assert plan["stat_cards", 1].node_pos == marked.pos


def test_export_writes_all_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<body><p>a</p><pre class='mermaid'>g</pre></body>", encoding="utf-8")
    (tmp_path / "in" / "b.html").write_text("<html></html>", encoding="utf-8")
    totals = export(spark, read_html_files(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    stats = spark.read.json(str(tmp_path / "out/page_stats"))
    names = [c for c in stats.columns if c.endswith("_count")]
    assert totals == {"pages": 2, **stats.groupBy().sum(*names).toDF(*names).first().asDict()} and totals["mermaid_count"] == 1
    markdown = {r.page_id.rsplit("/", 1)[1]: r.md for r in spark.read.parquet(str(tmp_path / "out/markdown")).collect()}
    assert markdown["b.html"] == "" and markdown["a.html"].startswith("a\n\n```mermaid\ng\n```")
    assert spark.read.json(str(tmp_path / "out/manifest")).first().filename == "mermaid_01.png"
    assert spark.read.parquet(str(tmp_path / "out/mermaid_sources")).first().source == "g"
    assert spark.read.json(str(tmp_path / "out/page_stats")).count() == 2
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert {r.page_id.rsplit("/", 1)[1]: r.manifest for r in read("manifest_arrays").collect()}["b.html"] == "[]"
    assert sorted(r.path for r in read("bundle").collect() if r.page_id.endswith("a.html")) == [
        "images/full_page.png", "images/mermaid_01.png", "mermaid_sources/mermaid_01.mmd", "output.md", "screenshot_manifest.json"]
    assert read("capture_plan").first().status == "found" and not read("image_refs").first().is_missing
    assert {r.success for r in spark.read.json(str(tmp_path / "out/capture_summary")).collect()} == {0, 1}
    assert {r.missing_count for r in spark.read.json(str(tmp_path / "out/missing_images")).collect()} == {0}
    assert read("checks").count() == 2


def test_missing_source_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_pages(spark, str(tmp_path / "none.parquet"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_and_one_python_stage_for_every_table(spark):
    """A page stays one row: no window, sort, join or exchange on the way to any of its tables."""
    table = Conversion(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")).table
    made = [table.select("page_id", "md"), *(f(table) for f in (
        assets.manifest, assets.mermaid_sources, assets.page_stats, assets.capture_candidates, assets.capture_plan, assets.capture_summary,
        assets.mermaid_png_names, assets.mermaid_name_gaps, assets.bundle_index, output_checks, lost_components))]
    for df in made:
        plan = plan_of(df)
        assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan ") == 1
        assert not any(x in plan for x in ("Window", "Sort", "Exchange", "Join"))
    # Counting renders nothing: no events are made for it.
    assert "quiet_stop" not in plan_of(assets.page_stats(table)) and "quiet_stop" in plan_of(table.select("md"))


def test_selectors_are_data(spark):
    """A new selector needs no code. Elements are named by their tag, or the text they hold."""
    html = (
        "<main><div class='a b' id='x' style='color: red'><p class='b'>1</p><ul><li><p>2</p></li></ul></div><P class='c-b'>3</P></main>"
        "<script class='b'>4</script>"
    )
    wanted = {
        "p": "1 2 3", ".b": "div 1 4", "div p": "1 2", "div li p, script": "2 4", "p.b": "1", "*:not(p):not(main *)": "main 4", "aside": "",
        '[class*="b"]': "div 1 3 4", '[id="x"]': "div", "[class]": "div 1 3 4", "div:has(li)": "div", "p:not(.b, li p)": "3", "main:has(p.c-b) .b": "div 1",
        '[style*="red"] li': "li",
    }
    c = Conversion(spark.createDataFrame([(1, html)], "page_id long, html string"), {text: text for text in wanted})
    nodes = c.nodes.collect()
    inner = {n.parent: n.text for n in nodes if n.kind == "text"}
    name = {n.pos: inner.get(n.pos, n.text if n.kind == "raw" else n.tag) for n in nodes}
    found = {text: [] for text in wanted}
    for r in assets.capture_candidates(c.table).orderBy("type", "ordinal").collect():
        found[r.type].append(name[r.node_pos])
    assert {text: " ".join(names) for text, names in found.items()} == wanted


@pytest.mark.parametrize("text", ["p:hover", "p > a", "", "a,", ":not(a", "a)", "[x^=\"y\"]"])
def test_other_selectors_are_refused(text):
    with pytest.raises(ValueError):
        compile_selector(text)


def test_long_unknown_reference_keeps_every_character(spark):
    name = "a" * 1_100_000
    got = spark.createDataFrame([(f"&{name};",)], "s string").select(F.length(decode_text(F.col("s"))).alias("n")).first()["n"]
    assert got == 1 + len(name)


def test_manifest_must_be_an_array_and_size_is_in_bytes(spark):
    rows = [(1, "x", '{"a":1}'), (2, "x", ' [{"type":"hero"}]'), (3, "x", "[]")]
    found = output_checks(spark.createDataFrame(rows, "page_id long, md string, manifest string")).collect()
    assert {r["page_id"]: r["manifest_is_array"] for r in found} == {1: False, 2: True, 3: True}
    html = spark.createDataFrame([(1, "é" * 300)], "page_id long, html string")
    assert source_census(html).first()["is_long"]


def test_paths_are_resolved_and_pages_without_references_count_zero(spark):
    paths = ["images/../images/x.png", "./images//./x.png", "../x.png", "/a/../../b", "a/..", ""]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select(assets.resolved(F.col("p"))).collect()
    assert [r[0] for r in found] == ["images/x.png", "images/x.png", "../x.png", "/b", "", ""]
    markdown = spark.createDataFrame([(1, "![a](images/../images/x.png) ![b](y.png)"), (2, "text")], "page_id long, md string")
    refs = assets.image_refs(markdown, spark.createDataFrame([(1, "images/x.png")], "page_id long, path string"))
    assert sorted(map(tuple, assets.missing_image_count(markdown, refs).collect())) == [(1, 1), (2, 0)]
    plan = spark.createDataFrame([(1, [("found",)]), (2, [])], "page_id long, plan array<struct<status: string>>")
    assert sorted(map(tuple, assets.capture_summary(plan).collect())) == [(1, 1, 0), (2, 0, 0)]


def test_any_unit_of_a_callout_sign_counts(spark):
    texts = ["> 💡", "✅", "⚠", "a📌b", "\uFE0F", "\U00010CA1", "🤖", "> a", "", "é" * 400_000 + "x", "é" * 400_000 + "🚨"]
    rows = [(i, t, "[]") for i, t in enumerate(texts)]
    found = output_checks(spark.createDataFrame(rows, "page_id long, md string, manifest string")).collect()
    units = lambda t: set(array("H", t.encode("utf-16-le")))
    signs = units("💡✅🚨⚠️")
    assert {r["page_id"]: r["has_callout_sign"] for r in found} == {i: bool(signs & units(t)) for i, t in enumerate(texts)}


def test_page_folders(spark, tmp_path):
    pages = [(1, "<p>é</p><pre class='mermaid'>g</pre><pre class='mermaid'>h</pre>"), (2, ""), (3, "<p>![x](images/x.png) ![y](./y.png)</p>")]
    table = Conversion(spark.createDataFrame([(f"u/{i}" if i == 2 else str(i), h) for i, h in pages], "page_id string, html string")).table
    out = tmp_path / "out"
    write_folders(table, out.as_uri())
    write_folders(table, out.as_uri())  # again: every file is there once
    odd = next(f.name for f in out.iterdir() if f.name.startswith("u_2_"))
    names = sorted(str(f.relative_to(out)) for f in out.rglob("*") if f.is_file() and not f.name.endswith(".crc"))
    assert names == sorted(["_SUCCESS", *(f"{d}/{n}" for d in ("1", odd, "3") for n in ("output.md", "screenshot_manifest.json")),
                            "1/mermaid_sources/mermaid_01.mmd", "1/mermaid_sources/mermaid_02.mmd"])
    assert (out / "1/output.md").read_text(encoding="utf-8").startswith("é\n\n```mermaid\ng") and (out / "1/mermaid_sources/mermaid_02.mmd").read_text() == "h"
    assert [e["filename"] for e in json.loads((out / "1/screenshot_manifest.json").read_text())] == ["mermaid_01.png", "mermaid_02.png"]
    assert json.loads((out / "_SUCCESS").read_text()) == {"pages": 3, "files": 8}
    # References are held against the files that lie there.
    (out / "3/images").mkdir()
    (out / "3/images/x.png").write_bytes(b"x")
    files = list_files(spark, out.as_uri()).withColumnRenamed("folder", "page_id")
    assert sorted(map(tuple, files.where("page_id = '3'").collect())) == [("3", "images/x.png"), ("3", "output.md"), ("3", "screenshot_manifest.json")]
    refs = assets.image_refs(table, files)
    assert {(r.ref, r.is_missing) for r in refs.where("page_id = '3'").collect()} == {("images/x.png", False), ("./y.png", True)}
    assert "content" not in plan_of(files)


def test_a_task_that_fails_half_way_and_runs_again_leaves_each_file_once(tmp_path):
    rows = [{"folder": str(i), "md": f"text {i}", "manifest": "[]", "sources": []} for i in range(3)]

    def failing():
        yield rows[0]
        yield rows[1]
        raise OSError("lost")

    writer = PageFolders({"path": tmp_path.as_uri()}).writer(None, False)
    with pytest.raises(OSError):
        writer.write(failing())
    writer.commit([writer.write(iter(rows)), None])
    assert sorted(f.name for f in tmp_path.iterdir()) == ["0", "1", "2", "_SUCCESS"]
    assert all(len(list((tmp_path / str(i)).iterdir())) == 2 for i in range(3))
    writer.abort([])
