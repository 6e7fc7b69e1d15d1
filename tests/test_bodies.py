"""Whole pages in one Python stage, held against the rules for single tokens and single kinds of blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import assets, bodies, cut, outline, parse, quality, render
from foliant.plans.convert import Conversion
from foliant.sources import rendered

TAGS = "p div span b em code a pre table tr td th ul ol li section header nav footer h1 h3 time body main textarea rt".split()
HELD = [
    "", "", " class='badge x'", ' class="note tip"', " class=mermaid", ' class="timeline"', ' style="border: 1; background-color: x; width: 2"', ' style="grid-template-columns: 1"',
    ' style="text-transform: x"', ' href="u&amp;v&copy=1&notit;"', ' class="fix success"', ' class="language-x lang-y"', " hidden", ' A=1 a="2"', " title='a>b'", ' x="a\'b"',
]
TEXTS = ["a", " ", "\n", " \n\t ", "2024", "May", "x | y", "&lt;b&gt;", "&#65;&#x1F600;&#150;&#0;&nosuch; &copy &amp;", " é ", "Jań 1", "a < b", "\xa0", "  ", "😀", "٢٠٢٤", "ſep"]
ODD = ["<!-- c 2020 -->", "<!---->", "<!-->", "<script>var t = '</p>';</script>", "<script src='mermaid.js'/>", '<SCRIPT src="x/mermaid.js"></script >', "<![CDATA[ <b>z&amp;</b> ]]>", "<!doctype html>",
       "<?pi x?>", "<br/>", "<img alt=x>", "<a href=x/>", "<div/>", "</>", "</ p>", "<p", "<!--", "<![cdata[", "<style>p > b"]
PARTS = [
    "<div><div><p>v</p><p>a  b</p></div><div><p>w</p><p>c</p></div></div>",
    "<div><span style='background:x;width:1'>a</span><div style='background-color:x;flex:2'> b </div><span>c</span></div>",
    "<div class='timeline'><div class='fix'><span>1999</span><span>1999</span><p>a</p><p>b<br>c</p></div><div><time>2 <i>x</i></time><p>k</p></div></div>",
    "<div style='grid-template-columns:1fr'><div><div style='text-transform:x'>T</div><p>a</p><pre><code>c</code></pre><b><div class='info'>n</div></b></div></div>",
    "<div style='border:0'><span class='badge'><p><b>x</b><code>y<b>z</b></code></p></span><table><tr><td>t|</td></tr><tr><td>1</td><th>2</th></tr></table></div>",
    "<pre class='mermaid'>g</pre>", "<div class='tip warn'>a\n\n <b>b</b></div>", "<pre class='lang-b'><code class='x'>a</code></pre>",
]


def _page(rng: random.Random) -> str:
    out, stack = ["<body>"] * (rng.random() < 0.3), []
    for _ in range(rng.choice([0, 10, 40])):
        turn = rng.random()
        if turn < 0.4 and len(stack) < 8:
            stack.append(rng.choice(TAGS))
            out.append(f"<{stack[-1]}{rng.choice(HELD)}>")
        elif turn < 0.65:
            out.append(rng.choice(TEXTS))
        elif turn < 0.9 and stack:
            out.append(f"</{stack.pop() if rng.random() < 0.95 else rng.choice(TAGS)}>")
        else:
            out.append(rng.choice(PARTS) if rng.random() < 0.5 else rng.choice(ODD[:-4] if rng.random() < 0.95 else ODD))
    return "".join(out)


def test_bodies_and_numbers_are_those_of_the_sql_rules(spark):
    rng = random.Random(5)
    rows = [(i, _page(rng)) for i in range(400)] + [(400, None), (401, "".join(PARTS))]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    conversion = Conversion(pages)
    arrays = [*outline.EVENTS, *outline.BLOCKS]
    found = parse.outlines(pages, arrays=[*arrays, *outline.CANDIDATES])
    found = found.select("*", assets.candidates(list(conversion.selectors)).alias("candidates"), assets.loads_diagrams().alias("loads_diagrams"))
    wanted = render.rendered(render.block_rows(found, ["candidates", "loads_diagrams"], arrays), carried=["candidates", "loads_diagrams"])
    columns = ["page_id", "blocks", "candidates", "loads_diagrams"]
    wanted_rows = wanted.select(columns).orderBy("page_id").collect()
    assert conversion.table.select(columns).orderBy("page_id").collect() == wanted_rows
    assert conversion.whole.select(columns).orderBy("page_id").collect() == wanted_rows
    assert {b.kind for r in wanted_rows for b in r.blocks} >= {"stat_cards", "progress_bar", "timeline", "comparison", "visual_component", "mermaid", "callout", "code", "hero"}
    numbered = conversion.numbers.select("page_id", "candidates", "loads_diagrams", "manifest").orderBy("page_id")
    assert numbered.collect() == conversion.whole.select("page_id", "candidates", "loads_diagrams", "manifest").orderBy("page_id").collect()


def test_tokens_are_those_of_the_sql_rules(spark):
    rng = random.Random(6)
    pieces = [*TEXTS, *ODD, *(f"<{t}{a}>" for t in ("p", "a") for a in HELD), "<", ">", "=", '"', "'", "--", "-- >", "/>", "<a ", "]]>", "é"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.choice([0, 2, 5, 20])))) for i in range(600)]
    row = parse.tokens(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id").collect()
    data = [html.encode() for _, html in rows]
    for many in (1, 7, 600):
        for lo in range(0, len(data), many):
            held = b"".join(data[lo : lo + many])
            bounds = cut.cut(held, np.cumsum([0, *map(len, data[lo : lo + many])])).tolist()
            assert [held[a:b].decode() for a, b in zip(bounds, bounds[1:])] == [t for r in row[lo : lo + many] for t in r.cut]
    for r in row:
        assert [cut.parsed(t) for t in dict.fromkeys(r.cut)] == [tuple(t) for t in r.tokens]


def test_dates_are_those_of_the_sql_rule(spark):
    texts = [*TEXTS, "1 Maý", "‍May", "Ⓐmay", "mıay", "DEC.", "Jan_", "x 99 999 9999", "decé", "é dec é", "may⃣"]
    found = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("t", text.looks_dated(F.col("t")).alias("d")).collect()
    assert {r.t: cut.looks_dated(r.t) for r in found} == {r.t: r.d for r in found}


@pytest.mark.parametrize("table", [
    lambda c: c.blocks(), lambda c: quality.lost_components(c.table), lambda c: quality.output_checks(c.table), lambda c: c.markdown,
    lambda c: assets.capture_summary(c.numbers), lambda c: assets.page_stats(c.numbers),
], ids=["blocks", "lost_components", "output_checks", "report_markdown", "capture_summary", "page_stats"])
def test_whole_pages_go_to_python_as_they_are(spark, table):
    """No token or event leaves the stage that cuts a page, so none is copied, and no rule runs on it as nested SQL."""
    plan = table(Conversion(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan and "ev_to[" not in plan and ".ev_" not in plan


def test_slices_do_not_change_results(monkeypatch):
    rng = random.Random(7)
    html = [_page(rng) for _ in range(60)]
    convert = bodies.converter(parse.selection(parse.SELECTORS))
    arrays = " ".join([*bodies.RENDERED, *outline.CANDIDATES])
    given = lambda lo, hi: (pa.array(html).slice(lo, hi - lo), pa.array([arrays] * (hi - lo)))
    rows = lambda batches: [r for part in convert(iter(batches)) for r in part.to_pylist()]
    wanted = rows([given(0, 60)])
    monkeypatch.setattr(bodies, "SLICE", 300)
    assert len(list(convert(iter([given(0, 60)])))) > 5
    assert rows([given(0, 7), given(7, 7), given(7, 60)]) == wanted


def test_orders_are_dealt_into_parts_by_their_bytes(spark, tmp_path):
    """Before, Spark merged them into about one a core, and at the end cores waited for the last few."""
    rng = random.Random(8)
    rows = [(k, rng.randrange(10**6), "F", rng.choice("abc"), None) for k in rng.sample(range(10**9), 40_000)] + [(None, 1, "O", "x", None)] * 3
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = rendered.batches(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 5  # the session has 4 cores and shuffle partitions
    kept = found.select("page_id", F.size("os").alias("n")).collect()
    assert sum(r.n for r in kept) == len(rows) and len(kept) == len({None if k is None else k // 10 for k, *_ in rows})
    few = spark.createDataFrame(rows[:5], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp")
    few.coalesce(1).write.parquet(f"{tmp_path}/few/orders.parquet")
    assert rendered.batches(spark, f"{tmp_path}/few").rdd.getNumPartitions() == 1
