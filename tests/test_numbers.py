"""Counts and numbers of blocks, without events; matching of tags; single attributes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.functions.text import decode_attribute, decode_text
from foliant.operators import assets, outline, parse, render
from foliant.operators.predicates import BIT, selection
from foliant.plans.convert import Conversion

PAGE = (
    '<body><header><h1>A</h1></header><div><p>one</p><div class="callout note"><b>x</b></div></div><table><tr><td>1</td></tr></table>'
    '<div class="mermaid-wrapper"><pre class="mermaid">graph</pre></div><pre class="mermaid"> </pre><div class="timeline"><div><time>2020-01-01</time></div></div></body>'
)


def _pages(spark):
    rows = [(1, PAGE), (2, "<p>a<b>c</p></i></div><ul><li>x<li>y</ul>" + PAGE), (3, ""), (4, None)]
    return spark.createDataFrame(rows, "page_id long, html string")


def test_numbers_agree_with_rendered_pages(spark):
    columns = ["page_id", "manifest", "candidates", "plan", "png_names", "loads_diagrams"]
    conversion = Conversion(_pages(spark))
    assert conversion.numbers.select(columns).orderBy("page_id").collect() == conversion.table.select(columns).orderBy("page_id").collect()
    assert assets.page_stats(conversion.numbers).orderBy("page_id").collect() == assets.page_stats(conversion.table).orderBy("page_id").collect()
    assert conversion.numbers.filter("page_id = 2").first().manifest.count("filename") > 1


def test_numbers_ask_for_no_events(spark):
    conversion = Conversion(_pages(spark))
    for df in (assets.manifest(conversion.numbers), assets.page_stats(conversion.numbers), assets.bundle_index(conversion.numbers)):
        plan = df._jdf.queryExecution().toString()
        assert "b_asset" in plan and "ev_tok" not in plan and "b_at" not in plan


def test_tags_match_in_arrays_as_one_by_one():
    rng = random.Random(7)
    for _ in range(200):
        pages = []
        for _ in range(rng.choice([0, 1, 5])):
            nests, tokens, stack = rng.random() < 0.6, [], []
            for _ in range(rng.choice([0, 2, 30])):
                name, kind = rng.randrange(3), rng.choice(["opens", "closes", "text"])
                if kind == "closes" and nests:
                    if not stack:
                        continue
                    name = stack.pop()
                elif kind == "opens":
                    stack.append(name)
                tokens.append((BIT[kind], name))
            pages.append(tokens)
        flat = [t for p in pages for t in p]
        bits, names = np.array([b for b, _ in flat], np.int64), np.array([n for _, n in flat], np.int64)
        begin = np.append(0, np.cumsum([len(p) for p in pages])).astype(np.int64)
        _, _, closer, turn, closes = outline._match(bits, names, begin)
        ours = np.full(len(bits), -1), np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)
        for lo, hi in zip(begin, begin[1:]):
            marks = lo + np.flatnonzero(bits[lo:hi] & (BIT["opens"] | BIT["closes"]))
            outline._match_one(marks, (bits[marks] == BIT["opens"]).tolist(), names[marks].tolist(), int(hi), *ours)
        assert [x.tolist() for x in (closer, turn, closes)] == [x.tolist() for x in ours]


def test_single_attributes(spark):
    tags = ['<a href="x">', "<a href='x'>", '<a HREF="x">', '<a href="x"/>', '<a href="" />', '<a href="x>y">', '<a href="a&amp;b&copy">', '<a\nhref="x" >', '<a href="x"b>']
    found = spark.createDataFrame([(tags,)], "t array<string>").select(F.explode(parse._parsed(F.col("t"))).alias("t")).select("t.attrs").collect()
    wanted = ["x", "x", "x", "x", "", "x>y", "a&b©", "x", "x"]
    assert [r.attrs["href"] for r in found] == wanted
    assert [len(r.attrs) for r in found] == [1] * 8 + [2]


def test_only_arrays_that_rules_read_are_asked_for(spark):
    conversion = Conversion(_pages(spark))
    plan = lambda df: df._jdf.queryExecution().toString()
    texts = conversion.entries("paragraph", f"array({render.plain(render.TOP)})")
    assert [r.item for r in texts.filter("page_id = 1").collect()] == ["one"]
    assert "ev_flags" in plan(texts) and not any(n in plan(texts) for n in ("ev_stop", "ev_date", "ev_parent", "b_pre", "titled", "classes"))
    assert "ev_date" in plan(conversion.blocks("timeline")) and "ev_date" not in plan(conversion.blocks("visual_component"))
    assert render.arrays_of("get(ix.ev_to, b.pre)") == ["ev_to", "b_at", *outline.NUMBERS, "b_pre"]


def test_attributes_as_maps_answer_as_columns_do():
    chosen = selection({"x": '[class*="a"][role="b"]', "y": "[hidden]"})
    rng, held = random.Random(3), []
    for _ in range(300):
        names = rng.sample(["class", "style", "role", "hidden", "href"], rng.randrange(4))
        held.append(rng.choice([None, {n: rng.choice(["a", "b", "a timeline", ""]) for n in names}]))
    tags, kinds, strings = [pa.array([rng.choice(v) for _ in held]) for v in (["p", "div", "", "pre"], [1, 1, 5], [0])]
    kinds, strings = kinds.to_numpy(), strings.to_numpy()
    maps = pa.array([None if h is None else list(h.items()) for h in held], pa.map_(pa.string(), pa.string()))
    columns = [pa.array([(h or {}).get(n) for h in held], pa.string()) for n in chosen.attributes]
    for lo, n in ((0, 300), (7, 100), (5, 0)):
        found = [outline._answers(kinds[lo : lo + n], strings[lo : lo + n], tags.slice(lo, n), [c.slice(lo, n) for c in form], chosen)[0].tolist() for form in ([maps], columns)]
        assert found[0] == found[1]
        wanted = [chosen.answers(t, {a: (h or {}).get(a) for a in chosen.attributes}) if k == 1 and t else 0 for t, h, k in zip(tags.to_pylist()[lo : lo + n], held[lo : lo + n], kinds[lo : lo + n])]
        assert [b & ~BIT["opens"] & ~BIT["text"] for b in found[0]] == wanted


def test_ampersands_are_decoded_in_one_go_as_in_pieces(spark):
    texts = ["a&amp;b", "&amp;amp;", "&amp", "&amp;&lt;", "&AMP;x", "a&b", "&amp;&amp; &", "x", "&amp;lt;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(decode_text(F.col("t")).alias("a"), decode_attribute(F.col("t")).alias("b"))
    assert [r.a for r in df.collect()] == ["a&b", "&amp;", "&", "&<", "&x", "a&b", "&& &", "x", "&lt;"]
    assert [r.b for r in df.collect()] == ["a&b", "&amp;", "&", "&<", "&x", "a&b", "&& &", "x", "&lt;"]
