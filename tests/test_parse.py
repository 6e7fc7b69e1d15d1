"""Node extraction against the standard library's HTML tokenizer."""

import time
from html.parser import HTMLParser

import pyarrow as pa

from foliant.operators import outline
from foliant.operators.parse import VOID_TAGS, nodes, tags, tokens
from foliant.operators.predicates import selection

PAGES = [
    "<html><body><p>a<b>b</p>c</b></p></x>d</body></html>",
    "<DIV Class='a  b' class=\"c\"><BR/>x<br>y<img src=a/></div><div/><span/>z",
    "<p>1<p>2<ul><li>3<li>4</ul>5",
    "<script>var t = '</p><b>';</script><style>p > b {}</style><p title='a>b'>t</p>",
    "<!DOCTYPE html><!-- c > d --><p>a < b <c>d</c></p><!weird><?pi x?>",
    "<table><tr><td>1<table><tr><td>2</table><td>3</table>",
    "<a href=x/>link</a><input disabled/><p id=\"u\" hidden>q",
    "text only",
    "<p>a<!-- b <i>c</i> <!-- d <b>e",
    "<p>a<!-- b --> <!-- c <i>d</i> <![CDATA[ e <b>f</b>",
    "<p>a <b c <d e",
    "<p><![CDATA[x > y &amp; <b>]]></p><![cdata[ z <!-- w --> <i>v</i>",
    "",
]


class _Reader(HTMLParser):
    """Elements as (tag, parent tags), by the same stack rule."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.stack, self.found, self.text = [], [], []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, tuple(self.stack)))
        if tag not in VOID_TAGS:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.found.append((tag, tuple(self.stack)))

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        self.text.append(data)

    def unknown_decl(self, data):
        self.text.append(data[len("CDATA[") :])


def _paths(rows):
    """Tag and ancestor tags of every element, from parent links."""
    by_pos = {r.pos: r for r in rows}
    out = []
    for r in sorted(rows, key=lambda r: r.pos):
        if r.kind not in ("element", "raw"):
            continue
        path, up = [], r.parent
        while up:
            path.append(by_pos[up].tag)
            up = by_pos[up].parent
        out.append((r.tag, tuple(reversed(path))))
    return out


def test_tree_matches_tokenizer(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    found = nodes(pages).collect()
    for i, html in enumerate(PAGES):
        reader = _Reader()
        reader.feed(html)
        reader.close()
        rows = [r for r in found if r.page_id == i]
        assert _paths(rows) == reader.found, html
        texts = [r.text for r in sorted(rows, key=lambda r: r.pos) if r.kind in ("text", "raw")]
        assert "".join(texts) == "".join(reader.text), html


def test_positions_nest(spark):
    html = "<div><p>a</p><p>b<b>c</div><p>d"
    rows = nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    for r in rows:
        inside = [c for c in rows if r.pos < c.pos < r.end_pos]
        assert all(c.end_pos < r.end_pos for c in inside)
        assert {c.pos for c in rows if c.parent == r.pos} <= {c.pos for c in inside}
    ends = [r.end_pos for r in rows if r.end_pos > r.pos] + [r.pos for r in rows]
    assert sorted(ends) == list(range(len(ends)))


def test_attributes_and_references(spark):
    html = (
        "<p class='x  Y' id=a ID=\"b&quot;\" style='c: &amp;'>&lt;&#65;&#x42;&nosuch; &copy &#150;&#128512;&#xffffffff;</p>"
        "<a href='?a=1&reg=2&amp;c=&eacute;&unknown;'>x</a>"
    )
    rows = {r.tag or r.kind: r for r in nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert rows["p"].attrs == {"class": "x  Y", "id": 'b"', "style": "c: &"}
    assert rows["p"].classes == ["x", "Y"]
    assert rows["a"].attrs["href"] == "?a=1®=2&c=é&unknown;"
    text = next(r.text for r in nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect() if r.kind == "text")
    assert text == "<AB&nosuch © –😀�"


def test_deep_and_long_pages(spark):
    pages = [(1, "<p>ab" * 30_000), (2, "<p>ab</p>" * 30_000), (3, "<p>" + "a < b " * 50_000)]
    found = nodes(spark.createDataFrame(pages, "page_id long, html string")).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in found} == {1: 60_001, 2: 60_001, 3: 3}


def test_pages_without_ends_take_linear_time(spark):
    pages = spark.createDataFrame([(1, "<!-- b " * 150_000), (2, "<a b " * 200_000), (3, "<p>" + "<!-- b > " * 100_000)], "page_id long, html string")
    nodes(pages.limit(1)).count()
    began = time.monotonic()
    lengths = {r.page_id: r.n for r in nodes(pages).where("kind = 'text'").selectExpr("page_id", "length(text) n").groupBy("page_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert time.monotonic() - began < 15
    assert lengths == {1: 1_050_000, 2: 1_000_000, 3: 900_000}


def test_sections_are_text_as_they_stand(spark):
    rows = nodes(spark.createDataFrame([(1, "<p><![CDATA[x > y &amp; <b>]]></p>")], "page_id long, html string")).collect()
    assert [r.text for r in rows if r.kind == "text"] == ["x > y &amp; <b>"]
    assert [r.tag for r in rows if r.kind == "element"] == ["p"]


def test_distinct_tokens_are_parsed_once(spark):
    html = "<p>a</p>" * 50 + "<p>b</p>"
    row = tokens(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert len(row.cut) == 153
    assert [(t.kind, t.tag, t.text) for t in row.tokens] == [("open", "p", None), ("text", "", "a"), ("close", "p", None), ("text", "", "b")]


def test_outline_gives_small_parts(monkeypatch):
    """What a worker holds does not grow with the pages that it is sent at a time."""
    monkeypatch.setattr(outline, "SLICE", 6)
    one = lambda *values: pa.array([list(values)] * 5)
    open_, close, text = (outline.KIND_CODES.index(k) for k in ("open", "close", "text"))
    batch = one("<p>", "a", "</p>"), one(open_, text, close), one(0, 2, 0), one("p", "", "p"), *[pa.array([[None] * 3] * 5, pa.list_(pa.string()))] * 2
    parts = list(outline.outliner(selection({}), ["tok", "b_at"])(iter([batch])))
    assert [len(p) for p in parts] == [2, 2, 1]
    assert [row["tok"] for p in parts for row in p.to_pylist()] == [[None, 0, 1]] * 5
    assert {f.name for f in parts[0].type} == {"tok", "b_at", "body_pos", "body_end"}


def test_only_asked_tags_are_parsed(spark):
    pages = spark.createDataFrame([(1, '<a href="x">1</a><abbr>2</abbr><A HREF="y"/><!-- <a href="z"> --><a>'), (2, None)], "page_id long, html string")
    found = {r.page_id: r.tokens and [(t.kind, t.attrs and t.attrs["href"]) for t in r.tokens] for r in tags(pages, "a").collect()}
    assert found == {1: [("open", "x"), ("void", "y"), ("open", None)], 2: None}
