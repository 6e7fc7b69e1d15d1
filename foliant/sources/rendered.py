"""Report pages rendered from the order table, to convert back and compare with the orders themselves.

A page covers ten consecutive order keys. The key is unique, so a page has ten orders at most and
no customer, however busy, makes a page grow. Every order goes into a page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import escape_markup

ORDERS_PER_PAGE = 10
STATUSES = ["F", "O", "P"]


def _fill(template: str, **values: Column) -> Column:
    """Concatenate a template's text with the columns named in its {braces}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def _each(template: str) -> Column:
    """The template once per order, in key order; {k} key, {s} status, {p} priority, {d} day, {c} customer."""
    return F.array_join(F.transform("os", lambda o: _fill(template, **{n: o[n] for n in ("k", "c", "s", "p", "d")})), "")


def _pick(o: Column, n: int, *choices: str) -> Column:
    """One of the choices by order key."""
    return F.element_at(F.array(*map(F.lit, choices)), (o["k"] % n + 1).cast("int"))


def _per_order(body) -> Column:
    return F.array_join(F.transform("os", body), "")


def _count(status: str) -> Column:
    return F.size(F.filter("os", lambda o: o["s"] == status))




def _hero() -> Column:
    return _fill(
        '<header class="hero"><h1>Batch {b}</h1><p class="lead-in">Orders of <b>batch</b> {b} &amp; more</p>'
        "<div><span>{n}</span><span>orders</span></div><div><div>{f}</div><div>closed</div><i>x</i></div>"
        "<div><span>alone</span></div></header>",
        b=F.col("page_id"), n=F.size("os"), f=_count("F"),
    )


def _contents() -> Column:
    return F.concat(F.lit("<nav><ul>"), _each('<li><a href="#o{k}"> Order <b>{k}</b> </a></li>'), F.lit("</ul></nav>"))


def _headings() -> Column:
    return _per_order(
        lambda o: _fill("<h{n}> Order <b>{k}</b><br>of {c} </h{n}>", n=o["k"] % 6 + 1, k=o["k"], c=o["c"])
    )


def _paragraphs() -> Column:
    return _each(
        '<p>Order <b>{k}</b> is <em>{s}</em>, see <a href="/o?id={k}&amp;x=1">page <i>{k}</i></a>, <a>none</a>, run '
        '<code>get <b>{k}</b></code><br/>now<!--note {c}--> <span class="badge b1"> <i>{p}</i> </span> '
        '<span class="badges">{d}</span></p>'
    )


def _tables() -> Column:
    def row(o: Column) -> Column:
        third = _fill("<td>{p} |\n  {d}</td>", p=o["p"], d=o["d"])
        return F.concat(
            _fill('<tr><td>{k}</td><td><span class="badge green"> {s} </span></td>', k=o["k"], s=o["s"]),
            F.when(o["k"] % 3 >= 1, third).otherwise(""),
            F.when(o["k"] % 3 == 2, "<td></td>").otherwise(""),
            F.lit("</tr>"),
        )

    return F.concat(
        F.lit("<table><thead><tr><th>Order</th><th>St<b>at</b>us</th></tr></thead><tbody><tr></tr>"),
        _per_order(row),
        F.lit("</tbody></table>"),
    )


CALLOUT_CHOICES = ("callout insight", "note", "alert", "tip warn", "danger")


def _callouts() -> Column:
    return F.concat(
        _per_order(
            lambda o: _fill(
                '<div class="{cls}"><div>Order <b>{k}</b></div>\n\n  <p>state <b>{s}</b></p>\n</div>',
                cls=_pick(o, 5, *CALLOUT_CHOICES), k=o["k"], s=o["s"],
            )
        ),
        F.lit('<div class="warn">text without a block is lost</div>'),
    )


def _progress() -> Column:
    bars = [_fill('<div style="background-color: teal; width: {n}em"> ' + s + " {n}</div>", n=_count(s)) for s in STATUSES]
    return F.concat(F.lit('<div class="progress-bar">'), *bars, F.lit("<span> </span></div>"))


def _stats() -> Column:
    cards = [_fill("<div><div> " + s + " </div>text<p>count\n {n}</p><p>more</p></div>", n=_count(s)) for s in STATUSES]
    return F.concat(F.lit('<div class="stats-row">'), *cards, F.lit("</div>"))


def _timeline() -> Column:
    def item(o: Column, i: Column) -> Column:
        body = _fill("<p>priority {p}<br>customer {c}</p>", p=o["p"], c=o["c"])
        return F.concat(
            _fill('<div class="item {state}"><time>{d}</time><div>Order <b>{k}</b></div>', state=_pick(o, 4, "fail", "success", "fix", "other"), d=o["d"], k=o["k"]),
            F.when(i > 0, body).otherwise(""),  # one card short of two parts, so this is not a row of stat cards
            F.lit("</div>"),
        )

    return F.concat(F.lit('<div class="timeline">'), F.array_join(F.transform("os", item), ""), F.lit("</div>"))


def _timeline_as_cards() -> Column:
    """Every entry has two parts: the rule for stat cards comes before the one for timelines."""
    return F.concat(
        F.lit('<div class="timeline"><div><div>all</div><div>orders</div></div><div><div>2 x</div><div>all</div></div>'),
        _each("<div><div>{d}</div><div>Order {k}</div><p>unused</p></div>"), F.lit("</div>"),
    )


def _code() -> Column:
    def block(o: Column) -> Column:
        start = _pick(o, 3, '<pre class="lang-x"><code class="wide language-sql">', '<pre class="lang-sh"><code>', "<pre>")
        end = _pick(o, 3, "</code></pre>", "</code></pre>", "</pre>")
        return F.concat(start, _fill('select "{k}" &lt; 1;\n\n\n\n  -- <b>{s}</b>', k=o["k"], s=o["s"]), end)

    return _per_order(block)


def _lists() -> Column:
    return F.concat(
        F.lit("<ol>"), _each("<li> Order <b>{k}</b></li>"), F.lit("</ol>\n<ul>"),
        _each("<li>{s}<ul><li>of {c}</li></ul></li>"), F.lit("</ul>"),
    )


def _mermaid() -> Column:
    return F.concat(
        _fill('<div class="mermaid-wrapper"><pre class="mermaid">graph TD\n', b=F.col("page_id")),
        _each("  B --&gt; O{k}\n"),
        F.lit('</pre></div><pre class="mermaid"> \n </pre><div class="mermaid">no source</div><pre class="mermaid">'),
        _fill("pie {n}</pre>", n=F.size("os")),
    )


def _comparison() -> Column:
    cards = [
        _fill(
            '<div><div style="text-transform: uppercase"> ' + s + " </div><p>{n} <b>orders</b></p><pre><code>n = {n}</code></pre>"
            '<div><div class="note">{n} open</div></div><ul><li>lost</li></ul></div>',
            n=_count(s),
        )
        for s in STATUSES
    ]
    # The first card has one part only, otherwise the row would count as stat cards.
    return F.concat(F.lit('<div style="display: grid; grid-template-columns: 1fr"><div><p>intro</p></div>'), *cards, F.lit("</div>"))


def _visual() -> Column:
    return F.concat(
        F.lit('<div style="border: 1px solid; border-radius: 4px; padding: 2px"><table>'),
        _each("<tr><td><p>Order {k}</p></td><td>{s}</td></tr>"), F.lit("</table><p>after</p></div>"),
    )


def _images() -> Column:
    return _each("<p>![Order {k}](./images/order_{k}.png) ![all](images/all.png) ![web](https://example.org/{k}.png)</p>")


def _footer() -> Column:
    return _fill("<footer> Batch <b>{b}</b> &copy; {n}<!-- end --></footer>", b=F.col("page_id"), n=F.size("os"))


_MARKED = (
    '<div class="mermaid-wrapper"><pre class="mermaid">graph</pre></div><table><tr><td><span class="badge green">a</span>'
    '</td><td><span class="badge red">b</span></td></tr></table>'
    + "".join(f'<div class="callout {c}">x</div>' for c in ("insight", "success", "danger", "warn"))
)


def _kept_or_lost() -> Column:
    """The same components in a section, which keeps them, or in a main element, which loses them."""
    tag = F.when(F.element_at("os", 1)["s"] == "F", "main").otherwise("section")
    return F.concat(F.lit("<"), tag, F.lit(">" + _MARKED + "</"), tag, F.lit(">"))


SECTIONS = {
    "hero": _hero, "contents": _contents, "headings": _headings, "paragraphs": _paragraphs, "tables": _tables,
    "callouts": _callouts, "progress": _progress, "stats": _stats, "timeline": _timeline,
    "timeline_as_cards": _timeline_as_cards, "code": _code, "lists": _lists, "mermaid": _mermaid,
    "comparison": _comparison, "visual": _visual, "images": _images, "footer": _footer, "kept_or_lost": _kept_or_lost,
}
# The order of the sections on a full page.
FULL_PAGE = [
    "hero", "contents", "headings", "paragraphs", "tables", "callouts", "progress", "stats", "timeline", "code",
    "lists", "mermaid", "comparison", "visual", "images", "footer", "kept_or_lost", "timeline_as_cards",
]
#: Full pages differ: of every so many sections one is left out, another one on the next page.
LEFT_OUT = 7


#: Orders become some 40 times as many bytes of HTML, and pages cost far more time than orders: so many bytes of orders go into a part, in files as they are.
PART_BYTES = 1 << 16
#: More parts than that for each core do not fill the cores any better.
PARTS_PER_CORE = 32


def _parts(spark: SparkSession, orders: DataFrame) -> int:
    """Parts that orders are dealt into. By their bytes alone Spark would make about one a core, and cores would wait for the last few."""
    size = int(str(orders._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(-(-size // PART_BYTES), PARTS_PER_CORE * spark.sparkContext.defaultParallelism))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and its orders, sorted by key."""
    order = F.struct(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"),
        F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dealt = orders.select(F.expr(f"o_orderkey div {ORDERS_PER_PAGE}").alias("page_id"), order.alias("o")).repartition(_parts(spark, orders), "page_id")
    return dealt.groupBy("page_id").agg(F.sort_array(F.collect_list("o")).alias("os"))


def reports(spark: SparkSession, sf_dir: str, *sections: str) -> DataFrame:
    """Pages with the named sections, or full pages, of which each lacks some. Odd sections are wrapped in containers."""
    names = sections or FULL_PAGE
    wrap = lambda i, html: F.concat(F.lit("<section><div>"), html, F.lit("</div>\n</section>\n")) if i % 2 else html
    here = lambda i, html: html if sections else F.when(F.col("page_id") % LEFT_OUT != i % LEFT_OUT, html).otherwise("")
    script = F.when(F.element_at("os", 1)["s"] == "F", '<script src="https://cdn.jsdelivr.net/npm/mermaid.min.js"></script>').otherwise("")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Report</title>"), script, F.lit("<style>p > b {x: y}</style></head><body>\nloose text"),
        F.lit("<script>var t = '</p><p>';</script><main><p>lost</p></main>"),
        *[here(i, wrap(i, SECTIONS[n]())) for i, n in enumerate(names)],
        F.lit("</body></html>"),
    )
    return batches(spark, sf_dir).select("page_id", html.alias("html"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as paragraphs of escaped text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("<body><p>"), escape_markup(F.col("text")), F.lit("</p></body>")).alias("html")
    )


def tree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose elements form trees that follow from the orders alone, with most end tags left out.

    The n-th order of a page is an element at depth 1 + min(a + n - m) over itself and the orders m before it, where ``a`` is 0 for the first and
    the customer's remainder by 5 for others: so each is at most one deeper than the one before. Its tag is its status and depth. Only one
    end tag is written where an element starts that is not below the one before: that of the element which it follows.
    """
    wish = F.transform("os", lambda o, n: F.when(n == 0, 0).otherwise(o["c"] % 5) - n)
    deep = F.transform("os", lambda o, n: F.struct(o["k"].alias("k"), o["s"].alias("s"), (n + 1 + F.array_min(F.slice("wish", 1, n + 1))).alias("d")))
    tags = F.transform("deep", lambda o: F.struct(o["k"].alias("k"), o["d"].alias("d"), F.concat(F.lower(o["s"]), o["d"].cast("string")).alias("tag")))

    def element(o: Column, n: Column) -> Column:
        same = F.filter("tags", lambda x, m: (m < n) & (x["d"] == o["d"]))
        follows = (n > 0) & (F.get(F.col("tags"), n - 1)["d"] >= o["d"])
        end = F.when(follows, _fill("</{t}>", t=F.try_element_at(same, F.lit(-1))["tag"])).otherwise("")
        return F.concat(end, _fill("<{t}>{k}", t=o["tag"], k=o["k"]), F.when(o["k"] % 3 == 0, "<br>").otherwise(""))

    found = batches(spark, sf_dir).select("page_id", "os", wish.alias("wish")).select("page_id", deep.alias("deep")).select("page_id", tags.alias("tags"))
    body = F.array_join(F.transform("tags", element), "")
    last = F.when(F.col("page_id") % 2 == 0, "</body></html>").otherwise("")
    return found.select("page_id", F.concat(F.lit("<html><body>"), body, last).alias("html"))
