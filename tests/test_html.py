"""HTML parse, strip, content root, title and links on small pages."""
from pyspark.sql import functions as F

from docmill.functions import urls as U
from docmill.operators import content as C
from docmill.operators.html_nodes import parse_to_nodes, with_nodes

FULL = """<!DOCTYPE html><html><head><title>Pump manual | Works</title></head><body class="page">
<div role="navigation"><ul><li><a href="/docs/index">Index</a></li></ul></div>
<nav class="side"><a href="/docs/side">Side</a></nav>
<main id="m"><h1>Pump manual</h1><ol><li>Open the <a href="/docs/valve">valve</a>.</li>
<li>Read <a href="/docs/gauge?x=1">the gauge</a>.</li></ol><table><tr><td>bar</td><td>2</td></tr></table></main>
<footer>Printed &amp; bound</footer></body></html>"""
TITLE_ONLY = "<title lang='en'>\n Valves &amp; pumps – Works – Home</title><p>no heading</p>"
NOTHING = "<html><body><p>Just text</p></body></html>"
EXTERNAL = '<article>See <a href="//mirror.net/docs/p">a mirror</a>, <a href="http://example.com.evil.io/docs/q">this</a>.</article>'
UNCLOSED = "<html><body><article><h1>T</h1><p><b>bold<p>second<br>line</article></body></html>"
HEADER_H1 = "<html><body><header><h1>Brand</h1></header><main><p>Body</p></main></body></html>"
NO_BODY = '<p>loose <a href="/docs/z">z</a></p>'


def _analyze(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return C.analyze_pages(with_nodes(df))


def _row(spark, html, url="https://example.com/docs/start"):
    a = _analyze(spark, [(1, url, html)])
    names = F.array(*[F.lit(s) for s in C.CONTENT_SELECTORS + ["body"]])
    return a.select(
        "title", F.get(names, F.col("root.p")).alias("root_sel"),
        C.content_text(F.col("content"), F.col("root")).alias("text"),
        C.anchors(F.col("kept")).alias("kept_links"), C.anchors(F.col("nodes")).alias("all_links"),
    ).first()


def test_full_page(spark):
    r = _row(spark, FULL)
    assert r.title == "Pump manual"
    assert r.root_sel == "main"
    assert "Open the" in r.text and "Printed" not in r.text and "Side" not in r.text
    assert [x for x in r.kept_links if x != "/docs/index"] == ["/docs/valve", "/docs/gauge?x=1"]   # nav links are stripped first
    assert r.all_links == ["/docs/index", "/docs/side", "/docs/valve", "/docs/gauge?x=1"]


def test_title_fallbacks(spark):
    assert _row(spark, TITLE_ONLY).title == "Valves & pumps"
    assert _row(spark, NOTHING).title == "Untitled"
    assert _row(spark, "<title>Intro-duction</title>").title == "Intro"   # any hyphen cuts
    assert _row(spark, "<h1>  </h1><title>X</title>").title == ""         # empty h1 wins


def test_h1_in_header_is_title_but_heading_gone(spark):
    r = _row(spark, HEADER_H1)
    assert r.title == "Brand" and "Brand" not in r.text and r.root_sel == "main"


def test_unclosed_tags_one_root(spark):
    r = _row(spark, UNCLOSED)
    assert r.root_sel == "article"
    assert " ".join(r.text.split()) == "T bold second line"


def test_no_body_no_content_but_links(spark):
    r = _row(spark, NO_BODY)
    assert r.root_sel is None and r.kept_links == ["/docs/z"]


def test_external_link_filtered(spark):
    df = _analyze(spark, [(1, "https://example.com/docs/start", EXTERNAL)])
    links = df.select(F.explode(C.anchors(F.col("kept"))).alias("h"), "url") \
        .select(U.normalize_url(U.resolve_url("url", "h")).alias("l"), F.lit("https://example.com/docs").alias("b")) \
        .filter(U.is_doc_link("l", "b"))
    assert links.count() == 0


def test_parser_intervals():
    nodes = parse_to_nodes("<div><p>a<b>b</div><img src=x><span>c</span>")
    by_tag = {n["tag"]: n for n in nodes if n["tag"] != "#text"}
    div = by_tag["div"]
    # everything up to the img is inside the div; the img and span are not
    assert div["post"] == by_tag["b"]["post"] == 4 and by_tag["img"]["pre"] == 5
    assert by_tag["img"]["pre"] == by_tag["img"]["post"]
    assert by_tag["span"]["parent"] == -1


def test_absolutize(spark):
    html = ('<main><a href="../x">a</a><a href="#top">t</a><img src="i.png">'
            '<img src="data:abc"><source srcset="a.png 1x, b.png 2x"></main>')
    df = spark.createDataFrame([(1, "https://h/docs/guide/page", html)], "page_id long, url string, html string")
    n = with_nodes(df).select(F.explode(C.absolutize(F.col("nodes"), F.col("url"))).alias("n"))
    got = [(r.n.tag, dict(r.n.attrs)) for r in n.collect() if r.n.tag in ("a", "img", "source")]
    assert got[0][1]["href"] == "https://h/docs/x"
    assert got[1][1]["href"] == "#top"
    assert got[2][1]["src"] == "https://h/docs/guide/i.png"
    assert got[3][1]["src"] == "data:abc"
    assert got[4][1]["srcset"] == "https://h/docs/guide/a.png 1x, b.png 2x"


def test_comment_splits_text(spark):
    assert _row(spark, "<h1>Foo <!-- v --> Bar</h1><main>x</main>").title == "FooBar"


def test_running_max_by_blocks(spark):
    import random

    rnd = random.Random(4)
    rows = [[rnd.randint(-1, 1000) for _ in range(n)] for n in (0, 1, 5, C.SWEEP, C.SWEEP + 1, 3 * C.SWEEP, 1000)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<bigint>").select("v", C.running_max(F.col("v")).alias("m"))
    for r in df.collect():
        best, want = -(1 << 62), []
        for x in r.v:
            best = max(best, x)
            want.append(best)
        assert r.m == want


def test_strip_on_a_page_of_many_cuts(spark):
    """30,000 nodes, more than half of them cut: the sweep is no product of both."""
    body = "".join(f"<p>t{i}</p><nav><b>n</b></nav>" for i in range(6_000))
    df = with_nodes(spark.createDataFrame([(f"<body>{body}</body>",)], "html string"))
    n, kept = df.select(F.size("nodes"), F.size(C.strip_nodes(F.col("nodes")))).first()
    assert (n, kept) == (30_001, 12_001)


def test_nodes_of_a_batch_leave_in_parts():
    """A worker never holds the nodes of a whole batch as Python objects."""
    import pyarrow as pa

    from docmill.operators import html_nodes as H
    page = "<main>" + "<p class='x'>one <a href='/y'>two</a></p>" * 100 + "</main>"
    pages = [page if i % 7 else None for i in range(300)] + ["", None]
    parts = list(H.parse_html_nodes.func(iter([pa.array(pages), pa.array([], pa.string())])))
    assert len(parts) > 3 and max(len(p) for p in parts) * len(page) < 2 * H.PIECE
    nodes = [n for p in parts for n in p.to_pylist()]
    assert [n is None for n in nodes] == [p is None for p in pages]
    want = H.parse_to_nodes(page)
    assert all([m["pre"], m["post"], m["tag"], m["attrs"]] == [w["pre"], w["post"], w["tag"], w["attrs"]] for m, w in zip(nodes[1], want))


def test_nodes_stay_with_their_pages(spark):
    from docmill.operators import html_nodes as H
    H.register_sql_functions(spark)
    df = spark.range(0, 2000, 1, 2).selectExpr("id AS page_id", "if(id % 5 = 0, null, concat('<p>', repeat('x', 400), id, '</p>')) AS html")
    for out in (with_nodes(df), df.selectExpr("*", "parse_html_nodes(html) AS nodes")):
        rows = out.select("page_id", F.col("nodes")[1]["text"].alias("t")).collect()
        assert len(rows) == 2000
        assert all(r.t == (None if r.page_id % 5 == 0 else "x" * 400 + str(r.page_id)) for r in rows)
