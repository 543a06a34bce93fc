"""Rendering contract (golden) and the whole conversion."""
from docmill.operators.html_nodes import parse_to_nodes
from pyspark.sql import functions as F

from docmill.operators.markdown import convert_pages, render_nodes, render_table
from docmill.operators import content as C
from docmill.operators.html_nodes import with_nodes


def md(html, **kw):
    return render_nodes(parse_to_nodes(html), **kw)


def lines(s):
    """The lines that hold something, without blanks behind."""
    return [x.rstrip() for x in s.splitlines() if x.strip()]


def test_headings_paragraphs():
    out = md("<div><h1>Title</h1><p>Para one.</p><h2>Sub</h2><h3>Deeper</h3></div>")
    assert lines(out) == ["# Title", "Para one.", "## Sub", "### Deeper"]


def test_code_block_language(spark):
    """Of a block's own classes; of its code element's only when asked."""
    html = ["<main><pre class='box Highlight-Rust lang-c'>a</pre></main>", "<main><pre><code class='language-sql'>b</code></pre></main>",
            "<main><pre class='plain'>c</pre><pre class='lang-'>d</pre></main>"]
    df = with_nodes(spark.createDataFrame(list(enumerate(html)), "page_id int, html string"))
    for look, second in ((False, ""), (True, "sql")):
        out = [r.md for r in render_table(df, ["page_id"], "nodes", None, "md", look_at_code=look).orderBy("page_id").collect()]
        assert "```rust\na\n```" in out[0] and f"```{second}\nb\n```" in out[1] and "```\nc\n```" in out[2]
        blocks = [(b.language, b.text) for r in df.select(C.code_blocks(F.col("nodes"), look).alias("b")).collect() for b in r.b]
        assert blocks == [("rust", "a"), ("sql" if look else None, "b"), (None, "c"), ("", "d")]


def test_table_without_header_cells():
    data = "<tr><td>1</td><td>2</td></tr><tr><td>3</td></tr>"
    assert "|  |  |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |" in md(f"<table>{data}</table>")
    assert "| 1 | 2 |\n| --- | --- |\n| 3 |  |" in md("<table><thead><tr><td>1</td><td>2</td></tr></thead><tbody><tr><td>3</td></tr></tbody></table>")


def test_lists_nested():
    out = md("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><ol><li>x</li><li>y</li></ol>")
    assert lines(out) == ["* a", "* b", "  + c", "1. x", "2. y"]


def test_inline_marks_no_escaping():
    out = md("<p>snake_case *star* <b>bold</b> <em>it</em> <code>c()</code></p>")
    assert "snake_case *star* **bold** *it* `c()`" in out


def test_links_images_br():
    out = md('<p><a href="https://x.org">https://x.org</a> <a href="https://y.org" title="T">Y</a>'
             '<br><img src="https://i/p.png" alt="pic"></p>')
    assert "<https://x.org>" in out and '[Y](https://y.org "T")' in out
    assert "  \n![pic](https://i/p.png)" in out


def test_table_blockquote_hr():
    out = md("<div><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
                    "<blockquote><p>q</p></blockquote><hr></div>")
    assert "| a | b |\n| --- | --- |\n| 1 | 2 |" in out
    assert "> q" in out and out.rstrip().endswith("---")


def test_unclosed_p_and_b():
    out = md("<article><p><b>bold<p>next</article>")
    assert "bold" in out and "next" in out


def test_empty_html():
    assert md("") == ""


def test_convert_pages_frontmatter_and_absolute_links(spark):
    html = '<main><h1>Hello</h1><p>See <a href="/docs/x">x</a>.</p></main>'
    df = spark.createDataFrame([(1, "https://h/docs/a", html)], "page_id long, url string, html string")
    a = C.analyze_pages(with_nodes(df))
    out = convert_pages(a, "2024-01-15", keep=["page_id", "url", "title"]).first().markdown
    assert out.startswith('---\ntitle: "Hello"\nsource: "https://h/docs/a"\nscraped_at: "2024-01-15"\n---\n')
    assert "[x](https://h/docs/x)" in out and out.endswith("\n") and "# Hello" in out


def test_language_callback():
    out = md('<pre class="x-py"><code>1</code></pre>',
             language_fn=lambda pre, code: "py" if "x-py" in pre else None)
    assert "```py\n1\n```" in out


def test_parser_from_sql(spark):
    from docmill.operators.html_nodes import register_sql_functions
    register_sql_functions(spark)
    spark.createDataFrame([(1, "<main><h1>T</h1><p>x</p></main>")], "page_id long, html string") \
         .createOrReplaceTempView("pg")
    rows = spark.sql("SELECT n.tag FROM pg LATERAL VIEW explode(parse_html_nodes(html)) t AS n "
                     "WHERE n.tag <> '#text'").collect()
    assert [r.tag for r in rows] == ["main", "h1", "p"]


def test_bad_link_and_deep_nesting_do_not_end_the_job(spark):
    bad = '<main><h1>T</h1><p><a href="http://[bad">x</a></p></main>'
    deep = "<main><h1>D</h1>" + "<p>para " * 2000 + "</main>"
    df = spark.createDataFrame([(1, "https://h/a", bad), (2, "https://h/b", deep)], "page_id long, url string, html string")
    a = C.analyze_pages(with_nodes(df))
    out = {r.page_id: r.markdown for r in convert_pages(a, "2024-01-15", keep=["page_id", "url", "title"]).collect()}
    assert "[x](http://[bad)" in out[1] and out[2].count("para") == 2000


def test_parser_failure_is_null_nodes(monkeypatch):
    from docmill.operators import html_nodes as H

    def broken(self, data):
        raise AssertionError("parser")

    monkeypatch.setattr(H._NodeBuilder, "handle_data", broken)
    assert H.parse_to_nodes("<p>text</p>") is None


def test_a_batch_is_rendered_page_by_page():
    """Of a batch's nodes only one page's are Python objects at a time."""
    import tracemalloc

    from docmill.operators import html_nodes as H
    from docmill.operators import markdown as MD
    nodes = H.parse_to_nodes("<main>" + "<p>one <b>two</b></p>" * 50 + "</main>")
    content = H.pa.array([nodes, None] * 150, type=H._PA_NODES)

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    whole = peak(content.to_pylist)[1]
    md, held = peak(lambda: MD.render_batch(content))
    assert md.to_pylist() == [MD.render_nodes(nodes), None] * 150 and held < whole / 10
