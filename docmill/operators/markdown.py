"""HTM-8 render and HTM-11 convert.

Rendering a tree to Markdown is the one step that needs imperative code:
one Arrow-batched UDF takes a page's content nodes (already stripped,
already selected, attributes already absolute -- all Catalyst work) and
returns its Markdown. One page per row, no state across rows. Clean-up and
frontmatter are Catalyst expressions again (:mod:`functions.text`).

Rendering contract (our golden tests state it): ATX headings; fenced code
blocks with the language from the ``pre`` element's classes; no escaping of
``_`` and ``*``; ``*`` bullets (then ``+``, ``-`` when nested), ``1.``
numbers; ``**bold**``, ``*em*``, `` `code` ``, ``[t](u)``, ``<u>`` when the
text is the URL, ``![alt](src)``; ``>`` quotes; ``---`` rules; pipe tables (a
table without header cells has an empty header row);
``<br>`` as two spaces and a newline.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_markdown, frontmatter
from .content import absolutize, with_languages
from .html_nodes import TEXT

# --- fixed values: element groups of the renderer -------------------------
BLOCK_TAGS = frozenset([
    "address", "article", "aside", "body", "div", "dl", "fieldset", "figure",
    "footer", "form", "header", "html", "main", "nav", "section", "details",
    "summary", "figcaption", "dd", "dt",
])
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
DROPPED = frozenset(["script", "style", "noscript", "template", "head", "title", "meta", "link"])
BULLETS = "*+-"
# ---------------------------------------------------------------------------

_WS = re.compile(r"[\t \r\n]+")
_BLOCKISH = BLOCK_TAGS | set(HEADINGS) | {"p", "pre", "ul", "ol", "li", "blockquote", "table",
                                          "hr", "thead", "tbody", "tfoot", "tr"}


class _Tree:
    """Children lists from parent indices. A fragment with several
    top-level nodes gets a virtual root (tag ``#fragment``)."""

    def __init__(self, nodes):
        self.nodes = nodes
        self.kids: dict[int, list[dict]] = {}
        pres = {n["pre"] for n in nodes}
        tops = [n for n in nodes if n["parent"] not in pres]
        if len(tops) > 1:
            self.root = {"pre": -2, "post": None, "parent": -3, "tag": "#fragment"}
            rest = nodes
        else:
            self.root = nodes[0]
            rest = nodes[1:]
        for n in rest:
            p = n["parent"] if n["parent"] in pres else self.root["pre"]
            self.kids.setdefault(p, []).append(n)

    def children(self, n):
        return self.kids.get(n["pre"], [])


def _attrs(n):
    a = n.get("attrs") or []
    return dict(a) if isinstance(a, list) else dict(a)


def _chomp(text):
    lead = " " if text[:1] in (" ", "\n") else ""
    trail = " " if text[-1:] in (" ", "\n") else ""
    return lead, trail, text.strip()


class _Renderer:
    def __init__(self, tree: _Tree, language_fn=None):
        self.t = tree
        self.language_fn = language_fn

    def kids_text(self, n, ctx):
        out = []
        ch = self.t.children(n)
        for i, c in enumerate(ch):
            if c["tag"] == TEXT:
                out.append(self.text(c, ch, i, ctx))
            else:
                out.append(self.el(c, ctx))
        return "".join(out)

    def text(self, n, siblings, i, ctx):
        s = n.get("text") or ""
        if ctx.get("pre"):
            return s
        s = _WS.sub(" ", s)
        if s.strip() == "":
            prev = siblings[i - 1]["tag"] if i > 0 else None
            nxt = siblings[i + 1]["tag"] if i + 1 < len(siblings) else None
            if prev is None or nxt is None or prev in _BLOCKISH or nxt in _BLOCKISH:
                return ""
            return " "
        return s

    def raw_text(self, n):
        parts = []
        for c in self.t.children(n):
            if c["tag"] == TEXT:
                parts.append(c.get("text") or "")
            elif c["tag"] == "br":
                parts.append("\n")
            else:
                parts.append(self.raw_text(c))
        return "".join(parts)

    def el(self, n, ctx):
        tag = n["tag"]
        if tag in DROPPED:
            return ""
        inline = ctx.get("inline", False)
        if tag in HEADINGS:
            txt = self.kids_text(n, {**ctx, "inline": True}).strip()
            if inline:
                return txt
            return f"\n\n{'#' * HEADINGS[tag]} {txt}\n\n" if txt else ""
        if tag == "p":
            txt = self.kids_text(n, ctx)
            if inline:
                return txt
            txt = txt.strip()
            return f"\n\n{txt}\n\n" if txt else ""
        if tag == "br":
            return "" if inline else "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag in ("b", "strong"):
            return self._wrap(n, ctx, "**")
        if tag in ("i", "em"):
            return self._wrap(n, ctx, "*")
        if tag in ("del", "s", "strike"):
            return self._wrap(n, ctx, "~~")
        if tag in ("code", "kbd", "samp", "tt"):
            if ctx.get("pre"):
                return self.kids_text(n, ctx)
            lead, trail, txt = _chomp(self.kids_text(n, ctx))
            return f"{lead}`{txt}`{trail}" if txt else ""
        if tag == "pre":
            code = self.raw_text(n)
            if not code:
                return ""
            inner = [c for c in self.t.children(n) if c["tag"] == "code"]
            inner_cls = inner[0].get("classes") if inner else None
            if self.language_fn is not None:
                lang = self.language_fn(n.get("classes") or [], inner_cls or []) or ""
            else:
                lang = n.get("lang") or ""
            return f"\n\n```{lang}\n{code}\n```\n\n"
        if tag == "a":
            lead, trail, txt = _chomp(self.kids_text(n, ctx))
            if not txt:
                return ""
            a = _attrs(n)
            href, title = a.get("href"), a.get("title")
            if not href:
                return lead + txt + trail
            if txt == href and not title:
                return f"{lead}<{href}>{trail}"
            tp = ' "%s"' % title.replace('"', r"\"") if title else ""
            return f"{lead}[{txt}]({href}{tp}){trail}"
        if tag == "img":
            a = _attrs(n)
            alt, src, title = a.get("alt") or "", a.get("src") or "", a.get("title")
            if inline and ctx.get("no_images"):
                return alt
            tp = ' "%s"' % title.replace('"', r"\"") if title else ""
            return f"![{alt}]({src}{tp})"
        if tag in ("ul", "ol"):
            return self.lst(n, ctx)
        if tag == "li":  # stray li outside a list
            return self.item(n, ctx, BULLETS[0])
        if tag == "blockquote":
            txt = self.kids_text(n, ctx).strip()
            if not txt:
                return ""
            body = "\n".join(("> " + ln) if ln else ">" for ln in txt.split("\n"))
            return f"\n\n{body}\n\n"
        if tag == "table":
            return self.table(n, ctx)
        if tag in BLOCK_TAGS:
            txt = self.kids_text(n, ctx)
            return txt if inline else f"\n\n{txt}\n\n"
        return self.kids_text(n, ctx)

    def _wrap(self, n, ctx, mark):
        lead, trail, txt = _chomp(self.kids_text(n, ctx))
        return f"{lead}{mark}{txt}{mark}{trail}" if txt else ""

    def lst(self, n, ctx):
        depth = ctx.get("list_depth", 0)
        ordered = n["tag"] == "ol"
        start = 1
        if ordered:
            try:
                start = int(_attrs(n).get("start", "1"))
            except ValueError:
                start = 1
        items, k = [], 0
        for c in self.t.children(n):
            if c["tag"] != "li":
                continue
            bullet = f"{start + k}." if ordered else BULLETS[depth % len(BULLETS)]
            items.append(self.item(c, {**ctx, "list_depth": depth + 1}, bullet))
            k += 1
        body = "".join(items)
        if depth > 0:
            return "\n" + body
        return f"\n\n{body}\n\n"

    def item(self, n, ctx, bullet):
        txt = self.kids_text(n, ctx).strip()
        txt = re.sub(r"\n{2,}", "\n", txt)
        pad = " " * (len(bullet) + 1)
        lines = txt.split("\n")
        body = lines[0] + "".join("\n" + (pad + ln if ln else ln) for ln in lines[1:])
        return f"{bullet} {body}\n"

    def table(self, n, ctx):
        rows, in_head = [], []

        def walk(x):
            for c in self.t.children(x):
                if c["tag"] == "tr":
                    rows.append(c)
                    if x["tag"] == "thead":
                        in_head.append(c)
                elif c["tag"] in ("thead", "tbody", "tfoot"):
                    walk(c)
        walk(n)
        if not rows:
            return ""
        cctx = {**ctx, "inline": True, "no_images": False}
        grid = []
        for r in rows:
            cells = [c for c in self.t.children(r) if c["tag"] in ("td", "th")]
            grid.append([_WS.sub(" ", self.kids_text(c, cctx)).strip().replace("|", r"\|")
                         for c in cells])
        width = max(len(g) for g in grid)
        grid = [g + [""] * (width - len(g)) for g in grid]
        first = self.t.children(rows[0])
        if not any(c["tag"] == "th" for c in first) and rows[0] not in in_head:
            grid.insert(0, [""] * width)  # rows of data alone: an empty header
        lines = ["| " + " | ".join(grid[0]) + " |", "| " + " | ".join(["---"] * width) + " |"]
        lines += ["| " + " | ".join(g) + " |" for g in grid[1:]]
        return "\n\n" + "\n".join(lines) + "\n\n"


def render_nodes(nodes, language_fn=None) -> str | None:
    """Markdown of a node list whose first node is the content root.

    A ``pre`` node's language is its field ``lang`` (:func:`content.with_languages`);
    ``language_fn(pre_classes, code_classes) -> str | None`` takes its place
    (the reference's language callback)."""
    if nodes is None:
        return None
    if not nodes:
        return ""
    # unclosed elements nest without bound: leave room for the deepest node
    deepest = max(n["depth"] or 0 for n in nodes)
    if sys.getrecursionlimit() < 8 * deepest + 1000:
        sys.setrecursionlimit(8 * deepest + 1000)
    tree = _Tree(nodes)
    r = _Renderer(tree, language_fn)
    root = tree.root
    if root["tag"] == TEXT:
        return _WS.sub(" ", root.get("text") or "")
    if root["tag"] == "#fragment":
        return r.kids_text(root, {})
    return r.el(root, {})


def render_batch(content: pa.Array, language_fn=None) -> pa.Array:
    """Markdown of each page's nodes, one page at a time as Python objects."""
    return pa.array((render_nodes(x.as_py(), language_fn) for x in content), type=pa.string())


def render_table(df: DataFrame, keep, content_col: str = "content", url_col: str | None = "url",
                 out: str = "markdown_raw", look_at_code: bool = False,
                 language_fn=None) -> DataFrame:
    """HTM-8 as a partition-wise Arrow job: ``keep`` columns pass through,
    ``out`` is the raw Markdown of ``content_col`` (links made absolute
    against ``url_col`` when given). Languages and absolute links are Catalyst
    expressions; only the needed columns are shipped to Python, one Arrow batch
    at a time, of which one page's nodes at a time are Python objects."""
    keep = [k for k in keep if k not in (content_col, out)]
    nodes = with_languages(F.col(content_col), look_at_code)
    if url_col:
        given = F.coalesce(F.col(url_col), F.lit("")) != ""
        nodes = F.when(given, with_languages(absolutize(F.col(content_col), F.col(url_col)), look_at_code)).otherwise(nodes)
    src = df.select(*keep, nodes.alias(content_col))
    schema = T.StructType([src.schema[k] for k in keep] + [T.StructField(out, T.StringType())])
    names = keep

    def run(batches):
        for b in batches:
            content = b.column(b.schema.get_field_index(content_col))
            md = render_batch(content, language_fn)
            arrays = [b.column(b.schema.get_field_index(k)) for k in names]
            yield pa.RecordBatch.from_arrays(arrays + [md], names=names + [out])
    return src.mapInArrow(run, schema)


def convert_pages(pages: DataFrame, scraped_on: str, url_col: str = "url",
                  keep=None, look_at_code: bool = False, language_fn=None) -> DataFrame:
    """HTM-11 on a table with ``content`` (nodes), ``title`` and the page URL:
    ``markdown`` = frontmatter + newline + clean(render(absolutize(content))).

    Absolutizing happens only when a source URL is given, as in the
    reference; ``base_url`` is not used there either."""
    keep = list(keep or [c for c in pages.columns if c not in ("content",)])
    if url_col not in keep:
        keep.append(url_col)
    r = render_table(pages, keep, url_col=url_col, look_at_code=look_at_code,
                     language_fn=language_fn)
    md = clean_markdown(F.col("markdown_raw"))
    return r.withColumn("markdown", F.concat(
        frontmatter(F.col("title"), F.col(url_col), F.lit(scraped_on)), F.lit("\n"), md)) \
            .drop("markdown_raw")
