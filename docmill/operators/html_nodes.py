"""HTM-1: parse pages into node arrays.

One Arrow-batched UDF turns each page's HTML into an ``array<struct>`` of
nodes in document order, with an interval encoding: ``pre`` is the start
order of the node and ``post`` the largest ``pre`` inside it, so
"``m`` is inside ``n``" is ``n.pre <= m.pre <= n.post``. Everything after
the parse (strip, content root, title, links, text) is a Catalyst
higher-order-function expression over that array, so the node data never
leaves its page's row and never shuffles.

Tree rules (lenient, as the reference's parser): no implied end tags, so an
unclosed ``<p>`` nests what follows; an end tag closes back to its nearest
open match or is ignored; void elements close at once; entities are
decoded; comments and doctypes are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: elements that never have content ---------------------
VOID_ELEMENTS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
])
# -------------------------------------------------------------------------

TEXT = "#text"

NODE_DDL = ("struct<pre:int,post:int,parent:int,depth:int,tag:string,id:string,"
            "classes:array<string>,role:string,attrs:map<string,string>,text:string>")
NODES_DDL = f"array<{NODE_DDL}>"
NODE_TYPE = T.StructType([
    T.StructField("pre", T.IntegerType()), T.StructField("post", T.IntegerType()),
    T.StructField("parent", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("role", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])
NODES_TYPE = T.ArrayType(NODE_TYPE)

_PA_NODE = pa.struct([
    ("pre", pa.int32()), ("post", pa.int32()), ("parent", pa.int32()),
    ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
    ("classes", pa.list_(pa.string())), ("role", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
])
_PA_NODES = pa.list_(_PA_NODE)


class _NodeBuilder(HTMLParser):
    """Builds the flat node list; ``post`` is filled when a node closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.buf: list[str] = []

    def _flush(self):
        if self.buf:
            text = "".join(self.buf)
            self.buf = []
            i = len(self.nodes)
            self.nodes.append({
                "pre": i, "post": i, "parent": self.stack[-1] if self.stack else -1,
                "depth": len(self.stack), "tag": TEXT, "id": None, "classes": None,
                "role": None, "attrs": None, "text": text,
            })

    def _open(self, tag, attrs, void):
        self._flush()
        amap: dict[str, str] = {}
        for k, v in attrs:
            amap[k] = "" if v is None else v
        i = len(self.nodes)
        cls = amap.get("class")
        self.nodes.append({
            "pre": i, "post": i, "parent": self.stack[-1] if self.stack else -1,
            "depth": len(self.stack), "tag": tag, "id": amap.get("id"),
            "classes": cls.split() if cls is not None else [],
            "role": amap.get("role"), "attrs": list(amap.items()), "text": None,
        })
        if not void:
            self.stack.append(i)

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, tag in VOID_ELEMENTS)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        self._flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[k]]["tag"] == tag:
                last = len(self.nodes) - 1
                for idx in self.stack[k:]:
                    self.nodes[idx]["post"] = last
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.buf.append(data)

    # whatever stands between two pieces of text keeps them apart
    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self) -> list[dict]:
        self.close()
        self._flush()
        last = len(self.nodes) - 1
        for idx in self.stack:
            self.nodes[idx]["post"] = last
        self.stack = []
        return self.nodes


def parse_to_nodes(html: str | None) -> list[dict] | None:
    """Plain-Python form of the parse, used inside the Arrow UDF and tests.
    A page the parser gives up on has NULL nodes, never the part read so far;
    the crawl lists it as an error."""
    if html is None:
        return None
    b = _NodeBuilder()
    try:
        b.feed(html)
        return b.finish()
    except Exception:  # malformed beyond the parser's tolerance
        return None


#: Characters of HTML whose nodes are held as Python objects at a time. A batch
#: of Spark's has thousands of pages; its nodes leave in parts of about this size.
PIECE = 256 << 10


@F.arrow_udf(NODES_TYPE)
def parse_html_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow UDF: html string -> node array (NULL stays NULL)."""
    for html in batches:
        yield from _parse_pieces(html)


def _parse_pieces(html: pa.Array) -> Iterator[pa.Array]:
    nodes, held = [], 0
    for page in html:
        page = page.as_py()
        nodes.append(parse_to_nodes(page))
        held += len(page or "")
        if held >= PIECE:
            yield pa.array(nodes, type=_PA_NODES)
            nodes, held = [], 0
    if nodes or not len(html):
        yield pa.array(nodes, type=_PA_NODES)


def with_nodes(pages, html_col: str = "html", out: str = "nodes"):
    """Adds the node array next to the page's other columns (HTM-1)."""
    return pages.withColumn(out, parse_html_nodes(F.col(html_col)))


def nodes_table(df, key_cols=("page_id",), nodes_col: str = "nodes"):
    """Relational node table: one row per node, for SQL users."""
    return df.select(*key_cols, F.explode(nodes_col).alias("n")).select(*key_cols, "n.*")


def start_tag_counts(nodes: Column) -> Column:
    """Per page, ``array<struct<tag, n>>``: how many elements of each tag.

    Counted inside the page's row (distinct tags, then a count per tag), so
    a node-count table needs no shuffle: ``inline`` it next to the page key.
    """
    tags = F.transform(F.filter(nodes, lambda n: n.tag != TEXT), lambda n: n.tag)
    return F.transform(F.array_distinct(tags), lambda t: F.struct(
        t.alias("tag"), F.size(F.filter(tags, lambda x: x == t)).cast("long").alias("n")))


def register_sql_functions(spark) -> None:
    """Makes the parser callable from SQL:
    ``SELECT page_id, n.* FROM pages LATERAL VIEW explode(parse_html_nodes(html)) t AS n``."""
    spark.udf.register("parse_html_nodes", parse_html_nodes)
