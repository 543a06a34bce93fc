"""Sitemaps: scan (SRC-2), parse (CRW-1), index traversal (CRW-2).

``sitemap_docs(url, status, body)`` holds fetched sitemap files. A body whose
URL ends in ``.gz`` (any case) is gunzipped and UTF-8 decoded; a file that
fails to decode is skipped. Parsing is ``from_xml`` (namespace-blind,
PERMISSIVE: a broken document yields the corrupt-record column, not a
failed job); the any-depth ``loc`` fallback is ``xpath``, evaluated only on
documents ``from_xml`` proved well-formed.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..functions.urls import is_doc_link, normalize_url, url_authority, url_scheme

# --- fixed values ------------------------------------------------------------
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_SITEMAP_FILES = 20
SITEMAP_PATH = "/sitemap.xml"
URLS_PER_FILE = 50000  # protocol limit of one sitemap file
# -----------------------------------------------------------------------------

_XML_SCHEMA = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt string"
# any number of declarations, processing instructions, comments before the root
_PROLOG_RE = r"^\uFEFF?\s*(?:<\?[\s\S]*?\?>\s*|<!--[\s\S]*?-->\s*|<!DOCTYPE[^>]*>\s*)*"
_ROOT_RE = _PROLOG_RE + r"<(?:[A-Za-z_][\w.\-]*:)?([A-Za-z_][\w.\-]*)"
_ROOT_TAG_RE = _PROLOG_RE + r"(<[^>]*>)"
# the namespace under the root's own prefix, whichever it is
_ROOT_NS_RE = (r"^<(?:([A-Za-z_][\w.\-]*):[\s\S]*\sxmlns:\1|[A-Za-z_][\w.\-]*(?=[\s>])[\s\S]*\sxmlns)\s*=\s*[\"']"
               + SITEMAP_NS.replace(".", r"\.") + r"[\"']")


def _gunzip_one(b):
    if b is None:
        return None
    try:
        return gzip.decompress(b).decode("utf-8", "replace")
    except Exception:
        return None


@F.arrow_udf(T.StringType())
def gunzip_utf8(body: pa.Array) -> pa.Array:
    """Gzip bytes -> UTF-8 text, bad bytes replaced; NULL if it isn't gzip."""
    return pa.array([_gunzip_one(b) for b in body.to_pylist()], type=pa.string())


def decode_bodies(docs: DataFrame) -> DataFrame:
    """SRC-2: (url, status, body binary|string) -> (url, status, text)."""
    body = F.col("body")
    if isinstance(docs.schema["body"].dataType, T.BinaryType):
        text = F.when(F.lower(F.col("url")).endswith(".gz"), gunzip_utf8(body)).otherwise(F.make_valid_utf8(body.cast("string")))
    else:
        text = body
    return docs.select("url", "status", text.alias("text"))


def read_sitemap_files(spark: SparkSession, path: str, url_prefix: str, root: str | None = None) -> DataFrame:
    """SRC-2 from files: every file below ``path`` becomes a sitemap doc
    whose URL is ``url_prefix`` + its path relative to ``path`` (status 200).
    Where ``path`` is a pattern, ``root`` is a regular expression of the folder
    names that its last part stands for.
    ``binaryFile`` keeps the bytes; gzip is undone by :func:`decode_bodies`."""
    base = path.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), r"^.*?/" + (root or re.escape(base.split("/")[-1])) + "/", "")
    return df.select(F.concat(F.lit(url_prefix.rstrip("/") + "/"), rel).alias("url"),
                     F.lit(200).alias("status"), F.col("content").alias("body"))


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """CRW-1: decoded docs (url, status, text) -> (url, kind, pos, loc).

    Root ``urlset`` -> kind 'url'; ``sitemapindex`` -> kind 'sitemap'; other
    roots and broken XML -> nothing. The namespaced direct path is used when
    the document is in the sitemap namespace; otherwise, or when that path
    is empty, any ``loc`` at any depth. Values are stripped.
    """
    ok = docs.filter((F.col("status") == 200) & F.col("text").isNotNull())
    x = F.from_xml(F.col("text"), _XML_SCHEMA,
                   {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"})
    p = ok.select("url", "text", x.alias("x"),
                  F.regexp_extract(F.col("text"), _ROOT_RE, 1).alias("root"))
    p = p.filter(F.col("x._corrupt").isNull() & F.col("root").isin("urlset", "sitemapindex"))
    in_ns = F.regexp_extract(F.col("text"), _ROOT_TAG_RE, 1).rlike(_ROOT_NS_RE)
    direct = F.when(F.col("root") == "urlset", F.transform(F.col("x.url"), lambda e: e.loc)) \
              .otherwise(F.transform(F.col("x.sitemap"), lambda e: e.loc))
    direct = F.filter(direct, lambda v: v.isNotNull())
    anywhere = F.xpath(F.col("text"), F.lit("//*[local-name()='loc']/text()"))
    locs = F.when(in_ns & (F.size(direct) > 0), direct).otherwise(anywhere)
    out = p.select("url", F.when(F.col("root") == "urlset", F.lit("url")).otherwise(F.lit("sitemap"))
                   .alias("kind"), F.posexplode(locs).alias("pos", "loc"))
    return out.select("url", "kind", (F.col("pos") + 1).alias("pos"), py_strip(F.col("loc")).alias("loc"))


def discover(requests: DataFrame, sitemap_docs: DataFrame,
             max_files: int | None = None) -> DataFrame:
    """CRW-2 + CRW-3: sitemap index traversal per request.

    FIFO from ``<scheme>://<authority>/sitemap.xml``; every file once; where
    a request has ``max_files`` (or the argument is given) at most so many files
    *including failures*, else all; then page
    URLs in file order, first occurrence kept, filtered by URL-5 against
    the request's normalized base URL. -> (project_id, url, seq)
    """
    from ..operators.crawl import bfs
    from ..operators.scan import running_count
    limit = F.col("max_files").cast("long") if "max_files" in requests.columns else F.lit(max_files).cast("long")
    req = requests.select("project_id", normalize_url(F.col("url")).alias("base_url"), limit.alias("_most"))
    root = F.concat(url_scheme(F.col("base_url")), F.lit("://"), url_authority(F.col("base_url")),
                    F.lit(SITEMAP_PATH))
    from ..operators.crawl import _materialize
    # files, children and pages all come from the one parse
    parsed = _materialize(parse_sitemaps(decode_bodies(sitemap_docs)))
    ok_files = parsed.select(F.col("url")).distinct()
    children = parsed.filter(F.col("kind") == "sitemap").select(
        F.col("url").alias("src"), F.col("pos").alias("position"), F.col("loc").alias("dst"))
    seeds = req.select("project_id", root.alias("url"), F.lit(0).cast("long").alias("seq"))
    # a site's walk ends at the level where its limit is reached
    limits = req.select("project_id", F.lit(None).cast("int").alias("max_depth"), F.col("_most").alias("max_pages"))
    files = bfs(seeds, children, requests=limits, expandable=ok_files, cap_visits=True)
    files = running_count(files, ["project_id"], ["depth", "key"], out="file_no") \
        .join(req.select("project_id", "_most"), "project_id") \
        .filter(F.col("_most").isNull() | (F.col("file_no") <= F.col("_most"))).drop("_most")
    pages = (files.select("project_id", F.col("url").alias("file"), "file_no")
                  .join(parsed.filter(F.col("kind") == "url")
                        .select(F.col("url").alias("file"), "pos", "loc"), "file"))
    first = pages.groupBy("project_id", F.col("loc").alias("url")) \
                 .agg(F.min(F.struct("file_no", "pos")).alias("_k"))
    first = first.join(req, "project_id").filter(is_doc_link(F.col("url"), F.col("base_url")))
    return running_count(first.select("project_id", "url", F.col("_k.file_no").alias("_f"),
                                      F.col("_k.pos").alias("_p")),
                         ["project_id"], ["_f", "_p", "url"], out="seq").drop("_f", "_p")


def sitemaps_from_archive(archive: DataFrame, urls_per_file: int = URLS_PER_FILE) -> DataFrame:
    """Sitemap files a site would publish for its archived pages: per site a
    ``/sitemap.xml`` index and child files of at most ``urls_per_file``
    URLs each (so every file is a bounded group), in page order.
    -> sitemap_docs(url, status, body)"""
    from ..operators.scan import running_count
    site = F.concat(url_scheme(F.col("url")), F.lit("://"), url_authority(F.col("url")))
    p = archive.select(site.alias("site"), "url", "page_id")
    p = running_count(p, ["site"], ["page_id", "url"], out="_n") \
        .withColumn("chunk", ((F.col("_n") - 1) / urls_per_file).cast("long") + 1)
    p = p.withColumn("_e", F.concat(F.lit("<url><loc>"), xml_escape(F.col("url")), F.lit("</loc></url>")))
    files = (p.groupBy("site", "chunk")
              .agg(ordered_listagg("_e", "", "_n").alias("_b"))
              .select("site", "chunk",
                      F.concat(F.col("site"), F.lit("/sitemap-"), F.col("chunk").cast("string"),
                               F.lit(".xml")).alias("url"),
                      F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="' + SITEMAP_NS
                                     + '">'), F.col("_b"), F.lit("</urlset>")).alias("body")))
    index = (files.withColumn("_e", F.concat(F.lit("<sitemap><loc>"), xml_escape(F.col("url")),
                                             F.lit("</loc></sitemap>")))
                  .groupBy("site").agg(ordered_listagg("_e", "", "chunk").alias("_b"))
                  .select(F.concat(F.col("site"), F.lit(SITEMAP_PATH)).alias("url"),
                          F.concat(F.lit('<sitemapindex xmlns="' + SITEMAP_NS + '">'), F.col("_b"),
                                   F.lit("</sitemapindex>")).alias("body")))
    return files.select("url", F.lit(200).alias("status"), "body") \
                .unionByName(index.select("url", F.lit(200).alias("status"), "body"))


def xml_escape(c):
    """Text content escaping: & < > (and quotes) as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ordered_listagg(col: str, sep: str, order: str):
    """``listagg(col, sep) WITHIN GROUP (ORDER BY order)`` (SQL form)."""
    return F.expr(f"listagg(`{col}`, '{sep}') WITHIN GROUP (ORDER BY `{order}`)")
