"""Registered queries: one per operator of the inventory, each with the
DuckDB SQL that recomputes it independently (where SQL can).

Every query reads the driver's tables (``sf_dir``) in full; parameters
(search terms, cap sizes, dates) are feature inputs, not row filters.
Column names are aliased alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import content as C
from ..operators import jobs as J
from ..operators import library as L
from ..operators import library_store as LS
from ..operators.html_nodes import TEXT, with_nodes
from ..sources import tables as S
from . import oracle_sql as O

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SCRAPED_ON = S.DEFAULT_SCRAPED_AT.strftime("%Y-%m-%d")
SEARCH_TERM = "the "
HIT_TERM = " the"
DELETE_IDS = ["src3", "src7", "no-such-project"]
MAX_PAGES = 50
PAGE_CAP = 3


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- helpers
def _pages(spark, sf):
    return S.page_archive(spark, sf)


def _analyzed(spark, sf):
    p = with_nodes(_pages(spark, sf).select("page_id", "url", "html"))
    return C.analyze_pages(p)


def _site_root(url):
    return F.concat(U.url_scheme(url), F.lit("://"), U.url_authority(url))


def _anchor_rows(df, nodes_col):
    return df.select("page_id", "url", F.posexplode(C.anchors(F.col(nodes_col))).alias("pos", "href")) \
             .withColumn("pos", (F.col("pos") + 1).cast("long"))


SQL_ROOT = f"lower({O.url_part('url', 1)}) || '://' || {O.url_part('url', 3)}"

# =============================================================== SRC-1
register("src_pages_html_gate", """
SELECT page_id, url, true AS kept, CAST(NULL AS VARCHAR) AS reason FROM pages
""")(lambda spark, sf: _gate(spark, sf))


def _gate(spark, sf):
    from ..sources.archive import html_gate
    return html_gate(_pages(spark, sf)).select("page_id", "url", "kept", "reason")


# =============================================================== URL-*
@register("url_normalize", f"SELECT page_id, url, {O.normalize('url')} AS normalized FROM pages")
def q_url_normalize(spark, sf):
    return _pages(spark, sf).select("page_id", "url", U.normalize_url("url").alias("normalized"))


@register("url_authority", f"SELECT page_id, {O.url_part('url', 3)} AS authority FROM pages")
def q_url_authority(spark, sf):
    return _pages(spark, sf).select("page_id", U.url_authority("url").alias("authority"))


@register("url_project_name",
          f"SELECT page_id, replace({O.url_part('url', 3)}, 'www.', '') AS project_name FROM pages")
def q_url_project_name(spark, sf):
    return _pages(spark, sf).select("page_id", U.project_name("url").alias("project_name"))


@register("url_page_id", "SELECT page_id, substring(md5(url), 1, 10) AS pid FROM pages")
def q_url_page_id(spark, sf):
    return _pages(spark, sf).select("page_id", U.page_id("url").alias("pid"))


_ANCH = O.anchors_cte()


@register("url_asset_filter", f"""
SELECT page_id, pos, {O.entities('href')} AS href, {O.is_asset(O.entities('href'))} AS is_asset
FROM ({_ANCH})""")
def q_url_asset(spark, sf):
    a = _anchor_rows(with_nodes(_pages(spark, sf).select("page_id", "url", "html")), "nodes")
    return a.select("page_id", "pos", "href", U.is_asset("href").alias("is_asset"))


_BASE_SQL = f"{SQL_ROOT} || '/' || split_part(ltrim({O.url_part('url', 4)}, '/'), '/', 1)"
_ABS_SQL = f"{SQL_ROOT} || {O.entities('href')}"


@register("url_prefix_filter", f"""
SELECT page_id, pos, {_ABS_SQL} AS link, {_BASE_SQL} AS base,
       starts_with(lower({O.url_part(_ABS_SQL, 4)}),
                   rtrim({O.url_part(_BASE_SQL, 4)}, '/')) AS in_base
FROM ({_ANCH})""")
def q_url_prefix(spark, sf):
    a = _anchor_rows(with_nodes(_pages(spark, sf).select("page_id", "url", "html")), "nodes")
    base = F.concat(_site_root(F.col("url")), F.lit("/"),
                    F.split_part(F.regexp_replace(U.url_path("url"), "^/+", ""), F.lit("/"), F.lit(1)))
    link = U.resolve_url(F.col("url"), F.col("href"))
    return a.select("page_id", "pos", link.alias("link"), base.alias("base"),
                    U.in_base_path(link, base).alias("in_base"))


@register("url_resolve", f"SELECT page_id, pos, {_ABS_SQL} AS resolved FROM ({_ANCH})")
def q_url_resolve(spark, sf):
    a = _anchor_rows(with_nodes(_pages(spark, sf).select("page_id", "url", "html")), "nodes")
    return a.select("page_id", "pos", U.resolve_url(F.col("url"), F.col("href")).alias("resolved"))


@register("url_doc_links", f"""
SELECT page_id, pos, {O.normalize(_ABS_SQL)} AS link
FROM ({_ANCH})
WHERE NOT {O.is_asset(O.normalize(_ABS_SQL))}
  AND {O.url_part(O.normalize(_ABS_SQL), 3)} = {O.url_part('url', 3)}
  AND starts_with(lower({O.url_part(O.normalize(_ABS_SQL), 4)}),
                  rtrim({O.url_part(_BASE_SQL, 4)}, '/'))""")
def q_url_doc_links(spark, sf):
    a = _anchor_rows(with_nodes(_pages(spark, sf).select("page_id", "url", "html")), "nodes")
    base = F.concat(_site_root(F.col("url")), F.lit("/"),
                    F.split_part(F.regexp_replace(U.url_path("url"), "^/+", ""), F.lit("/"), F.lit(1)))
    link = U.normalize_url(U.resolve_url(U.normalize_url(F.col("url")), F.col("href")))
    return U.materialize_cols(a.select("page_id", "pos", "url", "href"), {"link": link, "_b": base}) \
            .filter(U.is_doc_link(F.col("link"), F.col("_b"))).select("page_id", "pos", "link")


@register("url_slugify", f"SELECT doc_id, {O.slugify('text')} AS slug FROM documents")
def q_url_slugify(spark, sf):
    return S.spread(S.read(spark, sf, "documents")).select("doc_id", T.slugify("text").alias("slug"))


_RAW_SEED = "regexp_replace(url, '^https://', '')"


@register("url_seed_clean", f"""
SELECT page_id, s AS seed, (strpos(s, '.') > 0 AND strpos(s, ' ') = 0) AS valid FROM (
  SELECT page_id, CASE WHEN starts_with(t, 'http://') OR starts_with(t, 'https://') THEN t
                       ELSE 'https://' || t END AS s
  FROM (SELECT page_id, {O.strip(_RAW_SEED)} AS t FROM pages))""")
def q_url_seed_clean(spark, sf):
    raw = F.regexp_replace("url", "^https://", "")
    return _pages(spark, sf).select("page_id", U.seed_clean(raw).alias("seed"),
                                    U.seed_valid(raw).alias("valid"))


_NAME = "(source || ' ' || lang)"


@register("url_download_name", f"""
SELECT doc_id,
       replace({_NAME}, ' ', '_') || '_docs.md' AS single_name,
       {O.slugify(_NAME)} || '_docs.zip' AS zip_name,
       CASE WHEN length(regexp_replace({_NAME}, {O.q('[' + T.JS_WS + ']+')}, '_', 'g')) > 0
            THEN regexp_replace({_NAME}, {O.q('[' + T.JS_WS + ']+')}, '_', 'g') ELSE 'export' END
         || '_docs.md' AS client_name
FROM documents""")
def q_url_download_name(spark, sf):
    n = F.concat_ws(" ", "source", "lang")
    return S.read(spark, sf, "documents").select(
        "doc_id", U.download_name_single(n).alias("single_name"),
        U.download_name_zip(n).alias("zip_name"), U.download_name_client(n).alias("client_name"))


# =============================================================== HTM-*
@register("htm_node_counts", """
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag
  FROM pages) GROUP BY page_id, tag""")
def q_htm_node_counts(spark, sf):
    from ..operators.html_nodes import start_tag_counts
    p = with_nodes(_pages(spark, sf).select("page_id", "html"))
    return p.select("page_id", F.inline(start_tag_counts(F.col("nodes"))))


def _strip_hit_sql():
    g = C._group(C.STRIP_SELECTORS)
    tags = ", ".join(O.q(t) for t in g["tag"])
    cls = ", ".join(O.q(t) for t in g["class"])
    ids = ", ".join(O.q(t) for t in g["id"])
    roles = ", ".join(O.q(t) for t in g["role"])
    return f"""
SELECT page_id, count(*) AS n_elements,
       count(*) FILTER (WHERE tag IN ({tags})
           OR list_has_any(string_split_regex(trim(cls), '\\s+'), [{cls}])
           OR id IN ({ids}) OR role IN ({roles})) AS n_hits
FROM (
  SELECT page_id, lower(regexp_extract(t, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag,
         regexp_extract(t, '\\sclass="([^"]*)"', 1) AS cls,
         regexp_extract(t, '\\sid="([^"]*)"', 1) AS id,
         regexp_extract(t, '\\srole="([^"]*)"', 1) AS role
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z][A-Za-z0-9]*[^>]*>')) AS t
        FROM pages))
GROUP BY page_id"""


@register("htm_strip_counts", _strip_hit_sql())
def q_htm_strip_counts(spark, sf):
    p = with_nodes(_pages(spark, sf).select("page_id", "html"))
    els = F.filter("nodes", lambda n: n.tag != TEXT)
    return p.select("page_id", F.size(els).cast("long").alias("n_elements"),
                    F.size(C.cut_intervals(F.col("nodes"))).cast("long").alias("n_hits"))


_H1 = O.strip(O.entities("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"))


@register("htm_title", f"SELECT page_id, {_H1} AS title FROM pages")
def q_htm_title(spark, sf):
    p = with_nodes(_pages(spark, sf).select("page_id", "html"))
    return p.select("page_id", C.page_title(F.col("nodes")).alias("title"))


_TT = O.strip(O.entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
_SEP = "[" + T.PY_WS + "]*[|\\-–—][" + T.PY_WS + "]*"


@register("htm_title_tag",
          f"SELECT page_id, {O.strip(f'string_split_regex({_TT}, {O.q(_SEP)})[1]')} AS title_tag FROM pages")
def q_htm_title_tag(spark, sf):
    p = with_nodes(_pages(spark, sf).select("page_id", "html"))
    t = C.first_element(F.col("nodes"), "title")
    return p.select("page_id", C.title_from_tag(C.inner_text(F.col("nodes"), t)).alias("title_tag"))


_ART = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


@register("htm_content_text", f"""
SELECT page_id, 'article' AS root_sel, {O.collapse(O.entities(f"regexp_replace({_ART}, '<[^>]*>', ' ', 'g')"))} AS text
FROM pages""")
def q_htm_content_text(spark, sf):
    a = _analyzed(spark, sf)
    names = F.array(*[F.lit(s) for s in C.CONTENT_SELECTORS + ["body"]])
    return a.select("page_id", F.get(names, F.col("root.p")).alias("root_sel"),
                    T.collapse_ws(C.content_text(F.col("content"), F.col("root"))).alias("text"))


def _links(spark, sf, scope):
    a = _analyzed(spark, sf)
    nodes = "kept" if scope == "stripped" else "nodes"
    rows = _anchor_rows(a, nodes)
    cur = U.normalize_url(F.col("url"))
    link = U.normalize_url(U.resolve_url(cur, F.col("href")))
    m = U.materialize_cols(rows, {"dst_url": link, "_base": _site_root(cur)})
    return m.filter(U.is_doc_link(F.col("dst_url"), F.col("_base"))).select("page_id", "pos", "dst_url")


_LINK_SQL = O.normalize(_ABS_SQL)


@register("htm_links_all", f"""
SELECT page_id, pos, {_LINK_SQL} AS dst_url FROM ({_ANCH})
WHERE NOT {O.is_asset(_LINK_SQL)}""")
def q_htm_links_all(spark, sf):
    return _links(spark, sf, "all")


_STRIPPED = ("regexp_replace(html, '(?s)<(nav|header|footer|aside|script|style)[\\s>].*?</(nav|header|footer|aside|script|style)>', '', 'g')")


@register("htm_links_stripped", f"""
SELECT page_id, pos, {_LINK_SQL} AS dst_url FROM ({O.anchors_cte('(SELECT page_id, url, ' + _STRIPPED + ' AS html FROM pages)')})
WHERE NOT {O.is_asset(_LINK_SQL)}""")
def q_htm_links_stripped(spark, sf):
    return _links(spark, sf, "stripped")


@register("htm_abs_links", f"""
SELECT page_id, pos, 'a' AS tag, 'href' AS attr,
       CASE WHEN regexp_matches({O.entities('href')}, '^(data:|mailto:|javascript:|#)') THEN {O.entities('href')}
            ELSE {_ABS_SQL} END AS value
FROM ({_ANCH})""")
def q_htm_abs_links(spark, sf):
    p = with_nodes(_pages(spark, sf).select("page_id", "url", "html"))
    fixed = C.absolutize(F.col("nodes"), F.col("url"))
    els = F.filter(fixed, lambda n: n.tag.isin("a", "img", "source"))
    rows = p.select("page_id", F.posexplode(els).alias("pos", "n"))
    attr = F.when(F.col("n.tag") == "a", F.lit("href")).when(F.col("n.tag") == "img", F.lit("src")) \
            .otherwise(F.lit("srcset"))
    # number anchors among a[href] only, as the oracle's regex does
    out = rows.select("page_id", F.col("n.tag").alias("tag"), attr.alias("attr"),
                      F.col("n.attrs")[attr].alias("value"), "pos").filter(F.col("value").isNotNull())
    from pyspark.sql import Window
    w = Window.partitionBy("page_id", "tag").orderBy("pos")
    return out.withColumn("pos", F.row_number().over(w).cast("long")) \
              .select("page_id", "pos", "tag", "attr", "value")


# =============================================================== HTM-9/10/12
_PAD = "'  ' || chr(10) || ' ' || text || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || '  '"


@register("md_clean", f"SELECT doc_id, {O.clean_markdown(_PAD)} AS cleaned FROM documents")
def q_md_clean(spark, sf):
    pad = F.concat(F.lit("  \n "), F.col("text"), F.lit(" \n\n\n\n  "))
    return S.spread(S.read(spark, sf, "documents")).select("doc_id", T.clean_markdown(pad).alias("cleaned"))


@register("md_frontmatter", f"""
SELECT page_id, '---' || chr(10) || 'title: "' || {_H1} || '"' || chr(10) || 'source: "' || {O.normalize('url')}
       || '"' || chr(10) || 'scraped_at: "{SCRAPED_ON}"' || chr(10) || '---' AS frontmatter FROM pages""")
def q_md_frontmatter(spark, sf):
    a = with_nodes(_pages(spark, sf).select("page_id", "url", "html")) \
        .withColumn("title", C.page_title(F.col("nodes")))
    return a.select("page_id", T.frontmatter(F.col("title"), U.normalize_url("url"),
                                             F.lit(SCRAPED_ON)).alias("frontmatter"))


_WITH_FM = "'---' || chr(10) || 'title: \"' || source || '\"' || chr(10) || '---' || chr(10) || chr(10) || text"


@register("md_strip_frontmatter", f"""
SELECT doc_id, {O.strip_frontmatter(_WITH_FM)} AS with_block, {O.strip_frontmatter('text')} AS without_block
FROM documents""")
def q_md_strip_frontmatter(spark, sf):
    d = S.spread(S.read(spark, sf, "documents"))
    fm = F.concat(F.lit('---\ntitle: "'), F.col("source"), F.lit('"\n---\n\n'), F.col("text"))
    return d.select("doc_id", T.strip_frontmatter(fm).alias("with_block"),
                    T.strip_frontmatter(F.col("text")).alias("without_block"))


# =============================================================== library
def _docs_lib(spark, sf):
    return S.library_from_documents(spark, sf)


def _conv_lib(spark, sf):
    return S.library_from_conversations(spark, sf)


_DOC_URL = "'https://docs.example.org/' || source || '/' || CAST(doc_id AS VARCHAR)"
_DOCS = (f"(SELECT source AS project_id, doc_id AS position, substring(md5({_DOC_URL}), 1, 10) AS page_id, "
         f"source AS title, {_DOC_URL} AS url, text AS content FROM documents)")
_CONV_PID = "'conv-' || CAST(conv_id AS VARCHAR)"
_CONV_URL = f"'https://chat.example.org/' || {_CONV_PID} || '/' || CAST(turn AS VARCHAR)"
_CONV = (f"(SELECT {_CONV_PID} AS project_id, turn AS position, substring(md5({_CONV_URL}), 1, 10) AS page_id, "
         f"role AS title, {_CONV_URL} AS url, text AS content FROM conversations)")
_PROJ = ("(SELECT project_id, project_id AS name, 'https://docs.example.org/' || project_id AS url, "
         "CAST(count(*) AS INTEGER) AS page_count, TIMESTAMP '" + S.DEFAULT_SCRAPED_AT.isoformat(sep=' ')
         + "' AS scraped_at FROM {lib} GROUP BY project_id)")
# stored text per (project, page_id): last position wins
_STORED = ("(SELECT m.project_id, m.position, m.page_id, m.title, m.url, s.content FROM {lib} m LEFT JOIN "
           "(SELECT project_id, page_id, arg_max(content, position) AS content FROM {lib} GROUP BY ALL) s "
           "USING (project_id, page_id))")


# A library in which page ids repeat and texts are missing: pages of a site in
# one language share an id, a page that was cut off has no text, one asked for
# with a query has an empty one.
_WEB = ("(SELECT replace(" + O.url_part("url", 3) + ", 'www.', '') AS project_id, page_id AS position, "
        "substring(md5(split_part(url, '/', 4)), 1, 10) AS page_id, url AS title, url, "
        "CASE WHEN html NOT LIKE '%</html>' THEN NULL WHEN contains(url, '?') THEN '' ELSE html END AS content FROM pages)")


def _web_lib(spark, sf):
    html = F.col("html")
    return S.read(spark, sf, "pages").select(
        U.project_name("url").alias("project_id"), F.col("page_id").alias("position"),
        F.substring(F.md5(F.split_part("url", F.lit("/"), F.lit(4))), 1, 10).alias("page_id"), F.col("url").alias("title"), "url",
        F.when(~html.endswith("</html>"), None).when(F.col("url").contains("?"), "").otherwise(html).alias("content"))


_WEB_STORED = ("(SELECT m.project_id, m.position, m.page_id, s.content FROM {lib} m JOIN (SELECT project_id, page_id, "
               "arg_max_null(content, position) AS content FROM {lib} GROUP BY ALL) s USING (project_id, page_id))").format(lib=_WEB)


@register("lib_save_last_wins", f"""
SELECT project_id, page_id, max(position) AS position, md5(arg_max_null(content, position)) AS content_md5
FROM {_WEB} GROUP BY project_id, page_id""")
def q_lib_save(spark, sf):
    return L.save_last_wins(_web_lib(spark, sf)).select(
        "project_id", "page_id", "position", F.md5("content").alias("content_md5"))


@register("lib_manifest", f"""
SELECT m.project_id, row_number() OVER (PARTITION BY m.project_id ORDER BY position, page_id) AS entry_no,
       page_id, title, m.url AS page_url, p.page_count
FROM {_DOCS} m JOIN {_PROJ.format(lib=_DOCS)} p USING (project_id)""")
def q_lib_manifest(spark, sf):
    lib = _docs_lib(spark, sf)
    return (L.manifest_entries(lib).join(S.projects_of(lib).select("project_id", "page_count"), "project_id")
            .select("project_id", "entry_no", "page_id", "title", F.col("url").alias("page_url"), "page_count"))


@register("lib_export_single", f"""
SELECT project_id, position,
       CASE WHEN position = min(position) OVER (PARTITION BY project_id) THEN content
            ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || content END AS piece
FROM {_STORED.format(lib=_DOCS)} WHERE content IS NOT NULL AND length(content) > 0""")
def q_lib_export_single(spark, sf):
    return L.export_single_pieces(_docs_lib(spark, sf))


_NN = "CASE WHEN length(CAST(i AS VARCHAR)) < 2 THEN lpad(CAST(i AS VARCHAR), 2, '0') ELSE CAST(i AS VARCHAR) END"


_ENTRY_SQL = f"""
SELECT project_id, position, page_id, content,
       {O.slugify('project_id')} || '/' || {_NN} || '-' || slug ||
       CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END || '.md' AS entry
FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, slug ORDER BY position, page_id) AS k
  FROM (
    SELECT *, {O.slugify('title')} AS slug FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY position, page_id) AS i
      FROM {_STORED.format(lib=_CONV)})
    WHERE content IS NOT NULL AND length(content) > 0))"""


@register("lib_export_multi_names", f"SELECT project_id, position, page_id, entry FROM ({_ENTRY_SQL})")
def q_lib_export_multi(spark, sf):
    lib = _conv_lib(spark, sf)
    return L.export_multi_names(lib, S.projects_of(lib)).select("project_id", "position", "page_id", "entry")


@register("lib_export_entries", f"SELECT entry, md5(content) AS content_md5 FROM ({_ENTRY_SQL})")
def q_lib_export_entries(spark, sf):
    """Every entry is written as a file and read back."""
    from ..operators import entry_files as EF
    from ..session import shared_path
    lib, path = _conv_lib(spark, sf), shared_path(spark, "entries")
    EF.write_entries(L.export_multi_names(lib, S.projects_of(lib)), path)
    return EF.read_entries(spark, path).select("entry", F.md5("content").alias("content_md5"))


@register("lib_payload_names", f"""
SELECT project_id, CASE WHEN length(d) > 0 THEN d ELSE 'docs' END || '_' || project_id || '.json' AS file_name
FROM (SELECT project_id, replace({O.url_part('url', 3)}, ':', '_') AS d FROM
      (SELECT {SQL_ROOT} AS project_id, min(url) AS url FROM pages GROUP BY 1))""")
def q_lib_payload_names(spark, sf):
    sites = _pages(spark, sf).groupBy(_site_root(F.col("url")).alias("project_id")).agg(F.min("url").alias("url"))
    return L.payload_file_name(sites)


@register("lib_export_payload", f"""
SELECT project_id, position,
       CAST(json_object('type', 'text', 'text', 'File: ' || page_id || '.md' || chr(10) || 'Source: ' || url
            || chr(10) || chr(10) || content) AS VARCHAR) AS item
FROM {_STORED.format(lib=_CONV)} WHERE content IS NOT NULL AND length(content) > 0""")
def q_lib_export_payload(spark, sf):
    return L.export_payload_items(_conv_lib(spark, sf))


_BLOCK = ("'- ID: ' || project_id || chr(10) || '  Name: ' || name || chr(10) || '  URL: ' || url || chr(10) "
          "|| '  Pages: ' || coalesce(CAST(page_count AS VARCHAR), 'unknown') || chr(10) || chr(10)")


@register("lib_listing_text", f"""
SELECT '' AS sort_key, {O.q(L.LISTING_HEADER)} AS block
UNION ALL
SELECT project_id AS sort_key, {_BLOCK} AS block FROM {_PROJ.format(lib=_DOCS)}""")
def q_lib_listing(spark, sf):
    return L.listing_blocks(S.projects_of(_docs_lib(spark, sf)))


@register("lib_catalogue", f"""
SELECT project_id, {O.q(L.RESOURCE_SCHEME)} || project_id || {O.q(L.RESOURCE_SUFFIX)} AS uri,
       name || ' Documentation' AS name, 'Scraped markdown for ' || url AS description,
       {O.q(L.RESOURCE_MIME)} AS mime_type
FROM {_PROJ.format(lib=_DOCS)}""")
def q_lib_catalogue(spark, sf):
    return L.catalogue(S.projects_of(_docs_lib(spark, sf)))


@register("lib_list", f"SELECT project_id, name, url, page_count FROM {_PROJ.format(lib=_DOCS)}")
def q_lib_list(spark, sf):
    lib = _docs_lib(spark, sf)
    return L.list_projects(S.projects_of(lib), lib).select("project_id", "name", "url", "page_count")


@register("lib_get_project", f"""
SELECT project_id, name, url, page_count FROM {_PROJ.format(lib=_DOCS)} WHERE project_id = 'src3'""")
def q_lib_get_project(spark, sf):
    return L.get_project(S.projects_of(_docs_lib(spark, sf)), "src3") \
            .select("project_id", "name", "url", "page_count")


@register("lib_get_page", f"""
SELECT s.project_id, s.page_id, s.content FROM
  (SELECT project_id, arg_min(page_id, position) AS page_id FROM {_DOCS} GROUP BY project_id) r
  JOIN (SELECT project_id, page_id, arg_max(content, position) AS content FROM {_DOCS} GROUP BY ALL) s
  USING (project_id, page_id)""")
def q_lib_get_page(spark, sf):
    lib = _docs_lib(spark, sf)
    req = lib.groupBy("project_id").agg(F.min_by("page_id", "position").alias("page_id"))
    return LS.get_pages(LS.save(lib), req).select("project_id", "page_id", "content")


@register("lib_search", f"""
SELECT project_id, position, page_id FROM {_STORED.format(lib=_DOCS)}
WHERE content IS NOT NULL AND length(content) > 0 AND contains(lower(content), lower({O.q(SEARCH_TERM)}))""")
def q_lib_search(spark, sf):
    return L.search(_docs_lib(spark, sf), SEARCH_TERM)


_SEARCH_MANY = f"""
SELECT b.item_id, s.project_id, s.position
FROM {_STORED.format(lib=_DOCS)} s JOIN benchmark b ON contains(lower(s.content), lower(b.text))
WHERE s.content IS NOT NULL AND length(s.content) > 0"""


@register("lib_search_many", _SEARCH_MANY)
def q_lib_search_many(spark, sf):
    terms = S.read(spark, sf, "benchmark").select("item_id", F.col("text").alias("term"))
    return L.search_many(_docs_lib(spark, sf), terms).select("item_id", "project_id", "position")


@register("lib_store_search", _SEARCH_MANY)
def q_lib_store_search(spark, sf):
    terms = S.read(spark, sf, "benchmark").select("item_id", F.col("text").alias("term"))
    store = LS.save(_docs_lib(spark, sf))
    LS.index_grams(store)
    return LS.search_many(store, terms).select("item_id", "project_id", "position")


@register("lib_first_match", f"""
SELECT project_id, arg_min(page_id, (position, page_id)) AS first_page_id, count(*) AS n_matches
FROM {_STORED.format(lib=_DOCS)}
WHERE content IS NOT NULL AND length(content) > 0 AND contains(lower(content), lower({O.q(SEARCH_TERM)}))
GROUP BY project_id""")
def q_lib_first_match(spark, sf):
    return L.first_match(_docs_lib(spark, sf), SEARCH_TERM)


_HT = O.q(HIT_TERM.strip())
_BODY = f"lower({O.strip_frontmatter('content')})"


@register("lib_hit_counts", f"""
SELECT project_id, page_id, hits, first_offset FROM (
  SELECT project_id, page_id,
         (length({_BODY}) - length(replace({_BODY}, {_HT}, ''))) // length({_HT}) AS hits,
         strpos({_BODY}, {_HT}) AS first_offset
  FROM (SELECT project_id, page_id, arg_max(content, position) AS content FROM {_CONV} GROUP BY ALL)
  WHERE content IS NOT NULL) WHERE hits > 0""")
def q_lib_hit_counts(spark, sf):
    return L.hit_counts(_conv_lib(spark, sf), HIT_TERM)


_DEL = ", ".join(O.q(x) for x in DELETE_IDS)


@register("lib_delete", f"""
SELECT project_id, count(*) AS pages_left FROM {_DOCS} WHERE project_id NOT IN ({_DEL}) GROUP BY project_id""")
def q_lib_delete(spark, sf):
    lib = _docs_lib(spark, sf)
    dels = spark.createDataFrame([(x,) for x in DELETE_IDS], "project_id string")
    left, _, _ = L.delete_projects(lib, S.projects_of(lib), dels)
    return left.groupBy("project_id").agg(F.count(F.lit(1)).alias("pages_left"))


@register("lib_delete_answers", f"""
SELECT d.project_id, p.project_id IS NOT NULL AS existed
FROM (SELECT unnest([{_DEL}]) AS project_id) d LEFT JOIN {_PROJ.format(lib=_DOCS)} p USING (project_id)""")
def q_lib_delete_answers(spark, sf):
    lib = _docs_lib(spark, sf)
    dels = spark.createDataFrame([(x,) for x in DELETE_IDS], "project_id string")
    return L.delete_projects(lib, S.projects_of(lib), dels)[2]


@register("lib_missing_pages", f"""
SELECT project_id, position, page_id, CASE WHEN content IS NULL THEN 'missing' ELSE 'empty' END AS problem
FROM {_WEB_STORED} WHERE content IS NULL OR length(content) = 0""")
def q_lib_missing(spark, sf):
    return L.missing_pages(_web_lib(spark, sf))


@register("lib_store_entries", f"""
SELECT project_id, position, page_id, md5(content) AS content_md5 FROM {_WEB_STORED}""")
def q_lib_store_entries(spark, sf):
    return LS.entries(LS.save(_web_lib(spark, sf))).select("project_id", "position", "page_id", F.md5("content").alias("content_md5"))


@register("lib_store_missing", f"""
SELECT project_id, position, page_id, CASE WHEN content IS NULL THEN 'missing' ELSE 'empty' END AS problem
FROM {_WEB_STORED} WHERE content IS NULL OR length(content) = 0""")
def q_lib_store_missing(spark, sf):
    return LS.missing_pages(LS.save(_web_lib(spark, sf)))


@register("lib_cards", f"""
SELECT project_id, name, url, page_count, strftime(scraped_at, '%b %-d, %Y') AS scraped_on,
       CAST(count(*) OVER () AS VARCHAR) || CASE WHEN count(*) OVER () = 1 THEN ' project' ELSE ' projects' END
         AS library_total
FROM {_PROJ.format(lib=_DOCS)}""")
def q_lib_cards(spark, sf):
    return L.cards(S.projects_of(_docs_lib(spark, sf)))


@register("lib_page_count", f"SELECT project_id, count(*) AS page_count FROM {_CONV} GROUP BY project_id")
def q_lib_page_count(spark, sf):
    return L.page_counts(_conv_lib(spark, sf))


# =============================================================== jobs
_EV = ("(SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'started' "
       "WHEN 'view' THEN 'page_scraped' WHEN 'click' THEN 'converting' WHEN 'purchase' THEN 'complete' "
       "WHEN 'error' THEN 'error' END AS event, props AS payload FROM events)")


def _ev(spark, sf):
    return S.job_events(spark, sf)


@register("job_running_counts", f"""
SELECT job_id, event_id, ts, scraped, queued FROM (
  SELECT *, count(*) FILTER (WHERE event = 'page_scraped') OVER w AS scraped,
         CAST(1 + sum(CASE WHEN event = 'page_scraped' THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) - 1 ELSE 0 END) OVER w AS BIGINT) AS queued
  FROM {_EV} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE event = 'page_scraped'""")
def q_job_running(spark, sf):
    return J.running_counts(_ev(spark, sf))


_PH = ("CASE event WHEN 'started' THEN 'scraping' WHEN 'converting' THEN 'converting' "
       "WHEN 'complete' THEN 'complete' WHEN 'error' THEN 'error' END")


@register("job_latest_phase", f"""
SELECT job_id, last_phase,
       CASE WHEN coalesce(last_phase, 'scraping') IN ('complete', 'error') THEN last_phase ELSE 'error' END AS phase
FROM (SELECT job_id, arg_max({_PH}, (ts, event_id)) FILTER (WHERE {_PH} IS NOT NULL) AS last_phase
      FROM {_EV} GROUP BY job_id)""")
def q_job_phase(spark, sf):
    return J.latest_phase(_ev(spark, sf))


@register("job_latest4", f"""
SELECT * FROM (SELECT job_id, event_id, ts,
       row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rank
FROM {_EV} WHERE event = 'page_scraped') WHERE rank <= 4""")
def q_job_latest4(spark, sf):
    return J.latest_pages(_ev(spark, sf), 4)


@register("job_progress", f"""
SELECT job_id, scraped, least((scraped / {MAX_PAGES}) * 100.0, 95.0) AS progress_pct,
       least(coalesce(q, 0), {MAX_PAGES} - scraped) AS queued_shown
FROM (SELECT job_id, count(*) FILTER (WHERE event = 'page_scraped') AS scraped,
             arg_max(CAST(json_extract_string(payload, '$.k') AS BIGINT), (ts, event_id))
               FILTER (WHERE event = 'page_scraped') AS q
      FROM {_EV} GROUP BY job_id)""")
def q_job_progress(spark, sf):
    return J.progress(_ev(spark, sf), MAX_PAGES)


_CANCEL_SQL = f"""
SELECT e.job_id,
       count(*) FILTER (WHERE c.cts IS NULL OR (e.ts, e.event_id) < c.cts) AS kept_events,
       count(*) FILTER (WHERE (c.cts IS NULL OR (e.ts, e.event_id) < c.cts) AND e.event = 'page_scraped') AS kept_pages,
       bool_or(c.cts IS NOT NULL) AS cancelled,
       CASE WHEN count(*) FILTER (WHERE (c.cts IS NULL OR (e.ts, e.event_id) < c.cts)
                                   AND e.event = 'page_scraped') > 0 THEN 'complete' ELSE 'error' END AS outcome
FROM {_EV} e LEFT JOIN (SELECT job_id, min((ts, event_id)) AS cts FROM {_EV} WHERE event = 'error' GROUP BY job_id) c
  USING (job_id)
GROUP BY e.job_id"""


@register("job_cancel_cut", _CANCEL_SQL)
def q_job_cancel(spark, sf):
    ev = _ev(spark, sf)
    return J.cancel_cut(ev, ev.filter(F.col("event") == "error"))


@register("job_outcome", f"""
SELECT job_id, count(*) FILTER (WHERE event = 'page_scraped') AS scraped,
       count(*) FILTER (WHERE event = 'complete') AS complete_events,
       CASE WHEN count(*) FILTER (WHERE event = 'page_scraped') > 0 THEN 'complete' ELSE 'error' END AS outcome
FROM {_EV} GROUP BY job_id""")
def q_job_outcome(spark, sf):
    return J.outcome(_ev(spark, sf))


_HIST_COLS = ", ".join(f"count(*) FILTER (WHERE event = '{e}') AS \"{e}\"" for e in J.EVENT_TYPES)


@register("job_event_histogram", f"SELECT job_id, {_HIST_COLS} FROM {_EV} GROUP BY job_id")
def q_job_histogram(spark, sf):
    return J.event_histogram(_ev(spark, sf))


@register("job_events_parse", f"""
SELECT job_id, 3 * row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) + 1 AS line_no,
       event, payload FROM {_EV}""")
def q_job_events_parse(spark, sf):
    return J.parse_event_log(J.event_log_lines(_ev(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import crawl_queries  # noqa: F401  (registers crawl / stream / render queries)
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    from . import crawl_queries  # noqa: F401
    return dict(ORACLE)
