"""Crawl, render and stream queries (registered into the same registry)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as CR
from ..sources import tables as S
from . import oracle_sql as O
from ..sources.sitemaps import URLS_PER_FILE
from .queries import _CONV, _DOCS, register

# ------------------------------------------------------------ TPC-H graph
_EDGES_SQL = """
  SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS src, 'c' || CAST(c_custkey AS VARCHAR) AS dst,
         CAST(c_custkey AS BIGINT) AS pos FROM customer
  UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR),
         CAST(o_orderkey AS BIGINT) FROM orders
  UNION ALL SELECT DISTINCT 'o' || CAST(l_orderkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR),
         CAST(l_suppkey AS BIGINT) FROM lineitem
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR),
         CAST(s_nationkey AS BIGINT) FROM supplier"""

BFS_DEPTH = 3


def _graph_bfs(spark, sf, seeds_df, max_depth=BFS_DEPTH, with_seq=False):
    return CR.bfs(seeds_df, S.graph_edges(spark, sf), max_depth=max_depth, with_seq=with_seq)


def _customer_seeds(spark, sf):
    """One crawl for each customer, from its own node."""
    node = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return S.read(spark, sf, "customer").select(node.alias("project_id"), node.alias("url"), F.lit(0).cast("long").alias("seq"))


@register("crw_bfs_depth", f"""
WITH RECURSIVE e AS ({_EDGES_SQL}),
b(project_id, node, depth) AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), 0 FROM customer
  UNION
  SELECT b.project_id, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < {BFS_DEPTH})
SELECT project_id, node AS url, min(depth) AS depth FROM b GROUP BY project_id, node""")
def q_crw_bfs_depth(spark, sf):
    return _graph_bfs(spark, sf, _customer_seeds(spark, sf)).select("project_id", "url", "depth")


@register("crw_bfs_order", f"""
WITH RECURSIVE e AS ({_EDGES_SQL}),
b(project_id, node, depth, k) AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), 0, CAST([] AS BIGINT[]) FROM customer
  UNION
  SELECT b.project_id, e.dst, b.depth + 1, list_append(b.k, e.pos) FROM b JOIN e ON e.src = b.node
  WHERE b.depth < {BFS_DEPTH}),
m AS (SELECT project_id, node, min(depth) AS depth FROM b GROUP BY project_id, node),
f AS (SELECT b.project_id, b.node, b.depth, min(b.k) AS k FROM b JOIN m USING (project_id, node, depth)
      GROUP BY b.project_id, b.node, b.depth)
SELECT project_id, node AS url, depth,
       row_number() OVER (PARTITION BY project_id, depth ORDER BY k) AS seq,
       row_number() OVER (PARTITION BY project_id ORDER BY depth, k) AS crawl_pos
FROM f""")
def q_crw_bfs_order(spark, sf):
    v = _graph_bfs(spark, sf, _customer_seeds(spark, sf), with_seq=True)
    return CR.crawl_order(v).select("project_id", "url", "depth", "seq", "crawl_pos")


@register("crw_bfs_bulk", f"""
WITH RECURSIVE e AS ({_EDGES_SQL}),
b(node, depth) AS (
  SELECT DISTINCT 'n' || CAST(n_nationkey AS VARCHAR), 0 FROM nation
  UNION
  SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < {BFS_DEPTH})
SELECT 'all-nations' AS project_id, depth, count(*) AS nodes FROM
  (SELECT node, min(depth) AS depth FROM b GROUP BY node) GROUP BY depth""")
def q_crw_bfs_bulk(spark, sf):
    seeds = S.read(spark, sf, "nation").select(
        F.lit("all-nations").alias("project_id"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("url"),
        F.col("n_nationkey").cast("long").alias("seq"))
    v = _graph_bfs(spark, sf, seeds)
    return v.groupBy("project_id", "depth").agg(F.count(F.lit(1)).alias("nodes"))


# ------------------------------------------------------------ page archive
SITE_SQL = f"lower({O.url_part('url', 1)}) || '://' || {O.url_part('url', 3)}"
PAGE_CAP = 3


def _site(url):
    return F.concat(U.url_scheme(url), F.lit("://"), U.url_authority(url))


@register("crw_page_cap", f"""
SELECT project_id, page_id, r AS rank FROM (
  SELECT {SITE_SQL} AS project_id, page_id, row_number() OVER (PARTITION BY {SITE_SQL} ORDER BY page_id) AS r
  FROM pages) WHERE r <= {PAGE_CAP}""")
def q_crw_page_cap(spark, sf):
    p = S.page_archive(spark, sf).select(_site(F.col("url")).alias("project_id"), "page_id")
    return CR.page_cap(p.withColumn("seq", F.col("page_id")), n=PAGE_CAP, order=("seq",),
                       rank_col="rank").select("project_id", "page_id", "rank")


@register("crw_first_seen", f"""
SELECT {SITE_SQL} AS project_id, url, min(page_id) AS seq FROM pages
WHERE NOT {O.is_asset('url')} GROUP BY ALL""")
def q_crw_first_seen(spark, sf):
    p = S.page_archive(spark, sf).select(_site(F.col("url")).alias("project_id"), "url",
                                         F.col("page_id").alias("seq"))
    fs = CR.first_seen(p)
    return fs.filter(U.is_doc_link(F.col("url"), F.col("project_id"))).select("project_id", "url", "seq")


@register("crw_seeds", f"""
SELECT project_id, url, row_number() OVER (PARTITION BY project_id ORDER BY s) AS seq FROM (
  SELECT project_id, url, min(s) AS s FROM (
    SELECT DISTINCT {SITE_SQL} AS project_id, {SITE_SQL} AS url, 0 AS s FROM pages
    UNION ALL
    SELECT {SITE_SQL}, {O.normalize('url')}, page_id + 1 FROM pages
     WHERE {O.normalize('url')} <> {SITE_SQL})
  GROUP BY ALL)""")
def q_crw_seeds(spark, sf):
    p = S.page_archive(spark, sf).select(_site(F.col("url")).alias("project_id"), "url", "page_id")
    req = p.select("project_id", F.col("project_id").alias("url")).distinct()
    disc = p.select("project_id", "url", F.col("page_id").alias("seq"))
    sd = CR.seeds(req, disc)
    first = sd.groupBy("project_id", "url").agg(F.min("seq").alias("_s"))
    from ..operators.scan import running_count
    return running_count(first, ["project_id"], ["_s", "url"], out="seq").drop("_s")


def _site_crawl(spark, sf, scope, max_depth, max_pages=None):
    arch = S.page_archive(spark, sf)
    p = arch.select(_site(F.col("url")).alias("project_id"), "url", "page_id")
    req = p.select("project_id", F.col("project_id").alias("url")).distinct() \
           .withColumn("name", F.lit(None).cast("string")) \
           .withColumn("max_pages", F.lit(max_pages).cast("int")).withColumn("max_depth", F.lit(max_depth))
    disc = p.select("project_id", "url", F.col("page_id").alias("seq"))
    return CR.crawl_job(spark, req, arch, sitemap_urls=disc, scope=scope)


_NORM_PAGES = f"(SELECT {SITE_SQL} AS project_id, {O.normalize('url')} AS url FROM pages)"
# one archive row per normalized URL (lowest page_id), as a crawl fetches it once
_UNIQUE_PAGES = (f"(SELECT * FROM pages WHERE page_id IN (SELECT min(page_id) FROM pages "
                 f"GROUP BY {O.normalize('url')}))")
_LINKS = (f"(SELECT {SITE_SQL} AS project_id, {O.normalize('url')} AS src, pos, "
          f"{O.normalize(SITE_SQL + ' || ' + O.entities('href'))} AS dst FROM ({O.anchors_cte(_UNIQUE_PAGES)}))")


@register("crw_outcomes", f"""
WITH seeds AS (
  SELECT DISTINCT {SITE_SQL} AS project_id, {SITE_SQL} AS url FROM pages
  UNION SELECT project_id, url FROM {_NORM_PAGES}),
lvl1 AS (
  SELECT DISTINCT l.project_id, l.dst AS url FROM {_LINKS} l
  JOIN seeds s ON s.project_id = l.project_id AND s.url = l.src
  WHERE NOT {O.is_asset('l.dst')} AND {O.url_part('l.dst', 3)} = {O.url_part('l.project_id', 3)}
  EXCEPT SELECT project_id, url FROM seeds),
v AS (SELECT project_id, url, 0 AS depth FROM seeds UNION ALL SELECT project_id, url, 1 FROM lvl1)
SELECT v.project_id, v.url, v.depth,
       CASE WHEN v.url IN (SELECT url FROM {_NORM_PAGES}) THEN 'scraped' ELSE 'error' END AS outcome
FROM v""")
def q_crw_outcomes(spark, sf):
    job = _site_crawl(spark, sf, "all", 1)
    o = CR.outcomes(job["visits"], job["index"], job["analyzed"])
    return o.select("project_id", "url", "depth", "outcome")


@register("crw_edge_stats", f"""
SELECT src, count(*) AS out_degree, count(DISTINCT dst) AS distinct_targets,
       count(DISTINCT dst) FILTER (WHERE dst NOT IN (SELECT url FROM {_NORM_PAGES})) AS dangling
FROM {_LINKS} GROUP BY src""")
def q_crw_edge_stats(spark, sf):
    arch = S.page_archive(spark, sf)
    an = CR.analyzed_archive(arch, scope="all")
    return CR.edge_stats(CR.page_links(an), CR.archive_index(arch))


@register("crw_in_degree", f"""
SELECT dst, count(*) AS in_degree FROM {_LINKS} GROUP BY dst""")
def q_crw_in_degree(spark, sf):
    return CR.in_degree(CR.page_links(CR.analyzed_archive(S.page_archive(spark, sf), scope="all")))


@register("crw_capped_outcomes", f"""
WITH seeds AS (
  SELECT project_id, url, min(k) AS k FROM (
    SELECT {SITE_SQL} AS project_id, {SITE_SQL} AS url, -1 AS k FROM pages
    UNION ALL SELECT {SITE_SQL}, {O.normalize('url')}, page_id FROM pages)
  GROUP BY project_id, url),
o AS (
  SELECT *, url IN (SELECT url FROM {_NORM_PAGES}) AS there FROM seeds),
n AS (
  SELECT *, count(*) FILTER (there) OVER (PARTITION BY project_id ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - there::INT AS before FROM o)
SELECT project_id, url, CASE WHEN there THEN 'scraped' ELSE 'error' END AS outcome FROM n WHERE before < {PAGE_CAP}""")
def q_crw_capped_outcomes(spark, sf):
    """CRW-9 with a page cap that bites: visits end at the page that fills it."""
    job = _site_crawl(spark, sf, "all", 0, max_pages=PAGE_CAP)
    return CR.outcomes(job["visits"], job["index"], job["analyzed"]).select("project_id", "url", "outcome")


def _sitemap_crawl(spark, sf):
    """Sites publish sitemaps for their archived pages; every request follows
    links, and those whose site name has an even length ask for the sitemap."""
    from ..sources.sitemaps import sitemaps_from_archive
    arch = S.page_archive(spark, sf)
    site = _site(F.col("url"))
    req = arch.select(site.alias("project_id")).distinct().select(
        "project_id", F.col("project_id").alias("url"), F.lit(None).cast("string").alias("name"),
        F.lit(PAGE_CAP).alias("max_pages"), F.lit(2).alias("max_depth"), (F.length("project_id") % 2 == 0).alias("use_sitemap"))
    return CR.crawl_job(spark, req, arch, scope="all", sitemaps=sitemaps_from_archive(arch))


# All archived pages of a site are in its sitemap, so they are seeds; of those the
# first PAGE_CAP by place in the sitemap are the crawl's pages.
_JOB_PAGES = f"""
  SELECT project_id, position, substring(md5(url), 1, 10) AS page_id, url, 0 AS depth, title FROM (
    SELECT project_id, url, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS position, title FROM (
      SELECT {SITE_SQL} AS project_id, {O.normalize('url')} AS url, min(page_id) AS seq,
             arg_min({O.strip(O.entities("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"))}, page_id) AS title
      FROM pages WHERE NOT {O.is_asset('url')} GROUP BY 1, 2)
    WHERE length(project_id) % 2 = 0) WHERE position <= {PAGE_CAP}"""


@register("crw_job_summary", f"""
SELECT s.project_id, replace({O.url_part('s.project_id', 3)}, 'www.', '') AS name, s.project_id AS url,
       coalesce(n, 0) AS page_count, CASE WHEN n > 0 THEN 'ok' ELSE 'failed' END AS status
FROM (SELECT DISTINCT {SITE_SQL} AS project_id FROM pages) s
LEFT JOIN (SELECT project_id, count(*) AS n FROM ({_JOB_PAGES}) GROUP BY 1) USING (project_id)""")
def q_crw_job_summary(spark, sf):
    return _sitemap_crawl(spark, sf)["summary"]


@register("crw_job_pages", f"SELECT project_id, position, page_id, url, depth, title FROM ({_JOB_PAGES})")
def q_crw_job_pages(spark, sf):
    return _sitemap_crawl(spark, sf)["pages"].select("project_id", "position", "page_id", "url", "depth", "title")


# ------------------------------------------------------------ render / convert
SCRAPED_ON = S.DEFAULT_SCRAPED_AT.strftime("%Y-%m-%d")


def _analyzed_pages(spark, sf):
    from ..operators.content import analyze_pages
    from ..operators.html_nodes import with_nodes
    p = with_nodes(S.page_archive(spark, sf).select("page_id", "url", "html"))
    return analyze_pages(p).withColumn("url", U.normalize_url(F.col("url")))


@register("htm_markdown")
def q_htm_markdown(spark, sf):
    from ..operators.markdown import render_table
    a = _analyzed_pages(spark, sf).filter(F.col("root").isNotNull())
    return render_table(a, ["page_id"], url_col=None, out="markdown")


@register("htm_convert")
def q_htm_convert(spark, sf):
    from ..operators.markdown import convert_pages
    a = _analyzed_pages(spark, sf).filter(F.col("root").isNotNull())
    return convert_pages(a, SCRAPED_ON, keep=["page_id", "url", "title"]) \
        .select("page_id", "url", "title", "markdown")


@register("crw_job_library")
def q_crw_job_library(spark, sf):
    """Whole crawl job: discover -> BFS -> cap -> last write per page id ->
    convert -> library rows (pages overwritten by a later one are never
    rendered)."""
    from ..operators.markdown import convert_pages
    job = _site_crawl(spark, sf, "stripped", 3)
    lib = convert_pages(CR.last_writes(job), SCRAPED_ON, keep=["project_id", "page_id", "position", "title", "url"])
    return lib.select("project_id", "page_id", "position", "title",
                      F.length("markdown").alias("chars"))


# ------------------------------------------------------------ streams
_PH_SQL = ("CASE event_type WHEN 'signup' THEN 'scraping' WHEN 'click' THEN 'converting' "
           "WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' END")


@register("str_progress", f"""
SELECT user_id AS job_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'view') AS scraped,
       CASE WHEN coalesce(arg_max({_PH_SQL}, (ts, event_id)) FILTER (WHERE {_PH_SQL} IS NOT NULL), 'scraping')
                 IN ('complete', 'error')
            THEN arg_max({_PH_SQL}, (ts, event_id)) FILTER (WHERE {_PH_SQL} IS NOT NULL) ELSE 'error' END AS phase
FROM events GROUP BY user_id""")
def q_str_progress(spark, sf):
    from ..streaming.progress import event_stream, run_live_progress
    return run_live_progress(spark, event_stream(spark, sf))


@register("str_phase", f"""
SELECT job_id, last_phase, CASE WHEN last_phase IN ('complete', 'error') THEN last_phase ELSE 'error' END AS phase, scraped FROM (
  SELECT user_id AS job_id, arg_max({_PH_SQL}, (ts, event_id)) FILTER (WHERE {_PH_SQL} IS NOT NULL) AS last_phase,
         count(*) FILTER (WHERE event_type = 'view') AS scraped FROM events GROUP BY user_id)""")
def q_str_phase(spark, sf):
    """Several micro-batches, events up to an hour late; one final row a job."""
    from ..streaming.progress import run_phase_machine, table_feed
    return run_phase_machine(spark, table_feed(spark, sf))


@register("str_convert")
def q_str_convert(spark, sf):
    from ..streaming.progress import run_incremental_convert
    return run_incremental_convert(spark, sf, SCRAPED_ON).select(
        "project_id", "page_id", "url", "title", F.length("markdown").alias("chars"))


@register("str_dedupe", f"""
SELECT DISTINCT {SITE_SQL} AS project_id, {O.normalize('url')} AS url FROM pages""")
def q_str_dedupe(spark, sf):
    from ..streaming.progress import run_visited_dedupe, visits_feed
    return run_visited_dedupe(spark, visits_feed(spark, sf)).select("project_id", "url")


@register("str_event_log", """
SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'started'
       WHEN 'view' THEN 'page_scraped' WHEN 'click' THEN 'converting' WHEN 'purchase' THEN 'complete'
       WHEN 'error' THEN 'error' END AS event, props AS payload FROM events""")
def q_str_event_log(spark, sf):
    from ..streaming.progress import run_event_drain, table_feed
    return run_event_drain(spark, table_feed(spark, sf)).select("job_id", "event_id", "ts", "event", "payload")


# ------------------------------------------------------------ sitemaps
@register("crw_sitemap_urls", f"""
SELECT project_id, url, row_number() OVER (PARTITION BY project_id ORDER BY k) AS seq FROM (
  SELECT {SITE_SQL} AS project_id, url, min(page_id) AS k FROM pages GROUP BY ALL)
WHERE NOT {O.is_asset('url')} AND {O.url_part('url', 3)} = {O.url_part('project_id', 3)}""")
def q_crw_sitemap_urls(spark, sf):
    """Sites publish sitemaps for their archived pages (built by Spark from
    the archive); discovery walks index -> files -> URLs per site."""
    from ..sources.sitemaps import discover, sitemaps_from_archive
    arch = S.page_archive(spark, sf)
    docs = sitemaps_from_archive(arch)
    req = arch.select(_site(F.col("url")).alias("project_id")).distinct() \
              .withColumn("url", F.col("project_id")).withColumn("max_files", F.lit(None).cast("int"))
    return discover(req, docs).select("project_id", "url", "seq")


# ------------------------------------------------------------ file sources
# Spark writes the files from the tables; the readers under test read them.
PART = r"part-\d+-[0-9a-f]+"


def _files(spark, entries, name):
    """Folder pattern below which the entries (entry, content) are files."""
    from ..operators import entry_files as EF
    from ..session import shared_path
    path = shared_path(spark, name)
    EF.write_entries(entries, path)
    return path + "/part-*"


_SM_SQL = f"""
  SELECT {SITE_SQL} AS site, url, row_number() OVER (PARTITION BY {SITE_SQL} ORDER BY page_id, url) - 1 AS n FROM pages"""


@register("src_sitemap_files", f"""
WITH p AS ({_SM_SQL}), f AS (SELECT DISTINCT site, n // {URLS_PER_FILE} + 1 AS chunk FROM p)
SELECT 'files://sites/' || replace(site, '://', '/') || '/sitemap-' || CAST(n // {URLS_PER_FILE} + 1 AS VARCHAR) || '.xml' AS url,
       'url' AS kind, CAST(n % {URLS_PER_FILE} + 1 AS INTEGER) AS pos, url AS loc FROM p
UNION ALL SELECT 'files://sites/' || replace(site, '://', '/') || '/sitemap.xml', 'sitemap', CAST(chunk AS INTEGER),
       site || '/sitemap-' || CAST(chunk AS VARCHAR) || '.xml' FROM f""")
def q_src_sitemap_files(spark, sf):
    """SRC-2: sitemap files of all sites, scanned and parsed."""
    from ..sources.sitemaps import decode_bodies, parse_sitemaps, read_sitemap_files, sitemaps_from_archive
    docs = sitemaps_from_archive(S.page_archive(spark, sf))
    at = _files(spark, docs.select(F.replace("url", F.lit("://"), F.lit("/")).alias("entry"), F.col("body").alias("content")), "sitemap-files")
    return parse_sitemaps(decode_bodies(read_sitemap_files(spark, at, "files://sites", PART))).select("url", "kind", "pos", "loc")


@register("src_manifest_files", f"""
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY position) AS INTEGER) AS position, page_id, title, url FROM {_CONV}""")
def q_src_manifest_files(spark, sf):
    """SRC-3: a manifest file for each project, scanned."""
    from ..operators import library as L
    from ..sources.library_files import read_manifests
    lib = S.library_from_conversations(spark, sf)
    docs = L.manifest_json(lib, S.projects_of(lib))
    at = _files(spark, docs.select(F.concat("project_id", F.lit("/manifest.json")).alias("entry"), F.col("manifest").alias("content")), "manifests")
    return read_manifests(spark, at)[1]


@register("src_markdown_files", f"""
SELECT project_id, page_id, md5(content) AS content_md5 FROM {_DOCS} WHERE length(content) > 0""")
def q_src_markdown_files(spark, sf):
    """SRC-4: a Markdown file for each page, scanned."""
    from ..sources.library_files import read_markdown
    lib = S.library_from_documents(spark, sf).filter(F.length("content") > 0)
    at = _files(spark, lib.select(F.concat("project_id", F.lit("/"), "page_id", F.lit(".md")).alias("entry"), "content"), "markdown-files")
    return read_markdown(spark, at).select("project_id", "page_id", F.md5("content").alias("content_md5"))


# a page for each document: its text in a code block, whose classes name the language or don't
@register("htm_code_blocks", """
SELECT doc_id AS page_id, CAST(0 AS INTEGER) AS block, CASE doc_id % 4 WHEN 3 THEN NULL ELSE lower(lang) END AS language, md5(text) AS text_md5
FROM documents WHERE text IS NOT NULL""")
def q_htm_code_blocks(spark, sf):
    """HTM-7: language and text of every code block."""
    from ..operators.content import code_blocks
    from ..operators.html_nodes import with_nodes
    from ..sources.sitemaps import xml_escape
    kind = F.col("doc_id") % 4
    cls = (F.when(kind == 0, F.concat(F.lit("language-"), "lang")).when(kind == 1, F.concat(F.lit("hl Lang-"), F.upper("lang")))
           .when(kind == 2, F.concat(F.lit("highlight-"), "lang", F.lit(" lang-x"))).otherwise(F.lit("plain")))
    pages = S.read(spark, sf, "documents").filter(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("<main><p>one</p><pre class='"), cls, F.lit("'><code>"), xml_escape(F.col("text")), F.lit("</code></pre></main>")).alias("html"))
    rows = with_nodes(S.spread(pages)).select("page_id", F.posexplode(code_blocks(F.col("nodes"))).alias("block", "b"))
    return rows.select("page_id", "block", F.col("b.language").alias("language"), F.md5("b.text").alias("text_md5"))


@register("job_skip_histogram", f"""
WITH seeds AS (
  SELECT DISTINCT {SITE_SQL} AS project_id, {SITE_SQL} AS url FROM pages
  UNION SELECT project_id, url FROM {_NORM_PAGES}),
lvl1 AS (
  SELECT DISTINCT l.project_id, l.dst AS url FROM {_LINKS} l
  JOIN seeds s ON s.project_id = l.project_id AND s.url = l.src
  WHERE NOT {O.is_asset('l.dst')} AND {O.url_part('l.dst', 3)} = {O.url_part('l.project_id', 3)}
  EXCEPT SELECT project_id, url FROM seeds),
v AS (SELECT project_id, url FROM seeds UNION ALL SELECT project_id, url FROM lvl1),
o AS (SELECT project_id, CASE WHEN url IN (SELECT url FROM {_NORM_PAGES}) THEN 'scraped' ELSE 'error' END AS reason
      FROM v)
SELECT project_id,
       count(*) FILTER (WHERE reason = 'not_html') AS not_html,
       count(*) FILTER (WHERE reason = 'error') AS error,
       count(*) FILTER (WHERE reason = 'playwright_not_installed') AS playwright_not_installed
FROM o GROUP BY project_id""")
def q_job_skip_histogram(spark, sf):
    """JOB-7 on the crawl's own skip events: per crawl, skips by reason
    (the server drops these events; the crawl outcomes keep them)."""
    from ..operators.jobs import SKIP_REASONS, event_histogram
    job = _site_crawl(spark, sf, "all", 1)
    o = CR.outcomes(job["visits"], job["index"], job["analyzed"])
    skips = o.select(F.col("project_id").alias("job_id"), F.col("outcome").alias("reason"))
    return event_histogram(skips, SKIP_REASONS, col="reason").withColumnRenamed("job_id", "project_id")


from .queries import _CANCEL_SQL  # noqa: E402


@register("str_cancel_cut", _CANCEL_SQL)
def q_str_cancel_cut(spark, sf):
    from ..streaming.progress import run_cancel_cut, table_feed
    return run_cancel_cut(spark, table_feed(spark, sf))
