"""Discovery and crawl (CRW-3..11) over an archive table.

The reference pops a FIFO queue one URL at a time. Its result is the same
as a level-synchronous breadth-first search where, inside a level, nodes
are ordered by (parent's order, link position): a URL reached from several
parents takes its first queue slot, and a URL already visited at a
shallower depth is dropped. So the crawl is a driver loop of DataFrame
steps, one per depth:

    frontier(d) JOIN links ON url           -- expand
    -> per (project, dst): min(parent_seq, position)   (partial aggregate)
    -> LEFT ANTI JOIN visited                 -- each URL once
    -> rank per project by (parent_seq, position)      (skew-safe, scan.py)
    -> checkpoint                             -- lineage cut per level

The driver reads one count per level. Every key carries ``project_id``, so
one job crawls any number of sites. The page cap stops a project once it
has ``max_pages`` content-bearing pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import is_doc_link, normalize_url, page_id, project_name, resolve_url
from .content import analyze_pages, anchors
from .html_nodes import with_nodes
from .scan import bounded_broadcast, running_count
from ..sources.archive import html_gate


# ------------------------------------------------------------------ archive
def archive_index(archive: DataFrame) -> DataFrame:
    """Archive keyed by normalized URL (a fetch never sends the fragment).

    Rows that normalize alike keep the lowest ``page_id``. The HTML is not
    shuffled for that: a partial aggregate over (url_key, page_id) finds the
    keys that occur more than once -- normally few, so AQE broadcasts them --
    and only the losing rows are dropped. Adds ``kept``/``reason``.
    """
    g = html_gate(archive).withColumn("url_key", normalize_url(F.col("url")))
    dups = bounded_broadcast(
        g.groupBy("url_key").agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_win"))
         .filter(F.col("_n") > 1).select("url_key", "_win"))
    return (g.join(dups, "url_key", "left")
             .filter(F.col("_win").isNull() | (F.col("page_id") == F.col("_win")))
             .drop("_win"))


def analyzed_archive(archive: DataFrame, scope: str = "stripped", content_selectors=None, strip_selectors=None) -> DataFrame:
    """Per archived page: title, content root, stored HTML nodes and the
    hrefs of its links (``scope='stripped'`` as the reference: links inside
    removed furniture are not followed; ``'all'`` keeps them)."""
    idx = archive_index(archive)
    ok = idx.filter("kept")
    a = analyze_pages(with_nodes(ok.select("url_key", "page_id", "html")),
                      content_selectors=content_selectors, strip_selectors=strip_selectors)
    return a.withColumn("hrefs", anchors(F.col("kept" if scope == "stripped" else "nodes"))) \
            .withColumn("has_content", F.col("root").isNotNull()) \
            .withColumn("unparsed", F.col("nodes").isNull())


def page_links(analyzed: DataFrame) -> DataFrame:
    """(src, position, dst) with dst resolved against the page URL and
    normalized; the per-crawl doc-link filter is applied during the crawl."""
    e = analyzed.select(F.col("url_key").alias("src"),
                        F.posexplode("hrefs").alias("position", "href"))
    from ..functions.urls import materialize_cols
    e = materialize_cols(e, {"dst": normalize_url(resolve_url(F.col("src"), F.col("href")))})
    return e.select("src", (F.col("position") + 1).alias("position"), "dst")


# --------------------------------------------------------------------- BFS
#: A node with more links than this is a hub: its links are dealt into parts.
HUB_DEGREE = 50_000
#: Hashes of a link's source by which links are counted to find hubs.
HUB_BINS = 1 << 16


def deal_links(edges: DataFrame, hub_degree: int = HUB_DEGREE) -> tuple[DataFrame, DataFrame | None]:
    """(edges with ``part``, hubs (src, parts) or None). Links of a node with at
    most ``hub_degree`` are part 0; a hub's are dealt by ranges of their
    position into parts of about that many, so no key holds more. There is
    a hub at most for each ``hub_degree`` links.

    Links are first counted by a hash of their source: where a hash has at
    most ``hub_degree``, no node has more. Only nodes of the other hashes are
    counted one by one."""
    bin_ = F.pmod(F.xxhash64("src"), F.lit(HUB_BINS))
    full = bounded_broadcast(edges.groupBy(bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
                             .filter(F.col("_n") > hub_degree).select("_bin"))
    if full.isEmpty():
        return edges.withColumn("part", F.lit(0)), None
    deg = edges.withColumn("_bin", bin_).join(full, "_bin", "left_semi").groupBy("src").agg(
        F.count(F.lit(1)).alias("_n"), F.min("position").alias("_lo"), F.max("position").alias("_hi"))
    hubs = bounded_broadcast(deg.filter(F.col("_n") > hub_degree)
                             .withColumn("parts", F.ceil(F.col("_n") / hub_degree).cast("int")).drop("_n"))
    if hubs.isEmpty():
        return edges.withColumn("part", F.lit(0)), None
    at = F.floor((F.col("position") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * F.col("parts")).cast("int")
    dealt = edges.join(hubs, "src", "left").withColumn("part", F.coalesce(F.least(at, F.col("parts") - 1), F.lit(0)))
    return dealt.select("src", "position", "dst", "part"), hubs.select("src", "parts")


def to_parts(front: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The frontier (..., src) with a row for each part of a node's links."""
    if hubs is None:
        return front.withColumn("part", F.lit(0))
    cols = front.columns
    return front.join(hubs, "src", "left").select(
        *cols, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))


def _materialize(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """Write a level to the shared folder and read it back: one job, a
    lineage cut that survives lost executors, column pruning on re-read.

    Links and levels are written without dictionaries: their names hardly
    repeat, so a dictionary is built only to be given up."""
    from ..session import shared_path
    path = shared_path(df.sparkSession, "bfs")
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.parquet(path)


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None,
        requests: DataFrame | None = None, link_ok=None, expandable: DataFrame | None = None,
        content: DataFrame | None = None,
        with_seq: bool = False, hub_degree: int = HUB_DEGREE, cap_visits: bool = False) -> DataFrame:
    """Level-synchronous BFS.

    seeds:      (project_id, url, seq) -- depth 0 in ``seq`` order
    edges:      (src, position, dst)
    requests:   optional (project_id, max_depth, max_pages, base_url, ...)
                joined to candidate links for ``link_ok`` and the limits
                (a null limit is none)
    link_ok:    optional Column predicate over (dst, request columns)
    expandable: optional (url) -- only these nodes are expanded (fetched
                HTML); others are visited but not expanded
    content:    optional (url) of content-bearing pages, for the page cap
    cap_visits: the cap counts every visited node, whatever it holds
    Returns (project_id, url, depth, key, parent_url), plus ``seq`` with
    ``with_seq``.

    Order: a node's ``key`` is its parent's key plus the link position
    (``array<bigint>``); arrays compare element by element, so (depth, key)
    is the FIFO queue order and no level needs a ranking step. ``seq`` (the
    rank inside a depth) is computed once at the end, only when asked for.
    """
    lim = requests.select("project_id", "max_depth", "max_pages") if requests is not None else None
    # the link table is read once per level: computed and written once. A hub's
    # links lie in several partitions, and its frontier row goes to each
    links = _materialize(edges.select("src", F.col("position").cast("long").alias("position"), "dst"), dictionary=False)
    edges, hubs = deal_links(links, hub_degree)
    level = _materialize(
        seeds.groupBy("project_id", "url").agg(F.min("seq").cast("long").alias("_s"))
             .select("project_id", "url", F.lit(0).alias("depth"),
                     F.array(F.col("_s")).alias("key"),
                     F.lit(None).cast("string").alias("parent_url")), dictionary=False)
    levels = [level]
    visited = level.select("project_id", "url")
    d = 0
    while max_depth is None or d < max_depth:
        front = level
        if lim is not None:
            front = front.join(lim, "project_id").filter(
                F.col("max_depth").isNull() | (F.col("depth") < F.col("max_depth")))
        if (content is not None or cap_visits) and lim is not None:
            done = _capped(levels, None if cap_visits else content, lim)
            front = front.join(done, "project_id", "left_anti")
        if expandable is not None:
            front = front.join(expandable.select("url"), "url", "left_semi")
        front = to_parts(front.select("project_id", F.col("url").alias("src"), F.col("key").alias("pkey")), hubs)
        cand = front.join(edges, ["src", "part"])
        if requests is not None and link_ok is not None:
            cand = cand.join(requests, "project_id").filter(link_ok)
        first = (cand.groupBy("project_id", "dst")
                     .agg(F.min(F.struct(F.array_append("pkey", F.col("position")).alias("key"),
                                         F.col("src"))).alias("_f"))
                     .select("project_id", F.col("dst").alias("url"), "_f"))
        level = _materialize(first.join(visited, ["project_id", "url"], "left_anti")
                             .select("project_id", "url", F.lit(d + 1).alias("depth"),
                                     F.col("_f.key").alias("key"), F.col("_f.src").alias("parent_url")), dictionary=False)
        if level.isEmpty():
            break
        levels.append(level)
        visited = visited.unionByName(level.select("project_id", "url"))
        d += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    if not with_seq:
        return out
    # placed by project alone: the crawl order (crawl_order) needs no further shuffle
    return running_count(out, ["project_id", "depth"], ["key", "url"], out="seq", cluster=["project_id"])


def _capped(levels, content: DataFrame | None, lim: DataFrame) -> DataFrame:
    """Projects that already have ``max_pages`` content-bearing pages (nodes of
    any kind without ``content``)."""
    seen = levels[0]
    for lv in levels[1:]:
        seen = seen.unionByName(lv)
    n = ((seen if content is None else seen.join(content.select("url"), "url", "left_semi"))
             .groupBy("project_id").agg(F.count(F.lit(1)).alias("_n")))
    return n.join(lim, "project_id").filter(F.col("_n") >= F.col("max_pages")).select("project_id")


def crawl_order(visits: DataFrame) -> DataFrame:
    """CRW-7: 1-based crawl position per project: (depth, key)."""
    return running_count(visits, ["project_id"], ["depth", "key", "url"], out="crawl_pos")


def page_cap(pages: DataFrame, n: int | None = None, n_col: str = "max_pages",
             order=("depth", "key"), rank_col: str | None = None) -> DataFrame:
    """CRW-6: keep the first ``n`` (or per-project ``n_col``) content-bearing
    pages per project, earlier in crawl order first.

    With a literal ``n`` the ``row_number() <= n`` filter is planned as a
    per-partition WindowGroupLimit before the shuffle, so a huge project
    is cut map-side first."""
    w = Window.partitionBy("project_id").orderBy(*order)
    lim = F.lit(n) if n is not None else F.col(n_col)
    out = pages.withColumn("_r", F.row_number().over(w).cast("long")).filter(F.col("_r") <= lim)
    return out.withColumnRenamed("_r", rank_col) if rank_col else out.drop("_r")


# ----------------------------------------------------------------- discovery
def first_seen(discovered: DataFrame) -> DataFrame:
    """CRW-3: (project_id, url, seq) -> first occurrence of each exact URL."""
    return discovered.groupBy("project_id", "url").agg(F.min("seq").alias("seq"))


def seeds(requests: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """CRW-4: normalized base URL first, then normalized sitemap URLs that
    differ from it, first occurrence kept, all at depth 0.

    requests: (project_id, url); discovered: (project_id, url, seq)."""
    base = requests.select("project_id", normalize_url(F.col("url")).alias("url"),
                           F.lit(0).cast("long").alias("seq"))
    if discovered is None:
        return base
    b = base.select("project_id", F.col("url").alias("_base"))
    more = (discovered.join(b, "project_id")
                      .select("project_id", normalize_url(F.col("url")).alias("url"), "seq", "_base")
                      .filter(F.col("url") != F.col("_base")).drop("_base"))
    return base.unionByName(more.withColumn("seq", F.col("seq") + 1))


def outcomes(visits: DataFrame, idx: DataFrame, analyzed: DataFrame | None = None) -> DataFrame:
    """CRW-9: per visited URL: scraped / no_content / not_html / error.

    A URL missing from the archive counts as a failed fetch (``error``), and
    so does a page that the parser gave up on."""
    j = visits.join(idx.select(F.col("url_key").alias("url"), "kept", "reason"), "url", "left")
    if analyzed is not None:
        j = j.join(analyzed.select(F.col("url_key").alias("url"), "has_content", "unparsed"), "url", "left")
    else:
        j = j.withColumn("has_content", F.lit(True)).withColumn("unparsed", F.lit(False))
    o = (F.when(F.col("kept").isNull() | F.coalesce(F.col("unparsed"), F.lit(False)), F.lit("error"))
          .when(~F.col("kept"), F.col("reason"))
          .when(F.coalesce(F.col("has_content"), F.lit(False)), F.lit("scraped"))
          .otherwise(F.lit("no_content")))
    return j.withColumn("outcome", o).drop("kept", "reason", "has_content", "unparsed")


def edge_stats(links: DataFrame, idx: DataFrame) -> DataFrame:
    """CRW-11: per source page: links, distinct targets, dangling targets
    (not in the archive), and per target in-degree via ``in_degree``. Links are
    counted per (source, target) first, so no distinct is needed after."""
    known = idx.select(F.col("url_key").alias("dst"), F.lit(True).alias("_known"))
    pairs = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.join(known, "dst", "left").groupBy("src").agg(
        F.sum("_n").alias("out_degree"),
        F.count(F.lit(1)).alias("distinct_targets"),
        F.count(F.when(F.col("_known").isNull(), F.lit(1))).alias("dangling"))


def in_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


# ---------------------------------------------------------------- crawl job
def crawl_job(spark: SparkSession, requests: DataFrame, archive: DataFrame,
              sitemap_urls: DataFrame | None = None, scope: str = "stripped",
              fold_base: bool = False, strict_segments: bool = False,
              sitemaps: DataFrame | None = None, content_selectors=None, strip_selectors=None) -> dict:
    """CRW-10: requests -> discovery -> BFS over the archive -> capped pages.

    requests: (project_id, url, name, max_pages, max_depth), optionally
    ``use_sitemap`` (a null counts as true) and ``max_files``. ``sitemaps``
    (url, status, body) are the sitemap files there are: requests that use
    them get the page URLs that :func:`sitemaps.discover` finds as further
    seeds. ``sitemap_urls`` (project_id, url, seq) gives such URLs directly.
    Returns dict of DataFrames: visits, keys (capped pages without their
    content: project_id, url, depth, key, parent_url, position, page_id), pages
    (keys with title, content nodes and root), summary (one row per request;
    zero pages = failed). Only keys are ranked and capped; content is joined
    once, to what is kept (:func:`with_content`).
    ``fold_base`` / ``strict_segments`` repair the two path-prefix quirks
    of the doc-link rule (kept by default); the selector lists replace the
    fixed ones.
    """
    rules = {"fold_base": fold_base, "strict_segments": strict_segments}
    req = requests.select(
        "project_id", "url", "name", "max_pages", "max_depth",
        normalize_url(F.col("url")).alias("base_url"))
    req = req.withColumn("name", F.coalesce(F.col("name"), project_name(F.col("url"))))
    # narrow key table (no HTML) read by every level: written once
    idx = _materialize(archive_index(archive).select("url_key", "page_id", "kept", "reason"))
    # parse once: the page table every later step reads is materialized
    an = _materialize(analyzed_archive(archive, scope, content_selectors, strip_selectors).select(
        "url_key", "page_id", "title", "root", "content", "hrefs", "has_content", "unparsed"))
    links = page_links(an)
    disc = None
    if sitemaps is not None:
        from ..sources.sitemaps import discover
        asks = requests.filter(F.coalesce(F.col("use_sitemap"), F.lit(True))) if "use_sitemap" in requests.columns else requests
        disc = discover(asks, sitemaps).select("project_id", "url", "seq")
    if sitemap_urls is not None:
        given = sitemap_urls.select("project_id", "url", "seq")
        disc = given if disc is None else disc.unionByName(given)
    if disc is not None:
        disc = first_seen(disc).join(req.select("project_id", "base_url"), "project_id") \
            .filter(is_doc_link(F.col("url"), F.col("base_url"), **rules)).select("project_id", "url", "seq")
    having = _materialize(an.filter("has_content").select(F.col("url_key").alias("url")))
    visits = bfs(seeds(req.select("project_id", "url"), disc), links,
                 requests=req.select("project_id", "base_url", "max_depth", "max_pages"),
                 link_ok=is_doc_link(F.col("dst"), F.col("base_url"), **rules),
                 expandable=idx.filter("kept").select(F.col("url_key").alias("url")), content=having)
    limits = bounded_broadcast(req.select("project_id", "max_pages"))
    # a request for no page visits none
    visits = visits.join(limits, "project_id").filter(F.col("max_pages").isNull() | (F.col("max_pages") > 0))
    # CRW-6/7: skew-safe crawl position of the keys, then the per-request cap
    keys = running_count(visits.join(having, "url", "left_semi"), ["project_id"], ["depth", "key"], out="position") \
        .filter(F.col("max_pages").isNull() | (F.col("position") <= F.col("max_pages"))) \
        .withColumn("page_id", page_id(F.col("url")))
    keys = _materialize(keys)
    # the crawl stops at the page that fills the cap: what stands behind it in
    # the queue was never visited
    last = bounded_broadcast(keys.filter(F.col("position") == F.col("max_pages")).select(
        "project_id", F.struct("depth", "key", "url").alias("_last")))
    keys = keys.drop("max_pages")
    visits = visits.drop("max_pages").join(last, "project_id", "left").filter(
        F.col("_last").isNull() | (F.struct("depth", "key", "url") <= F.col("_last"))).drop("_last")
    counts = keys.groupBy("project_id").agg(F.count(F.lit(1)).alias("page_count"))
    summary = (req.join(counts, "project_id", "left")
                  .select("project_id", "name", "url",
                          F.coalesce("page_count", F.lit(0)).alias("page_count"),
                          F.when(F.coalesce("page_count", F.lit(0)) > 0, F.lit("ok"))
                           .otherwise(F.lit("failed")).alias("status")))
    return {"visits": visits, "keys": keys, "pages": with_content(keys, an), "summary": summary, "index": idx,
            "analyzed": an, "links": links}


def with_content(keys: DataFrame, analyzed: DataFrame) -> DataFrame:
    """``keys`` (..., url) with the title, content nodes and root of their
    pages. Keys within the broadcast bound go to the pages, which stay where
    they are; beyond it both meet in one shuffle."""
    return analyzed.filter("has_content").select(F.col("url_key").alias("url"), "title", "content", "root") \
        .join(bounded_broadcast(keys), "url")


def last_writes(job: dict) -> DataFrame:
    """Pages of a crawl job with their content, of those that share a page id
    the last; which one that is, is settled on the keys."""
    last = (job["keys"].groupBy("project_id", "page_id")
            .agg(F.max_by(F.struct("position", "url"), F.col("position")).alias("w"))
            .select("project_id", "page_id", "w.*"))
    return with_content(last, job["analyzed"])


def save_crawl(job: dict, path: str, scraped_at, scraped_on: str | None = None) -> dict:
    """End of CRW-10: convert the capped pages, keep the last write per page
    id, and write ``<path>/library`` (partitioned by project) and
    ``<path>/projects``. Requests with zero pages are failed and write
    nothing. Returns the two paths."""
    from .library import write_library
    from .markdown import convert_pages
    day = scraped_on or scraped_at.strftime("%Y-%m-%d")
    conv = convert_pages(last_writes(job), day, keep=["project_id", "page_id", "position", "title", "url"])
    lib = conv.select("project_id", "position", "page_id", "title", "url",
                      F.col("markdown").alias("content"))
    lib_path = f"{path.rstrip('/')}/library"
    write_library(lib, lib_path)
    ok = job["summary"].filter(F.col("status") == "ok")
    proj_path = f"{path.rstrip('/')}/projects"
    (ok.select("project_id", "name", "url", F.col("page_count").cast("int").alias("page_count"),
               F.lit(scraped_at).cast("timestamp").alias("scraped_at"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("project_id").parquet(proj_path))
    return {"library": lib_path, "projects": proj_path}
