"""Library sinks and queries (SNK-1..7, LIB-1..11).

Inputs are ``library_pages(project_id, position, page_id, title, url,
content)`` and ``projects(project_id, name, url, page_count, scraped_at)``.
Order inside a project is the ``position`` column. Nothing here gathers a
project into one row: exports come out as ordered pieces that a sink writes
in order, and numbering per project uses the skew-safe rank of
:mod:`scan`. Aggregates are partial (map-side) aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EXPORT_SEPARATOR, first_hit, hit_count, slugify
from ..functions.urls import url_authority
from .scan import bounded_broadcast, running_count
from .term_scan import scan

# --- fixed values: texts of the library listing and the resource catalogue.
# The library's own name is a parameter (LIBRARY_NAME); the rest of the
# wording and layout is fixed.
LIBRARY_NAME = "docmill"
LISTING_HEADER = "Scraped Projects in " + LIBRARY_NAME + ":\n\n"
LISTING_EMPTY = "(No projects currently saved.)\n"
RESOURCE_SCHEME = LIBRARY_NAME + "://"
RESOURCE_SUFFIX = "/docs.md"
RESOURCE_MIME = "text/markdown"
# ---------------------------------------------------------------------------


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) > 0)


# SNK-1 ---------------------------------------------------------------------
def _last_writes(lib: DataFrame) -> DataFrame:
    """Keys written more than once and their winning (last) position.

    A partial aggregate over narrow columns; normally tiny, so the joins
    that use it are broadcast and page texts stay where they are."""
    return bounded_broadcast(
        lib.groupBy("project_id", "page_id")
           .agg(F.count(F.lit(1)).alias("_n"), F.max("position").alias("_win"))
           .filter(F.col("_n") > 1).select("project_id", "page_id", "_win"))


def save_last_wins(lib: DataFrame) -> DataFrame:
    """One stored text per (project, page_id): the last position wins."""
    d = _last_writes(lib)
    return (lib.join(d, ["project_id", "page_id"], "left")
               .filter(F.col("_win").isNull() | (F.col("position") == F.col("_win")))
               .select("project_id", "page_id", "position", "content",
                       *(c for c in ("title", "url") if c in lib.columns)))


def stored_content(lib: DataFrame) -> DataFrame:
    """(project_id, page_id, content) as the files on disk would hold them."""
    return save_last_wins(lib).select("project_id", "page_id", "content")


def write_library(lib: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by project; dynamic partition overwrite replaces only the
    projects present in ``lib``."""
    (save_last_wins(lib).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project_id").parquet(path))


def read_library_table(spark, path: str, project_id: str | None = None) -> DataFrame:
    """The stored library; a project filter prunes to that partition folder
    (LIB-2/3 read one directory, as the reference does)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("project_id") == project_id) if project_id is not None else df


def delete_library_projects(spark, path: str, project_ids) -> dict:
    """LIB-8 on the stored library: drop each project's partition folder
    (Hadoop FileSystem API, so HDFS/object stores alike); answers whether
    it existed. Only folder metadata is touched, no rows move."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    # as the writer names partition folders: no id leaves the library's folder
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    out = {}
    for pid in project_ids:
        folder = jvm.org.apache.hadoop.fs.Path(path, "project_id=" + escape(pid))
        fs = folder.getFileSystem(conf)
        existed = bool(fs.exists(folder))
        if existed:
            fs.delete(folder, True)
        out[pid] = existed
    return out


# SNK-2 ---------------------------------------------------------------------
def manifest_entries(lib: DataFrame) -> DataFrame:
    """Manifest rows in order: ``entry_no`` is the 1-based manifest position."""
    return running_count(lib.select("project_id", "position", "page_id", "title", "url"),
                         ["project_id"], ["position", "page_id"], out="entry_no")


def manifest_json(lib: DataFrame, projects: DataFrame) -> DataFrame:
    """The reference's manifest document per project (for small projects:
    it holds the whole page list in one row)."""
    pages = (lib.groupBy("project_id")
                .agg(F.sort_array(F.collect_list(F.struct("position", "page_id", "title", "url")))
                     .alias("p"))
                .select("project_id", F.transform("p", lambda x: F.struct(
                    x.page_id.alias("id"), x.title.alias("title"), x.url.alias("url")))
                    .alias("pages")))
    return (projects.join(pages, "project_id", "left")
            .select("project_id", F.to_json(F.struct(
                F.col("project_id").alias("id"), "name", "url",
                F.coalesce("pages", F.array()).alias("pages"), "page_count",
                F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
                 .alias("scraped_at"))).alias("manifest")))


# SNK-3 ---------------------------------------------------------------------
def export_single_pieces(lib: DataFrame) -> DataFrame:
    """Single-file export as ordered pieces: non-empty texts in position
    order, every piece after the first prefixed by the separator. Writing
    the pieces in (project, position) order gives the export text."""
    ne = stored_in_manifest(lib).filter(_nonempty(F.col("content")))
    first = bounded_broadcast(ne.groupBy("project_id").agg(F.min("position").alias("_first")))
    return (ne.join(first, "project_id")
              .select("project_id", "position",
                      F.when(F.col("position") == F.col("_first"), F.col("content"))
                       .otherwise(F.concat(F.lit(EXPORT_SEPARATOR), F.col("content")))
                       .alias("piece")))


def export_single_text(lib: DataFrame, project_id: str) -> DataFrame:
    """One project's export as one string (the reference's response body)."""
    p = export_single_pieces(lib.filter(F.col("project_id") == project_id))
    from ..sources.sitemaps import ordered_listagg
    return p.groupBy("project_id").agg(ordered_listagg("piece", "", "position").alias("export"))


def write_export(pieces: DataFrame, path: str) -> None:
    """Ordered, sharded text export: one folder per project whose part
    files, concatenated in name order, are the export text.

    Rows are the lines of each piece without its final newline (the writer
    ends every row with one), so pieces that end in a newline -- every
    converted page does -- are reproduced byte for byte; a piece without a
    final newline gets one. Range partitioning keeps the order and splits a
    large project over many tasks."""
    body = F.regexp_replace(F.col("piece"), "\n\\z", "")
    lines = pieces.select("project_id", "position",
                          F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    (lines.repartitionByRange("project_id", "position", "line_no")
          .sortWithinPartitions("project_id", "position", "line_no")
          .select("project_id", "line").write.mode("overwrite")
          .partitionBy("project_id").text(path))


def stored_in_manifest(lib: DataFrame) -> DataFrame:
    """LIB-9: manifest entries with the stored text of their page id (the
    last write when an id repeats; every entry keeps its own row)."""
    d = _last_writes(lib)
    cols = ["project_id", "position", "page_id", "title", "url", "content"]
    if d.isEmpty():  # no id repeats: every entry has its own text
        return lib.select(*cols)
    won = (lib.join(d, ["project_id", "page_id"]).filter(F.col("position") == F.col("_win"))
              .select("project_id", "page_id", F.lit(True).alias("_again"), F.col("content").alias("_c")))
    return (lib.join(won, ["project_id", "page_id"], "left")
               .withColumn("content", F.when(F.col("_again"), F.col("_c")).otherwise(F.col("content")))
               .select(*cols))


# SNK-4 ---------------------------------------------------------------------
def export_multi_names(lib: DataFrame, projects: DataFrame) -> DataFrame:
    """Zip entry names: ``<project slug>/<NN>-<slug>[-k].md``.

    NN is the 1-based manifest position (empty pages skipped but counted),
    zero-padded to two; repeated slugs among written pages get -2, -3, ...
    """
    m = running_count(stored_in_manifest(lib), ["project_id"], ["position", "page_id"], out="i")
    ne = m.filter(_nonempty(F.col("content"))).withColumn("slug", slugify(F.col("title")))
    ne = running_count(ne, ["project_id", "slug"], ["position", "page_id"], out="k")
    nn = F.col("i").cast("string")
    nn = F.when(F.length(nn) < 2, F.lpad(nn, 2, "0")).otherwise(nn)
    leaf = F.when(F.col("k") > 1, F.concat("slug", F.lit("-"), F.col("k").cast("string"))) \
            .otherwise(F.col("slug"))
    return (ne.join(bounded_broadcast(projects.select("project_id", "name")), "project_id")
              .select("project_id", "position", "page_id",
                      F.concat(slugify(F.col("name")), F.lit("/"), nn, F.lit("-"), leaf,
                               F.lit(".md")).alias("entry"),
                      "content"))


# SNK-5 ---------------------------------------------------------------------
def export_payload_items(lib: DataFrame) -> DataFrame:
    """Agent payload elements, one JSON object per non-empty page."""
    ne = stored_in_manifest(lib).filter(_nonempty(F.col("content")))
    txt = F.concat(F.lit("File: "), F.col("page_id"), F.lit(".md\nSource: "), F.col("url"),
                   F.lit("\n\n"), F.col("content"))
    return ne.select("project_id", "position",
                     F.to_json(F.struct(F.lit("text").alias("type"), txt.alias("text")))
                      .alias("item"))


def write_payload(items: DataFrame, path: str) -> None:
    """The agent payload as a JSON array per project, written as ordered
    pieces ('[' + item, ', ' + item, ..., ']') sharded by range, so no
    project is gathered into one task."""
    from ..operators.scan import running_count
    r = running_count(items, ["project_id"], ["position"], out="_k")
    last = bounded_broadcast(items.groupBy("project_id").agg(F.max("position").alias("_last")))
    piece = F.concat(F.when(F.col("_k") == 1, F.lit("[")).otherwise(F.lit(", ")), F.col("item"),
                     F.when(F.col("position") == F.col("_last"), F.lit("]")).otherwise(F.lit("")))
    out = r.join(last, "project_id").select("project_id", "position", piece.alias("piece"))
    write_export(out, path)


def payload_file_name(projects: DataFrame) -> DataFrame:
    """``<authority with ':'->'_'>_<project_id>.json`` ('docs' if no authority)."""
    dom = url_authority(F.col("url"))
    dom = F.when(F.col("url").isNull() | (F.col("url") == ""), F.col("project_id")).otherwise(dom)
    dom = F.replace(dom, F.lit(":"), F.lit("_"))
    dom = F.when(F.length(dom) > 0, dom).otherwise(F.lit("docs"))
    return projects.select("project_id", F.concat(dom, F.lit("_"), F.col("project_id"),
                                                  F.lit(".json")).alias("file_name"))


# SNK-6 / SNK-7 ---------------------------------------------------------------
def listing_blocks(projects: DataFrame) -> DataFrame:
    """Library listing as ordered text blocks (seq 0 = header)."""
    blk = F.concat(F.lit("- ID: "), F.col("project_id"), F.lit("\n  Name: "), F.col("name"),
                   F.lit("\n  URL: "), F.col("url"), F.lit("\n  Pages: "),
                   F.coalesce(F.col("page_count").cast("string"), F.lit("unknown")),
                   F.lit("\n\n"))
    body = projects.select(F.col("project_id").alias("sort_key"), blk.alias("block"))
    head = projects.sparkSession.range(1).select(
        F.lit("").alias("sort_key"),
        F.when(projects.exists(), F.lit(LISTING_HEADER))
         .otherwise(F.lit(LISTING_HEADER + LISTING_EMPTY)).alias("block"))
    return head.unionByName(body)


def catalogue(projects: DataFrame) -> DataFrame:
    return projects.select(
        "project_id",
        F.concat(F.lit(RESOURCE_SCHEME), F.col("project_id"), F.lit(RESOURCE_SUFFIX)).alias("uri"),
        F.concat(F.col("name"), F.lit(" Documentation")).alias("name"),
        F.concat(F.lit("Scraped markdown for "), F.col("url")).alias("description"),
        F.lit(RESOURCE_MIME).alias("mime_type"))


def resource_project_id(uri: Column) -> Column:
    """Project id of a resource URI, NULL unless prefix and suffix fit."""
    ok = uri.startswith(RESOURCE_SCHEME) & uri.endswith(RESOURCE_SUFFIX)
    inner = F.substring_index(F.substring_index(uri, RESOURCE_SCHEME, -1), RESOURCE_SUFFIX, 1)
    return F.when(ok, inner)


# LIB-1..3 ---------------------------------------------------------------------
def list_projects(projects: DataFrame, lib: DataFrame | None = None) -> DataFrame:
    """Projects that have a manifest, ordered by id."""
    p = projects
    if lib is not None:
        p = p.join(lib.select("project_id").distinct(), "project_id", "left_semi")
    return p.orderBy("project_id")


def get_project(projects: DataFrame, project_id: str) -> DataFrame:
    return projects.filter(F.col("project_id") == project_id)


def get_pages(lib: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch point lookups: ``requests(project_id, page_id)`` -> content or
    no row."""
    return stored_content(lib).join(requests.select("project_id", "page_id"),
                                    ["project_id", "page_id"], "inner")


# LIB-4..7 ---------------------------------------------------------------------
def search(lib: DataFrame, q: str, project_id: str | None = None) -> DataFrame:
    """Case-insensitive literal substring over the stored text; empty query
    matches every non-empty page. Result in manifest order."""
    s = stored_in_manifest(lib)
    if project_id is not None:
        s = s.filter(F.col("project_id") == project_id)
    s = s.filter(_nonempty(F.col("content")))
    if q:
        s = s.filter(F.contains(F.lower(F.col("content")), F.lower(F.lit(q))))
    return s.select("project_id", "position", "page_id")


def search_many(lib: DataFrame, terms: DataFrame, term_col: str = "term",
                max_term_bytes: int = 8 << 20) -> DataFrame:
    """LIB-5: every (term, page) with a case-insensitive hit.

    The distinct terms go to the tasks while their measured size is within
    ``max_term_bytes`` (:mod:`term_scan`: one pass over the texts); beyond it
    the library is saved with a gram index and searched there.
    """
    t = terms.filter(F.col(term_col).isNotNull()) \
             .select(F.col(term_col).alias("term"), *[c for c in terms.columns if c != term_col])
    asked = t.select(F.lower("term").alias("_q")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("_q") + 64), F.lit(0))).first()[0]
    if size > max_term_bytes:
        from . import library_store as LS
        store = LS.save(lib)
        LS.index_grams(store)
        return LS.search_many(store, t)
    texts = [r[0] for r in asked.orderBy("_q").collect()]  # within max_term_bytes
    pages = stored_in_manifest(lib).filter(_nonempty(F.col("content"))) \
        .select("project_id", "position", "page_id", F.lower("content").alias("_lc"))
    numbered = lib.sparkSession.createDataFrame(list(enumerate(texts)), "_no int, _q string")
    found = scan(pages, "_lc", texts, "_no")
    return (found.join(F.broadcast(numbered), "_no")
            .join(t.withColumn("_q", F.lower("term")), "_q")
            .select(*t.columns, "project_id", "position", "page_id"))


def first_match(lib: DataFrame, q: str) -> DataFrame:
    """LIB-6: first matching page per project (manifest order)."""
    return (search(lib, q).groupBy("project_id")
            .agg(F.min_by("page_id", F.struct("position", "page_id")).alias("first_page_id"),
                 F.count(F.lit(1)).alias("n_matches")))


def hit_counts(lib: DataFrame, q: str) -> DataFrame:
    from ..functions.text import strip_frontmatter
    body = strip_frontmatter(F.col("content"))
    return (stored_content(lib).filter(F.col("content").isNotNull())
            .select("project_id", "page_id",
                    hit_count(body, F.lit(q)).alias("hits"),
                    first_hit(body, F.lit(q)).alias("first_offset"))
            .filter(F.col("hits") > 0))


# LIB-8..11 ---------------------------------------------------------------------
def delete_projects(lib: DataFrame, projects: DataFrame, deletes: DataFrame):
    """Returns (remaining library, remaining projects, answers) where answers
    says per requested id whether it existed."""
    d = deletes.select("project_id").distinct()
    answers = d.join(projects.select("project_id", F.lit(True).alias("existed")),
                     "project_id", "left").select(
        "project_id", F.coalesce("existed", F.lit(False)).alias("existed"))
    return (lib.join(d, "project_id", "left_anti"),
            projects.join(d, "project_id", "left_anti"), answers)


def missing_pages(lib: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """LIB-9 report: manifest entries without text or with empty text."""
    s = stored_in_manifest(lib) if stored is None else lib.join(stored, ["project_id", "page_id"], "left")
    return s.filter(~_nonempty(F.col("content"))) \
            .select("project_id", "position", "page_id",
                    F.when(F.col("content").isNull(), F.lit("missing"))
                     .otherwise(F.lit("empty")).alias("problem"))


def cards(projects: DataFrame) -> DataFrame:
    """LIB-10: card fields per project and the library total label."""
    total = projects.select(F.count(F.lit(1))).scalar()
    label = F.when(total == 1, F.lit(" project")).otherwise(F.lit(" projects"))
    return projects.select(
        "project_id", "name", "url", "page_count",
        F.date_format("scraped_at", "MMM d, yyyy").alias("scraped_on"),
        F.concat(total.cast("string"), label).alias("library_total"))


def page_counts(lib: DataFrame) -> DataFrame:
    return lib.groupBy("project_id").agg(F.count(F.lit(1)).alias("page_count"))


