"""Driver tables -> docmill tables.

The driver's parquet tables stand in for the reference's inputs:

* ``pages`` -> ``page_archive(page_id, url, status, content_type, html)``
* ``documents`` -> ``library_pages`` (project = ``source``)
* ``conversations`` -> ``library_pages`` (project = ``conv_id``)
* ``events`` -> ``job_events`` (job = ``user_id``)
* nation/customer/orders/lineitem/supplier -> a cyclic link graph

Every mapping is a projection over a scan, so Catalyst prunes columns and
pushes filters into the parquet reader.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import page_id

# --- fixed values: event names of the reference's progress stream --------
# driver event_type -> crawl event
EVENT_MAP = {
    "signup": "started",
    "view": "page_scraped",
    "click": "converting",
    "purchase": "complete",
    "error": "error",
}
# A fixed save time keeps reruns of manifests, frontmatter and cards equal.
DEFAULT_SCRAPED_AT = _dt.datetime(2024, 1, 15, 12, 30, 0)
# ------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Give CPU-heavy row work (HTML parse, whole-text regexes) at least one
    task per core: when the scan yields fewer input splits than the
    cluster's default parallelism (e.g. a file with one row group), a
    round-robin repartition spreads the rows. On large inputs the scan
    already has many splits and this is a no-op (no shuffle)."""
    try:
        t = target or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a remote session): leave the scan as is
        return df
    return df.repartition(t) if n < t else df


def page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``pages`` as an archive; missing columns default to a
    successful HTML response (200, ``text/html``)."""
    p = spread(read(spark, sf_dir, "pages"))
    cols = set(p.columns)
    status = F.col("status") if "status" in cols else F.lit(200)
    ctype = F.col("content_type") if "content_type" in cols else F.lit("text/html; charset=utf-8")
    return p.select("page_id", "url", status.cast("int").alias("status"),
                    ctype.alias("content_type"), "html")


def library_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a library: project = source, position = doc_id,
    page id = md5 of the page URL (doc URL built from source and doc_id),
    title = source, content = text."""
    d = spread(read(spark, sf_dir, "documents"))
    url = F.concat(F.lit("https://docs.example.org/"), F.col("source"), F.lit("/"),
                   F.col("doc_id").cast("string"))
    return d.select(
        F.col("source").alias("project_id"),
        F.col("doc_id").alias("position"),
        page_id(url).alias("page_id"),
        F.col("source").alias("title"),
        url.alias("url"),
        F.col("text").alias("content"),
    )


def library_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a library: project = 'conv-<id>', position =
    turn, title = role (repeats on purpose), content = text."""
    c = read(spark, sf_dir, "conversations")
    pid = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    url = F.concat(F.lit("https://chat.example.org/"), pid, F.lit("/"), F.col("turn").cast("string"))
    return c.select(
        pid.alias("project_id"),
        F.col("turn").alias("position"),
        page_id(url).alias("page_id"),
        F.col("role").alias("title"),
        url.alias("url"),
        F.col("text").alias("content"),
    )


def projects_of(library: DataFrame, scraped_at: _dt.datetime = DEFAULT_SCRAPED_AT) -> DataFrame:
    """``projects(project_id, name, url, page_count, scraped_at)`` of a library.

    A partial-aggregated count; name = project id, url = its site root.
    """
    return (library.groupBy("project_id")
            .agg(F.count(F.lit(1)).cast("int").alias("page_count"))
            .select("project_id",
                    F.col("project_id").alias("name"),
                    F.concat(F.lit("https://docs.example.org/"), F.col("project_id")).alias("url"),
                    "page_count",
                    F.lit(scraped_at).cast("timestamp").alias("scraped_at")))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as crawl progress events: job = user_id, order (ts, event_id)."""
    e = read(spark, sf_dir, "events")
    m = F.create_map(*[x for k, v in EVENT_MAP.items() for x in (F.lit(k), F.lit(v))])
    return e.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id"),
        F.col("ts"),
        m[F.col("event_type")].alias("event"),
        F.col("props").alias("payload"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic link graph nation -> customer -> order -> supplier -> nation.

    Node ids carry a letter prefix (n, c, o, s); ``position`` orders a
    node's out-links (by the target's key).
    """
    def key(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    nat = read(spark, sf_dir, "customer").select(
        key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"),
        F.col("c_custkey").cast("long").alias("k"))
    cus = read(spark, sf_dir, "orders").select(
        key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"),
        F.col("o_orderkey").cast("long").alias("k"))
    # repeated (order, supplier) pairs are repeated links: kept, as a page
    # may link a target twice; BFS takes the first position anyway
    ordr = read(spark, sf_dir, "lineitem").select(
        key("o", "l_orderkey").alias("src"), key("s", "l_suppkey").alias("dst"),
        F.col("l_suppkey").cast("long").alias("k"))
    sup = read(spark, sf_dir, "supplier").select(
        key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"),
        F.col("s_nationkey").cast("long").alias("k"))
    return nat.unionByName(cus).unionByName(ordr).unionByName(sup) \
              .withColumnRenamed("k", "position")
