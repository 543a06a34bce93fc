"""Job progress over ``job_events(job_id, event_id, ts, event, payload)``
(JOB-1..7, SRC-5).

Order inside a job is ``(ts, event_id)``. Per-job results are partial
aggregates (``max`` of a struct = last event, ``count_if``); the running
counter uses the skew-safe rank of :mod:`scan`; "latest 4" is a
``row_number`` filter that Spark plans as a per-partition
``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .scan import bounded_broadcast, running_count, running_max, running_sum

# --- fixed values: client phases and the events that set them -------------
PHASE_OF_EVENT = {
    "started": "scraping",
    "converting": "converting",
    "complete": "complete",
    "error": "error",
}
FINAL_PHASES = ["complete", "error"]
SKIP_REASONS = ["not_html", "error", "playwright_not_installed"]
EVENT_TYPES = ["started", "sitemap_discovered", "page_scraped", "page_skipped",
               "converting", "complete", "error"]
MAX_PROGRESS = 95
# ---------------------------------------------------------------------------

_ORDER = ["ts", "event_id"]


def _phase(col="event"):
    e = F.col(col)
    expr = None
    for k, v in PHASE_OF_EVENT.items():
        expr = F.when(e == k, F.lit(v)) if expr is None else expr.when(e == k, F.lit(v))
    return expr


def payload_int(field: str):
    """An integer field of the JSON payload (NULL when absent or bad JSON)."""
    return F.get_json_object(F.col("payload"), f"$.{field}").cast("long")


def running_counts(ev: DataFrame, found_field: str = "k") -> DataFrame:
    """JOB-1: per page_scraped event its n-th success within the job
    (``scraped``) and the URLs then waiting (``queued``): the first one, plus
    those found so far (``found_field`` of sitemap and page events), less those
    taken (scraped or skipped)."""
    taken = F.col("event").isin("page_scraped", "page_skipped")
    found = F.when(taken | (F.col("event") == "sitemap_discovered"), payload_int(found_field))
    steps = ev.select("job_id", "event_id", "ts", "event",
                      (F.coalesce(found, F.lit(0)) - taken.cast("long")).alias("_step"))
    return running_sum(steps, ["job_id"], _ORDER, {
        "scraped": (F.col("event") == "page_scraped").cast("long"), "queued": F.col("_step"),
    }).filter(F.col("event") == "page_scraped").select(
        "job_id", "event_id", "ts", "scraped", (F.col("queued") + 1).alias("queued"))


def latest_phase(ev: DataFrame) -> DataFrame:
    """JOB-2: last phase-setting event per job; a stream that ends in
    neither complete nor error counts as error."""
    ph = _phase()
    last = F.max(F.when(ph.isNotNull(), F.struct("ts", "event_id", ph.alias("phase"))))
    agg = ev.groupBy("job_id").agg(last.alias("_l"))
    p = F.coalesce(F.col("_l.phase"), F.lit("scraping"))
    return agg.select("job_id",
                      F.col("_l.phase").alias("last_phase"),
                      F.when(p.isin(*FINAL_PHASES), p).otherwise(F.lit("error")).alias("phase"))


def latest_pages(ev: DataFrame, n: int = 4) -> DataFrame:
    """JOB-3: the latest ``n`` page events per job."""
    w = Window.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (ev.filter(F.col("event") == "page_scraped")
              .withColumn("rank", F.row_number().over(w).cast("long"))
              .filter(F.col("rank") <= n)
              .select("job_id", "event_id", "ts", "rank"))


def progress(ev: DataFrame, max_pages: int = 50, queued_field: str = "k") -> DataFrame:
    """JOB-4: progress percent (capped at 95) and the queue length shown."""
    last_page = F.max(F.when(F.col("event") == "page_scraped",
                             F.struct("ts", "event_id", payload_int(queued_field).alias("q"))))
    agg = ev.groupBy("job_id").agg(
        F.count_if(F.col("event") == "page_scraped").alias("scraped"),
        last_page.alias("_l"))
    pct = F.least((F.col("scraped") / F.lit(max_pages)) * F.lit(100.0), F.lit(float(MAX_PROGRESS)))
    return agg.select(
        "job_id", "scraped",
        pct.alias("progress_pct"),
        F.least(F.coalesce(F.col("_l.q"), F.lit(0)), F.lit(max_pages) - F.col("scraped"))
         .alias("queued_shown"))


def cancel_times(cancels: DataFrame) -> DataFrame:
    """First cancel per job (later ones change nothing)."""
    return cancels.groupBy("job_id").agg(F.min(F.struct("ts", "event_id")).alias("_c"))


def cancel_cut(ev: DataFrame, cancels: DataFrame) -> DataFrame:
    """JOB-5: events strictly before the job's first cancel; jobs without a
    cancel keep everything. Per job: kept events, kept pages, outcome.

    The per-job cancel table has one row per job; it is broadcast when its
    measured row count is within bounds, else joined by shuffle (AQE splits
    a hot job's partition)."""
    c = bounded_broadcast(cancel_times(cancels))
    kept = F.col("_c").isNull() | (F.struct("ts", "event_id") < F.col("_c"))
    agg = ev.join(c, "job_id", "left").groupBy("job_id").agg(
        F.count_if(kept).alias("kept_events"),
        F.count_if(kept & (F.col("event") == "page_scraped")).alias("kept_pages"),
        F.max(F.col("_c").isNotNull()).alias("cancelled"))
    return agg.select("job_id", "kept_events", "kept_pages", "cancelled",
                      F.when(F.col("kept_pages") > 0, F.lit("complete"))
                       .otherwise(F.lit("error")).alias("outcome"))


def outcome(ev: DataFrame) -> DataFrame:
    """JOB-6: complete when at least one page was scraped, else error."""
    agg = ev.groupBy("job_id").agg(
        F.count_if(F.col("event") == "page_scraped").alias("scraped"),
        F.count_if(F.col("event") == "complete").alias("complete_events"))
    return agg.select("job_id", "scraped", "complete_events",
                      F.when(F.col("scraped") > 0, F.lit("complete")).otherwise(F.lit("error"))
                       .alias("outcome"))


def event_histogram(ev: DataFrame, values=None, col: str = "event") -> DataFrame:
    """JOB-7: counts per job and event type (or skip reason), pivoted.

    The pivot values are given, so no extra job discovers them."""
    vals = list(values or EVENT_TYPES)
    return ev.groupBy("job_id").pivot(col, vals).agg(F.count(F.lit(1))).na.fill(0, subset=vals)


def parse_event_log(lines: DataFrame) -> DataFrame:
    """SRC-5: ``lines(job_id, line_no, line)`` of an SSE log -> events.

    A ``data:`` line takes the latest ``event:`` line after the previous
    ``data:`` line of the job; data without an event name, and bad JSON, are
    dropped. The lookup is two running "last value" scans keyed by job and
    ordered by line number, chunked so a huge job spans many tasks
    (:func:`scan.running_max`).
    """
    is_ev = F.col("line").startswith("event: ")
    is_data = F.col("line").startswith("data: ")
    lab = lines.select(
        "job_id", "line_no",
        F.when(is_ev, F.struct(F.col("line_no").alias("at"),
                               py_strip(F.substring(F.col("line"), 8, 1 << 30)).alias("name")))
         .alias("_ev"),
        F.when(is_data, F.substring(F.col("line"), 7, 1 << 30)).alias("_data"))
    lab = running_max(lab, ["job_id"], ["line_no"], {
        "_last_ev": F.col("_ev"),
        "_last_data": F.when(F.col("_data").isNotNull(), F.col("line_no")),
    }, exclusive=True)
    ok = (F.col("_data").isNotNull() & F.col("_last_ev").isNotNull()
          & (F.col("_last_ev.at") > F.coalesce(F.col("_last_data"), F.lit(-1)))
          & (F.length(F.col("_last_ev.name")) > 0))
    parsed = lab.filter(ok).select(
        "job_id", "line_no", F.col("_last_ev.name").alias("event"),
        F.col("_data").alias("payload"))
    return parsed.filter(F.try_parse_json(F.col("payload")).isNotNull())


def event_log_lines(ev: DataFrame) -> DataFrame:
    """The SSE text of each job as numbered lines (the writer side of SRC-5):
    ``event: X`` / ``data: {json}`` / blank, in (ts, event_id) order."""
    ranked = running_count(ev, ["job_id"], _ORDER, out="_k")
    frame = F.array(F.concat(F.lit("event: "), F.col("event")),
                    F.concat(F.lit("data: "), F.col("payload")), F.lit(""))
    return ranked.select("job_id", F.col("_k"), F.posexplode(frame).alias("_i", "line")) \
                 .select("job_id", (F.col("_k") * 3 + F.col("_i")).alias("line_no"), "line")
