"""Structured Streaming forms of the job and crawl operators (STR-1..5, JOB-5).

Sources are ``readStream`` over folders of event or page files. A run takes the
*place* of its result: below it lie the table and the query's checkpoint, so a
later run with the same place goes on where the last one stopped. Tables are
written by epoch (``epoch_sink``): each micro-batch owns the folder
``epoch=<n>`` and replaces it whole, so a batch that is replayed after a failure
adds nothing, and no batch rewrites what others wrote. A table whose rows
supersede each other (``latest``) is read by taking each key's row of the
greatest epoch; ``compact`` folds old epochs into one.

``trigger(availableNow=True)`` drains what is there and stops. A feed can be
closed by an END row, far ahead in event time: it moves the watermark past
all that came before, so timers fire and open join rows come out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import normalize_url, url_authority, url_scheme
from ..operators import jobs as J
from ..session import shared_path
from ..sources.tables import EVENT_MAP, read

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
VISITS_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])
#: How far events of a feed may be out of order.
LATENESS = "2 hours"
#: A job is over when it has been quiet for so long ...
IDLE = dt.timedelta(days=3)
#: ... and forgotten, also by the cancel join, after so long.
JOB_LIFETIME = dt.timedelta(days=31)
#: The row that closes a feed.
END, END_JOB = "end_of_input", -1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, sf_dir: str, table: str, schema: T.StructType,
                max_files: int | None = None) -> DataFrame:
    """The table's file, or the files of its folder, as a stream. The name is
    given as a pattern: Spark takes a plain path for a folder."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir.rstrip('/')}/{table}.parque[t]")


def as_job_events(e: DataFrame) -> DataFrame:
    """Event files as ``job_events``; END rows keep their name."""
    m = F.create_map(*[x for k, v in {**EVENT_MAP, END: END}.items() for x in (F.lit(k), F.lit(v))])
    return e.select(F.col("user_id").alias("job_id"), "event_id", "ts",
                    m[F.col("event_type")].alias("event"), F.col("props").alias("payload"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` files as a live ``job_events`` stream."""
    return as_job_events(read_stream(spark, sf_dir, "events", EVENTS_SCHEMA))


def feed_stream(spark: SparkSession, feed: str, files: int = 1) -> DataFrame:
    """A folder of event files as a stream, so many files a micro-batch."""
    return as_job_events(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files).parquet(feed))


def write_feed(events: DataFrame, feed: str, batches: int = 4, jitter_minutes: int = 60, close: bool = True, files: int = 1) -> str:
    """``events`` as files that arrive in ``batches`` parts: in the order of
    time, but each event up to ``jitter_minutes`` late. A part has ``files``
    files, of which none is in order: only a micro-batch of them all keeps
    the watermark behind the events of the part."""
    spark = events.sparkSession
    late = F.pmod(F.xxhash64("event_id"), F.lit(max(1, jitter_minutes)))
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + late * 60_000_000
    timed = events.select(*[f.name for f in EVENTS_SCHEMA], arrival.alias("_at"))
    lo, hi = timed.agg(F.min("_at"), F.max("_at")).first()
    if lo is None:
        timed.drop("_at").coalesce(1).write.mode("append").parquet(feed)
        return feed
    width = (hi - lo) // batches + 1
    for k in range(batches):
        part = timed.filter(F.floor((F.col("_at") - lo) / width) == k).drop("_at")
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(feed)
        # few rows make fewer files: empty ones take their place
        for _ in range((k + 1) * files - count_files(spark, feed)):
            spark.createDataFrame([], EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    if close:
        close_feed(spark, feed, events.agg(F.max("ts")).first()[0])
    return feed


def count_files(spark: SparkSession, folder: str) -> int:
    """Data files of a folder that Spark wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sum(not f.getPath().getName().startswith(("_", ".")) for f in found)


def close_feed(spark: SparkSession, feed: str, last: dt.datetime) -> None:
    """Add the END row, later than all timers that events up to ``last`` set."""
    end = (0, last + 2 * JOB_LIFETIME, END_JOB, END, None, None)
    spark.createDataFrame([end], EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(feed)


def _place(spark: SparkSession, place: str | None, name: str) -> str:
    return place or shared_path(spark, name)


def _drain(writer, name: str, place: str):
    q = writer.option("checkpointLocation", place + "/checkpoint").trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    return q


def epoch_sink(place: str):
    """``foreachBatch`` writer: an epoch's rows are its folder, nothing else."""
    def write(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{place}/table/epoch={epoch}")

    return write


def table(spark: SparkSession, place: str, schema: T.StructType) -> DataFrame:
    """All epochs of a table, with their ``epoch``."""
    return spark.read.schema(T.StructType([*schema, T.StructField("epoch", T.LongType())])).parquet(place + "/table")


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Each key's row of the greatest epoch."""
    rest = [c for c in rows.columns if c not in (*key, "epoch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*key, "_r.*")


def compact(spark: SparkSession, place: str, schema: T.StructType, *key: str) -> None:
    """Fold all epochs into the newest one's folder. Run it between runs of the
    query: the new folder is written aside and then takes the place of the old
    ones, greatest epoch last, so a reader never misses a key."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = path(place).getFileSystem(conf)
    rows = table(spark, place, schema)
    epochs = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path(place + "/table")))
    if len(epochs) < 2:
        return
    aside = f"{place}/compact-{epochs[-1]}"
    latest(rows, *key).write.mode("overwrite").parquet(aside)
    fs.delete(path(f"{place}/table/epoch={epochs[-1]}"), True)
    fs.rename(path(aside), path(f"{place}/table/epoch={epochs[-1]}"))
    for e in epochs[:-1]:
        fs.delete(path(f"{place}/table/epoch={e}"), True)


# STR-1 --------------------------------------------------------------------
PROGRESS = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("events", T.LongType()), T.StructField("scraped", T.LongType()),
    T.StructField("phase", T.StringType()),
])


def live_progress(events: DataFrame) -> DataFrame:
    """Per job: events seen, pages scraped, phase -- a streaming aggregation
    (state = one row per job)."""
    ph = J._phase()
    agg = events.filter(F.col("event") != END).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event") == "page_scraped").alias("scraped"),
        F.max(F.when(ph.isNotNull(), F.struct("ts", "event_id", ph.alias("phase")))).alias("_l"))
    p = F.coalesce(F.col("_l.phase"), F.lit("scraping"))
    return agg.select("job_id", "events", "scraped", F.when(p.isin(*J.FINAL_PHASES), p).otherwise(F.lit("error")).alias("phase"))


def run_live_progress(spark: SparkSession, events: DataFrame, place: str | None = None) -> DataFrame:
    """Drains the stream in update mode: a micro-batch writes the jobs that it
    changed; the current table is each job's latest row."""
    place = _place(spark, place, "str_progress")
    _drain(live_progress(events).writeStream.outputMode("update").foreachBatch(epoch_sink(place)), "str_progress", place)
    return latest(table(spark, place, PROGRESS), "job_id")


# STR-2 --------------------------------------------------------------------
PHASES = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("last_phase", T.StringType()), T.StructField("phase", T.StringType()),
    T.StructField("scraped", T.LongType()), T.StructField("ended", T.BooleanType()),
])


#: Before any time and any id, in the place of null.
_NEVER = -(1 << 63)
#: Parts into which jobs are dealt by hash; each has one state. Fixed for a place.
BUCKETS = 1024


def _ms(t: dt.timedelta) -> int:
    return int(t.total_seconds() * 1000)


class PhaseMachine(StatefulProcessor):
    """The client's reducer per job. State of a job: the latest phase-setting
    event, the pages counted, the time of the last event, whether the job is
    over. A job that was quiet for ``idle`` is over: its phase is final,
    ``error`` if it never came to one. Later events open it again; ``lifetime``
    after its last event it is forgotten.

    Each use of a state variable is a message to the JVM, so the jobs of a
    bucket share one value, an array a field, and one timer. Events that come
    later don't move the timer: when it comes, each job's last event tells
    what is due, and the timer goes to the next."""

    def __init__(self, idle: dt.timedelta, lifetime: dt.timedelta):
        self.idle, self.lifetime = _ms(idle), _ms(lifetime)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "job array<long>, phase array<string>, ts_us array<long>, event_id array<long>, "
                                         "scraped array<long>, last_ms array<long>, ended array<boolean>, due_ms long")

    def _read(self) -> tuple[dict, int | None]:
        """job -> [phase, ts_us, event_id, scraped, last_ms, ended], and when the timer is due."""
        if not self.jobs.exists():
            return {}, None
        *columns, due = self.jobs.get()
        return {job: rest for job, *rest in zip(*columns)}, due

    def _write(self, jobs: dict, due: int | None) -> None:
        self.jobs.update((*map(list, zip(*((job, *rest) for job, rest in jobs.items()))), due))

    def _rows(self, jobs: list, ended: bool) -> pd.DataFrame:
        phases, scraped = [j[0] for _, j in jobs], [j[3] for _, j in jobs]
        shown = [p if p in J.FINAL_PHASES else "error" if ended else p or "scraping" for p in phases]
        return pd.DataFrame({"job_id": pd.Series([i for i, _ in jobs], dtype="Int64"), "last_phase": pd.Series(phases, dtype="object"),
                             "phase": shown, "scraped": scraped, "ended": ended})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, due = self._read()
        came, before = {}, due
        for pdf in rows:
            for i, missing, us, event_id, event in zip(*(pdf[c].tolist() for c in ("job_id", "no_job", "us", "event_id", "event"))):
                i = None if missing else i
                if i == END_JOB:
                    continue
                job = came.get(i)
                if job is None:
                    job = came[i] = jobs.setdefault(i, [None, _NEVER, _NEVER, 0, None, False])
                last = max(us // 1000, -1)
                if job[4] is None or last > job[4]:
                    job[4], job[5] = last, False
                if event == "page_scraped":
                    job[3] += 1
                sets = J.PHASE_OF_EVENT.get(event)
                if sets is not None and (job[0] is None or (us, event_id) > (job[1], job[2])):
                    job[:3] = sets, us, event_id
        if not came:
            return
        quiet = [job[4] + self.idle for job in came.values() if not job[5]]
        due = min(quiet if due is None else [due, *quiet])
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        self._write(jobs, due)
        yield self._rows(list(came.items()), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, _ = self._read()
        now, over = timerValues.getCurrentWatermarkInMs(), []
        for i, job in jobs.items():
            if not job[5] and job[4] + self.idle <= now:
                job[5] = True
                over.append((i, job))
        jobs = {i: job for i, job in jobs.items() if not job[5] or job[4] + self.lifetime > now}
        if jobs:
            due = min(job[4] + (self.lifetime if job[5] else self.idle) for job in jobs.values())
            self.handle.registerTimer(due)
            self._write(jobs, due)
        else:
            self.jobs.clear()
        if over:
            yield self._rows(over, True)

    def close(self) -> None:
        pass


def phase_machine(events: DataFrame, idle: dt.timedelta = IDLE, lifetime: dt.timedelta = JOB_LIFETIME) -> DataFrame:
    """STR-2: rows of a job as its phase changes (``ended`` false) and when it is over."""
    never = F.lit(_NEVER)
    return (events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", LATENESS)
                  .select(F.pmod(F.hash("job_id"), F.lit(BUCKETS)).alias("bucket"), F.coalesce("job_id", F.lit(0)).alias("job_id"),
                          F.col("job_id").isNull().alias("no_job"), F.coalesce("event_id", never).alias("event_id"), "event",
                          F.coalesce(F.unix_micros("event_time"), never).alias("us"), "event_time")
                  .groupBy("bucket").transformWithStateInPandas(PhaseMachine(idle, lifetime), PHASES, "Update", "EventTime"))


def run_phase_machine(spark: SparkSession, events: DataFrame, place: str | None = None, **times) -> DataFrame:
    """Final phase of each job that is over (latest ended row)."""
    place = _place(spark, place, "str_phase")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        _drain(phase_machine(events, **times).writeStream.outputMode("update").foreachBatch(epoch_sink(place)), "str_phase", place)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return latest(table(spark, place, PHASES).filter("ended"), "job_id").drop("ended")


# STR-3 --------------------------------------------------------------------
def run_incremental_convert(spark: SparkSession, sf_dir: str, scraped_on: str, place: str | None = None) -> DataFrame:
    """Pages are parsed, selected and rendered as they arrive; stateless,
    written as parquet partitioned by site."""
    from ..operators.content import analyze_pages
    from ..operators.html_nodes import with_nodes
    from ..operators.markdown import convert_pages
    pages = read_stream(spark, sf_dir, "pages", PAGES_SCHEMA)
    a = analyze_pages(with_nodes(pages)).filter(F.col("root").isNotNull()) \
        .withColumn("url", normalize_url(F.col("url"))) \
        .withColumn("project_id", F.concat(url_scheme(F.col("url")), F.lit("://"),
                                           url_authority(F.col("url"))))
    conv = convert_pages(a, scraped_on, keep=["project_id", "page_id", "url", "title"])
    place = _place(spark, place, "str_convert")
    _drain(conv.writeStream.format("parquet").option("path", place + "/table").partitionBy("project_id"), "str_convert", place)
    return spark.read.schema(conv.schema).parquet(place + "/table")


# STR-4 --------------------------------------------------------------------
VISITED = T.StructType([
    T.StructField("project_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("page_id", T.LongType()),
])


def visit_stream(spark: SparkSession, feed: str, files: int = 1) -> DataFrame:
    """A folder of visit files (``VISITS_SCHEMA``) as a stream."""
    return spark.readStream.schema(VISITS_SCHEMA).option("maxFilesPerTrigger", files).parquet(feed)


def write_visits(pages: DataFrame, feed: str, batches: int = 4) -> str:
    """``pages`` as visits that arrive in parts, an hour between parts. A page
    is visited twice: in its part and again two parts later."""
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    part = F.pmod(F.xxhash64("page_id"), F.lit(batches)).cast("int")
    for k in range(batches):
        own = pages.filter((part == k) | (F.pmod(part + 2, F.lit(batches)) == k))
        own.select("page_id", "url", (start + F.make_interval(hours=F.lit(k))).alias("fetched_at")).coalesce(1).write.mode("append").parquet(feed)
    return feed


def run_visited_dedupe(spark: SparkSession, visits: DataFrame, place: str | None = None, within: str = "30 minutes") -> DataFrame:
    """First arrival of each (site, normalized URL) wins. The stream's state
    holds the URLs of the last ``within`` only; what is older is met in the
    stored table by an anti join. An epoch reads the epochs before it, so its
    replay gives the same rows."""
    place = _place(spark, place, "str_dedupe")
    u = normalize_url(F.col("url"))
    recent = (visits.withWatermark("fetched_at", within)
              .select(F.concat(url_scheme(F.col("url")), F.lit("://"), url_authority(F.col("url"))).alias("project_id"), u.alias("url"), "page_id", "fetched_at")
              .dropDuplicatesWithinWatermark(["project_id", "url"]))
    sink = epoch_sink(place)

    def write(batch: DataFrame, epoch: int):
        batch = batch.drop("fetched_at")
        if epoch > 0:
            known = table(batch.sparkSession, place, VISITED).filter(F.col("epoch") < epoch)
            batch = batch.join(known, ["project_id", "url"], "left_anti")
        sink(batch, epoch)

    run_visited_dedupe.last = _drain(recent.writeStream.foreachBatch(write), "str_dedupe", place)
    return table(spark, place, VISITED).drop("epoch")


# STR-5 --------------------------------------------------------------------
EVENT_LOG = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event", T.StringType()), T.StructField("payload", T.StringType()),
])


def run_event_drain(spark: SparkSession, events: DataFrame, place: str | None = None) -> DataFrame:
    """Events written to the ``job_events`` table, an epoch a micro-batch; order
    lives in the (ts, event_id) columns, never in arrival."""
    place = _place(spark, place, "str_event_log")
    _drain(events.filter(F.col("event") != END).writeStream.foreachBatch(epoch_sink(place)), "str_event_log", place)
    return table(spark, place, EVENT_LOG)


# JOB-5 live ------------------------------------------------------------------
CUT = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("cut", T.BooleanType()),
])


def cancel_join(events: DataFrame, cancels: DataFrame, lifetime: dt.timedelta = JOB_LIFETIME) -> DataFrame:
    """Each event with ``cut``: whether a cancel of its job lies at or before
    it, in the order of (ts, event_id). An outer join of two streams: an event
    waits until the watermark has passed it, a cancel is kept for
    ``lifetime``. An event behind several cancels comes out several times."""
    e = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", LATENESS).alias("e")
    c = (cancels.select(F.col("job_id").alias("c_job"), F.col("event_id").alias("c_id"), F.col("ts").cast("timestamp").alias("c_time"))
         .withWatermark("c_time", LATENESS).alias("c"))
    on = ((F.col("job_id") == F.col("c_job")) & (F.col("c_time") <= F.col("event_time"))
          & (F.col("c_time") >= F.col("event_time") - F.make_dt_interval(secs=F.lit(lifetime.total_seconds())))
          & ((F.col("c_time") < F.col("event_time")) | (F.col("c_id") <= F.col("event_id"))))
    return e.join(c, on, "left_outer").select("job_id", "event_id", "event", F.col("c_id").isNotNull().alias("cut"))


def run_cancel_cut(spark: SparkSession, events: DataFrame, place: str | None = None) -> DataFrame:
    """JOB-5 live: cancels are the job's error events. Per job: events and pages
    before the first cancel, and the outcome. A cancel that arrives before or
    after the events that it cuts, within ``LATENESS``, cuts them alike."""
    place = _place(spark, place, "str_cancel")
    cancels = events.filter(F.col("event").isin("error", END))
    _drain(cancel_join(events, cancels).writeStream.outputMode("append").foreachBatch(epoch_sink(place)), "str_cancel", place)
    rows = table(spark, place, CUT).filter(F.col("job_id") != END_JOB)
    each = rows.groupBy("job_id", "event_id").agg(F.max("cut").alias("cut"), F.max("event").alias("event"))
    agg = each.groupBy("job_id").agg(F.count_if(~F.col("cut")).alias("kept_events"),
                                     F.count_if(~F.col("cut") & (F.col("event") == "page_scraped")).alias("kept_pages"),
                                     F.max("cut").alias("cancelled"))
    return agg.select("job_id", "kept_events", "kept_pages", "cancelled",
                      F.when(F.col("kept_pages") > 0, F.lit("complete")).otherwise(F.lit("error")).alias("outcome"))


# the registered queries' feeds --------------------------------------------------
def table_feed(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The ``events`` table as a closed feed of several micro-batches, one for a
    part of the feed whatever the table's size; a part has as many files as
    the table has input splits."""
    events = read(spark, sf_dir, "events")
    files = max(1, events.rdd.getNumPartitions())
    return feed_stream(spark, write_feed(events, shared_path(spark, "event-feed"), batches, files=files), files)


def visits_feed(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    return visit_stream(spark, write_visits(read(spark, sf_dir, "pages"), shared_path(spark, "visit-feed"), batches))
