"""Streams of several micro-batches equal the batch results; what a run left is
taken up by the next; a replayed epoch adds nothing."""
import datetime as dt

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from docmill.operators import jobs as J
from docmill.sources.tables import job_events
from docmill.streaming import progress as P

T0 = dt.datetime(2024, 5, 1, 12)
TYPES = {"started": "signup", "page_scraped": "view", "converting": "click", "complete": "purchase", "error": "error"}


def events(spark, rows):
    """(job, id, minutes, event) rows as an event table."""
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), job, TYPES[e], 0.0, "{}") for job, i, m, e in rows], P.EVENTS_SCHEMA)


def add(spark, feed, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(feed)


def test_feed_has_several_batches_and_all_events(spark, tmp_path):
    feed = P.write_feed(spark.read.parquet(SF_SMALL + "/events.parquet"), str(tmp_path / "feed"), 4)
    place = str(tmp_path / "log")
    log = P.run_event_drain(spark, P.feed_stream(spark, feed), place)
    assert log.select("epoch").distinct().count() >= 4
    batch = job_events(spark, SF_SMALL)
    assert sorted(log.select("job_id", "event_id", "event").collect()) == sorted(batch.select("job_id", "event_id", "event").collect())


def test_progress_by_epochs_equals_batch(spark, tmp_path):
    feed = P.write_feed(spark.read.parquet(SF_SMALL + "/events.parquet"), str(tmp_path / "feed"), 4)
    place = str(tmp_path / "progress")
    s = {r.job_id: (r.scraped, r.phase) for r in P.run_live_progress(spark, P.feed_stream(spark, feed), place).collect()}
    ev = job_events(spark, SF_SMALL)
    b_ph = {r.job_id: r.phase for r in J.latest_phase(ev).collect()}
    b_sc = {r.job_id: r.scraped for r in J.outcome(ev).collect()}
    assert s == {k: (b_sc[k], b_ph[k]) for k in b_ph}
    rows = P.table(spark, place, P.PROGRESS)
    assert rows.select("epoch").distinct().count() >= 4
    P.compact(spark, place, P.PROGRESS, "job_id")
    after = P.table(spark, place, P.PROGRESS)
    assert after.count() == len(s) and {r.job_id: (r.scraped, r.phase) for r in after.collect()} == s


def test_replayed_epoch_adds_no_row(spark, tmp_path):
    place, sink = str(tmp_path), P.epoch_sink(str(tmp_path))
    df = spark.createDataFrame([(1, 2, 3, "error")], P.PROGRESS)
    sink(df, 0)
    sink(df, 1)
    sink(df, 1)
    assert sorted(r.epoch for r in P.table(spark, place, P.PROGRESS).collect()) == [0, 1]


def test_a_later_run_goes_on(spark, tmp_path):
    feed, place = str(tmp_path / "feed"), str(tmp_path / "log")
    add(spark, feed, [(1, 1, 0, "started"), (1, 2, 1, "page_scraped")])
    assert P.run_event_drain(spark, P.feed_stream(spark, feed), place).count() == 2
    add(spark, feed, [(1, 3, 2, "complete")])
    assert P.run_event_drain(spark, P.feed_stream(spark, feed), place).count() == 3
    assert P.run_event_drain(spark, P.feed_stream(spark, feed), place).count() == 3


def test_phase_machine_ends_every_job(spark, tmp_path):
    """Events out of order and in several batches; a job quiet for long ends and
    opens again; the last word is the batch's."""
    feed, place = str(tmp_path / "feed"), str(tmp_path / "phase")
    rows = [(1, 1, 0, "started"), (1, 2, 30, "page_scraped"), (2, 3, 31, "started"), (3, 4, 32, "page_scraped")]
    later = [(1, 6, 40, "complete"), (1, 5, 35, "converting"), (2, 7, 20, "complete"), (4, 8, 45, "started")]
    much_later = [(1, 9, 9000, "page_scraped"), (4, 10, 9001, "error"), (2, 11, 9002, "page_scraped")]
    kw = {"idle": dt.timedelta(hours=12), "lifetime": dt.timedelta(days=20)}
    add(spark, feed, rows)
    P.run_phase_machine(spark, P.feed_stream(spark, feed), place, **kw)
    add(spark, feed, later)
    add(spark, feed, [(5, 12, 3000, "error")])  # time goes on without job 1
    over = P.run_phase_machine(spark, P.feed_stream(spark, feed), place, **kw)
    assert {r.job_id: r.phase for r in over.collect()} == {1: "complete", 2: "error", 3: "error", 4: "error"}
    add(spark, feed, much_later)
    P.close_feed(spark, feed, T0 + dt.timedelta(minutes=9002))
    got = {r.job_id: (r.last_phase, r.phase, r.scraped) for r in P.run_phase_machine(spark, P.feed_stream(spark, feed), place, **kw).collect()}
    assert got == {1: ("complete", "complete", 2), 2: ("scraping", "error", 1), 3: (None, "error", 1), 4: ("error", "error", 0), 5: ("error", "error", 0)}
    all_rows = P.table(spark, place, P.PHASES)
    assert all_rows.select("epoch").distinct().count() >= 3
    # job 1 was over once before it opened again
    assert all_rows.filter("ended and job_id = 1").count() == 2


def test_parts_of_several_files_are_one_batch_each(spark, tmp_path):
    """A table of several input splits: all events of a part are one micro-batch, so none is late."""
    rows = [(n % 3 if n % 10 else None, n, n * 37, ("started", "page_scraped", "converting", "complete", "error")[n % 7 % 5]) for n in range(240)]
    df = events(spark, rows)
    for k in range(3):
        df.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    files = P.read(spark, str(tmp_path), "events").rdd.getNumPartitions()
    assert files > 1
    want = {r.job_id: (r.last_phase, r.phase) for r in J.latest_phase(job_events(spark, str(tmp_path))).collect()}
    scraped = {r.job_id: r.scraped for r in J.outcome(job_events(spark, str(tmp_path))).collect()}
    place = str(tmp_path / "phase")
    got = P.run_phase_machine(spark, P.table_feed(spark, str(tmp_path)), place).collect()
    assert {r.job_id: (r.last_phase, r.phase, r.scraped) for r in got} == {k: (*v, scraped[k]) for k, v in want.items()}
    assert None in want and P.table(spark, place, P.PHASES).filter("not ended").select("epoch").distinct().count() == 4
    kept = {r.job_id: r.kept_events for r in P.run_cancel_cut(spark, P.table_feed(spark, str(tmp_path)), str(tmp_path / "cut")).collect() if r.job_id is not None}
    assert kept == {r.job_id: r.kept_events for r in J.cancel_cut(job_events(spark, str(tmp_path)), job_events(spark, str(tmp_path)).filter("event = 'error'")).collect() if r.job_id is not None}


def test_a_part_with_fewer_rows_than_files(spark, tmp_path):
    """Parts keep their number of files, whatever rows they have."""
    feed = P.write_feed(events(spark, [(1, n, n * 500, "page_scraped") for n in range(5)]), str(tmp_path / "feed"), 4, files=6)
    assert P.count_files(spark, feed) == 4 * 6 + 1
    got = P.run_phase_machine(spark, P.feed_stream(spark, feed, 6), str(tmp_path / "phase")).collect()
    assert [tuple(r) for r in got] == [(1, None, "error", 5)]


@pytest.mark.parametrize("cancel_first", [True, False])
def test_cancel_cut_in_either_order(spark, tmp_path, cancel_first):
    feed, place = str(tmp_path / "feed"), str(tmp_path / "cut")
    cancel = [(1, 50, 30, "error"), (2, 51, 5, "error")]
    rest = [(1, 1, 0, "started"), (1, 2, 10, "page_scraped"), (1, 3, 30, "page_scraped"), (1, 60, 30, "page_scraped"), (1, 4, 40, "page_scraped"),
            (2, 5, 6, "page_scraped"), (3, 6, 7, "page_scraped")]
    for part in ([cancel, rest] if cancel_first else [rest, cancel]):
        add(spark, feed, part)
    add(spark, feed, [(1, 70, 80, "error"), (1, 71, 81, "page_scraped")])
    P.close_feed(spark, feed, T0 + dt.timedelta(minutes=81))
    got = sorted(tuple(r) for r in P.run_cancel_cut(spark, P.feed_stream(spark, feed), place).collect())
    assert got == [(1, 3, 2, True, "complete"), (2, 0, 0, True, "error"), (3, 1, 1, False, "complete")]
    assert P.table(spark, place, P.CUT).select("epoch").distinct().count() >= 2


def test_dedupe_keeps_recent_urls_only(spark, tmp_path):
    """Every URL once, though it comes again hours later; the state holds the
    last half hour."""
    pages = spark.range(120).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/p"), F.pmod("id", F.lit(80))).alias("url"))
    feed = P.write_visits(pages, str(tmp_path / "feed"), 6)
    got = P.run_visited_dedupe(spark, P.visit_stream(spark, feed), str(tmp_path / "visited"))
    assert got.count() == got.select("project_id", "url").distinct().count() == 80
    states = [p["stateOperators"][0]["numRowsTotal"] for p in P.run_visited_dedupe.last.recentProgress if p["stateOperators"]]
    assert len(states) >= 6 and states[-1] <= 45  # 40 visits a part at the most, of 240 in all


def test_a_table_that_is_a_folder_of_files_is_streamed(spark, tmp_path):
    """Large tables are folders; a stream of one reads its files, of an empty one nothing."""
    pages = [(i, f"http://h{i % 2}.org/p{i}", f"<main><h1>T{i}</h1><p>x</p></main>") for i in range(4)]
    df = spark.createDataFrame(pages, P.PAGES_SCHEMA)
    df.repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = P.run_incremental_convert(spark, str(tmp_path), "2024-01-15", str(tmp_path / "run"))
    assert sorted((r.page_id, r.title) for r in got.collect()) == [(i, f"T{i}") for i in range(4)]
    df.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert P.run_incremental_convert(spark, str(tmp_path / "none"), "2024-01-15", str(tmp_path / "run2")).count() == 0
    spark.read.parquet(SF_SMALL + "/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    of_file = P.run_live_progress(spark, P.event_stream(spark, SF_SMALL), str(tmp_path / "a")).collect()
    assert sorted(of_file) == sorted(P.run_live_progress(spark, P.event_stream(spark, str(tmp_path)), str(tmp_path / "b")).collect())
