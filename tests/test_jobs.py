"""Job events: the client's cases (stream ending at once, cancel, full
run) and the event-log parser's (data without event, bad JSON)."""
import datetime as dt

from docmill.operators import jobs as J

EV = "job_id long, event_id long, ts timestamp, event string, payload string"


def t(s):
    return dt.datetime(2024, 1, 1, 0, 0, s)


def _ev(spark):
    rows = [
        (1, 1, t(1), "started", '{"url": "u"}'), (1, 2, t(2), "page_scraped", '{"scraped": 1, "k": 9}'),
        (1, 3, t(3), "page_scraped", '{"scraped": 2, "k": 7}'), (1, 4, t(4), "converting", "{}"),
        (1, 5, t(5), "complete", "{}"),
        (2, 6, t(1), "started", "{}"),                                  # ends at once -> error
        (3, 7, t(1), "started", "{}"), (3, 8, t(2), "page_scraped", '{"k": 1}'),
        (3, 9, t(3), "error", "{}"), (3, 10, t(4), "page_scraped", '{"k": 2}'),
    ]
    return spark.createDataFrame(rows, EV)


def test_phase_and_outcome(spark):
    ev = _ev(spark)
    ph = {r.job_id: r.phase for r in J.latest_phase(ev).collect()}
    assert ph == {1: "complete", 2: "error", 3: "error"}
    oc = {r.job_id: r.outcome for r in J.outcome(ev).collect()}
    assert oc == {1: "complete", 2: "error", 3: "complete"}


def test_running_and_latest_and_progress(spark):
    ev = _ev(spark)
    rc = sorted((r.job_id, r.event_id, r.scraped, r.queued) for r in J.running_counts(ev).collect())
    assert rc == [(1, 2, 1, 9), (1, 3, 2, 15), (3, 8, 1, 1), (3, 10, 2, 2)]
    more = spark.createDataFrame([(5, 1, t(1), "sitemap_discovered", '{"k": 4}'), (5, 2, t(2), "page_skipped", '{"k": 3}'),
                                  (5, 3, t(3), "page_scraped", "no json"), (5, 4, t(4), "started", '{"k": 99}'), (5, 5, t(5), "page_scraped", '{"k": 0}')], EV)
    assert sorted((r.event_id, r.scraped, r.queued) for r in J.running_counts(more).collect()) == [(3, 1, 6), (5, 2, 5)]
    l4 = [r.event_id for r in J.latest_pages(ev, 1).collect()]
    assert sorted(l4) == [3, 10]
    pr = {r.job_id: (r.scraped, r.progress_pct, r.queued_shown) for r in J.progress(ev, 2).collect()}
    assert pr[1] == (2, 95.0, 0) and pr[2] == (0, 0.0, 0)


def test_cancel_cut(spark):
    ev = _ev(spark)
    cancels = spark.createDataFrame([(1, 0, t(3)), (1, 0, t(9))], "job_id long, event_id long, ts timestamp")
    r = {x.job_id: x for x in J.cancel_cut(ev, cancels).collect()}
    assert (r[1].kept_events, r[1].kept_pages, r[1].outcome) == (2, 1, "complete")
    assert r[2].cancelled is False and r[2].kept_events == 1


def test_event_log_parse(spark):
    lines = ["event: started", 'data: {"a": 1}', "", 'data: {"orphan": 1}', "event: page_scraped",
             "", 'data: {"b": 2}', "event: x", "data: not json", "event: first", "event: second",
             'data: {"c": 3}']
    df = spark.createDataFrame([(7, i, s) for i, s in enumerate(lines)], "job_id long, line_no long, line string")
    got = [(r.event, r.payload) for r in J.parse_event_log(df).orderBy("line_no").collect()]
    assert got == [("started", '{"a": 1}'), ("page_scraped", '{"b": 2}'), ("second", '{"c": 3}')]


def test_histogram(spark):
    h = {r.job_id: r for r in J.event_histogram(_ev(spark)).collect()}
    assert h[1].page_scraped == 2 and h[2].complete == 0
