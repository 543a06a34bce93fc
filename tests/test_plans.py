"""Plan shapes the design relies on (checked on sf0.001 plans)."""
import re

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_page_pipeline_has_no_hash_shuffle(spark):
    import __spark_entry__ as E
    for name in ("htm_content_text", "htm_title", "htm_strip_counts", "htm_node_counts"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "hashpartitioning" not in plan, name          # nodes never shuffle
        assert "ArrowEvalPython" in plan, name               # one Arrow parse per page


def test_search_is_one_pruned_scan(spark):
    import __spark_entry__ as E
    df = E.queries()["lib_search"](spark, SF_SMALL)
    plan = _plan(df)
    assert "Join" not in plan and plan.count("FileScan parquet") == 1   # no id repeats: texts are read once
    text = _formatted(spark, df)
    assert "Contains(lower(text" in text                        # predicate sits on the scan
    for schema in re.findall(r"ReadSchema: (struct<[^\n]*>)", text):
        assert "lang" not in schema and "n_chars" not in schema    # pruned columns


def test_top_k_is_window_group_limit(spark):
    import __spark_entry__ as E
    assert "WindowGroupLimit" in _plan(E.queries()["job_latest4"](spark, SF_SMALL))


def test_job_aggregates_are_partial(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["job_latest_phase"](spark, SF_SMALL))
    assert "partial_max" in plan


def test_crawl_library_moves_no_content(spark):
    """Content nodes are in no shuffle of the whole crawl job's result."""
    import __spark_entry__ as E
    plan = _formatted(spark, E.queries()["crw_job_library"](spark, SF_SMALL))
    for block in plan.split("\n\n"):
        if "Exchange" in block and "BroadcastExchange" not in block and block.startswith("("):
            assert "content" not in block and "html" not in block, block
