"""Driver contract: entry() and every registered query run on sf0.001."""
import pytest

from conftest import SF_SMALL


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["page_id", "url", "title", "content_chars"]


def test_registry_has_oracles_for_sql_expressible_ops():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("name", ["url_doc_links", "htm_title", "lib_export_multi_names",
                                  "job_running_counts", "crw_bfs_order", "str_progress"])
def test_some_queries_run(spark, name):
    import __spark_entry__ as E
    assert E.queries()[name](spark, SF_SMALL).count() >= 0
