"""Library sinks and queries on small libraries (the reference's storage
tests restated as rows, plus the cases it leaves untested)."""
import datetime as dt

from pyspark.sql import functions as F

from docmill.operators import library as L

TS = dt.datetime(2024, 3, 5, 8, 0, 0)
LIB = "project_id string, position long, page_id string, title string, url string, content string"
PROJ = "project_id string, name string, url string, page_count int, scraped_at timestamp"


def _lib(spark, rows):
    return spark.createDataFrame(rows, LIB)


def _base(spark):
    lib = _lib(spark, [
        ("p1", 1, "aaa", "Intro", "https://d.org/a", "# Intro\nHello world"),
        ("p1", 2, "bbb", "Guide", "https://d.org/b", "# Guide\nMore text"),
    ])
    proj = spark.createDataFrame([("p1", "My Docs", "https://www.d.org:8080", 2, TS)], PROJ)
    return lib, proj


def test_list_get_and_pages(spark):
    lib, proj = _base(spark)
    assert [r.project_id for r in L.list_projects(proj, lib).collect()] == ["p1"]
    assert L.get_project(proj, "nope").count() == 0
    req = spark.createDataFrame([("p1", "bbb"), ("p1", "zzz")], "project_id string, page_id string")
    got = L.get_pages(lib, req).collect()
    assert [(r.page_id, r.content) for r in got] == [("bbb", "# Guide\nMore text")]


def test_empty_library_listing(spark):
    empty = spark.createDataFrame([], PROJ)
    blocks = [r.block for r in L.listing_blocks(empty).orderBy("sort_key").collect()]
    assert blocks == [L.LISTING_HEADER + L.LISTING_EMPTY]


def test_export_single_joins_with_separator(spark):
    lib, _ = _base(spark)
    txt = L.export_single_text(lib, "p1").first().export
    assert txt == "# Intro\nHello world\n\n---\n\n# Guide\nMore text"
    assert L.export_single_text(lib, "missing").count() == 0
    assert len(txt.split("\n\n---\n\n")) == 2


def test_last_write_wins_and_missing_pages(spark):
    lib = _lib(spark, [
        ("p", 1, "dup", "A", "u1", "first"),
        ("p", 2, "dup", "B", "u2", "second"),
        ("p", 3, "emp", "C", "u3", ""),
    ])
    stored = {r.page_id: r.content for r in L.save_last_wins(lib).collect()}
    assert stored == {"dup": "second", "emp": ""}
    # the manifest keeps both entries; both read the last text
    pieces = L.export_single_pieces(lib).orderBy("position").collect()
    assert [p.piece for p in pieces] == ["second", "\n\n---\n\nsecond"]
    miss = L.missing_pages(lib).collect()
    assert [(m.page_id, m.problem) for m in miss] == [("emp", "empty")]


def test_zip_entry_names(spark):
    rows = [("p", i, f"id{i}", t, f"u{i}", c) for i, (t, c) in enumerate([
        ("Intro", "x"), ("Intro", "y"), ("Empty", ""), ("Intro", "z"), ("Intro-2", "w")], start=1)]
    lib = _lib(spark, rows)
    proj = spark.createDataFrame([("p", "My Site!", "u", 5, TS)], PROJ)
    names = [r.entry for r in L.export_multi_names(lib, proj).orderBy("position").collect()]
    assert names == ["my-site/01-intro.md", "my-site/02-intro-2.md", "my-site/04-intro-3.md",
                     "my-site/05-intro-2.md"]


def test_zip_numbers_over_99(spark):
    rows = [("p", i, f"id{i}", f"t{i}", "u", "c") for i in range(1, 106)]
    proj = spark.createDataFrame([("p", "n", "u", 105, TS)], PROJ)
    names = [r.entry for r in L.export_multi_names(_lib(spark, rows), proj).orderBy("position").collect()]
    assert names[0] == "n/01-t1.md" and names[104] == "n/105-t105.md"


def test_search_cases(spark):
    lib = _lib(spark, [
        ("p", 1, "a", "A", "u", '---\ntitle: "Alpha"\nsource: "https://d.org/x"\n---\nBody TEXT'),
        ("p", 2, "b", "B", "u", "other"),
        ("p", 3, "c", "C", "u", ""),
    ])
    ids = lambda q: [r.page_id for r in L.search(lib, q, "p").orderBy("position").collect()]
    assert ids("text") == ["a"]          # case-insensitive
    assert ids("d.org") == ["a"]         # frontmatter is searched too
    assert ids("") == ["a", "b"]         # empty query: every non-empty page
    assert ids("(") == []                # literal, not a regex
    assert L.search(lib, "x", "missing").count() == 0
    fm = L.first_match(lib, "o").first()
    assert (fm.first_page_id, fm.n_matches) == ("b", 1) or fm.first_page_id == "a"


def test_search_many_chunked_broadcast(spark):
    lib, _ = _base(spark)
    terms = spark.createDataFrame([("hello",), ("guide",), ("zzz",)], "term string")
    one = L.search_many(lib, terms).select("term", "page_id").collect()
    many = L.search_many(lib, terms, max_term_bytes=10).select("term", "page_id").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) == [("guide", "bbb"), ("hello", "aaa")]


def test_delete_and_answers(spark):
    lib, proj = _base(spark)
    d = spark.createDataFrame([("p1",), ("nope",)], "project_id string")
    left, lp, ans = L.delete_projects(lib, proj, d)
    assert left.count() == 0 and lp.count() == 0
    assert {r.project_id: r.existed for r in ans.collect()} == {"p1": True, "nope": False}


def test_payload_catalogue_cards(spark):
    lib, proj = _base(spark)
    items = [r.item for r in L.export_payload_items(lib).orderBy("position").collect()]
    import json
    first = json.loads(items[0])
    assert first == {"type": "text", "text": "File: aaa.md\nSource: https://d.org/a\n\n# Intro\nHello world"}
    assert L.payload_file_name(proj).first().file_name == "www.d.org_8080_p1.json"
    c = L.catalogue(proj).first()
    assert c.uri == L.RESOURCE_SCHEME + "p1/docs.md" and c.name == "My Docs Documentation"
    assert L.resource_project_id(F.lit(c.uri)) is not None
    card = L.cards(proj).first()
    assert (card.scraped_on, card.library_total) == ("Mar 5, 2024", "1 project")


def test_stored_library_pruning_and_delete(spark, tmpdir_path):
    import os
    lib, _ = _base(spark)
    more = _lib(spark, [("p2", 1, "ccc", "X", "u", "other project")])
    path = os.path.join(tmpdir_path, "lib")
    L.write_library(lib.unionByName(more), path)
    one = L.read_library_table(spark, path, "p2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan and "p2" in plan
    assert [r.page_id for r in one.collect()] == ["ccc"]
    assert L.delete_library_projects(spark, path, ["p2", "nope"]) == {"p2": True, "nope": False}
    left = L.read_library_table(spark, path)
    assert sorted(r.page_id for r in left.collect()) == ["aaa", "bbb"]
    # dynamic overwrite replaces only the projects present in the new data
    L.write_library(_lib(spark, [("p1", 1, "aaa", "Intro", "u", "new text")]), path)
    got = {r.page_id: r.content for r in L.read_library_table(spark, path, "p1").collect()}
    assert got == {"aaa": "new text"}
