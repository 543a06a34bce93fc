"""The saved library: buckets, manifest entries and gram search, by hand-made
libraries and against plain scans."""
import random

import pytest

from docmill.operators import library as L
from docmill.operators import library_store as LS
from docmill.operators import term_scan

LIB = "project_id string, position long, page_id string, title string, url string, content string"


@pytest.fixture(scope="module")
def lib(spark):
    rnd = random.Random(2)
    words = ["Straße", "İstanbul", "die", "THE", "theme", "ab", "é", "x", "日本", "a_b%", "😀", "of", "zz"]
    rows = []
    for p in ("alpha", "beta", "c/d"):
        for i in range(40):
            content = rnd.choice([None, "", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))])
            rows.append((p, i, f"id{rnd.randint(0, 24)}", f"T{i}", f"u{i}", content))
    rows += [("beta", 100 + i, "hot", "H", "u", f"the hot page {i}") for i in range(200)]
    return spark.createDataFrame(rows, LIB).repartition(4), rows


@pytest.fixture(scope="module")
def store(lib):
    s = LS.save(lib[0])
    LS.index_grams(s)
    yield s
    LS.drop(s)


def stored(rows):
    last = {}
    for r in sorted(rows, key=lambda r: r[1]):
        last[r[0], r[2]] = r[5]
    return last


def test_lookup_reads_one_bucket(spark, store, lib):
    last = stored(lib[1])
    for key in (("beta", "hot"), ("alpha", lib[1][0][2]), ("c/d", "nowhere")):
        got = LS.get_page(store, *key)
        assert [r["content"] for r in got.collect()] == ([last[key]] if key in last else [])
    # the plan names the buckets only where the scan isn't made plain for a lookup alone
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = LS.get_page(store, "beta", "hot")._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of" in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_batch_lookup(spark, store, lib, monkeypatch):
    last = stored(lib[1])
    req = spark.createDataFrame([*last, *list(last)[:5], ("alpha", "nowhere")], "project_id string, page_id string")
    for bound in (1000, 3):  # buckets by name, and joined bucket by bucket
        monkeypatch.setattr(LS, "LITERAL_KEYS", bound)
        assert {(r["project_id"], r["page_id"]): r["content"] for r in LS.get_pages(store, req).collect()} == last


def test_entries_move_no_text(store, lib):
    """Each entry with the last text of its id; no exchange below the join."""
    last = stored(lib[1])
    got = sorted((r["project_id"], r["position"], r["content"] or "") for r in LS.entries(store).collect())
    assert got == sorted((p, i, last[p, page] or "") for p, i, page, *_ in lib[1])
    plan = LS.entries(store)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("content#") and plan.count("FileScan parquet") == 2
    miss = {(r["project_id"], r["position"]): r["problem"] for r in LS.missing_pages(store).collect()}
    assert miss == {(p, i): "missing" if last[p, page] is None else "empty" for p, i, page, *_ in lib[1] if not last[p, page]} and miss


def test_gram_search_against_scan(spark, store, lib):
    terms = ["the", "THE ", "straße", "İSTANBUL", "i̇stan", "d", "ab", "z", "zz", "日本", "😀", "a_b%", "hot page 19", "", None, "not there", "the", "e t", "é x"]
    asked = spark.createDataFrame(list(enumerate(terms)), "n int, term string")
    last = stored(lib[1])
    lower = dict(spark.createDataFrame([(x,) for x in {*terms, *last.values()}], "t string").selectExpr("t", "lower(t)").collect())
    want = sorted((n, p, i) for n, t in enumerate(terms) if t is not None for p, i, page, *_ in lib[1]
                  if last[p, page] and lower[t] in lower[last[p, page]])
    for found in (LS.search_many(store, asked), L.search_many(lib[0], asked), L.search_many(lib[0], asked, max_term_bytes=10)):
        got = sorted((r["n"], r["project_id"], r["position"]) for r in found.collect())
        assert got == want and len({n for n, *_ in got}) >= 13
    one = sorted(tuple(r) for r in LS.search(store, "The", "beta").collect())
    assert one == sorted(tuple(r) for r in L.search(lib[0], "The", "beta").collect())


def test_search_has_no_nested_loop(spark, store, lib):
    asked = spark.createDataFrame([(1, "theme")], "n int, term string")
    for found in (LS.search_many(store, asked), L.search_many(lib[0], asked)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_term_scan_by_pieces(monkeypatch):
    """Texts looked at one by one or together give the same hits."""
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    terms = ["", "a", "é", "ab", "zz", "abc", "a b", "cab ", "".join("abcab")]
    index = term_scan.TermIndex(terms)
    want = sorted((i, k) for i, t in enumerate(texts) for k, x in enumerate(terms) if t and x in t)
    assert sorted(index.hits(texts)) == want
    assert sorted((i, k) for i, t in enumerate(texts) for _, k in index.hits([t])) == want


def test_empty_library(spark):
    s = LS.save(spark.createDataFrame([], LIB))
    LS.index_grams(s)
    assert LS.entries(s).count() == 0 and LS.get_page(s, "a", "b").count() == 0 and LS.search(s, "x").count() == 0 and LS.search(s, "").count() == 0
    LS.drop(s)


def test_index_rows_hold_many_pages(spark, store):
    """A gram has a row for the pages a task saw together, not one for each page;
    the counts are those of the pages that hold it."""
    texts = [(r["page_no"], r["content"].lower()) for r in store.table("texts").filter("length(content) > 0").collect()]
    want = {}
    for no, t in texts:
        for g in {(t + "\0\0")[i:i + 3] for i in range(len(t))}:
            want.setdefault(tuple(LS.PAD if c == "\0" else ord(c) for c in g), set()).add(no)
    want = {sum(c << LS.CODE_BITS * (2 - i) for i, c in enumerate(g)): pages for g, pages in want.items()}
    rows = store.grams("grams").collect()
    got = {}
    for r in rows:
        got.setdefault(r["gram"], []).extend(r["page_nos"])
    assert {g: sorted(p) for g, p in got.items()} == {g: sorted(p) for g, p in want.items()}
    assert len(rows) < sum(map(len, want.values()))
    counts = {r["gram"]: r["pages"] for r in store.grams("gram_counts").collect()}
    assert counts == {g: len(p) for g, p in want.items()}


def test_candidates_hold_the_rarest_grams(spark):
    """Pages that lack one of a term's rarest grams are not fetched."""
    rows = [("p", i, f"id{i}", "T", "u", t) for i, t in enumerate(["abcxyz", "abc", "bcx", "cxy", "xyz", "abcx cxyz", "bcx cxy", "abcxyz again"])]
    s = LS.save(spark.createDataFrame(rows, LIB))
    LS.index_grams(s)
    terms = spark.createDataFrame([("abcxyz",), ("zz",), ("ab",), ("nowhere",)], "q string")
    number = {r["page_no"]: r["page_id"] for r in s.table("texts").collect()}
    got = sorted((r["q"], number[r["page_no"]]) for r in LS.candidates(s, terms).collect())
    assert got == [("ab", "id0"), ("ab", "id1"), ("ab", "id5"), ("ab", "id7"), ("abcxyz", "id0"), ("abcxyz", "id5"), ("abcxyz", "id7")]
    found = LS.search_many(s, spark.createDataFrame([("ABCxyz",)], "term string")).collect()
    assert sorted(r["page_id"] for r in found) == ["id0", "id7"]
    LS.drop(s)
