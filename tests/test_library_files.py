"""SRC-3/4: a library folder in the reference's layout, read by Spark, and
the sharded text sinks read back."""
import glob
import json
import os

from docmill.operators import library as L
from docmill.sources.library_files import read_library


def _write_layout(root):
    os.makedirs(os.path.join(root, "a1b2c3"), exist_ok=True)
    os.makedirs(os.path.join(root, "zz-no-manifest"), exist_ok=True)
    man = {"id": "a1b2c3", "name": "Docs", "url": "https://d.org",
           "pages": [{"id": "p1", "title": "One", "url": "https://d.org/1"},
                     {"id": "p2", "title": "Two", "url": "https://d.org/2"},
                     {"id": "p3", "title": "Gone", "url": "https://d.org/3"}],
           "page_count": 3, "scraped_at": "2024-02-01T10:00:00.123456+00:00"}
    with open(os.path.join(root, "a1b2c3", "manifest.json"), "w") as f:
        json.dump(man, f, indent=2)
    for pid, txt in [("p1", "# One\n\nfirst\n"), ("p2", "# Two\nsecond\n")]:
        with open(os.path.join(root, "a1b2c3", f"{pid}.md"), "w", encoding="utf-8") as f:
            f.write(txt)
    with open(os.path.join(root, "zz-no-manifest", "x.md"), "w") as f:
        f.write("orphan")


def test_read_library_layout(spark, tmpdir_path):
    _write_layout(tmpdir_path)
    projects, pages = read_library(spark, tmpdir_path)
    assert [r.project_id for r in projects.collect()] == ["a1b2c3"]
    rows = {r.page_id: (r.position, r.content) for r in pages.collect()}
    assert rows == {"p1": (1, "# One\n\nfirst\n"), "p2": (2, "# Two\nsecond\n"), "p3": (3, None)}
    miss = L.missing_pages(pages.select("project_id", "position", "page_id", "title", "url", "content"))
    assert [r.page_id for r in miss.collect()] == ["p3"]


def test_export_sinks_round_trip(spark, tmpdir_path):
    _write_layout(tmpdir_path)
    _, pages = read_library(spark, tmpdir_path)
    lib = pages.select("project_id", "position", "page_id", "title", "url", "content")
    out = os.path.join(tmpdir_path, "export")
    L.write_export(L.export_single_pieces(lib), out)
    parts = sorted(glob.glob(os.path.join(out, "project_id=a1b2c3", "part-*")))
    text = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert text == "# One\n\nfirst\n\n\n---\n\n# Two\nsecond\n"
    pay = os.path.join(tmpdir_path, "payload")
    L.write_payload(L.export_payload_items(lib), pay)
    parts = sorted(glob.glob(os.path.join(pay, "project_id=a1b2c3", "part-*")))
    arr = json.loads("".join(open(p, encoding="utf-8").read() for p in parts))
    assert [a["text"].split("\n")[0] for a in arr] == ["File: p1.md", "File: p2.md"]


def test_markdown_files_are_listed_by_tasks(spark, tmpdir_path, monkeypatch):
    """The driver gives Spark no list of files; every file is read, whatever its name."""
    from pyspark.sql import DataFrameReader

    from docmill.sources.library_files import read_markdown

    want = {}
    for p in ("a1", "b c", "_p"):
        os.makedirs(os.path.join(tmpdir_path, p))
        for n, text in (("x", "one\n"), ("x y", ""), ("é%", "two\r\nthree"), ("_h", "hidden"), ("_a=b", "k"), (".d", "hidden")):
            with open(os.path.join(tmpdir_path, p, n + ".md"), "w", encoding="utf-8", newline="") as f:
                f.write(text)
            if text and text != "hidden":
                want[p.replace(" ", "%20"), n.replace("%", "%25")] = text
        with open(os.path.join(tmpdir_path, p, "other.txt"), "w") as f:
            f.write("x")
    with open(os.path.join(tmpdir_path, "top.md"), "w") as f:
        f.write("x")
    old = spark.read.text(f"{tmpdir_path}/*/*.md", wholetext=True).select("value").collect()
    monkeypatch.setattr(DataFrameReader, "text", lambda *a, **k: 1 / 0)
    rows = read_markdown(spark, tmpdir_path).collect()
    assert {(r.project_id, r.page_id): r.content for r in rows} == want and len(rows) == len(want)
    assert sorted(r.value for r in old) == sorted(want.values())
