"""Sitemap parse and discovery (inline XML, gzip, 404, filter, dedupe,
file cap, cycle, broken gzip, nested loc, wrong root)."""
import gzip

from docmill.sources import sitemaps as SM

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _docs(spark, rows):
    return spark.createDataFrame(rows, "url string, status int, body binary")


def test_parse_cases(spark):
    rows = [
        ("https://x/a.xml", 200, f"<urlset {NS}><url><loc>https://x/docs/1</loc></url><url><loc>https://x/docs/2</loc></url></urlset>".encode()),
        ("https://x/b.xml", 200, f"<sitemapindex {NS}><sitemap><loc>https://x/c1.xml</loc></sitemap><sitemap><loc>https://x/c2.xml</loc></sitemap></sitemapindex>".encode()),
        ("https://x/c.xml", 200, b"<urlset><url><loc>  https://x/docs/3 \n</loc></url></urlset>"),
        ("https://x/d.xml", 200, b"not xml <<"),
        ("https://x/e.xml", 200, b"<feed><loc>https://x/no</loc></feed>"),
        ("https://x/f.xml", 200, b"<urlset><url><extra><loc>https://x/deep</loc></extra></url></urlset>"),
    ]
    p = SM.parse_sitemaps(SM.decode_bodies(_docs(spark, rows)))
    got = sorted((r.url.split("/")[-1], r.kind, r.loc) for r in p.collect())
    assert got == [("a.xml", "url", "https://x/docs/1"), ("a.xml", "url", "https://x/docs/2"),
                   ("b.xml", "sitemap", "https://x/c1.xml"), ("b.xml", "sitemap", "https://x/c2.xml"),
                   ("c.xml", "url", "https://x/docs/3"), ("f.xml", "url", "https://x/deep")]


def _urlset(*locs):
    return (f"<urlset {NS}>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>").encode()


def test_discover_index_gzip_404_filter_dedupe(spark):
    rows = [
        ("https://h.org/sitemap.xml", 200, (f"<sitemapindex {NS}>" + "".join(
            f"<sitemap><loc>https://h.org/{n}</loc></sitemap>" for n in
            ["s1.xml", "s2.xml.gz", "gone.xml", "bad.xml.gz", "s1.xml"]) + "</sitemapindex>").encode()),
        ("https://h.org/s1.xml", 200, _urlset("https://h.org/docs/a", "https://h.org/blog/x",
                                              "https://h.org/docs/pic.png", "https://h.org/docs/a")),
        ("https://h.org/s2.xml.gz", 200, gzip.compress(_urlset("https://h.org/docs/b", "https://h.org/docs/a"))),
        ("https://h.org/gone.xml", 404, b""),
        ("https://h.org/bad.xml.gz", 200, b"not gzip"),
    ]
    req = spark.createDataFrame([("p", "https://h.org/docs")], "project_id string, url string")
    got = [r.url for r in SM.discover(req, _docs(spark, rows)).orderBy("seq").collect()]
    assert got == ["https://h.org/docs/a", "https://h.org/docs/b"]


def test_discover_cap_and_cycle(spark):
    # a chain of 25 index files, each listing one page and the next file; the
    # last points back to the first (a cycle). At most 20 files are asked for.
    rows = []
    for i in range(25):
        nxt = f"https://c.org/i{i + 1}.xml" if i < 24 else "https://c.org/sitemap.xml"
        me = "https://c.org/sitemap.xml" if i == 0 else f"https://c.org/i{i}.xml"
        rows.append((me, 200, f"<sitemapindex {NS}><sitemap><loc>{nxt}</loc></sitemap><sitemap><loc>https://c.org/u{i}.xml</loc></sitemap></sitemapindex>".encode()))
        rows.append((f"https://c.org/u{i}.xml", 200, _urlset(f"https://c.org/p{i}")))
    req = spark.createDataFrame([("p", "https://c.org")], "project_id string, url string")
    got = [r.url for r in SM.discover(req, _docs(spark, rows), max_files=20).orderBy("seq").collect()]
    # FIFO: sitemap.xml, i1, u0, i2, u1, ..., i9, u8, i10 = 20 files -> u0..u8 read
    assert got == [f"https://c.org/p{i}" for i in range(9)]


    # the limit is the request's own, and without one every file is read
    req = spark.createDataFrame([("p", "https://c.org", 2), ("q", "https://c.org", None)], "project_id string, url string, max_files int")
    got = {}
    for r in SM.discover(req, _docs(spark, rows)).collect():
        got.setdefault(r.project_id, set()).add(r.url)
    assert got == {"q": {f"https://c.org/p{i}" for i in range(25)}}


def test_files_as_generators_write_them(spark):
    sm = "http://www.sitemaps.org/schemas/sitemap/0.9"
    rows = [
        ("https://x/a.xml", 200, f'<?xml version="1.0"?>\n<?xml-stylesheet href="s.xsl"?><!-- made -->\n{_urlset("https://x/1").decode()}'.encode()),
        ("https://x/b.xml", 200, f'<sm:urlset xmlns:sm="{sm}" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"><sm:url><sm:loc>https://x/2'
                                 '</sm:loc><image:image><image:loc>https://x/p.jpg</image:loc></image:image></sm:url></sm:urlset>'.encode()),
        ("https://x/c.xml", 200, _urlset("https://x/3").replace(b"<url>", b"<url><note>caf\xe9</note>", 1)),
        ("https://x/d.xml", 200, b"\xef\xbb\xbf" + _urlset("https://x/4")),
    ]
    got = sorted((r.url[-5], r.loc) for r in SM.parse_sitemaps(SM.decode_bodies(_docs(spark, rows))).collect())
    assert got == [("a", "https://x/1"), ("b", "https://x/2"), ("c", "https://x/3"), ("d", "https://x/4")]


def test_read_sitemap_files_gz(spark, tmpdir_path):
    import os
    os.makedirs(os.path.join(tmpdir_path, "site"), exist_ok=True)
    with open(os.path.join(tmpdir_path, "site", "sitemap.xml"), "wb") as f:
        f.write(f"<sitemapindex {NS}><sitemap><loc>https://f.org/more.xml.gz</loc></sitemap></sitemapindex>".encode())
    with open(os.path.join(tmpdir_path, "site", "more.xml.gz"), "wb") as f:
        f.write(gzip.compress(_urlset("https://f.org/docs/z")))
    docs = SM.read_sitemap_files(spark, os.path.join(tmpdir_path, "site"), "https://f.org")
    req = spark.createDataFrame([("p", "https://f.org")], "project_id string, url string")
    assert [r.url for r in SM.discover(req, docs).collect()] == ["https://f.org/docs/z"]
