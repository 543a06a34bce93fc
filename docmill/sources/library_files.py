"""SRC-3 / SRC-4: read a library stored in the reference's on-disk layout.

``<root>/<project_id>/manifest.json`` (one JSON document per project) and
``<root>/<project_id>/<page_id>.md`` (one Markdown file per page). Manifests
are a plain Spark file scan. Of the pages the driver knows the project folders
only: tasks list them, and the files are dealt over all tasks to be read.
"""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = ("id string, name string, url string, "
                   "pages array<struct<id:string,title:string,url:string>>, "
                   "page_count int, scraped_at string")


def read_manifests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """-> (projects, manifest_pages). Folders without a manifest are left
    out; the project id is the folder name; ``position`` is 1-based."""
    m = (spark.read.option("multiLine", True).schema(MANIFEST_SCHEMA)
         .json(f"{root.rstrip('/')}/*/manifest.json")
         .withColumn("project_id", F.regexp_extract(F.col("_metadata.file_path"),
                                                    r"/([^/]+)/manifest\.json$", 1)))
    projects = m.select("project_id", "name", "url", "page_count",
                        F.to_timestamp("scraped_at").alias("scraped_at"))
    pages = m.select("project_id", F.posexplode("pages").alias("pos", "p")).select(
        "project_id", (F.col("pos") + 1).alias("position"), F.col("p.id").alias("page_id"),
        F.col("p.title").alias("title"), F.col("p.url").alias("url"))
    return projects, pages


#: Bytes of files, and files, passed on at a time.
PIECE, FILES = 8 << 20, 10_000
#: What a URI's path quotes.
_QUOTED = re.compile(r"[^\w\-.!~*'():@&=+$,;\u0080-\U0010ffff]|[\u0080-\u00a0\s]")
_PLAIN = re.compile(r"[\w\-./:]+", re.ASCII)


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, as the session's file system names them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [p.toString() for p in jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)] if found else []


def _reached_by_tasks(folders: list[str]) -> bool:
    """Whether pyarrow opens the folders' store."""
    from ..operators.entry_files import open_fs

    if all(f.startswith(("file:", "/")) for f in folders):
        return True
    try:
        open_fs(folders[0])
    except Exception:  # a store that only Spark's readers know
        return False
    return all(_PLAIN.fullmatch(f) for f in folders)


def _uri(name: str) -> str:
    return _QUOTED.sub(lambda m: quote(m[0], safe=""), name)


def _list_markdown(it):
    """(folder, name) of the Markdown files in each folder; like Spark's scans
    without empty and hidden ones."""
    from pyarrow import fs as pafs

    from ..operators.entry_files import open_fs

    for b in it:
        for folder in b.column(0).to_pylist():
            fs, where = open_fs(folder)
            if fs.get_file_info(where).type != pafs.FileType.Directory:
                continue
            names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(where))
                     if f.type == pafs.FileType.File and f.size and f.base_name.endswith(".md")]
            names = [n for n in names if not n.startswith(".") and not (n.startswith("_") and "=" not in n)]
            for s in range(0, len(names), FILES):
                part = names[s:s + FILES]
                yield pa.record_batch([pa.array([folder] * len(part), pa.string()), pa.array(part, pa.string())], names=["folder", "name"])


def _read_markdown(it):
    """(project_id, page_id, content) of (folder, name)."""
    from ..operators.entry_files import open_fs

    last, rows, held = None, [], 0

    def batch():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))],
                               names=["project_id", "page_id", "content"])

    for b in it:
        for folder, name in zip(*(c.to_pylist() for c in b.columns)):
            if folder != last:
                last, (fs, where) = folder, open_fs(folder)
            with fs.open_input_stream(f"{where}/{name}", compression=None) as f:
                rows.append((_uri(folder.rsplit("/", 1)[1]), _uri(name[:-len(".md")]), f.read()))
            held += len(rows[-1][2])
            if held >= PIECE or len(rows) >= FILES:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def _scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """The same by Spark's text scan, for stores that tasks can't open; the
    driver gets the status of every file."""
    t = spark.read.text(f"{root}/*/*.md", wholetext=True)
    path = F.col("_metadata.file_path")
    return t.select(F.regexp_extract(path, r"/([^/]+)/[^/]+\.md$", 1).alias("project_id"),
                    F.regexp_extract(path, r"/([^/]+)\.md$", 1).alias("page_id"),
                    F.col("value").alias("content"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """-> (project_id, page_id, content): one whole file per row. Names are as
    in a file's URI."""
    root = root.rstrip("/")
    folders = _folders(spark, f"{root}/*")
    if not folders or not _reached_by_tasks(folders):
        return _scan_markdown(spark, root)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(folders), 10_000))
    names = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), tasks))
    files = names.mapInArrow(_list_markdown, "folder string, name string")
    # files by their own hash: a project of any size is read by all tasks
    files = files.repartition(tasks, "folder", "name").sortWithinPartitions("folder", "name")
    rows = files.mapInArrow(_read_markdown, "project_id string, page_id string, content binary")
    return rows.withColumn("content", F.col("content").cast("string"))


def read_library(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """-> (projects, library_pages) joined the tolerant way (LIB-9): a
    listed page without a file has NULL content."""
    projects, pages = read_manifests(spark, root)
    md = read_markdown(spark, root)
    return projects, pages.join(md, ["project_id", "page_id"], "left")
