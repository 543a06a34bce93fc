"""Export of library pages as files, one an entry (SNK-4), as a Spark data source.

``df.write.format("entry_files")`` writes rows (entry, content) in two phases. A
task writes its entries below a staging folder of its own attempt and reports
it. Only when all tasks are done does the driver move the reported folders to
their place (one rename a task, whatever the number of entries) and then write
the commit file that lists them. A lost or repeated attempt stays in the
staging folder, which goes with the commit or the abort; what a commit file
doesn't list is no part of the export (``read_entries``).

The folder is reached through pyarrow's file systems, as tasks see it: a shared
folder, HDFS or an object store.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "entry_files"


def open_fs(uri: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder (None: it had no rows) and its entries."""

    partition: int
    folder: str | None
    entries: int


class EntryWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging/{self.job}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        return self.write_attempt(iterator, ctx.partitionId(), ctx.taskAttemptId())

    def write_attempt(self, iterator, partition: int, attempt: int) -> Written:
        fs, root = open_fs(self.path)
        folder, made, n = f"{self._staging(root)}/{partition:05d}-{attempt}", set(), 0
        for b in iterator:
            names, texts = b.column("entry").to_pylist(), b.column("content")
            for i, name in enumerate(names):
                full = posixpath.normpath(f"{folder}/{name}")
                if not name or not full.startswith(folder + "/"):
                    raise ValueError(f"not a relative entry name: {name!r}")
                parent = posixpath.dirname(full)
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                if fs.get_file_info(full).type.name != "NotFound":
                    raise ValueError(f"entry name repeats: {name!r}")
                with fs.open_output_stream(full) as f:
                    f.write((texts[i].as_py() or "").encode())
                n += 1
        return Written(partition, folder if n else None, n)

    def commit(self, messages) -> None:
        fs, root = open_fs(self.path)
        before = [f.path for f in fs.get_file_info(_selector(root)) if f.base_name.startswith(("part-", "commit-"))] if self.overwrite else []
        parts = []
        for m in messages:
            if m is not None and m.folder is not None:
                parts.append(f"part-{m.partition:05d}-{self.job}")
                fs.move(m.folder, f"{root}/{parts[-1]}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/commit-{self.job}.txt") as f:
            f.write("".join(p + "\n" for p in parts).encode())
        for old in before:  # the commit file first: what it doesn't list is gone for readers
            fs.delete_file(old) if old.endswith(".txt") else fs.delete_dir(old)
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, fs, root: str) -> None:
        if fs.get_file_info(self._staging(root)).type.name != "NotFound":
            fs.delete_dir(self._staging(root))


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root, allow_not_found=True)


class EntryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> EntryWriter:
        missing = {"entry", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        return EntryWriter(self.options["path"], overwrite)


def write_entries(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Write (entry, content) as files."""
    entries.sparkSession.dataSource.register(EntryFiles)
    entries.select("entry", "content").write.format(FORMAT).mode(mode).save(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry, content binary) of all committed entries but those without bytes
    (the export has none: empty pages are skipped). The driver knows the parts
    only, one a task of the writing job; tasks list their files and read them."""
    fs, root = open_fs(path)
    commits = [f.path for f in fs.get_file_info(_selector(root)) if f.base_name.startswith("commit-")]
    parts = []  # one name a task of the writing job
    for c in commits:
        with fs.open_input_stream(c) as f:
            parts += f.read().decode().split()
    if not parts:
        return spark.createDataFrame([], "entry string, content binary")

    def run(it):
        from pyarrow import fs as pafs

        fs, root = open_fs(path)
        for b in it:
            for part in b.column(0).to_pylist():
                names, texts, held = [], [], 0
                for f in fs.get_file_info(pafs.FileSelector(f"{root}/{part}", recursive=True)):
                    if f.type != pafs.FileType.File or not f.size:
                        continue
                    with fs.open_input_stream(f.path) as stream:
                        texts.append(stream.read())
                    names.append(f.path.split(f"/{part}/", 1)[1])
                    held += f.size
                    if held >= PIECE or len(names) >= 10_000:
                        yield _entries(names, texts)
                        names, texts, held = [], [], 0
                if names:
                    yield _entries(names, texts)

    names = spark.createDataFrame([(p,) for p in parts], "part string").repartition(len(parts))
    return names.mapInArrow(run, "entry string, content binary")


#: Bytes of entries read before they are passed on.
PIECE = 8 << 20


def _entries(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["entry", "content"])
