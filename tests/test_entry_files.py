"""Entries as files: two-phase commit, repeated and failed attempts."""
import os

import pyarrow as pa
import pytest

from docmill.operators import entry_files as EF


def rows(spark, path):
    return sorted((r["entry"], bytes(r["content"]).decode()) for r in EF.read_entries(spark, path).collect())


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_round_trip_append_overwrite(spark, tmp_path):
    path = str(tmp_path / "export")
    data = [(f"p{i % 3}/{i:02d}-é.md", None if i == 4 else f"text {i}\n" * i) for i in range(20)]
    df = spark.createDataFrame(data, "entry string, content string").repartition(4)
    EF.write_entries(df, path)
    # Spark's reader leaves out files without bytes
    assert rows(spark, path) == sorted((n, t) for n, t in data if t)
    assert len([f for f in files(path) if f.endswith(".md")]) == 20
    EF.write_entries(spark.createDataFrame([("q/01-a.md", "more")], "entry string, content string"), path)
    assert len(rows(spark, path)) == 19
    EF.write_entries(df.limit(0), path, "overwrite")
    assert rows(spark, path) == [] and [f for f in files(path) if not f.startswith("commit-")] == []


def test_repeated_attempt_leaves_no_second_file(spark, tmp_path):
    path = str(tmp_path)
    w, b = EF.EntryWriter(path, False), pa.record_batch({"entry": ["a/01-x.md"], "content": ["one"]})
    w.write_attempt(iter([b]), 0, 7)  # lost: never reported
    told = w.write_attempt(iter([b]), 0, 8)
    assert rows(spark, path) == []  # nothing is there before the commit
    w.commit([told, None])
    assert rows(spark, path) == [("a/01-x.md", "one")] and len([f for f in files(path) if f.endswith(".md")]) == 1


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path)
    df = spark.createDataFrame([("a/1.md", "x"), ("../b.md", "y")], "entry string, content string").coalesce(1)
    with pytest.raises(Exception, match="not a relative entry name"):
        EF.write_entries(df, path)
    assert rows(spark, path) == [] and files(path) == []
    twice = spark.createDataFrame([("a/1.md", "x"), ("a/1.md", "y")], "entry string, content string").coalesce(1)
    with pytest.raises(Exception, match="repeats"):
        EF.write_entries(twice, path)


def test_tasks_list_the_entries(spark, tmp_path):
    """The driver's file index holds no entry; names that Spark's reader takes for hidden ones are read as well."""
    path = str(tmp_path / "export")
    data = [(f"p{i % 3}/{'_' if i % 2 else ''}{i:02d}.md", f"text {i}") for i in range(30)]
    EF.write_entries(spark.createDataFrame(data, "entry string, content string").repartition(3), path)
    assert EF.read_entries(spark, path).inputFiles() == []
    assert rows(spark, path) == sorted(data)
