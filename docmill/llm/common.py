"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, shared_path

#: The white space that separates words and is stripped from lines.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, *name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", *name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def drop_tree(spark: SparkSession, path: str) -> None:
    """Delete a superseded table of ours below the shared folder."""
    if not path.startswith(checkpoint_root(spark).rstrip("/")):
        raise ValueError(f"not below the shared folder: {path}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def batches(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 4096,
            max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack row tuples into record batches bounded by rows and by the bytes
    of their variable-length values."""
    cols: list[list] = [[] for _ in schema]
    held = 0
    for row in rows:
        for c, v in zip(cols, row):
            c.append(v)
            if isinstance(v, (str, bytes, list)):
                held += len(v)
            elif hasattr(v, "nbytes"):
                held += v.nbytes
        if len(cols[0]) >= max_rows or held >= max_bytes:
            yield _pack(cols, schema)
            cols, held = [[] for _ in schema], 0
    if cols[0]:
        yield _pack(cols, schema)


def _pack(cols: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a shared-folder URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def set_aside(df: DataFrame, names: Iterable[str]):
    """``df`` with columns of these names (in any case) renamed to free ones, and
    a function that gives them their names back."""
    taken, moved = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            free = c + "_"
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            moved[c] = free
    return df.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({v: k for k, v in moved.items()})


def map_column(df: DataFrame, column: str, keep: bool, fields: list, start, most: int = 1 << 22) -> DataFrame:
    """``df`` with ``fields`` computed from each row's ``column`` (left out
    unless ``keep``) by the function that ``start()`` gives in a task; columns
    of the fields' names are replaced. Rows are passed on in parts of about
    ``most`` items of output."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {f.name for f in fields}
    rest = [f for f in df.schema if f.name not in new and (keep or f.name != column)]
    schema = T.StructType(rest + fields)
    names = [f.name for f in rest]

    def run(it):
        call, out = start(), to_arrow_schema(schema)
        for b in it:
            values = b.column(b.schema.names.index(column))
            others = [b.column(b.schema.names.index(n)) for n in names]
            begin, held, got = 0, 0, []
            for i in range(b.num_rows):
                row = call(values[i])
                got.append(row)
                held += sum(len(v) for v in row if hasattr(v, "__len__"))
                if held >= most or i + 1 == b.num_rows:
                    cols = [pa.array(c, type=out.field(f.name).type) for c, f in zip(zip(*got), fields)]
                    yield pa.record_batch([c.slice(begin, i + 1 - begin) for c in others] + cols, names=names + [f.name for f in fields])
                    begin, held, got = i + 1, 0, []

    return df.mapInArrow(run, schema)
