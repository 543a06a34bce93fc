"""What the Python workers of the tokenizers keep."""

import sys

import pyarrow as pa
import pytest

from docmill.llm import byte_bpe


def test_decode_without_the_encoder(spark, monkeypatch):
    """A worker that decodes holds the ids' bytes only, not the library."""
    path, pattern = byte_bpe.vocabulary()
    rows = spark.createDataFrame([], "doc_id long, ids array<int>")
    caught = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: caught.append(run))
    byte_bpe.decode(rows, path, pattern)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    for name in ("_ENC", "_BYTES"):
        monkeypatch.setattr(byte_bpe, name, {}, raising=False)
    by_id = {i: t for t, i in byte_bpe._ranks(path).items()}
    lists = [[5, 49_000, 7], [], None, [i % 50_000 for i in range(600_000)], [3]]
    batch = pa.record_batch([pa.array([1, 2, 3, 4, 5], pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    out = pa.Table.from_batches(caught[0](iter([batch.slice(1), batch.slice(0, 1)])))
    assert out.column("doc_id").to_pylist() == [2, 3, 4, 5, 1]
    assert out.column("decoded").to_pylist() == [b"".join(by_id[i] for i in x or ()) for x in [*lists[1:], lists[0]]]
    missing = pa.record_batch([pa.array([1], pa.int64()), pa.array([[1 << 30]], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    with pytest.raises((LookupError, pa.ArrowInvalid)):
        list(caught[0](iter([missing])))
