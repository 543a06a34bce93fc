"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to ``chunk`` characters is encoded by one call. A longer one is
cut into chunks that overlap by ``overlap`` characters, and the chunks are
dealt over the cluster as rows:

1. every chunk is pre-tokenised on its own; its boundaries in the overlap
   with the chunk before (``head``) and after (``tail``) are kept;
2. a boundary found from both sides is a point where the two runs agree, and
   from there on they stay equal, as the pattern only looks forward; the
   first such point is where chunk k ends and chunk k+1 begins. Only
   boundaries after a character that isn't white space count, so that the
   text cut there has the same pieces as the whole;
3. the span between two such points is encoded; a document's ids are its
   spans' ids in order.

Where an overlap has no common boundary (a run of letters longer than the
overlap), the rest of that document is one span: slower, never different.

Decoding concatenates the bytes of the ids.

Edge cases: a null text counts as empty and has no ids; repeated rows each get
their own result row; further columns of the input are kept as they are, the
new ones replace any of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, set_aside

CHUNK = 32_768
OVERLAP = 1_024
#: A boundary this close to a chunk's end may still move: the longest
#: alternative of fixed length has three characters.
MARGIN = 4

_ENC: dict = {}
_BYTES: dict = {}


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(path: str, pattern: str):
    """The tiktoken encoding and the bytes of each id, once per Python worker."""
    if (path, pattern) not in _ENC:
        import tiktoken

        _ENC[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
    return _ENC[path, pattern], _token_bytes(path)


def _token_bytes(path: str) -> pa.BinaryArray:
    """The bytes of each id (null: no such id), once per Python worker; a
    worker that only decodes holds this array alone."""
    if path not in _BYTES:
        ranks = _ranks(path)
        table: list = [None] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        _BYTES[path] = pa.array(table, pa.binary())
    return _BYTES[path]


def vocabulary() -> tuple[str, str]:
    """(rank file, pattern) used by the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _encode_rows(df: DataFrame, text: str, path: str, pattern: str, ids: str) -> DataFrame:
    """Replace ``text`` by its ids, one call per row."""
    schema = T.StructType([f for f in df.schema if f.name != text] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(it):
        enc, out = _encoding(path, pattern)[0], _arrow(schema)
        for b in it:
            others = [b.column(i) for i, f in enumerate(b.schema) if f.name != text]
            texts = b.column(b.schema.names.index(text))
            begin, held, got = 0, 0, []
            for i in range(b.num_rows):
                t = texts[i].as_py()
                got.append(np.array(enc.encode_ordinary(t) if t else (), np.int32))
                held += len(got[-1])
                if held >= 1 << 18 or i + 1 == b.num_rows:
                    yield pa.record_batch([c.slice(begin, i + 1 - begin) for c in others] + [pa.array(got, out.field(ids).type)],
                                          schema=pa.schema([*(pa.field(f.name, f.type) for f in b.schema if f.name != text), out.field(ids)]))
                    begin, held, got = i + 1, 0, []

    return df.mapInArrow(run, schema)


def cut_chunks(docs: DataFrame, text: str, chunk: int, overlap: int) -> DataFrame:
    """(*other columns, k, start, chunk text): chunk k begins at character
    ``start`` and reaches ``overlap`` characters into the next one."""
    keep = [f for f in docs.schema if f.name != text]
    schema = T.StructType(keep + [T.StructField("k", T.IntegerType()), T.StructField("start", T.LongType()),
                                  T.StructField("part", T.StringType())])

    def run(it):
        out = _arrow(schema)

        def rows(b):
            texts = b.column(b.schema.names.index(text))
            cols = [b.column(f.name) for f in keep]
            for i in range(b.num_rows):
                t = texts[i].as_py()
                own = [c[i].as_py() for c in cols]
                for k, s in enumerate(range(0, max(1, len(t)), chunk)):
                    yield (*own, k, s, t[s:s + chunk + overlap])

        for b in it:
            yield from batches(rows(b), out)

    return docs.mapInArrow(run, schema)


def _boundaries(parts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Add ``head`` and ``tail``, the usable boundaries (characters from the
    document's start) in the overlaps with the chunk before and after."""
    schema = T.StructType([*parts.schema, T.StructField("head", T.ArrayType(T.LongType())),
                           T.StructField("tail", T.ArrayType(T.LongType()))])

    def run(it):
        import regex

        pat, out = regex.compile(pattern), _arrow(schema)

        def rows(b):
            cols = [c.to_pylist() for c in b.columns]
            ks, starts, texts = (cols[b.schema.names.index(n)] for n in ("k", "start", "part"))
            for i, (k, s, t) in enumerate(zip(ks, starts, texts)):
                head, tail = [], []
                for m in pat.finditer(t):
                    e = m.end()
                    if e > len(t) - MARGIN:
                        break
                    if t[e - 1].isspace():
                        continue
                    if k and e <= overlap:
                        head.append(s + e)
                    if e > chunk:
                        tail.append(s + e)
                yield (*(c[i] for c in cols), head, tail)

        for b in it:
            yield from batches(rows(b), out)

    return parts.mapInArrow(run, schema)


def _encode_long(docs: DataFrame, text: str, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_bpe_id, _bpe_h, ids) of texts longer than ``chunk``, once for equal rows."""
    parts = cut_chunks(docs, text, chunk, overlap).dropDuplicates(["_bpe_id", "_bpe_h", "k"])
    doc = Window.partitionBy("_bpe_id", "_bpe_h").orderBy("k")
    met = _boundaries(parts, pattern, chunk, overlap).withColumn(
        "sync", F.array_min(F.array_intersect("head", F.lag("tail").over(doc))))
    # from the first overlap without a common boundary on, all is one span
    met = met.withColumn("lost", F.max((F.col("k") > 0) & F.col("sync").isNull()).over(doc))
    met = met.withColumn("begin", F.when(F.col("k") == 0, F.lit(0)).when(~F.col("lost"), F.col("sync")))
    met = met.withColumn("span", F.max(F.when(F.col("begin").isNotNull(), F.col("k"))).over(doc))
    met = met.withColumn("until", F.lead("begin").over(doc))
    spans = (met.groupBy("_bpe_id", "_bpe_h", "span")
             .agg(F.min("begin").alias("begin"), F.max("until").alias("until"),
                  F.sort_array(F.collect_list(F.struct("k", "start", "part"))).alias("parts"))
             .repartition("_bpe_id", "_bpe_h", "span"))
    # the chunks of a span, each without what the next one repeats
    whole = F.array_join(F.transform("parts", lambda p, i: F.when(i == F.size("parts") - 1, p["part"])
                                     .otherwise(F.substring(p["part"], 1, chunk))), "")
    skip = (F.col("begin") - F.col("parts")[0]["start"]).cast("int")
    size = F.coalesce((F.col("until") - F.col("begin")).cast("int"), F.lit(2**31 - 1) - skip)
    spans = spans.select("_bpe_id", "_bpe_h", "span", F.substring(whole, skip + 1, size).alias(text))
    return (_encode_rows(spans, text, path, pattern, "ids").groupBy("_bpe_id", "_bpe_h")
            .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("span", "ids"))), lambda s: s["ids"])).alias("ids")))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without its text, with ``ids`` array<int>: the ids of the whole
    text by the rank file at ``path``, each match of ``pattern`` on its own."""
    if overlap > chunk or overlap <= MARGIN:
        raise ValueError("overlap must be over the margin and at most a chunk")
    docs, back = set_aside(docs.drop("ids"), ("_bpe_id", "_bpe_h", "_bpe_i", "_bpe_g"))
    rest = [c for c in docs.columns if c != text]
    long = F.coalesce(F.length(text), F.lit(0)) > chunk
    short = _encode_rows(docs.filter(~long), text, path, pattern, "ids")
    cut = docs.filter(long).withColumns({"_bpe_id": F.col(id_col), "_bpe_h": F.md5(text)})
    found = _encode_long(cut.select("_bpe_id", "_bpe_h", text), text, path, pattern, chunk, overlap)
    own = cut.drop(text).withColumnsRenamed({"_bpe_id": "_bpe_i", "_bpe_h": "_bpe_g"})
    joined = own.join(found, own["_bpe_i"].eqNullSafe(found["_bpe_id"]) & (own["_bpe_g"] == found["_bpe_h"])).select(*rest, "ids")
    return back(short.select(*rest, "ids").unionByName(joined))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` binary, the ids' bytes one after the other (null: none). An
    id that the rank file lacks is an error."""
    tokens = tokens.drop(out)
    schema = T.StructType([*tokens.schema, T.StructField(out, T.BinaryType())])

    def run(it):
        import pyarrow.compute as pc

        table = _token_bytes(path)
        for b in it:
            lists = b.column(b.schema.names.index(ids))
            # ids before each row; rows go on in parts of about 256 K ids
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            begin = 0
            while begin < b.num_rows:
                until = max(begin + 1, int(np.searchsorted(ends, ends[begin] + (1 << 18), "right")) - 1)
                found = table.take(lists.slice(begin, until - begin).flatten())
                if found.null_count:
                    raise KeyError("an id that the rank file lacks")
                at = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)])
                at = at[ends[begin:until + 1] - ends[begin]].astype(np.int32)
                own = pa.Array.from_buffers(pa.binary(), until - begin, [None, pa.py_buffer(at), found.buffers()[2] or pa.py_buffer(b"")])
                yield pa.record_batch([*b.slice(begin, until - begin).columns, own], schema=pa.schema([*b.schema, pa.field(out, pa.binary())]))
                begin = until

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and
    decoded_sha256 of every document, through ``encode`` and ``decode``."""
    path, pattern = vocabulary()
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
