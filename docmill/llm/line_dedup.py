"""Line deduplication with a once-seen and a twice-seen Bloom filter.

1. Every task passes over its documents' line keys (once per document) with
   two blocked Bloom filters: a key that the *once* filter already holds goes
   to the *twice* filter, any other one to *once*.
2. The tasks' filters are merged segment by segment, in two levels:
   ``twice |= once & other_once | other_twice; once |= other_once``. A key in
   two tasks has all its bits in both *once* filters, so *twice* holds every
   key of two documents or more: no repeat is missed, whatever the size.
3. Only keys that the twice filter holds ("suspected repeats") are shuffled,
   as whole keys; an exact count of their documents, combined before the
   shuffle, settles which of them repeat and which document keeps them.

The filters have a power of two of bits, ``BITS_PER_LINE`` for each line up to
``MAX_BITS`` (64 MB a filter), which bounds the broadcast. Beyond that more
keys are suspected and shuffled; the result stays the same.

Edge cases: a null or empty text is one empty line; a null ``doc_id`` counts
as a document below all others; rows that share a ``doc_id`` count one by one,
and all rows of the largest ``doc_id`` keep the line. Further columns are kept;
result columns replace any of the same name. Empty tables give empty results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 12
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
SEGMENT_BITS = 1 << 16
HASHES = 4
FAN_IN = 32


def line_key(line: bytes) -> bytes:
    """The line stripped at both ends, A-Z in lower case (bytes of UTF-8)."""
    return line.strip(STRIP).lower()


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    """Distinct keys of at least ``min_chars`` code points."""
    got = set()
    for line in (text or "").encode().split(b"\n"):
        k = line_key(line)
        # UTF-8 has at least as many bytes as code points
        if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars):
            got.add(k)
    return got


def _hashes(keys) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """(n, HASHES) bit numbers of each hash: all in one 512-bit block."""
    block = (h >> np.uint64(36)) % np.uint64(bits // 512)
    inner = (h[:, None] >> (np.uint64(9) * np.arange(HASHES, dtype=np.uint64))) & np.uint64(511)
    return block[:, None] * np.uint64(512) + inner


class Filters:
    """A pair of Bloom filters of ``bits`` bits each."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    @staticmethod
    def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
        byte, bit = (places >> np.uint64(3)).astype(np.int64), (places & np.uint64(7)).astype(np.uint8)
        return ((bitmap[byte] >> bit) & 1).all(axis=1)

    @staticmethod
    def put(bitmap: np.ndarray, places: np.ndarray) -> None:
        byte, bit = (places >> np.uint64(3)).astype(np.int64), (places & np.uint64(7)).astype(np.uint8)
        np.bitwise_or.at(bitmap, byte.ravel(), (np.uint8(1) << bit).ravel())

    def add(self, h: np.ndarray) -> None:
        """The keys of some documents, a repeated key as often as it occurs."""
        uniq, n = np.unique(h, return_counts=True)
        places = _places(uniq, self.bits)
        again = (n > 1) | self.has(self.once, places)
        self.put(self.twice, places[again])
        self.put(self.once, places[~again])
        self.put(self.once, places[n > 1])


_SEGMENTS = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_SEGMENTS_SQL = "segment int, part int, once binary, twice binary"


def twice_filter(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, bits: int | None = None) -> tuple[bytes, int]:
    """The merged twice-seen filter and its number of bits."""
    if bits is None:
        breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
        lines = docs.agg(F.coalesce(F.sum(F.coalesce(breaks, F.lit(0)) + 1), F.lit(0))).first()[0]
        bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_LINE * max(1, lines) - 1).bit_length()))
    size = min(bits, SEGMENT_BITS) // 8

    def build(it):
        from pyspark import TaskContext

        own, part, held, h = Filters(bits), TaskContext.get().partitionId() % FAN_IN, 0, []
        for b in it:
            for t in b.column(0):
                k = _keys(t.as_py(), min_chars)
                if k:
                    h.append(_hashes(k))
                    held += len(k)
                if held > 200_000:
                    own.add(np.concatenate(h))
                    held, h = 0, []
        if h:
            own.add(np.concatenate(h))

        def segments():
            for s in range(bits // 8 // size):
                once, twice = own.once[s * size:(s + 1) * size], own.twice[s * size:(s + 1) * size]
                if once.any():
                    yield s, part, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)

        yield from batches(segments(), _SEGMENTS)

    def merge(it):
        """Rows come sorted by (segment, part): one running pair at a time."""
        def merged():
            at = once = twice = None
            for b in it:
                for row in b.to_pylist():
                    o, t = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
                    if at != (row["segment"], row["part"]):
                        if at is not None:
                            yield (*at, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))
                        at, once, twice = (row["segment"], row["part"]), o.copy(), t.copy()
                    else:
                        twice |= (once & o) | t
                        once |= o
            if at is not None:
                yield (*at, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))

        yield from batches(merged(), _SEGMENTS)

    def level(df: DataFrame) -> DataFrame:
        return df.repartition("segment", "part").sortWithinPartitions("segment", "part").mapInArrow(merge, _SEGMENTS_SQL)

    first = level(docs.select(text).mapInArrow(build, _SEGMENTS_SQL))
    both = level(first.withColumn("part", F.lit(0)))
    out = np.zeros(bits // 8, np.uint8)
    for row in both.select("segment", "twice").toLocalIterator():
        out[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out.tobytes(), bits


def dropped_keys(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """(id, keys): the keys whose lines that document loses."""
    filter_bytes, bits = twice_filter(docs, text, min_chars, bits)
    shared = docs.sparkSession.sparkContext.broadcast(filter_bytes)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.BinaryType())])

    def suspects(it):
        from .byte_bpe import _arrow

        bitmap, out = np.frombuffer(shared.value, np.uint8), _arrow(schema)

        def rows():
            for b in it:
                for i, t in zip(b.column(0), b.column(1)):
                    if k := list(_keys(t.as_py(), min_chars)):
                        i = i.as_py()
                        for hit in np.flatnonzero(Filters.has(bitmap, _places(_hashes(k), bits))):
                            yield i, k[hit]

        yield from batches(rows(), out, 20_000)

    found = docs.select(F.col(id_col).alias("id"), text).mapInArrow(suspects, schema)
    kept = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs)
    lost = found.join(kept, "key").filter(~F.col("id").eqNullSafe(F.col("last")))
    return lost.groupBy("id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """``docs`` with ``text`` less the lines whose key is in ``min_docs``
    documents or more, but for those of the largest id that holds the key;
    and with ``n_lines`` (before) and ``n_dropped``. Null texts become empty."""
    docs = docs.drop("n_lines", "n_dropped")
    # names that docs doesn't have
    own_id, own_keys = (next(n + "_" * i for i in range(len(docs.columns) + 1) if n + "_" * i not in docs.columns) for n in ("_line_id", "_line_keys"))
    lost = dropped_keys(docs, id_col, text, min_chars, min_docs, bits).select(F.col("id").alias(own_id), F.col("keys").alias(own_keys))
    both = docs.join(lost, docs[id_col].eqNullSafe(lost[own_id]), "left").drop(own_id)
    schema = T.StructType([*docs.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(it):
        from .byte_bpe import _arrow

        out = _arrow(schema)
        names = out.names[:-2]

        def rows():
            for b in it:
                keys = b.column(b.schema.names.index(own_keys))
                cols, at = [b.column(b.schema.names.index(n)) for n in names], names.index(text)
                for i in range(b.num_rows):
                    row = [c[i].as_py() for c in cols]
                    t, dropped = row[at] or "", 0
                    n = t.count("\n") + 1
                    if keys[i].is_valid:
                        gone, lines = set(keys[i].as_py()), t.encode().split(b"\n")
                        left = [x for x in lines if line_key(x) not in gone]
                        t, dropped = b"\n".join(left).decode(), n - len(left)
                    row[at] = t
                    yield (*row, n, dropped)

        yield from batches(rows(), out)

    return both.mapInArrow(rebuild, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeats AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.last <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeats r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
