"""Removal of repeated byte strings with a logarithmic family of hashed suffix levels.

A byte goes when it lies in a string of ``K`` bytes that also starts earlier
(smaller doc_id, or same document and earlier place). Copies of a whole text
are settled by its digest; all else goes through the index.

No suffix array is kept: an array of every byte's suffix would be many times the
input. Instead the levels of the index hold the hashes of the ``G`` bytes at
anchors. The anchor of a K-byte window is the place of the least hash among its
G-byte strings (leftmost of equals), so equal windows have their anchor at the
same distance, and neighbouring windows mostly share one: about 2 hashes in
(K - G + 2) bytes. Levels are ordered by hash, not by the bytes that follow.

Index family: documents come in batches, in doc_id order. A batch's level is
written as a table bucketed and sorted by hash, and joined in step with each
existing level (a merge join without shuffling the level); hashes met twice tell
where long matches can be, no more. Before a batch goes in, levels of equal size
are merged, so n batches leave about log n levels and each hash is rewritten
about log n times.

Exact matches: occurrences of those hashes are looked up in the texts (a Bloom
filter of bounded size tells where). The bytes around an anchor that its windows
cover are its context. All but the first occurrence of a context go entirely.
Where a suffix has several contexts, the windows of each one's first
occurrence are compared to the others': groups of neighbouring windows meet by
the bytes they have in common, with the few bytes to the left and right that
tell their windows apart. A group of more than ``MAX_MEMBERS`` members isn't
held in a task: its windows are dealt out one by one and counted before the
shuffle, so a passage found in a third of all documents isn't brought to one
task.

Edge cases: null and empty texts have no bytes. A null doc_id is the smallest.
Rows equal in doc_id and text are one document and get equal results; rows that
share a doc_id (or have none) and differ in text are documents of their own, in
the order of their digests. doc_id must be a number. Further columns are not
looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, drop_tree, materialize, shared_path
from .line_dedup import Filters, _places

K = 100
G = 24
BATCHES = 4
#: Windows whose distances to the anchor are equal when divided by this are compared together first.
GROUP = 25
#: Bytes hashed together: the arrays of a group stay in the processor's cache.
PIECE = 1 << 18
#: Members of a group of windows that one task compares in memory.
MAX_MEMBERS = 20_000
MAX_BROADCAST = 1_000_000
MAX_SPANS = 2_000_000
BITS_PER_KEY = 12
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
SEGMENT = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict = {}


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse mod 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def anchors(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(part, anchor, first window, last window, print of the suffix) of every
    run of windows with one anchor; places count from the part's start."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = int(sizes.sum())
    if n < K:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = _mix((total[G:] - total[:-G]) * down[:n - G + 1])
    low = np.uint64((1 << (n - 1).bit_length()) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= K - G + 1:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < K - G + 1:
        m = np.minimum(m[:-(K - G + 1 - width)], m[K - G + 1 - width:])
    p = np.flatnonzero(of[:n - K + 1] == of[K - 1:])
    at = (m[p] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]) if len(p) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(p)][:len(first)] - 1
    part, a = of[p[first]].astype(np.int64), at[first]
    begin = np.r_[0, np.cumsum(sizes)][part]
    return part, a - begin, p[first] - begin, p[last] - begin, h[a]


def _pieces(rows):
    """Groups of (doc_id, place of the piece in its text, bytes), each group of
    about PIECE bytes; a longer text is cut into pieces that share K - 1 bytes,
    so each of its windows is in one piece."""
    group, held = [], 0
    for i, text in rows:
        raw = (text or "").encode()
        for s in range(0, max(1, len(raw) - K + 1), PIECE):
            piece = raw[s:s + PIECE + K - 1]
            if len(piece) < K:
                continue
            group.append((i, s, piece))
            held += len(piece)
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


def _texts(it):
    for b in it:
        yield from ((i.as_py(), t.as_py()) for i, t in zip(b.column(0), b.column(1)))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _fields(docs: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("doc", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in more])


# ------------------------------------------------------------ index family
def suffixes(docs: DataFrame) -> DataFrame:
    """(doc, print, place, again) of the suffixes at anchors: the first of each
    print in a group of texts, ``again`` if it occurs there more than once."""
    schema = _fields(docs, ("print", T.LongType()), ("place", T.LongType()), ("again", T.BooleanType()))

    def run(it):
        out = _arrow(schema)

        def rows():
            for group in _pieces(_texts(it)):
                group.sort(key=lambda g: (g[0] is not None, g[0], g[1]))
                part, a, _, _, h = anchors([g[2] for g in group])
                uniq, first, n = np.unique(h, return_index=True, return_counts=True)
                for x, j, m in zip(uniq.view(np.int64).tolist(), first.tolist(), n.tolist()):
                    i, s, _ = group[part[j]]
                    yield i, x, s + int(a[j]), m > 1

        yield from batches(rows(), out, 50_000)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class IndexFamily:
    """Levels of suffix arrays; (size class, table, path) each."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"suffixes_{uuid.uuid4().hex}", shared_path(self.spark, "llm", "suffixes")
        (rows.repartition(self.buckets, "print").write.option("path", path).option("compression", "zstd")
         .bucketBy(self.buckets, "print").sortBy("print").format("parquet").saveAsTable(name))
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_tree(self.spark, path)

    @staticmethod
    def _first(rows: DataFrame) -> DataFrame:
        got = rows.groupBy("print").agg(F.min(F.struct(F.col("doc").isNotNull(), "doc", "place")).alias("at"), (F.max("again") | (F.count(F.lit(1)) > 1)).alias("again"))
        return got.select("print", "at.doc", "at.place", "again")

    def add(self, docs: DataFrame) -> DataFrame:
        """Put a batch in; (print) of its suffixes that occur twice in it or
        in it and in a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, pa_), (_, b, pb) = self.levels.pop(), self.levels.pop()
            both = self.spark.table(a).unionByName(self.spark.table(b))
            self.levels.append((size + 1, *self._write(self._first(both))))
            self._drop(a, pa_)
            self._drop(b, pb)
        name, path = self._write(self._first(suffixes(docs)))
        new = self.spark.table(name)
        found = new.filter("again").select("print")
        for _, level, _ in self.levels:
            found = found.unionByName(new.select("print").join(self.spark.table(level).select("print"), "print"))
        found = materialize(found, "repeated-suffixes")
        self.levels.append((0, name, path))
        return found

    def drop(self) -> None:
        for _, name, path in self.levels:
            self._drop(name, path)
        self.levels = []


def _bloom(prints: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of (print): segments are built where their bits meet."""
    n = prints.count()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_KEY * max(1, n) - 1).bit_length()))
    size = min(bits, SEGMENT) // 8
    rows = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])

    def spread(it):
        def got(b):
            places = np.unique(_places(b.column(0).to_numpy().view(np.uint64), bits).ravel())
            segment = (places // np.uint64(size * 8)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(places) else []
            for s, e in zip(cut, [*cut[1:], len(places)]):
                yield int(segment[s]), (places[s:e] % np.uint64(size * 8)).astype("<u4").tobytes()

        for b in it:
            yield from batches(got(b), rows)

    def join(it):
        def got():
            at, held = None, None
            for b in it:
                for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                    if s != at:
                        if at is not None:
                            yield at, zlib.compress(np.packbits(held, bitorder="little").tobytes(), 1)
                        at, held = s, np.zeros(size * 8, np.uint8)
                    held[np.frombuffer(x.as_buffer(), "<u4")] = 1
            if at is not None:
                yield at, zlib.compress(np.packbits(held, bitorder="little").tobytes(), 1)

        yield from batches(got(), rows)

    kind = "segment int, bits binary"
    parts = prints.select("print").mapInArrow(spread, kind).repartition("segment").sortWithinPartitions("segment").mapInArrow(join, kind)
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["segment"] * size:(r["segment"] + 1) * size] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.tobytes(), bits


# ------------------------------------------------------------- exact matches
def contexts(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc, print, context, lo, size): where the suffixes with these prints
    (and a few others) are, a hash of the bytes their windows cover, and these
    bytes' place and number."""
    import xxhash  # noqa: F401  used by the tasks

    bitmap, bits = _bloom(prints)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = _fields(docs, ("print", T.LongType()), ("context", T.LongType()), ("lo", T.LongType()), ("size", T.IntegerType()))

    def run(it):
        from xxhash import xxh3_64_intdigest as digest

        out, held = _arrow(schema), np.frombuffer(shared.value, np.uint8)

        def rows():
            for group in _pieces(_texts(it)):
                part, a, lo, hi, h = anchors([g[2] for g in group])
                for j in np.flatnonzero(Filters.has(held, _places(h, bits))).tolist() if len(h) else ():
                    i, s, raw = group[part[j]]
                    b, e = int(lo[j]), int(hi[j]) + K
                    c = digest(raw[b:e], int(a[j]) - b)
                    yield i, int(h[j:j + 1].view(np.int64)[0]), c - (1 << 64) if c >> 63 else c, s + b, e - b

        yield from batches(rows(), out, 50_000)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _with_places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, wanted) of the documents in ``wanted`` (doc, lo, ...)."""
    by = materialize(wanted.groupBy("doc").agg(F.collect_list(F.struct(*(c for c in wanted.columns if c != "doc"))).alias("wanted")), "places")
    n = by.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    if n[0] <= MAX_BROADCAST and n[1] <= MAX_SPANS:
        by = F.broadcast(by)
    return docs.select("doc_id", "text").join(by, F.col("doc_id").eqNullSafe(F.col("doc"))).select("doc_id", "text", "wanted")


def _runs(it, make):
    """``make(doc, print, raw, a, lo, hi, place of raw)`` of each wanted run."""
    for b in it:
        for i, t, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            want = {}
            for w in wanted.as_py():
                want.setdefault(w["lo"], []).append(w.get("class"))
            for group in _pieces([(i, t.as_py())]):
                for part, a, lo, hi, h in zip(*anchors([g[2] for g in group])):
                    _, s, raw = group[part]
                    if s + int(lo) in want:
                        yield from make(i, int(np.uint64(h).view(np.int64)), raw, int(a), int(lo), int(hi), s, want[s + int(lo)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def common_bytes(docs: DataFrame, first: DataFrame) -> DataFrame:
    """A row for each context in ``first`` (doc, lo) and each group of its
    windows: a hash of the ``core`` that all windows of such a group share,
    which begins at ``near``; the windows begin ``t0`` to ``t1`` bytes before
    it, and ``left`` and ``right`` are what they cover besides."""
    schema = _fields(docs, ("print", T.LongType()), ("class", T.IntegerType()), ("core", T.LongType()), ("lo", T.LongType()),
                     ("near", T.LongType()), ("t0", T.IntegerType()), ("t1", T.IntegerType()), ("left", T.BinaryType()), ("right", T.BinaryType()))

    def run(it):
        from xxhash import xxh3_64_intdigest as digest

        def make(i, h, raw, a, lo, hi, s, _):
            for c in range((a - hi) // GROUP, (a - lo) // GROUP + 1):
                near = a - GROUP * c  # the last window of the group begins here
                t0, t1, end = near - min(hi, near), near - max(lo, near - GROUP + 1), near + K - GROUP + 1
                yield (i, h, c, _signed(digest(raw[near:end], c)), s + lo, s + near, t0, t1, raw[near - t1:near], raw[end:end + GROUP - 1 - t0])

        yield from batches(_runs(it, make), _arrow(schema), 50_000)

    return _with_places(docs, first.select("doc", "lo")).mapInArrow(run, schema)


def _compare(members: list[tuple]) -> list[tuple]:
    """(doc, lo, hi) of the windows in a group that are equal to an earlier
    one's; members are (doc, near, t0, t1, left, right)."""
    best: dict = {}
    for doc, near, t0, t1, left, right in members:
        for t in range(t0, t1 + 1):
            key, at = (t, left[t1 - t:], right[:GROUP - 1 - t]), (doc is not None, doc, near - t)
            if key not in best or at < best[key]:
                best[key] = at
    out = []
    for doc, near, t0, t1, left, right in members:
        run = None
        for t in range(t0, t1 + 1):
            p = near - t
            if best[t, left[t1 - t:], right[:GROUP - 1 - t]] == (doc is not None, doc, p):
                continue
            if run and run[0] == p + 1:
                run[0] = p
            else:
                if run:
                    out.append((doc, run[0], run[1] + K))
                run = [p, p]
        if run:
            out.append((doc, run[0], run[1] + K))
    return out


def compared(groups: DataFrame) -> DataFrame:
    """Spans (doc, lo, hi) of repeated windows, with ``class`` null; members of
    groups too large for a task come back as they are: (doc, lo, class)."""
    fields = {f.name: f for f in groups.schema}
    schema = T.StructType([fields["doc"], T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("class", T.IntegerType())])

    def run(it):
        def rows():
            at, held, large = None, [], False
            for b in it:
                for doc, h, c, core, lo, near, t0, t1, left, right in zip(*(x.to_pylist() for x in b.columns)):
                    if (h, c, core) != at:
                        if len(held) > 1 and not large:
                            yield from ((d, x, y, None) for d, x, y in _compare([m[:6] for m in held]))
                        at, held, large = (h, c, core), [], False
                    if large:
                        yield doc, lo, None, c
                        continue
                    held.append((doc, near, t0, t1, left, right, lo))
                    if len(held) > MAX_MEMBERS:
                        yield from ((m[0], m[6], None, c) for m in held)
                        held, large = [], True
            if len(held) > 1:
                yield from ((d, x, y, None) for d, x, y in _compare([m[:6] for m in held]))

        yield from batches(rows(), _arrow(schema), 50_000)

    keys = ["print", "class", "core"]
    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def window_prints(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, print, window, place) of the windows of groups (doc, lo, class)."""
    schema = _fields(docs, ("print", T.LongType()), ("window", T.LongType()), ("place", T.LongType()))

    def run(it):
        from xxhash import xxh3_64_intdigest as digest

        def make(i, h, raw, a, lo, hi, s, classes):
            for c in classes:
                for p in range(max(lo, a - GROUP * c - GROUP + 1), min(hi, a - GROUP * c) + 1):
                    yield i, h, _signed(digest(raw[p:p + K], a - p)), s + p

        yield from batches(_runs(it, make), _arrow(schema), 50_000)

    return _with_places(docs, groups.select("doc", "lo", "class")).mapInArrow(run, schema)


def _earliest(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(*keys, first_doc, first_place, n) of the earliest of each key."""
    got = rows.groupBy(*keys).agg(F.min(F.struct(F.col("doc").isNotNull(), "doc", place)).alias("f"), F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.col("f.doc").alias("first_doc"), F.col(f"f.{place}").alias("first_place"), "n")


def repeated_spans(docs: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """(doc, lo, hi): byte ranges to remove, of documents no text of which is a
    copy of another's; ranges may overlap."""
    spark = docs.sparkSession
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / n_batches for i in range(1, n_batches)], 0.01)))
    i, edges = F.col("doc_id"), [None, *bounds, None]
    family, found = IndexFamily(spark), None
    try:
        for lo, hi in zip(edges, edges[1:]):
            cond = F.lit(True) if lo is None else i > lo
            if hi is not None:
                cond = cond & (i <= hi)
            if lo is None:
                cond = cond | i.isNull()
            new = family.add(docs.filter(cond))
            found = new if found is None else found.unionByName(new)
    finally:
        family.drop()
    at = materialize(contexts(docs, materialize(found.distinct(), "repeated")), "contexts")
    first = materialize(_earliest(at, ["print", "context"], "lo"), "first-contexts")
    several = first.groupBy("print").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("print")
    own = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("lo") == F.col("first_place"))
    spans = at.join(first.filter("n > 1"), ["print", "context"]).filter(~own).select("doc", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    # suffixes with several contexts: the first occurrences of those
    heads = first.join(several, "print", "left_semi").select(F.col("first_doc").alias("doc"), F.col("first_place").alias("lo")).distinct()
    met = materialize(compared(common_bytes(docs, heads)), "compared")
    spans = spans.unionByName(met.filter("class is null").select("doc", "lo", "hi"))
    left = met.filter("class is not null").select("doc", "lo", "class").distinct()
    if left.isEmpty():
        return spans
    windows = materialize(window_prints(docs, left), "windows")
    early = _earliest(windows, ["print", "window"], "place").filter("n > 1")
    own = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("place") == F.col("first_place"))
    more = windows.join(early, ["print", "window"]).filter(~own).select("doc", F.col("place").alias("lo"), (F.col("place") + K).alias("hi"))
    return spans.unionByName(more)


def merged(by: DataFrame) -> DataFrame:
    """(doc, spans) with spans that overlap or touch made one, in order. A null
    ``hi`` is the text's end."""
    schema = by.schema

    def run(it):
        def rows(b):
            for doc, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = []
                for lo, hi in sorted(((x["lo"], x["hi"]) for x in spans), key=lambda x: (x[0], x[1] is None, x[1])):
                    if runs and (runs[-1][1] is None or lo <= runs[-1][1]):
                        runs[-1][1] = None if hi is None or runs[-1][1] is None else max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                yield doc, [{"lo": lo, "hi": hi} for lo, hi in runs]

        for b in it:
            yield from batches(rows(b), _arrow(schema))

    return by.mapInArrow(run, schema)


def _numbered(docs: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with a number of its own for each document, in the order of
    (doc_id, digest), and (doc_id, number, md5)."""
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("md5")]
    ordered = keyed.select("doc_id", "md5").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = materialize(ordered.withColumn("number", F.monotonically_increasing_id()), "numbers")
    own = docs.select("doc_id", "text", F.md5("text").alias("md5"))
    named = numbers.withColumnsRenamed({"doc_id": "d", "md5": "m"})
    both = own.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("md5").eqNullSafe(F.col("m")))
    return both.select(F.col("number").alias("doc_id"), "text"), numbers


def remove_repeats(docs: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every row."""
    docs = docs.select("doc_id", "text")
    keyed = materialize(docs.select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").alias("n")), "digests")
    if keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        return _removed(docs, keyed, n_batches)
    numbered, numbers = _numbered(docs, keyed)
    own = keyed.join(numbers.withColumnsRenamed({"doc_id": "d", "md5": "m"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("md5").eqNullSafe(F.col("m")))
    found = _removed(numbered, own.select(F.col("number").alias("doc_id"), "md5", "n"), n_batches)
    named = numbers.select(F.col("doc_id").alias("d"), "number")
    return found.join(named, F.col("doc_id") == F.col("number")).select(F.col("d").alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")


def _removed(docs: DataFrame, keyed: DataFrame, n_batches: int) -> DataFrame:
    """``remove_repeats`` of documents each with an id of its own."""
    keyed = keyed.filter(F.col("n") >= K)
    first = keyed.groupBy("md5").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f"))
    copies = keyed.join(first, "md5").filter(~F.col("doc_id").eqNullSafe(F.col("f.doc_id"))).select("doc_id").distinct()
    copies = materialize(copies, "copies")
    few = F.broadcast(copies) if copies.count() <= MAX_BROADCAST else copies
    spans = materialize(repeated_spans(docs.join(few, "doc_id", "left_anti"), n_batches), "spans")
    whole = few.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    by = spans.unionByName(whole).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    by = materialize(merged(by), "spans-by-document")
    n = by.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if n[0] <= MAX_BROADCAST and n[1] <= MAX_SPANS:
        by = F.broadcast(by)
    both = docs.join(by, F.col("doc_id").eqNullSafe(F.col("doc")), "left").select("doc_id", "text", "spans")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("kept", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")])

    def run(it):
        out = _arrow(schema)

        def rows(b):
            for i, t, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = (t.as_py() or "").encode()
                kept, at, runs = [], 0, [(x["lo"], len(raw) if x["hi"] is None else x["hi"]) for x in s.as_py() or ()]
                for lo, hi in runs:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                yield i, left, len(raw), len(raw) - len(left), len(runs)

        for b in it:
            yield from batches(rows(b), out)

    return both.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
