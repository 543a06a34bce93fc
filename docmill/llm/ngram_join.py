"""Jaccard self-join on word n-grams, heavy-light by set size.

A document's set is its distinct ``N``-word shingles (64-bit hashes of the
lower-cased words); two documents link when their sets' Jaccard similarity is
at least ``PERCENT`` per cent. Equal sets are one class from the start, and all
work below is on one set of each class.

Light sets (at most ``boundary`` shingles): two sets of s and t shingles link
exactly when they share a subset of c(s, t) shingles, the least intersection
for their sizes. Each light set emits the hash of each of its subsets of each
size it may need; sets with a subset in common are linked to the smallest of
them, which links all that belong together without listing their pairs.

Heavy sets scan inverted lists. The lists hold each set's rarest shingles,
as many as it may miss plus one, so two sets that link meet in a list.
Shingles that a task meets in several documents are counted over the corpus
and, the most frequent first, put last in that order; this only shortens
lists. A list is scanned in rounds: first every member is compared to one pivot
of its list and size class, and what links becomes a component; when that
leaves few enough pairs of members in different components, these pairs are
compared. Members already connected need no comparison, so a group of
thousands of near copies costs a comparison or two each. Shingles that stand in
no other set bound what two sets can share: the first pivot is the member with
the fewest of them, and pairs that have too many are no candidates. As the
lists hold a part of each set only, a shingle counts as such when its hash is
below what every set of a size to link with lists, for this count, also beyond
its rarest ones (``listed_to``). Every pair
is checked first by position and by a parity bitmap (its Hamming distance is
never more than the sets' difference; where lists are compared in full, a fold of
it to 256 bits is part of the join), then exactly on the sets.

The boundary is the size at which subsets and list entries cost the least in
sum, from the sets' size histogram and the lists' lengths.

Edge cases: null and empty texts have no set, no link and their own
component; fewer words than ``N`` make one shingle of all of them; rows that
share a doc_id but not their set are linked each by its own set, and each has its own
component; rows with a null doc_id are in no component (null) and have no link.
Further columns are not looked at.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialize

N = 3
PERCENT = 90
#: What near-duplicate stages take.
NEAR_N, NEAR_PERCENT = 5, 80
#: At most so many frequent shingles are ordered by their counts.
MAX_FREQUENT = 1 << 17
#: Tables of ids are broadcast up to so many rows (16 MB).
MAX_BROADCAST = 1_000_000
LARGEST_BOUNDARY = 39
#: Pairs in different components are compared when an entry has no more than
#: this many on average; else one more round with other pivots comes first.
FEW_PAIRS = 1000
MAX_ROUNDS = 4
#: Shingles that a task counts at a time (8 bytes each).
_FLUSH = 1 << 19

_TABLE = bytes(32 if 9 <= i <= 13 else i for i in range(256)).lower()
_P = 0x9E3779B97F4A7C15


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    raw = (text or "").encode().translate(_TABLE).strip(b" ")
    if not raw:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    word = b != 32
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    length = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - start
    place = np.arange(len(b)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(b)]))
    powers = np.full(int(length.max()), _P, np.uint64).cumprod()
    value = np.where(word, b.astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers[np.minimum(place, len(powers) - 1)]
    w = _mix(np.add.reduceat(value, start) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k if k < n else 0, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(_P) + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def least_overlap(s, t, percent: int = PERCENT):
    """The least intersection of sets of s and t elements that link."""
    return -(-percent * (s + t) // (100 + percent))


def shortest(n, percent: int = PERCENT):
    """The least intersection of a set of n elements with any that it links to."""
    return -(-percent * n // 100)


def listed_to(n: int, percent: int = PERCENT) -> np.uint64:
    """A set of n elements lists all its infrequent ones below this hash: about
    its rarest ones and two standard deviations. Falls as n grows."""
    p = n * (100 - percent) / 100 + 1
    return np.uint64(min(1.0, (p + 2 * p ** 0.5) / n) * (2.0 ** 64 - 2.0 ** 12))


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity bitmap: each element toggles one bit; a power of two of bytes."""
    bits = 1 << max(8, int(len(h) - 1).bit_length())
    odd = np.bincount((_mix(h + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def signature(bits: np.ndarray) -> np.ndarray:
    """The bitmap folded onto 256 bits, as four longs."""
    return np.bitwise_xor.reduce(bits.reshape(-1, 32)).view(np.int64)


def _close_signatures(x: str, y: str, most):
    """Whether two signatures differ in at most ``most`` bits: sets of a
    symmetric difference within it never differ in more."""
    apart = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(4)]
    return apart[0] + apart[1] + apart[2] + apart[3] <= most


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance after folding the larger bitmap onto the size of the smaller."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size)) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _few(df: DataFrame) -> DataFrame:
    """``df`` (ids, written out) with a broadcast hint if it is small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


# ----------------------------------------------------------- sets and classes
def survey(docs: DataFrame, n: int = N) -> DataFrame:
    """Rows (doc_id, size, key) of the documents, and rows (shingle, times) of
    the shingles that one task met in several different sets."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("size", T.IntegerType()), T.StructField("key", T.BinaryType()),
                           T.StructField("shingle", T.LongType()), T.StructField("times", T.LongType())])

    def run(it):
        import xxhash

        out, seen, held, known = _arrow(schema), np.empty(_FLUSH, np.uint64), 0, set()

        def often():
            """The shingles met twice or more, as columns."""
            part = seen[:held]
            part.sort()
            at = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), held]
            n = np.diff(at)
            h, n = part[at[:-1][n > 1]].view(np.int64), n[n > 1]
            for i in range(0, len(h), 20_000):
                pair = pa.array(h[i:i + 20_000]), pa.array(n[i:i + 20_000], pa.int64())
                yield pa.record_batch([pa.nulls(len(pair[0]), f.type) for f in list(out)[:3]] + list(pair), schema=out)

        for b in it:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(t.as_py(), n)
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                rows.append((i, len(s), key, None, None))
                if key and key not in known:
                    known.add(key)
                    while len(s):
                        part, s = s[:_FLUSH - held], s[_FLUSH - held:]
                        seen[held:held + len(part)] = part
                        held += len(part)
                        if held == _FLUSH:
                            yield from often()
                            held = 0
                            known.clear()
            yield from batches(rows, out, 20_000)
        if held:
            yield from often()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def set_key(text: str | None, n: int = N) -> bytes | None:
    """A 128-bit hash of the text's set; null without one."""
    import xxhash

    s = shingle_set(text, n)
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def representatives(docs: DataFrame, own: DataFrame, classes: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text), one row for each class: of its documents the one with the
    smallest id. Where some rows share a doc_id, ``doc_id`` is a struct of it
    and, for those rows, the class's key, so that it names one set."""
    shared = materialize(own.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                         .filter("n > 1").select("doc_id"), "shared-ids")
    reps = materialize(classes.select(F.col("least").alias("doc_id")).distinct(), "representatives")
    if shared.isEmpty():
        return docs.select("doc_id", "text").join(_few(reps), "doc_id", "left_semi")
    name = lambda key: F.struct("doc_id", key.alias("key")).alias("doc_id")
    alone = docs.join(reps.join(shared, "doc_id", "left_anti"), "doc_id", "left_semi").select(name(F.lit(b"")), "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("key", T.BinaryType())])

    def keyed(it):
        for b in it:
            keys = pa.array([set_key(t.as_py(), n) for t in b.column(1)], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), keys], names=["doc_id", "text", "key"])

    several = docs.select("doc_id", "text").join(reps.join(shared, "doc_id", "left_semi"), "doc_id", "left_semi").mapInArrow(keyed, schema)
    one = several.groupBy("doc_id", "key").agg(F.min("text").alias("text"))
    one = one.join(classes.withColumnRenamed("least", "doc_id"), ["doc_id", "key"], "left_semi")
    return alone.unionByName(one.select(name(F.col("key")), "text"))


def profiles(docs: DataFrame, frequent: list[tuple[int, int]], n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, size, rare, more, sure, bitmap, sig): the first shingles of each set
    in the order of frequency, as many as the set may miss plus one; the other
    infrequent ones up to ``listed_to``; and how many of the first ones any set
    that may link to this one has in either of its two."""
    hashes = np.array([h for h, _ in frequent], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    # at most MAX_FREQUENT entries of 16 bytes
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], np.array([c for _, c in frequent], np.int64)[order]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("size", T.IntegerType()),
                           T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("more", T.ArrayType(T.LongType())),
                           T.StructField("sure", T.IntegerType()), T.StructField("bitmap", T.BinaryType()), T.StructField("sig", T.ArrayType(T.LongType()))])

    def run(it):
        out = _arrow(schema)
        often, times = shared.value

        def rows(b):
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(t.as_py(), n)
                if not len(s) or i is None:
                    continue
                p = len(s) - shortest(len(s), percent) + 1
                at = np.searchsorted(often, s).clip(0, max(0, len(often) - 1))
                known = often[at] == s if len(often) else np.zeros(len(s), bool)
                new = s[~known]
                rare, more = new[:p], new[p:]
                more = more[more < listed_to(len(s), percent)]
                sure = int((rare < listed_to(100 * len(s) // percent, percent)).sum())
                if len(rare) < p:
                    f = s[known]
                    rare = np.r_[rare, f[np.lexsort((f, times[at[known]]))[:p - len(rare)]]]
                bits = bitmap(s)
                yield i, len(s), rare.view(np.int64), more.view(np.int64), sure, bits.tobytes(), signature(bits)

        for b in it:
            yield from batches(rows(b), out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ----------------------------------------------------------------- light sets
def n_subsets(size: int, percent: int = PERCENT) -> int:
    return sum(comb(size, c) for c in range(shortest(size, percent), size + 1))


def light_links(docs: DataFrame, light: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(a, b) of light sets with a common subset large enough for their sizes."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("size", T.IntegerType()), T.StructField("c", T.IntegerType()),
                           T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def run(it):
        from itertools import combinations

        out = _arrow(schema)

        def rows(b):
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(t.as_py(), n)
                sums = [_mix(s + np.uint64(salt)) for salt in (1, 2)]
                for c in range(shortest(len(s), percent), len(s) + 1):
                    gone = np.array(list(combinations(range(len(s)), len(s) - c)), np.int64).reshape(comb(len(s), c), len(s) - c)
                    h1, h2 = ((x.sum() - x[gone].sum(axis=1)).view(np.int64).tolist() for x in sums)
                    for x, y in zip(h1, h2):
                        yield i, len(s), c, x, y

        for b in it:
            yield from batches(rows(b), out, 20_000)

    texts = docs.select("doc_id", "text").join(_few(light), "doc_id", "left_semi")
    subsets = texts.select("doc_id", "text").mapInArrow(run, schema)
    first = Window.partitionBy("c", "h1", "h2").orderBy("size", "id")
    met = subsets.select("id", "size", "c", F.first(F.struct("id", "size")).over(first).alias("least"))
    need = F.ceil(percent * (F.col("size") + F.col("least.size")) / (100 + percent))
    return met.filter((F.col("id") != F.col("least.id")) & (need <= F.col("c"))).select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct()


def pick_boundary(sizes: dict[int, int], mean_list: float, percent: int = PERCENT) -> int:
    """The size up to which sets are light, at the least cost: subsets emitted
    by light sets plus list entries read by heavy ones."""
    def cost(b):
        light = sum(c * n_subsets(s, percent) for s, c in sizes.items() if s <= b)
        heavy = sum(c * (s - shortest(s, percent) + 1) * mean_list for s, c in sizes.items() if s > b)
        return light + heavy

    return min(range(0, LARGEST_BOUNDARY + 1), key=cost)


# ----------------------------------------------------------------- heavy sets
def _check_bitmaps(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    p = profile.select("doc_id", "size", "bitmap")
    both = (pairs.join(p.withColumnsRenamed({"doc_id": "a", "size": "size_a", "bitmap": "map_a"}), "a")
            .join(p.withColumnsRenamed({"doc_id": "b", "size": "size_b", "bitmap": "map_b"}), "b"))
    schema = pairs.select("a", "b").schema

    def run(it):
        for b in it:
            s, t = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            most = s + t - 2 * least_overlap(s, t, percent)
            ok = [hamming(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= m
                  for x, y, m in zip(b.column(4), b.column(5), most)]
            yield pa.record_batch(b.select([0, 1]).filter(pa.array(ok, pa.bool_())).columns, names=["a", "b"])

    return both.select("a", "b", "size_a", "size_b", "map_a", "map_b").mapInArrow(run, schema)


def _check_exactly(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Texts of documents in a
    pair are moved, not sets: they compress, hashes don't."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ids")
    texts = docs.select("doc_id", "text").join(_few(ids), "doc_id", "left_semi")
    both = (pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
            .join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").sortWithinPartitions("a").select("a", "b", "text_a", "text_b"))

    def run(it):
        last, own = None, None
        for b in it:
            ok = []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if a != last or own is None:
                    last, own = a, shingle_set(x.as_py(), n)
                other = shingle_set(y.as_py(), n)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(100 * shared >= percent * (len(own) + len(other) - shared))
            yield pa.record_batch(b.select([0, 1]).filter(pa.array(ok, pa.bool_())).columns, names=["a", "b"])

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, profile: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    near = materialize(_check_bitmaps(pairs, profile, percent), "near-pairs")
    return materialize(_check_exactly(near, docs, n, percent), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each linked id's component, by taking
    the least label among neighbours and jumping to its label in turn."""
    both = materialize(links.select(F.col("a").alias("id"), F.col("b").alias("other"))
                       .unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct(), "edges")
    labels = materialize(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "other"}), "other").groupBy("id").agg(F.min("label").alias("m"))
        new = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("m"))
        jump = labels.withColumnsRenamed({"id": "m", "label": "far"})
        new = materialize(new.join(jump, "m", "left").select("id", "old", F.least("m", F.coalesce("far", "m")).alias("label")), "labels")
        moved = new.filter("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels


def _may_link(s: str, alone_s: str, t: str, alone_t: str, percent: int):
    """Whether sets of these sizes, with so many shingles that no other set
    has, can share enough."""
    s, a, t, b = (F.col(c) for c in (s, alone_s, t, alone_t))
    return F.least(s - a, t - b, (s + t - a - b) / 2) >= F.ceil(percent * (s + t) / (100 + percent))


def heavy_links(docs: DataFrame, profile: DataFrame, lists: DataFrame, boundary: int, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(a, b): links enough to connect all heavy sets that belong together."""
    # what a size class holds is within the range of sizes of one link or of its neighbours
    lists = lists.withColumn("class", F.floor(F.log("size") / F.log(F.lit(100 / percent))).cast("int"))
    links, labels = None, None
    for turn in range(MAX_ROUNDS):
        at = lists.withColumn("label", F.col("id")) if labels is None else (
            lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
        # lists whose members are all connected are done
        of = Window.partitionBy("shingle")
        at = materialize(at.withColumns({"lo": F.min("label").over(of), "hi": F.max("label").over(of)}).filter("lo <> hi").drop("lo", "hi"), "open")
        if turn:
            by = at.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(
                F.sum("n").alias("n"), F.max("n").alias("most"))
            left = by.agg(F.sum("n"), F.sum((F.col("n") - F.col("most")) * F.col("n"))).first()
            if not left[0] or left[1] <= FEW_PAIRS * left[0]:
                break
        rank = [F.xxhash64("id", F.lit(turn)), F.col("id")] if turn else [F.col("alone"), F.col("id")]
        pivot = F.first(F.struct("id", "label", "size", "alone")).over(Window.partitionBy("shingle", "class").orderBy(*rank))
        pairs = at.withColumn("pivot", pivot).filter(
            (F.col("label") != F.col("pivot.label")) & _may_link("size", "alone", "pivot.size", "pivot.alone", percent)).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
        found = _verified(pairs, profile, docs, n, percent)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    # what is left: members outside their list's largest component, against all in the list
    most = Window.partitionBy("shingle").orderBy(F.col("n").desc(), "label")
    main = at.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(most)).filter("r = 1")
    fewer = at.join(main.select("shingle", F.col("label").alias("main")), "shingle").filter("label <> main")
    sig = profile.select(F.col("doc_id").alias("id"), "sig")
    open_lists = at.join(fewer.select("shingle").distinct(), "shingle", "left_semi")
    x = fewer.join(sig, "id").select("shingle", "main", *(F.col(c).alias(c + "_x") for c in ("id", "size", "place", "alone", "label", "sig")))
    y = open_lists.join(sig, "id").select("shingle", *(F.col(c).alias(c + "_y") for c in ("id", "size", "place", "alone", "label", "sig")))
    small, large = F.least("size_x", "size_y"), F.greatest("size_x", "size_y")
    need = F.ceil(percent * (small + large) / (100 + percent))
    # at the first shingle that two sets share, what stands before it in either
    # order is in neither's intersection
    reach = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    pairs = x.join(y, "shingle").filter(
        (F.col("label_x") != F.col("label_y")) & (100 * small >= percent * large) & (large > boundary) & (reach >= need)
        & _may_link("size_x", "alone_x", "size_y", "alone_y", percent) & _close_signatures("sig_x", "sig_y", small + large - 2 * need)
        & ((F.col("id_x") < F.col("id_y")) | (F.col("label_y") == F.col("main"))))
    pairs = pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    found = _verified(pairs, profile, docs, n, percent)
    return found if links is None else links.unionByName(found)


def link_documents(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    seen = materialize(survey(docs, n), "survey")
    own = seen.filter("size is not null")
    counts = seen.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    frequent = [(r[0], r[1]) for r in counts.orderBy(F.col("times").desc(), "shingle").limit(MAX_FREQUENT).collect()]
    classes = materialize(own.filter("size > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least")), "classes")
    texts = representatives(docs, own, classes, n)
    profile = materialize(profiles(texts, frequent, n, percent), "profiles")
    entries = profile.select(F.col("doc_id").alias("id"), "size", "sure", F.size("rare").alias("p"), F.posexplode(F.concat("rare", "more")).alias("place", "shingle"))
    of = Window.partitionBy("shingle")
    entries = entries.withColumns({"n": F.count_if(F.col("place") < F.col("p")).over(of), "all": F.count(F.lit(1)).over(of)})
    entries = materialize(entries.filter("place < p and all > 1"), "lists")
    lists = entries.filter("n > 1").select("id", "size", "place", "shingle", "n")
    # the first ``sure`` shingles that no other set lists, not even beyond its
    # rarest ones, are in no other set
    alone = entries.groupBy("id").agg(F.max("sure").alias("sure"), F.count_if(F.col("place") < F.col("sure")).alias("met")).select(
        "id", F.greatest(F.col("sure") - F.col("met"), F.lit(0)).alias("alone"))
    # sets by size, and the mean length of the list of an entry
    sizes = {r["size"]: r["n"] for r in profile.filter(F.col("size") <= LARGEST_BOUNDARY).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = profile.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0))).first()[0]
    shared = lists.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    mean_list = (shared[0] + total - shared[1]) / max(1, total)
    boundary = pick_boundary(sizes, mean_list, percent)
    light = materialize(profile.filter(F.col("size") <= boundary).select("doc_id"), "light")
    heavy = lists.filter(F.col("size") >= shortest(boundary + 1, percent)).drop("n").join(alone, "id")
    links = light_links(texts, light, n, percent).unionByName(heavy_links(texts, profile, heavy, boundary, n, percent))
    labels = components(links)
    if isinstance(labels.schema["id"].dataType, T.StructType):
        whole = F.struct(F.col("least").alias("doc_id"), "key")
        named = classes.withColumn("of", F.array(whole, F.struct(F.col("least").alias("doc_id"), F.lit(b"").alias("key"))))
        named = named.select("key", "least", F.explode("of").alias("id")).join(labels, "id").select("key", F.col("label.doc_id").alias("label"))
        named = classes.join(named, "key", "left")
    else:
        named = classes.join(labels, classes["least"] == labels["id"], "left")
    named = named.select("key", F.coalesce("label", "least").alias("component"))
    return own.join(named, "key", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  WHERE 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""
