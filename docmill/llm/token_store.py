"""Binary token-id shards with a minimal perfect hash index.

Shards: documents are range-partitioned by their key and sorted, and each
task writes one file of raw little-endian ids (2 bytes each where the
vocabulary allows, else 4), key after key, without any header. A file's name
holds a random part, so that a repeated task attempt writes another file; only
files named in the record table belong to the store. Files are written to the
cluster's shared folder, in a stream.

Index: keys are dealt into buckets of about ``BUCKET_KEYS`` by hash. For each
bucket a task builds a minimal perfect hash function: a cascade of bit
arrays; a key is placed in the first level where its bit is its alone, and
its slot is the rank of that bit. Slot tables keep a 32-bit fingerprint of
the key, the shard, the offset and the length. A look-up computes the slot
(constant time), compares the fingerprint and reads the ids at the offset.

Repeated keys: the records of a key lie one after the other; record ``dup`` of
a key (0 first) has the index key (key, dup). Equal rows are stored once each.
A null key sorts first and is a key of its own. A null text is empty. A key that
isn't stored is not found, but for one in 2^32 (fingerprint). An empty table
gives a store without shards and an empty index.
"""

from __future__ import annotations

import os
import string
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialize, open_fs, shared_path

END_ID = 2
BUCKET_KEYS = 20_000
#: Bits of a level for each key still without a place.
GAMMA = 1.5
MAX_LEVELS = 64

#: Marks that are cut off words: ASCII punctuation but for the apostrophe,
#: with which contractions begin.
MARKS = string.punctuation.replace("'", "")
#: Python splits at these, the tokenizer doesn't: texts with them are encoded whole.
NOT_BLANK = "\x1c\x1d\x1e\x1f"

_TOK: dict = {}


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space.

    White space always ends a piece and is never part of one, so a text's ids
    are those of its words; each distinct word is encoded once by the library
    and kept. ``check_splits`` says whether a tokenizer is of that kind.
    """

    KEEP = 1_200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        #: texts that hold one of these strings are encoded whole: the library looks for them before it splits
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        self.pieces = {"": b""}
        self.by_word = self.check_splits()
        self.folds = self.check_folds()
        self.wide = self.lib.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        #: ids that end a piece, where the model marks them; a word of letters is one piece
        mark = getattr(self.lib.model, "end_of_word_suffix", None)
        self.ends = None
        if mark:
            self.ends = np.zeros(max(self.lib.get_vocab().values()) + 1, bool)
            self.ends[[i for t, i in self.lib.get_vocab().items() if t.endswith(mark)]] = True

    def check_splits(self) -> bool:
        a = self.lib.encode("one  two,\tTHREE\n'll x", add_special_tokens=False).ids
        b = [i for w in ("one", "two,", "THREE", "'ll", "x") for i in self._encode([w])[0]]
        return a == b

    def check_folds(self) -> bool:
        """Whether A-Z have the ids of a-z: such texts are lower-cased first."""
        upper = [*string.ascii_uppercase, string.ascii_uppercase, "THREE'LL", "No.1,A"]
        return self._encode(upper) == self._encode([w.lower() for w in upper])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Many words are one text for the library where the
        ids say where a word of letters ends, which takes half the time."""
        out: list = [None] * len(words)
        joined = [i for i, w in enumerate(words) if w.isalpha()] if self.ends is not None else []
        for s in range(0, len(joined), 20_000):
            own = joined[s:s + 20_000]
            texts = [" ".join([words[i] for i in own[k:k + 50]]) for k in range(0, len(own), 50)]
            ids = np.concatenate([np.array(x, self.kind) for x in self._encode(texts)])
            until = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(until) == len(own) and until[-1] == ids.nbytes:
                raw, until = ids.tobytes(), until.tolist()
                for i, x, y in zip(own, [0, *until], until):
                    out[i] = raw[x:y]
        single = [i for i, x in enumerate(out) if x is None]
        for s in range(0, len(single), 20_000):
            for i, x in zip(single[s:s + 20_000], self._encode([words[i] for i in single[s:s + 20_000]])):
                out[i] = np.array(x, self.kind).tobytes()
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Encode words not met before. A word of letters with marks before or
        behind has the ids of the marks, the letters and the marks."""
        pieces, whole, cut, ask = self.pieces, [], [], {}
        for w in new:
            core = w.strip(MARKS) if self.folds else ""
            if not core or not core.isalpha() or "İ" in core or "Σ" in core:
                whole.append((w, w))
                if w not in pieces:
                    ask[w] = None
                continue
            low = core.lower()
            if low not in pieces:
                ask[low] = None
            if len(core) == len(w):
                whole.append((w, low))
                continue
            at = w.index(core)
            cut.append((w, w[:at], low, w[at + len(core):]))
            for x in cut[-1][1::2]:
                if x not in pieces:
                    ask[x] = None
        pieces.update(zip(ask, self._encode_words(list(ask))))
        out = {w: pieces[x] for w, x in whole}
        for w, a, b, c in cut:
            out[w] = pieces[a] + pieces[b] + pieces[c]
        self.ids.update(out)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        if not self.by_word:
            return [np.array(x, self.kind).tobytes() for x in self._encode(texts)]
        # fewer distinct words; other than in A-Z, lower case may hang on the characters around
        low = [t.lower() if self.folds and t.isascii() else t for t in texts]
        odd = [i for i, (t, x) in enumerate(zip(texts, low)) if any(c in t for c in NOT_BLANK) or any(c in t or c in x for c in self.added)]
        for i in odd:
            low[i] = ""
        if len(self.ids) > self.KEEP:
            self.ids.clear()
            self.pieces = {"": b""}
        # Arrow splits at the same white space as Python
        split = pc.utf8_split_whitespace(pa.array(low, pa.string()))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        table = list(map(self.ids.get, distinct))
        learned = self._learn([w for w, ids in zip(distinct, table) if ids is None])
        table = pa.array([learned[w] if ids is None else ids for w, ids in zip(distinct, table)], pa.large_binary())
        got = table.take(coded.indices)
        at = np.concatenate([[0], np.cumsum(pc.binary_length(got).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = at[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        raw = memoryview(got.buffers()[2] or b"")
        out = [bytes(raw[x:y]) for x, y in zip(at, at[1:])]
        for i in odd:
            out[i] = np.array(self._encode([texts[i]])[0], self.kind).tobytes()
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _TOK:
        _TOK[path] = WordEncoder(path)
    return _TOK[path]


@dataclass
class TokenStore:
    """records: (key, dup, shard, file, offset, n_tokens); shards: (shard,
    file, n_tokens, base); index: a row for each bucket; width: bytes an id."""

    records: DataFrame
    shards: DataFrame
    index: DataFrame
    n_buckets: int
    width: int


# ------------------------------------------------------------------ shards
def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """Write the files; (key, shard, file, offset, n_tokens) of each record,
    with offsets in ids from the file's start."""
    key_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()),
                           T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(it):
        from pyspark import TaskContext

        from .byte_bpe import _arrow

        out, shard, at, f = _arrow(schema), TaskContext.get().partitionId(), 0, None
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        encode = _encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        try:
            for b in it:
                keys, texts = b.column(0).to_pylist(), b.column(1)
                rows, group, held = [], [], 0
                for i in range(b.num_rows):
                    group.append(texts[i].as_py() or "")
                    held += len(group[-1])
                    if held < 1 << 22 and i + 1 < b.num_rows:
                        continue
                    first = i + 1 - len(group)
                    for j, ids in enumerate(encode(group)):
                        if f is None:
                            fs, where = open_fs(folder)
                            fs.create_dir(where, recursive=True)
                            f = fs.open_output_stream(f"{where}/{name}")
                        f.write(ids + end)
                        n = len(ids) // encode.kind.itemsize + 1
                        rows.append((keys[first + j], shard, name, at, n))
                        at += n
                    group, held = [], 0
                yield from batches(rows, out, 20_000)
        finally:
            if f is not None:
                f.close()

    dealt = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text")).repartitionByRange("key")
    return dealt.sortWithinPartitions("key", F.xxhash64("text")).mapInArrow(run, schema)


# ------------------------------------------------------------------- index
def key_hashes(key: Column, dup: Column) -> tuple[Column, Column]:
    """(hash that picks bucket and slot, hash whose low bits are the print)."""
    h = F.xxhash64(key, dup)
    return h, F.xxhash64(h, key, F.lit(0x5EED), dup)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash for each level (finalizer of splitmix64)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def build_mph(h: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(sizes of the levels, all their bits) for distinct 64-bit hashes."""
    sizes, arrays, left = [], [], h
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("equal key hashes in one bucket")
        m = max(64, int(GAMMA * len(left)))
        place = (_mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
        bits = np.bincount(place, minlength=m) == 1
        sizes.append(m)
        arrays.append(bits)
        left = left[~bits[place]]
    return sizes, np.concatenate(arrays) if arrays else np.zeros(0, bool)


def mph_slots(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each hash, from 0 to the number of keys less 1; -1 for a hash
    that no level has a bit for (such a key is not stored)."""
    rank = np.cumsum(bits) - 1
    out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, m in enumerate(sizes):
        place = base + (_mix(h[todo], level) % np.uint64(m)).astype(np.int64)
        hit = bits[place]
        out[todo[hit]] = rank[place[hit]]
        todo, base = todo[~hit], base + m
    return out


_INDEX = ("bucket long, n long, sizes array<int>, bits binary, prints binary, shards binary, offsets binary, lengths binary")


def build_index(records: DataFrame, n_buckets: int) -> DataFrame:
    """One row for each bucket: the hash function and its slot tables."""
    h, p = key_hashes(F.col("key"), F.col("dup"))
    rows = records.select(F.pmod(h, F.lit(n_buckets)).alias("bucket"), h.alias("h"), p.alias("p"), "shard", "offset", "n_tokens")

    def build(pdf):
        import pandas as pd

        hashes = pdf["h"].to_numpy().astype(np.uint64)
        sizes, bits = build_mph(hashes)
        slot = mph_slots(hashes, sizes, bits)

        def table(col, kind):
            t = np.zeros(len(pdf), kind)
            t[slot] = pdf[col].to_numpy().astype(np.uint64).astype(kind)
            return t.tobytes()

        return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0], "n": len(pdf), "sizes": sizes, "bits": np.packbits(bits).tobytes(),
                              "prints": table("p", "<u4"), "shards": table("shard", "<u4"), "offsets": table("offset", "<u8"),
                              "lengths": table("n_tokens", "<u8")}])

    return rows.groupBy("bucket").applyInPandas(build, _INDEX)


def write_store(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text",
                end_id: int = END_ID, folder: str | None = None) -> TokenStore:
    """Write shards, records and index below the shared folder."""
    spark = docs.sparkSession
    tokenizer = tokenizer or word_tokenizer_path()
    folder = folder or shared_path(spark, "llm", "tokens")
    rows = materialize(write_shards(docs, folder, tokenizer, id_col, text, end_id), "token-records")
    # the repeats of a key lie together: their number is their rank in the shards
    dup = F.row_number().over(Window.partitionBy("key").orderBy("shard", "offset")) - 1
    records = rows.withColumn("dup", dup)
    shards = rows.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n_tokens"))
    # as many rows as there are files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("file", F.concat(F.lit(folder + "/"), "file"))
    n_buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    index = materialize(build_index(records, n_buckets), "token-index")
    return TokenStore(records, shards, index, n_buckets, _encoder(tokenizer).kind.itemsize)


# ----------------------------------------------------------------- reading
def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(key, dup, shard, offset, n_tokens) of the stored ones among ``keys``
    (key, dup), each of which must be there once only."""
    h, p = key_hashes(F.col("key"), F.col("dup"))
    asked = keys.select("key", "dup", F.pmod(h, F.lit(store.n_buckets)).alias("bucket"), h.alias("h"), p.alias("p"))
    schema = T.StructType([keys.schema["key"], keys.schema["dup"], T.StructField("shard", T.IntegerType()),
                           T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def find(asked, index):
        import pandas as pd

        if not len(index) or not len(asked):
            return pd.DataFrame({f.name: pd.Series(dtype="object") for f in schema}).iloc[:0]
        row = index.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        slot = mph_slots(asked["h"].to_numpy().astype(np.uint64), sizes, bits)
        prints = np.frombuffer(row["prints"], "<u4")
        own = asked["p"].to_numpy().astype(np.uint64).astype("<u4")
        hit = (slot >= 0) & (prints[slot] == own)
        slot = slot[hit]
        return pd.DataFrame({"key": asked["key"].to_numpy()[hit], "dup": asked["dup"].to_numpy()[hit]} | {
            c: np.frombuffer(row[t], k)[slot].astype(np.int64) for c, t, k in (("shard", "shards", "<u4"), ("offset", "offsets", "<u8"), ("n_tokens", "lengths", "<u8"))})

    return asked.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInPandas(find, schema)


def fetch(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(key, dup, start, n_tokens, ids): the ids of each stored key as
    little-endian unsigned 32-bit integers, and the number of ids before it."""
    where = locate(store, keys).join(store.shards.select("shard", "file", "base"), "shard")
    # neighbours in a file are read by one task, in order
    where = where.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    where = where.select("key", "dup", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "file", "offset")
    schema = T.StructType([*where.schema.fields[:4], T.StructField("ids", T.BinaryType())])
    kind = np.dtype(f"<u{store.width}")

    def run(it):
        from .byte_bpe import _arrow

        out, name, f = _arrow(schema), None, None

        def rows():
            nonlocal name, f
            for b in it:
                for key, dup, start, n, file, offset in zip(*(c.to_pylist() for c in b.columns)):
                    if file != name:
                        fs, path = open_fs(file)
                        name, f = file, fs.open_input_file(path)
                    raw = f.read_at(n * kind.itemsize, offset * kind.itemsize)
                    if len(raw) != n * kind.itemsize:
                        raise OSError(f"{file} ends before {offset} + {n} ids")
                    yield key, dup, start, n, np.frombuffer(raw, kind).astype("<u4").tobytes()

        yield from batches(rows(), out)

    return where.mapInArrow(run, schema)


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files
    by way of the index; the keys asked for are those of ``docs``."""
    store = write_store(docs.select("doc_id", "text"))
    dup = (F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))) - 1).alias("dup")
    asked = docs.select(F.col("doc_id").alias("key")).select("key", dup)
    got = fetch(store, asked)
    return got.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
