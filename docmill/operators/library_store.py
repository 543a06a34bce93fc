"""A saved library that is read by key, by manifest entry and by substring
(SNK-1, LIB-3, LIB-4, LIB-5, LIB-9 on stored data).

``save`` writes three tables below one folder:

* ``texts``: one row per (project, page id) -- the last write; earlier ones are
  left out before the shuffle -- bucketed by ``page_no``, a hash of the key;
* ``manifest``: every entry, without text, bucketed alike;
* ``grams`` and ``gram_counts`` (``index_grams``): for each three characters
  in lower case the pages that hold them, in folders by a hash of the gram. A
  row has the pages of one gram among some hundred pages that a task looked at
  together, so a gram that most pages hold has many rows of bounded size.

A page lookup reads the key's buckets only. Manifest entries meet their texts
bucket by bucket: neither side moves, and each text is read once. A search
looks up each term's rarest grams (dynamic partition pruning reads their folders
only), takes the pages that hold all of them to the texts' buckets and confirms them by
``contains``. Page texts never move, and no term is compared to every page.
``page_no`` only locates: equal hashes of different keys are told apart by the
key or by the text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .library import save_last_wins

#: Folders of the gram index.
SHARDS = 64
#: Characters of a gram; code points take 21 bits each, so a gram is one long.
Q = 3
CODE_BITS = 21
#: Grams of a term that a candidate must hold.
RAREST = 3
#: (gram, page) pairs that a task of the index holds at a time.
PAIRS = 1 << 19
#: Behind a text's end: lets terms shorter than a gram be looked up as well.
PAD = (1 << CODE_BITS) - 1
#: Up to so many keys, a lookup names its buckets in the plan.
LITERAL_KEYS = 1000


@dataclass(frozen=True)
class LibraryStore:
    spark: SparkSession
    path: str
    name: str

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def grams(self, part: str) -> DataFrame:
        value = "page_nos array<long>" if part == "grams" else "pages long"
        return self.spark.read.schema(f"gram long, {value}, shard int").parquet(f"{self.path}/{part}")


def page_no(project_id: Column, page_id: Column) -> Column:
    return F.xxhash64(project_id, page_id)


def save(lib: DataFrame, path: str | None = None, name: str | None = None) -> LibraryStore:
    """Write ``texts`` and ``manifest``. Of several writes of a page id the one
    with the greatest position stays (of equals, the greatest text)."""
    spark = lib.sparkSession
    store = LibraryStore(spark, path or shared_path(spark, "library"), name or f"library_{uuid.uuid4().hex}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = page_no(F.col("project_id"), F.col("page_id")).alias("page_no")
    # earlier writes stay behind before the texts move, once, to their buckets;
    # writes of one position are settled there
    texts = (save_last_wins(lib).select(number, "project_id", "page_id", "position", "content", "title", "url").repartition(n, "page_no")
             .groupBy("page_no", "project_id", "page_id").agg(F.max(F.struct("position", "content", "title", "url")).alias("w"))
             .select("page_no", "project_id", "page_id", "w.*"))
    entries = lib.select(number, "project_id", "position", "page_id", "title", "url").repartition(n, "page_no")
    for part, rows in (("texts", texts), ("manifest", entries)):
        (rows.write.option("path", f"{store.path}/{part}").bucketBy(n, "page_no").sortBy("page_no")
         .format("parquet").mode("overwrite").saveAsTable(f"{store.name}_{part}"))
    return store


def drop(store: LibraryStore) -> None:
    """Forget the tables (the files stay with the folder's owner)."""
    for part in ("texts", "manifest"):
        store.spark.sql(f"DROP TABLE IF EXISTS {store.name}_{part}")


# LIB-3 -----------------------------------------------------------------------
def get_page(store: LibraryStore, project_id: str, page_id: str) -> DataFrame:
    """(project_id, page_id, content): one row, or none; reads one bucket."""
    return store.table("texts").filter(
        (F.col("page_no") == page_no(F.lit(project_id), F.lit(page_id))) & (F.col("project_id") == project_id) & (F.col("page_id") == page_id)
    ).select("project_id", "page_id", "content")


def get_pages(store: LibraryStore, requests: DataFrame) -> DataFrame:
    """Texts of ``requests(project_id, page_id)`` that are stored. Up to
    LITERAL_KEYS requests read their buckets only; more are joined bucket by
    bucket."""
    wanted = requests.select("project_id", "page_id").distinct().withColumn("page_no", page_no(F.col("project_id"), F.col("page_id")))
    texts = store.table("texts").select("page_no", "project_id", "page_id", "content")
    few = [r["page_no"] for r in wanted.limit(LITERAL_KEYS + 1).collect()]
    if len(few) <= LITERAL_KEYS:
        texts = texts.filter(F.col("page_no").isin(few))
    return texts.join(wanted, ["page_no", "project_id", "page_id"], "left_semi").drop("page_no")


# LIB-9 -----------------------------------------------------------------------
def entries(store: LibraryStore) -> DataFrame:
    """Manifest entries with the stored text of their page id (null: none)."""
    texts = store.table("texts").select("page_no", "project_id", "page_id", "content")
    return store.table("manifest").join(texts, ["page_no", "project_id", "page_id"], "left").select(
        "project_id", "position", "page_id", "title", "url", "content")


def missing_pages(store: LibraryStore) -> DataFrame:
    """Entries without a stored text, or with an empty one."""
    return entries(store).filter(F.coalesce(F.length("content"), F.lit(0)) == 0).select(
        "project_id", "position", "page_id", F.when(F.col("content").isNull(), "missing").otherwise("empty").alias("problem"))


# LIB-4, LIB-5 ------------------------------------------------------------------
def _text_grams(text: str, pad: bool):
    """The distinct grams of a text, in order."""
    import numpy as np

    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.concatenate([c, np.full(Q - 1 if pad else 0, PAD)])
    if len(c) < Q:
        return c[:0]
    return np.unique((c[:-2] << 2 * CODE_BITS) | (c[1:-1] << CODE_BITS) | c[2:])


def _gram_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram) of the distinct grams of each row's text."""
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema[key], T.StructField("gram", T.LongType())])

    def run(it):
        for b in it:
            for i, t in enumerate(b.column(1)):
                g = _text_grams(t.as_py(), False)
                for s in range(0, len(g), 1 << 16):
                    part = pa.array(g[s:s + (1 << 16)])
                    yield pa.record_batch([pa.repeat(b.column(0)[i], len(part)), part], names=[key, "gram"])

    return rows.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def _postings(texts: DataFrame) -> DataFrame:
    """(gram, page_nos) of ``texts`` (page_no, lc): the pages that hold a gram
    among those with PAIRS pairs of gram and page together."""

    def run(it):
        import numpy as np

        def batch(grams, pages):
            g = np.concatenate(grams)
            p = np.repeat(np.array(pages, np.int64), [len(x) for x in grams])
            order = np.argsort(g, kind="stable")
            g, p = g[order], p[order]
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(g)), pa.int32()), pa.array(p))
            return pa.record_batch([pa.array(g[at]), lists], names=["gram", "page_nos"])

        grams, pages, held = [], [], 0
        for b in it:
            for no, t in zip(b.column(0).to_pylist(), b.column(1)):
                grams.append(_text_grams(t.as_py(), True))
                pages.append(no)
                held += len(grams[-1])
                if held >= PAIRS:
                    yield batch(grams, pages)
                    grams, pages, held = [], [], 0
        if held:
            yield batch(grams, pages)

    return texts.select("page_no", "lc").mapInArrow(run, "gram long, page_nos array<long>")


def _shard() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(SHARDS)).cast("int")


def index_grams(store: LibraryStore) -> None:
    """Write the inverted index of the stored texts' grams."""
    texts = store.table("texts").filter(F.length("content") > 0).select("page_no", F.lower("content").alias("lc"))
    # a folder's files are written by ``deal`` tasks, each with grams of its own
    deal = max(1, int(store.spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    rows = _postings(texts).withColumn("shard", _shard())
    (rows.repartition(SHARDS * deal, "shard", F.pmod(F.xxhash64("gram", F.lit(deal)), F.lit(deal))).sortWithinPartitions("shard", "gram")
     .write.mode("overwrite").partitionBy("shard").parquet(f"{store.path}/grams"))
    (store.grams("grams").groupBy("shard", "gram").agg(F.sum(F.size("page_nos").cast("long")).alias("pages"))
     .repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{store.path}/gram_counts"))


def _code(term: Column, n: int) -> Column:
    """The first ``n`` characters' share of a gram."""
    out = F.lit(0).cast("long")
    for i in range(n):
        out = out.bitwiseOR(F.shiftleft(F.ascii(F.substring(term, i + 1, 1)).cast("long"), CODE_BITS * (Q - 1 - i)))
    return out


def candidates(store: LibraryStore, terms: DataFrame) -> DataFrame:
    """(q, page_no) of lower-cased distinct terms ``q`` and the pages that hold
    the RAREST rarest grams of each, or all where it has fewer; terms of one or
    two characters have all grams that begin with them."""
    grams = store.grams("grams")
    long = _gram_rows(terms.filter(F.length("q") >= Q), "q", "q").withColumn("shard", _shard())
    counted = long.join(store.grams("gram_counts"), ["shard", "gram"], "left")
    # a gram that no page has is the rarest
    own = Window.partitionBy("q")
    rank = F.row_number().over(own.orderBy(F.coalesce("pages", F.lit(0)), "gram"))
    rarest = (counted.withColumns({"rank": rank, "need": F.least(F.lit(RAREST), F.count(F.lit(1)).over(own))})
              .filter(F.col("rank") <= RAREST).select("q", "need", "shard", "gram"))
    met = grams.join(rarest, ["shard", "gram"]).select("q", "need", F.explode("page_nos").alias("page_no"))
    out = met.groupBy("q", "need", "page_no").agg(F.count(F.lit(1)).alias("held")).filter("held >= need").select("q", "page_no")
    for n in (1, 2):
        bits = CODE_BITS * (Q - n)
        short = terms.filter(F.length("q") == n).select("q", F.shiftright(_code(F.col("q"), n), bits).alias("head"))
        met = grams.withColumn("head", F.shiftright("gram", bits)).join(short, "head")
        out = out.unionByName(met.select("q", F.explode("page_nos").alias("page_no")).distinct())
    return out


def search_many(store: LibraryStore, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``terms`` with each manifest entry (project_id, position, page_id) whose
    stored text holds the term, in any case. A null term is nowhere, an empty
    one in every non-empty page."""
    asked = terms.filter(F.col(term_col).isNotNull()).withColumn("q", F.lower(F.col(term_col)))
    distinct = asked.select("q").distinct()
    texts = store.table("texts").filter(F.length("content") > 0)
    found = candidates(store, distinct.filter("q <> ''")).join(texts.select("page_no", "project_id", "page_id", "content"), "page_no")
    found = found.filter(F.contains(F.lower("content"), F.col("q"))).select("q", "page_no", "project_id", "page_id")
    everywhere = texts.filter(distinct.filter("q = ''").exists()).select(F.lit("").alias("q"), "page_no", "project_id", "page_id")
    pages = found.unionByName(everywhere).join(store.table("manifest"), ["page_no", "project_id", "page_id"])
    return asked.join(pages.select("q", "project_id", "position", "page_id"), "q").drop("q")


def search(store: LibraryStore, q: str, project_id: str | None = None) -> DataFrame:
    """(project_id, position, page_id) of the entries whose text holds ``q``."""
    out = search_many(store, store.spark.range(1).select(F.lit(q).alias("term"))).drop("term")
    return out.filter(F.col("project_id") == project_id) if project_id is not None else out
