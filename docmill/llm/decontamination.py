"""Benchmark decontamination: MinHash containment search, then an exact check.

A test item is found in a document when at least ``MIN_CONTAINMENT`` of the
item's distinct five-word shingles are among the document's. Words are runs of
letters and digits in lower case.

Search: items are partitioned by size (powers of two of their number of
shingles). For each partition a sketch size k is set from its largest item:
an item may miss at most q - ceil(0.8 q) of its q shingles, so of its k =
that + 1 shingles with the smallest hashes (its bottom-k MinHash sketch) any
document that contains the item has one at least. Documents are sketched by
threshold: they show every shingle whose hash is no larger than the largest
in any item's sketch, so that short items are found in documents of any
length. A common hash makes a candidate, and no match is missed.

Check: for the candidates, shingles themselves are compared, and the shared
ones are counted exactly.

Everything is DataFrame work. The items' sketches are broadcast while they are
at most ``MAX_BROADCAST`` rows of 16 bytes, else joined by shuffle; candidates
are written out, so that Spark knows their size when it joins them to the texts.

Edge cases: null or empty texts and items of fewer than five words have no
shingle and are in no result. Rows that share a doc_id are held as parts of
one document, and the best of them counts; item rows that share an item_id
are one item. A null doc_id is an id of its own; items without an id are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHINGLE = 5
MIN_PERCENT = 80
MAX_BROADCAST = 2_000_000


def _let(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later expressions use many times, computed once."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words: Column, make) -> Column:
    """``make`` of the five words at each place; an empty array for fewer."""
    n = F.size(words)
    places = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(*(F.get(words, i + j) for j in range(SHINGLE))))


def item_shingles(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, shingles, q) of the items that have a shingle."""
    rows = _let(items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), text), w=plain_words(F.col(text)))
    each = rows.select("item", _windows(F.col("w"), lambda *w: F.concat_ws(" ", *w)).alias("shingles"))
    # an item is a short text: its shingles are one array
    one = each.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    return one.withColumn("q", F.size("shingles")).filter("q > 0")


def item_sketches(shingles: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(h, item): the bottom-k sketch of each item, k by size partition."""
    # partition p holds the items with 2^p to 2^(p+1) - 1 shingles
    top = 2 * F.expr("shiftleft(1, cast(floor(log2(q)) as int))") - 1
    may_miss = top - F.ceil(top * min_percent / 100)
    hashes = F.transform("shingles", lambda s: F.xxhash64(*(F.get(F.split(s, " "), j) for j in range(SHINGLE))))
    k = F.least(F.col("q"), (may_miss + 1).cast("int"))
    return shingles.select("item", F.explode(F.slice(F.sort_array(hashes), F.lit(1), k)).alias("h")).select("h", "item")


def candidates(docs: DataFrame, sketches: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, items): the items with which a document shares a sketched shingle."""
    rows, limit = sketches.agg(F.count(F.lit(1)), F.max("h")).first()
    if rows <= MAX_BROADCAST:
        sketches = F.broadcast(sketches)
    words = _let(docs.select(F.col(id_col).alias("doc"), text), w=plain_words(F.col(text)))
    shown = words.select("doc", F.explode(_windows(F.col("w"), F.xxhash64)).alias("h")).filter(F.col("h") <= F.lit(limit).cast("bigint"))
    return shown.join(sketches, "h").groupBy("doc").agg(F.collect_set("item").alias("items"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", min_percent: int = MIN_PERCENT) -> DataFrame:
    """(doc, item, item_shingles, shared, containment) of every document and
    item it contains by at least ``min_percent``."""
    shingles = materialize(item_shingles(items, item_id, item_text), "item-shingles")
    found = materialize(candidates(docs, item_sketches(shingles, min_percent), id_col, text), "candidates")
    texts = docs.select(F.col(id_col).alias("own"), text).join(found, F.col("own").eqNullSafe(F.col("doc"))).drop("own")
    words = _let(texts, w=plain_words(F.col(text))).drop(text)
    both = _let(words, have=F.array_distinct(_windows(F.col("w"), lambda *w: F.concat_ws(" ", *w)))).drop("w")
    pairs = both.select("doc", "have", F.explode("items").alias("of")).join(shingles, F.col("of").eqNullSafe(F.col("item")))
    pairs = pairs.select("doc", "item", F.col("q").cast("long").alias("item_shingles"),
                         F.size(F.array_intersect("have", "shingles")).cast("long").alias("shared"))
    best = pairs.groupBy("doc", "item").agg(F.max("item_shingles").alias("item_shingles"), F.max("shared").alias("shared"))
    best = best.filter(100 * F.col("shared") >= min_percent * F.col("item_shingles"))
    return best.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_shingles, shared and containment: all items
    against all documents, a row for each item found in a document."""
    return contaminated(docs, items).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d),
items AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * shared >= 80 * item_shingles
"""
