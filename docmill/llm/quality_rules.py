"""Quality rules: counted features, then a hashed n-gram log-likelihood ratio.

The method's verdict compares two multinomials over hashed n-grams: that of a
trusted target (documents labelled good) and that of the raw corpus (all
documents). A document's score is the mean, over its n-grams, of the
logarithm of target share over raw share; it is kept when that is at least
``MIN_RATIO``. The same threshold holds for every document, and nothing is
drawn at random. N-grams are character trigrams at the words' ends (whole words
of up to three characters) and the pairs that consecutive ones make, so that
scripts, cases and punctuation tell, whatever the words.

Everything is DataFrame work: the texts are read once to count n-grams (summed
before the shuffle: one row per bucket and task) and once to score them by an
array literal of ``BUCKETS`` values.

Bounds: the trusted target has at most ``MAX_TRUSTED`` labelled rows, those with
the smallest hash of the id (their ids are broadcast); raw counts cover all rows.

Edge cases: null and empty texts have no words and fail the base rule; without
trusted rows every document that passes the base rule is kept. Rows with a
null id are counted in the corpus and judged like any other. Further columns
stay, result columns replace any of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, set_aside

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BUCKETS = 1 << 13
MAX_TRUSTED = 10_000
MIN_RATIO = -0.5
SMOOTH = 1.0
_BLANKS = " \t\n\x0b\x0c\r"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Columns of steps in between; a table's own columns of these names are set aside.
HELPERS = ("qr_words", "qr_grams", "qr_lines", "qr_places", "qr_ends", "qr_buckets")


def _let(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later expressions use many times: the generator keeps
    the optimizer from copying them into each use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def _words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+"))


def _repeat_words() -> Column:
    """Words in 3-word windows found twice or more, from ``qr_grams``, the
    sorted (hash, place) of all windows: neighbours with equal hashes repeat,
    and each repeated place adds the words up to the next one, at most 3."""
    g, n = F.col("qr_grams"), F.size("qr_grams")
    same = F.filter(g, lambda x, i: (F.get(g, i - 1)["h"] == x["h"]) | (F.get(g, i + 1)["h"] == x["h"]))
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(same, lambda x: x["i"])))


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with FEATURES and the array ``qr_words``."""
    docs, back = set_aside(docs.drop(HELPERS[0]), HELPERS[1:])
    t = F.coalesce(F.col(text), F.lit(""))
    docs = _let(docs.drop(*FEATURES), qr_words=_words(F.col(text)))
    w, n = F.col("qr_words"), F.size("qr_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    docs = _let(docs, qr_grams=F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))), qr_lines=lines)
    docs = _let(docs, qr_places=_repeat_words())
    p = F.col("qr_places")
    repeats = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                          F.lit(0).cast("bigint"), lambda a, x: a + x)
    docs = docs.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.octet_length(t) - F.octet_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long"),
        "n_repeat_words": repeats,
    }).drop("qr_grams", "qr_lines", "qr_places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return back(docs.withColumn("base_failed", failed))


def _ends(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(F.right(x, F.lit(3))))


def _buckets(ends: Column) -> Column:
    """Bucket of each end, then of each pair of it and the next one (the last
    is paired with none)."""
    single = F.transform(ends, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    pair = F.transform(ends, lambda x, i: F.pmod(F.xxhash64(x, F.get(ends, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(single, pair)


def trusted_ids(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id) of at most MAX_TRUSTED rows labelled good."""
    good = labels.filter((F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRUSTED)


def ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", id_col: str = "doc_id") -> list[float] | None:
    """log(target share / raw share) of each bucket, from its count in the
    target and the count expected there by its raw share, SMOOTH added to both;
    None without a target."""
    # at most MAX_TRUSTED ids
    ids = F.broadcast(trusted.select(F.col("doc_id").alias("qr_id"), F.lit(1).alias("qr_good")))
    rows = docs.select(F.col(id_col).alias("qr_own"), text).join(ids, F.col("qr_own") == F.col("qr_id"), "left")
    rows = _let(rows.select("qr_good", text), qr_ends=_ends(_words(F.col(text))))
    each = rows.select("qr_good", F.explode(_buckets(F.col("qr_ends"))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("qr_good").alias("good")).collect()
    raw, good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    if not good:
        return None
    out = [0.0] * BUCKETS
    for r in counts:
        out[r["bucket"]] = math.log((r["good"] + SMOOTH) / (r["raw"] * good / raw + SMOOTH))
    return out


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text", id_col: str = "doc_id", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with FEATURES, ``log_ratio`` (null without words) and ``kept``."""
    docs, back = set_aside(docs.drop("log_ratio", "kept"), HELPERS)
    value = ratios(docs, trusted, text, id_col)
    rows = base_features(docs, text)
    if value is None:
        return back(rows.drop("qr_words").withColumn("log_ratio", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed")))
    # folded into one array literal
    table = F.split(F.lit(",".join(f"{v:.9g}" for v in value)), ",").cast("array<double>")
    rows = _let(_let(rows, qr_ends=_ends(F.col("qr_words"))).drop("qr_words"), qr_buckets=_buckets(F.col("qr_ends")))
    total = F.aggregate("qr_buckets", F.lit(0.0), lambda a, b: a + F.get(table, b))
    rows = rows.withColumn("log_ratio", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words")))).drop("qr_ends", "qr_buckets")
    return back(rows.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= min_ratio)))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the features, base_failed and kept of every document."""
    out = judge(docs.select("doc_id", "text"), trusted_ids(labels))
    return out.select("doc_id", *FEATURES, "kept", "log_ratio")
