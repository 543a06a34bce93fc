"""Cleaning of a corpus in five stages, each on all that the one before kept.

Every stage calls one operator of ``docmill.llm``; its result is written as
Parquet to the shared folder and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``. Null and empty texts fail the
quality rules, so an empty table passes through all stages as an empty table.
Rows are judged one by one: those that share a doc_id or have none are documents of
their own (of linked ones without an id, the one with the smallest digest stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import byte_bpe, decontamination, line_dedup, ngram_join, quality_rules
from docmill.llm.common import materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose n-grams are no less likely
    under the trusted target than the threshold asks."""
    judged = quality_rules.judge(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))
    return judged.filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no word is left goes too."""
    out = line_dedup.dedup_lines(docs)
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def _numbered(docs: DataFrame):
    """``docs`` with a doc_id of its own for each row, in the order of the old
    ones (null first), and a function that puts the old ones back. A table
    whose ids are all there and differ is left as it is."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs, lambda out: out
    old = "own_id"
    while old in [c.lower() for c in docs.columns]:
        old += "_"
    by = [F.asc_nulls_first("doc_id"), F.md5("text")]
    rows = docs.withColumn(old, F.col("doc_id")).repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = materialize(rows.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    return numbered, lambda out: out.withColumn("doc_id", F.col(old)).drop(old)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    rows, back = _numbered(docs)
    linked = materialize(ngram_join.link_documents(rows, ngram_join.NEAR_N, ngram_join.NEAR_PERCENT).filter("component_id <> doc_id").select("doc_id"), "near-duplicates")
    gone = F.broadcast(linked) if linked.count() <= ngram_join.MAX_BROADCAST else linked
    return back(rows.join(gone, "doc_id", "left_anti")).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    rows, back = _numbered(docs)
    found = decontamination.contaminated(rows, read(spark, sf_dir, "benchmark"))
    gone = materialize(found.select(F.col("doc").alias("doc_id")).distinct(), "contaminated")
    return back(rows.join(gone, "doc_id", "left_anti")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and whether they decode to it."""
    path, pattern = byte_bpe.vocabulary()
    coded = byte_bpe.encode(docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text"), path, pattern)
    both = byte_bpe.decode(coded, path, pattern)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("exact"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", benchmarks), ("byte-level BPE", tokens)]

#: The quality rules' hashed likelihood ratio has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline", name.replace(" ", "-"))
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
