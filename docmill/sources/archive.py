"""SRC-1: page archive scan with the HTML gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def html_gate(archive: DataFrame) -> DataFrame:
    """Adds ``kept`` and ``reason``.

    A response is kept when it is a success (2xx, after redirects) and
    its content type *contains* ``text/html`` (case-sensitive). Otherwise
    reason ``error`` (failed fetch / any other status / no body) or ``not_html``,
    checked in that order. The requested URL stays the identity.
    """
    ok = F.col("status").isNotNull() & F.col("status").between(200, 299) & F.col("html").isNotNull()
    html = F.coalesce(F.col("content_type"), F.lit("")).contains("text/html")
    reason = F.when(~ok, F.lit("error")).when(~html, F.lit("not_html"))
    return archive.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def read_archive(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Archive table from files; missing status / content type default to a
    successful HTML response."""
    df = spark.read.format(fmt).load(path)
    cols = set(df.columns)
    if "status" not in cols:
        df = df.withColumn("status", F.lit(200))
    if "content_type" not in cols:
        df = df.withColumn("content_type", F.lit("text/html; charset=utf-8"))
    return df
