"""The flagship query: the minimum slice of the page pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, page_id
from ..operators.content import analyze_pages, content_text
from ..operators.html_nodes import with_nodes
from ..sources.archive import html_gate
from ..sources.tables import page_archive


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_gate(page_archive(spark, sf_dir)).filter("kept")
    a = analyze_pages(with_nodes(pages.select("url", "html")))
    norm = normalize_url(F.col("url"))
    return a.select(
        page_id(norm).alias("page_id"),
        norm.alias("url"),
        F.col("title"),
        F.length(content_text(F.col("content"), F.col("root"))).alias("content_chars"),
    )
