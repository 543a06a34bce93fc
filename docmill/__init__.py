"""docmill: documentation archives to Markdown libraries, as Spark jobs.

Layout
------
functions/  Column -> Column helpers (URLs, slugs, text clean-up)
sources/    scans: page archive, sitemaps, manifests, Markdown files, event logs
operators/  HTML node arrays, content selection, Markdown rendering, crawl,
            library queries, job-progress aggregates, skew-safe scans
plans/      the registered queries and their DuckDB oracle SQL
streaming/  Structured Streaming forms of the job/crawl operators
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
