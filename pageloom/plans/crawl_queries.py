"""Crawls. The SQL walks every crawl one page at a time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.crawl import crawl_documents as documents_of_crawls
from ..operators.crawl import crawl_page, crawl_site, crawl_summary, explode_results
from ..session import materialize, scratch_path
from ..sources.tables import read_results_json, write_results_json
from .inputs import SQL_SITE, site_jobs, site_pages
from .registry import query

_HEAD = f"WITH RECURSIVE {SQL_SITE}"
_SUMMARY = """summary AS (
  SELECT j.crawl_id, j.max_depth, j.lim, j.cancelled, count(v.seq) FILTER (v.error IS NULL) AS total, count(v.error) AS failures
  FROM jobs j LEFT JOIN visits v USING (crawl_id) GROUP BY ALL),
states AS (
  SELECT *, CASE WHEN cancelled THEN 'cancelled' WHEN failures > 0 AND total = 0 THEN 'failed'
    WHEN failures > 0 THEN 'partial' ELSE 'completed' END AS status FROM summary)"""


def _crawled(spark, folder, **options):
    return crawl_site(site_jobs(spark, folder), site_pages(spark, folder), **options)


@query(f"{_HEAD} SELECT * FROM visits")
def crawl_pages(spark, folder):
    """Pages of every crawl in order."""
    out = _crawled(spark, folder)
    return out.select("crawl_id", F.col("seq").cast("bigint").alias("seq"), "url", F.col("depth").cast("bigint").alias("depth"), "error")


@query(
    f"""{_HEAD}, {_SUMMARY}
SELECT crawl_id, status, total, max_depth, lim, failures,
  md5(coalesce((SELECT string_agg(url, ' ' ORDER BY seq) FROM visits v WHERE v.crawl_id = s.crawl_id AND error IS NULL), '')) AS pages_md5,
  coalesce((SELECT string_agg(url || '=' || error, ' ' ORDER BY seq) FROM visits v WHERE v.crawl_id = s.crawl_id AND error IS NOT NULL), '') AS failed
FROM states s"""
)
def crawl_summaries(spark, folder):
    """Status, counts and nested lists."""
    summary = crawl_summary(_crawled(spark, folder), site_jobs(spark, folder))
    urls = F.array_join(F.transform("data", lambda d: d.url), " ")
    failed = F.array_join(F.transform("failedUrls", lambda d: F.concat(d.url, F.lit("="), d.error)), " ")
    return summary.select(
        "crawl_id",
        "status",
        F.col("total").cast("bigint").alias("total"),
        F.col("maxDepth").cast("bigint").alias("max_depth"),
        F.col("limit").cast("bigint").alias("lim"),
        F.coalesce(F.size("failedUrls"), F.lit(0)).cast("bigint").alias("failures"),
        F.md5(F.coalesce(urls, F.lit("")).cast("binary")).alias("pages_md5"),
        F.coalesce(failed, F.lit("")).alias("failed"),
    )


@query(
    f"""{_HEAD}
SELECT crawl_id, CAST(row_number() OVER (PARTITION BY crawl_id, error IS NULL ORDER BY seq) - 1 AS BIGINT) AS pos, url, error FROM visits"""
)
def crawl_results_exploded(spark, folder):
    """Nested results back to rows."""
    summary = crawl_summary(_crawled(spark, folder), site_jobs(spark, folder))
    return explode_results(summary).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    f"""{_HEAD}, {_SUMMARY},
ok AS (SELECT crawl_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY seq) - 1 AS rank FROM visits WHERE error IS NULL),
batch AS (SELECT crawl_id, count(*) AS returned, string_agg(url, ' ' ORDER BY rank) AS pages FROM ok WHERE rank >= 2 AND rank < 7 GROUP BY 1)
SELECT s.crawl_id, status, total AS pages_crawled, CAST(least(100, floor(total * 100 / lim)) AS BIGINT) AS progress,
  coalesce(returned, 0) AS returned, 2 + coalesce(returned, 0) AS next_offset, pages FROM states s LEFT JOIN batch b USING (crawl_id)"""
)
def crawl_batches(spark, folder):
    """One batch of pages per crawl with progress."""
    jobs, pages = site_jobs(spark, folder), _crawled(spark, folder)
    out = crawl_page(pages, crawl_summary(pages, jobs), offset=2, limit=5)
    big = [F.col(c).cast("bigint").alias(c) for c in ("pages_crawled", "progress", "returned", "next_offset")]
    return out.select("crawl_id", "status", *big, F.array_join("pages", " ").alias("pages"))


@query(
    f"""{_HEAD.replace("AS links,", "AS all_links,", 1).replace("CASE WHEN gone THEN 'empty response' END AS static_error", "list_filter(all_links, lambda u: regexp_matches(u, '/p/') AND NOT regexp_matches(u, '[37]$')) AS links, CASE WHEN gone THEN 'empty response' END AS static_error", 1)} SELECT * FROM visits"""
)
def crawl_with_patterns(spark, folder):
    """Only links that match, none that are excluded."""
    out = _crawled(spark, folder, include_patterns=("/p/",), exclude_patterns=("[37]$",))
    return out.select("crawl_id", F.col("seq").cast("bigint").alias("seq"), "url", F.col("depth").cast("bigint").alias("depth"), "error")


#: A crawl document as it is written.
DOCUMENT = T.StructType([T.StructField("crawl_id", T.StringType(), True), *schemas.CRAWL_RESULT.fields])

SQL_DOCUMENTS = f"""{_HEAD}, {_SUMMARY}
SELECT crawl_id, status, total, max_depth, lim,
  coalesce((SELECT string_agg(v.url || ' ' || md5(s1.page), ' ' ORDER BY seq) FROM visits v
    JOIN site1 s1 ON s1.origin || '/p/' || s1.m = v.url WHERE v.crawl_id = s.crawl_id AND error IS NULL), '') AS pages,
  CASE WHEN total > 0 THEN 'colly' END AS engines, total AS with_markdown,
  (SELECT string_agg(url || '=' || error, ' ' ORDER BY seq) FROM visits v WHERE v.crawl_id = s.crawl_id AND error IS NOT NULL) AS failed
FROM states s"""


def document_rows(documents):
    """What a document holds, page by page."""
    pages = F.transform("data", lambda d: F.concat(d.url, F.lit(" "), F.md5(d.html.cast("binary"))))
    engines = F.array_distinct(F.transform("data", lambda d: F.element_at(d.metadata, "engine")))
    marked = F.size(F.filter("data", lambda d: F.length(d.markdown) > 0))
    big = [F.col(c).cast("bigint").alias(a) for c, a in (("total", "total"), ("maxDepth", "max_depth"), ("limit", "lim"))]
    return documents.select(
        "crawl_id",
        "status",
        *big,
        F.coalesce(F.array_join(pages, " "), F.lit("")).alias("pages"),
        F.nullif(F.array_join(engines, " "), F.lit("")).alias("engines"),
        F.greatest(F.coalesce(marked, F.lit(0)), F.lit(0)).cast("bigint").alias("with_markdown"),
        F.array_join(F.transform("failedUrls", lambda f: F.concat(f.url, F.lit("="), f.error)), " ").alias("failed"),
    )


@query(SQL_DOCUMENTS)
def crawl_documents(spark, folder):
    """A document per crawl with the payload of its pages, written
    as gzip JSON and read back."""
    jobs, pages = site_jobs(spark, folder), site_pages(spark, folder)
    found = materialize(crawl_site(jobs, pages), "crawled")
    path = scratch_path(spark, "crawl-documents")
    write_results_json(documents_of_crawls(found, jobs, pages), path)
    return document_rows(read_results_json(spark, path, DOCUMENT))
