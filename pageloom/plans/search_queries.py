"""Search over documents and pages."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from ..operators.postings import write_search_store
from ..operators.search import documents_corpus, search, search_and_scrape, search_page, shape_provider_results
from ..session import scratch_path
from ..sources.tasks import provider_responses
from .inputs import SQL_MARKED, SQL_SHELL, marked_pages
from .registry import AS_OF, SQL_KEY, load, query


def _tf(*terms):
    return " + ".join(
        f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in terms
    )


_CORPUS = """corpus AS (
  SELECT doc_id AS id, 'Document ' || doc_id AS title, 'https://' || source || '.example.com/doc/' || doc_id AS url,
    left(text, 80) AS description, text, source || '.example.com' AS domain, {tf} AS score FROM documents)"""


def _ranked(terms, where, offset, limit):
    return f"""WITH {_CORPUS.format(tf=_tf(*terms))},
hits AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS n FROM corpus WHERE score > 0 AND {where}),
page AS (SELECT *, n - {offset} AS idx FROM hits WHERE n >= {offset} AND n < {offset} + {limit})"""


def _dated(corpus):
    return corpus.withColumn(
        "ts", F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=(F.col("id") % 480).cast("int"))
    )


@lru_cache(maxsize=4)
def _store_once(spark, folder):
    corpus = _dated(documents_corpus(load(spark, folder, "documents")))
    return write_search_store(corpus, f"search_{uuid.uuid4().hex}", scratch_path(spark, "search-store"))


def document_store(spark, folder):
    """The postings of ``documents``, written once per session and folder."""
    return _store_once(spark, folder)


def _relevance(df):
    return df.withColumn("relevance", F.round("relevance", 6)).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    f"""{_ranked(("the", "que"), "TRUE", 15, 30)}
SELECT idx, title, url, description, 'The Que_' || n AS id, domain, round(1.0::DOUBLE - idx * 0.05::DOUBLE, 6) AS relevance FROM page"""
)
def search_results(spark, folder):
    """One page of ranked results."""
    return _relevance(search(document_store(spark, folder), "The Que", 15, 30))


@query(
    f"""{_ranked(("and",), "(domain IN ('src1.example.com', 'src2.example.com') OR domain LIKE '%.src1.example.com' OR domain LIKE '%.src3.example.com' OR domain = 'src3.example.com') AND NOT domain = 'src2.example.com' AND contains(lower(text), 'the') AND contains(lower(text), 'on')", 0, 100)}
SELECT idx, title, url, description, 'and_' || n AS id, domain, round(1.0::DOUBLE - idx * 0.05::DOUBLE, 6) AS relevance FROM page"""
)
def search_filtered(spark, folder):
    """Domain and text filters, limit clamped to 100."""
    return _relevance(
        search(
            document_store(spark, folder),
            "and",
            -5,
            500,
            include=["src1.example.com", "src2.example.com", "src3.example.com"],
            exclude=["src2.example.com"],
            required=["THE", "on"],
        )
    )


@query(
    """WITH dated AS (
  SELECT doc_id, text, source, TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST(doc_id % 480 AS INTEGER)) AS ts FROM documents),
corpus AS (SELECT *, (length(lower(text)) - length(replace(lower(text), 'der', ''))) // 3 AS score FROM dated
  WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 7 DAY)
SELECT row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS idx, 'Document ' || doc_id AS title FROM corpus WHERE score > 0
ORDER BY score DESC, doc_id LIMIT 10"""
)
def search_fresh(spark, folder):
    """results of the last week."""
    out = search(document_store(spark, folder), "der", max_age=7, as_of=AS_OF)
    return out.select(F.col("idx").cast("bigint").alias("idx"), "title")


@query(
    f"""{_ranked(("die",), "TRUE", 20, 10)}
SELECT 'die' AS query, (SELECT string_agg(url, ' ' ORDER BY idx) FROM page) AS urls,
  30 < 20 + count(*) + CASE WHEN count(*) >= 10 THEN 100 ELSE 0 END AS has_more, CAST(30 AS BIGINT) AS next_offset, count(*) AS n FROM page"""
)
def search_response(spark, folder):
    """A whole response row."""
    out = search_page(document_store(spark, folder), "die", 20, 10)
    return out.select(
        "query",
        F.array_join(F.transform("results", lambda r: r.url), " ").alias("urls"),
        F.col("hasMore").alias("has_more"),
        F.col("nextOffset").cast("bigint").alias("next_offset"),
        F.col("count").cast("bigint").alias("n"),
    )


@query(
    """SELECT 'q' || (doc_id // 10) AS query, doc_id % 10 AS idx, 'T' || doc_id AS title,
  'http://user@' || source || '.example.org:8080/' || doc_id AS url, left(text, 40) AS description,
  'q' || (doc_id // 10) || '_' || ((doc_id // 10) % 7 + doc_id % 10) AS id, source || '.example.org' AS domain,
  round(1.0::DOUBLE - (doc_id % 10) * 0.05::DOUBLE, 6) AS relevance FROM documents"""
)
def provider_results(spark, folder):
    """Stored provider answers, ten hits each, to result rows."""
    n = F.col("doc_id")
    hit = F.struct(
        (n % 10).alias("_n"),
        F.concat(F.lit("T"), n.cast("string")).alias("title"),
        F.concat(F.lit("http://user@"), "source", F.lit(".example.org:8080/"), n.cast("string")).alias("url"),
        F.substring("text", 1, 40).alias("description"),
    )
    group = F.floor(n / 10)
    bodies = (
        load(spark, folder, "documents")
        .groupBy(group.alias("g"))
        .agg(F.array_sort(F.collect_list(hit)).alias("results"))
        .select(
            F.concat(F.lit("q"), F.col("g").cast("string")).alias("query"),
            (F.col("g") % 7).cast("int").alias("offset"),
            F.to_json(F.struct(F.struct("results").alias("web"))).alias("body"),
        )
    )
    good, _ = provider_responses(bodies)
    return _relevance(shape_provider_results(good))


@query(
    f"""WITH {SQL_MARKED}, corpus AS (
  SELECT page_id AS id, url, {_tf("tion", "the").replace("text", "html")} AS score FROM pages),
top AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS idx FROM corpus WHERE score > 0 ORDER BY score DESC, id LIMIT 20),
s AS (SELECT {SQL_KEY} AS page_key, html, row_number() OVER (PARTITION BY {SQL_KEY} ORDER BY page_id) AS rn FROM marked)
SELECT idx, 'Page ' || id AS title, url, CASE WHEN html IS NULL THEN 'page not found' WHEN html = '' THEN 'empty response'
  WHEN {SQL_SHELL} THEN 'dynamic scraper not configured' END AS error
FROM top LEFT JOIN s ON {SQL_KEY} = s.page_key AND s.rn = 1"""
)
def search_then_scrape(spark, folder):
    """Top results and what scraping them gives."""
    corpus = load(spark, folder, "pages").select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        "url",
        F.lit("").alias("description"),
        F.col("html").alias("text"),
    )
    out = search_and_scrape(corpus, marked_pages(spark, folder), "tion the", k=20)
    return out.select(F.col("idx").cast("bigint").alias("idx"), "title", "url", "error")
