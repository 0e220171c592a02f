"""Term-frequency search over a corpus table, with shaping and paging."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.requests import (
    DEFAULT_LIMIT,
    FRESHNESS_DAYS,
    MAX_LIMIT,
    estimated_total,
    has_more,
    preview,
)
from ..functions.urls import _let, hostname
from ..session import materialize, materialize_counted
from .postings import SearchStore, scores, shown

# A corpus has: id, title, url, description, text, domain and optionally ts.


def documents_corpus(documents: DataFrame) -> DataFrame:
    """The ``documents`` table as a corpus; its source stands for the site."""
    site = F.concat(F.col("source"), F.lit(".example.com"))
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("https://"), site, F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring("text", 1, 80).alias("description"),
        "text",
        site.alias("domain"),
    )


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def term_frequency(lowered: Column, terms: list[str]) -> Column:
    """Occurrences of all terms in lower-case text."""
    counts = [
        F.floor((F.length(lowered) - F.length(F.replace(lowered, F.lit(t), F.lit("")))) / F.lit(len(t)))
        for t in terms
    ]
    return reduce(add, counts).cast("bigint")


def in_domains(domain: Column, domains) -> Column:
    """The domain itself or one below it."""
    return reduce(or_, [(domain == d) | domain.endswith("." + d) for d in domains])


def effective_days(max_age: int | None, mode: str | None) -> int | None:
    if max_age in FRESHNESS_DAYS:
        return max_age
    return 1 if mode == "fast" else None


def _row_filters(include, exclude, max_age, mode, as_of, dated: bool) -> list[Column]:
    """Conditions on ``domain`` and ``ts``."""
    found = []
    if include:
        found.append(in_domains(F.col("domain"), include))
    if exclude:
        found.append(~in_domains(F.col("domain"), exclude))
    days = effective_days(max_age, mode)
    if days is not None and dated:
        if as_of is None:
            raise ValueError("as_of is needed to bound the age of results")
        found.append(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return found


def ranked(
    corpus: DataFrame,
    query: str,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    required: list[str] | None = None,
    max_age: int | None = None,
    mode: str | None = None,
    as_of: str | None = None,
    scorer: Column | None = None,
) -> DataFrame:
    """Matching corpus rows with ``score``. Cheap column filters come before
    any text is looked at. ``scorer`` replaces the term frequency."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("query parameter is required")
    rows = corpus
    for condition in _row_filters(include, exclude, max_age, mode, as_of, "ts" in corpus.columns):
        rows = rows.filter(condition)
    if required:
        phrases = [phrase.lower() for phrase in required]
        rows = rows.filter(
            _let(F.lower("text"), lambda text: reduce(and_, [text.contains(p) for p in phrases]))
        )
    if scorer is None:
        # Bound once: the filter below lowers each text a single time.
        scorer = _let(F.lower("text"), lambda text: term_frequency(text, terms))
    return rows.withColumn("score", scorer).filter(F.col("score") > 0)


def page_bounds(offset: int | None, limit: int | None) -> tuple[int, int]:
    offset = max(offset or 0, 0)
    limit = DEFAULT_LIMIT if not limit else min(limit, MAX_LIMIT)
    if limit < 0:
        raise ValueError("limit must not be negative")
    return offset, limit


#: Rows that a task may order for a page, and rows of a range beyond that.
NEAR_ROWS, RANGE_ROWS = 10_000, 50_000


def page_of(scored: DataFrame, offset: int, limit: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``scored(id, score)``, by score then id.

    Near pages are a top-k per task. For far ones the rows are dealt into ranges
    of the order; their counts, one per range, tell which ranges hold the page,
    and only these are ordered.
    """
    order = (F.desc("score"), F.asc("id"))
    if offset + limit <= NEAR_ROWS:
        return scored.orderBy(*order).offset(offset).limit(limit)
    scored, total = materialize_counted(scored, "search-scores")
    if offset >= total:
        return scored.limit(0)
    ranged = scored.repartitionByRange(-(-total // range_rows), *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "search-ranges")
    before, first, kept = 0, 0, []
    for row in sorted(ranged.groupBy("_range").count().collect()):
        if before + row["count"] > offset and before < offset + limit:
            first = first if kept else before
            kept.append(row["_range"])
        before += row["count"]
    return ranged.filter(F.col("_range").isin(kept)).drop("_range").orderBy(*order).offset(offset - first).limit(limit)


def _stored_scores(store: SearchStore, query: str, include, exclude, required, max_age, mode, as_of) -> DataFrame:
    terms = query_terms(query)
    if not terms:
        raise ValueError("query parameter is required")
    where = _row_filters(include, exclude, max_age, mode, as_of, store.dated)
    phrases = [phrase.lower() for phrase in required or []]
    if any(phrase.split() != [phrase] for phrase in phrases):
        raise ValueError("a store holds words: required phrases with white space need the texts, search the corpus")
    return scores(store, terms, phrases, reduce(and_, where) if where else None)


def search(corpus: DataFrame | SearchStore, query: str, offset: int = 0, limit: int = 10, **filters) -> DataFrame:
    """One page of results: ``idx, title, url, description, id, domain,
    relevance``. Only ids and scores are ordered; the few rows of the page are
    then joined with what they show.

    Over a ``SearchStore`` the query reads its own words. Over a corpus it reads
    all texts; that also serves a ``scorer`` and phrases of several words.
    """
    offset, limit = page_bounds(offset, limit)
    if isinstance(corpus, SearchStore):
        options = {"include": None, "exclude": None, "required": None, "max_age": None, "mode": None, "as_of": None}
        scored = _stored_scores(corpus, query, **{**options, **filters})
    else:
        scored = ranked(corpus, query, **filters).select("id", "score")
    top = page_of(scored, offset, limit)
    # At most 100 rows are left, so one task may number them.
    idx = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1
    page = top.select("id", "score", idx.alias("idx"))
    if isinstance(corpus, SearchStore):
        rows = shown(corpus, page)
    else:
        rows = corpus.select("id", "title", "url", "description").join(F.broadcast(page), "id")
    return rows.select(
        "idx",
        "title",
        "url",
        "description",
        F.concat(F.lit(f"{query}_"), (F.col("idx") + offset).cast("string")).alias("id"),
        hostname(F.col("url")).alias("domain"),
        (F.lit(1.0) - F.col("idx") * F.lit(0.05)).alias("relevance"),
    )


def search_page(corpus: DataFrame | SearchStore, query: str, offset: int = 0, limit: int = 10, **filters) -> DataFrame:
    """One response row: results in order, count and paging fields."""
    offset, limit = page_bounds(offset, limit)
    rows = search(corpus, query, offset, limit, **filters)
    fields = F.struct("idx", "title", "url", "description", "id", "domain", "relevance")
    grouped = rows.agg(F.array_sort(F.collect_list(fields)).alias("r"), F.count(F.lit(1)).cast("int").alias("count"))
    total = estimated_total(F.lit(offset), F.col("count"), F.lit(limit))
    return grouped.select(
        F.lit(query).alias("query"),
        F.transform("r", lambda r: r.dropFields("idx")).alias("results"),
        has_more(F.lit(offset), F.lit(limit), total).alias("hasMore"),
        F.lit(offset + limit).alias("nextOffset"),
        "count",
    )


def shape_provider_results(responses: DataFrame, query: str = "query", offset: str = "offset") -> DataFrame:
    """Rows of stored provider responses (``web.results``) as search results."""
    hits = responses.select(query, offset, F.posexplode("response.web.results").alias("idx", "hit"))
    return hits.select(
        F.col(query).alias("query"),
        "idx",
        F.col("hit.title").alias("title"),
        F.col("hit.url").alias("url"),
        F.col("hit.description").alias("description"),
        F.format_string("%s_%d", F.col(query), F.col(offset) + F.col("idx")).alias("id"),
        hostname(F.col("hit.url")).alias("domain"),
        (F.lit(1.0) - F.col("idx") * F.lit(0.05)).alias("relevance"),
    )


def search_and_scrape(
    corpus: DataFrame, pages: DataFrame, query: str, k: int = 3, rendered: DataFrame | None = None, **options
) -> DataFrame:
    """Top results with a preview of their page; a page that fails keeps its
    row and its error."""
    from .scrape import scrape

    top = search(corpus, query, 0, k)
    requests = top.select(F.col("id").alias("request_id"), "idx", "title", "url")
    result = scrape(requests, pages, rendered, with_images=False, **options)
    return result.select("idx", "title", "url", "error", preview(F.col("markdown")).alias("preview"))
