"""Scrape requests against stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import markdown
from ..functions.requests import cache_key, mark_cached, metadata_map, resolve_mode
from ..functions.urls import key_of
from ..session import bound_batches, materialize
from .cache import match_cache, with_results
from .images import image_arrays
from .pages import ENGINE_NAMES, asked_pages, choice_for, chosen_page_id, documents_of, missing_errors, page_index

IMAGE_LIST = "array<struct<url:string,alt:string,title:string,source:string>>"
RESULT_COLUMNS = ("url", "markdown", "html", "metadata", "images")


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Mode resolved, flags filled, page key and cache key added."""

    def flag(name):
        return F.coalesce(F.col(name), F.lit(False)) if name in requests.columns else F.lit(False)

    mode = F.col("mode") if "mode" in requests.columns else F.lit(None).cast("string")
    return requests.withColumns(
        {
            "mode": resolve_mode(flag("render"), mode),
            "screenshot": flag("screenshot"),
            "images": flag("images"),
            "page_key": key_of("url"),
        }
    ).withColumn(
        "cache_key", cache_key(F.col("url"), F.col("mode"), F.col("screenshot"), F.col("images"))
    )


def split_requests(requests: DataFrame, field: str = "url") -> tuple[DataFrame, DataFrame]:
    """Requests with their required field, and the rejected rest."""
    present = F.coalesce(F.col(field), F.lit("")) != ""
    rejected = requests.filter(~present).withColumn(
        "error", F.lit("URL is required" if field == "url" else f"{field} parameter is required")
    )
    return requests.filter(present), rejected


def decide(
    requests: DataFrame, pages: DataFrame | None, rendered: DataFrame | None, index: DataFrame | None = None
) -> DataFrame:
    """Adds ``engine, error, cacheable, page_id``: which snapshot answers each
    request. Works on the narrow index only; pass a stored one if there is one."""
    index = page_index(pages, rendered) if index is None else index
    static_missing, dynamic_missing = missing_errors(pages, rendered)
    found = requests.join(index, "page_key", "left")
    return found.withColumn("_choice", choice_for(static_missing, dynamic_missing)).select(
        *requests.columns,
        F.col("_choice.engine").alias("engine"),
        F.col("_choice.error").alias("error"),
        F.col("_choice.cacheable").alias("cacheable"),
        chosen_page_id().alias("page_id"),
    )


def scrape(
    requests: DataFrame,
    pages: DataFrame | None,
    rendered: DataFrame | None = None,
    cache: DataFrame | None = None,
    as_of: str = "1970-01-01 00:00:00",
    index: DataFrame | None = None,
    max_images: int = 10,
    with_images: bool = True,
) -> DataFrame:
    """One result or error per request.

    ``requests(request_id, url, render, mode, screenshot, images[, ts])``;
    rows found in ``cache`` are answered from it. Every needed document is
    converted once; decision and document are attached in the one join that
    moves requests, where AQE's skew join splits pages that very many requests
    ask for.

    Adds ``engine, error, cacheable, cached`` and the result columns.
    """
    bound_batches(requests.sparkSession)
    asked = normalize_requests(requests)
    at = F.col("ts") if "ts" in requests.columns else F.lit(as_of).cast("timestamp")
    open_requests = asked
    hits = None
    if cache is not None:
        # The match is narrow; stored results are attached to hits alone.
        matched = materialize(match_cache(asked.withColumn("asked_at", at), cache, "asked_at").drop("asked_at"), "cache-matches")
        hits = with_results(matched.filter(F.col("cached_at").isNotNull()), cache)
        open_requests = matched.filter(F.col("cached_at").isNull()).drop("cached_at")
    # What is asked of a page has few forms, so deciding on distinct forms keeps
    # a page that very many requests want from gathering in one task. They are
    # stored, as the page side asks for them again and again.
    forms = materialize(open_requests.select("page_key", "mode", "screenshot").distinct(), "asked-forms")
    keys = forms.select("page_key")
    pages, rendered = asked_pages(pages, keys), asked_pages(rendered, keys)
    decided = decide(forms, pages, rendered, index)
    needed = decided.filter(F.col("error").isNull()).select("page_key", "engine", "page_id").distinct()
    documents = documents_of(needed, pages, rendered)
    converted = documents.withColumn("markdown", markdown(F.col("html")))
    if with_images:
        fields = ["page_key", "engine", "html", "markdown"]
        converted = image_arrays(converted, fields, max_images, base="page_key").withColumnRenamed(
            "images", "page_images"
        )
    else:
        converted = converted.withColumn("page_images", F.lit(None).cast(IMAGE_LIST))
    # A form's document is copied only to forms that some request has.
    answers = decided.drop("page_id").join(converted, ["page_key", "engine"], "left")
    joined = open_requests.join(answers, ["page_key", "mode", "screenshot"], "left")
    engine_name = F.create_map(*[F.lit(x) for pair in ENGINE_NAMES.items() for x in pair])
    ok = F.col("error").isNull()
    fresh = joined.select(
        *[c for c in asked.columns if c not in ("page_key",)],
        "engine",
        "error",
        "cacheable",
        F.lit(False).alias("cached"),
        "markdown",
        "html",
        F.when(ok, metadata_map(at, F.try_element_at(engine_name, F.col("engine")))).alias("metadata"),
        F.when(ok & F.col("images"), F.col("page_images")).alias("page_images"),
    )
    if hits is None:
        return fresh
    from_cache = hits.select(
        *[c for c in asked.columns if c not in ("page_key",)],
        F.lit(None).cast("string").alias("engine"),
        F.lit(None).cast("string").alias("error"),
        F.lit(False).alias("cacheable"),
        F.lit(True).alias("cached"),
        F.col("result.markdown").alias("markdown"),
        F.col("result.html").alias("html"),
        mark_cached(F.col("result.metadata")).alias("metadata"),
        F.col("result.page_images").alias("page_images"),
    )
    return fresh.unionByName(from_cache)


def cache_rows(results: DataFrame, at) -> DataFrame:
    """Entries to append to the cache after a ``scrape``."""
    return results.filter(F.col("cacheable")).select(
        "cache_key",
        at.alias("cached_at"),
        F.struct("url", "markdown", "html", "metadata", "page_images").alias("result"),
    )
