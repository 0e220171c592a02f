"""Page snapshots: keys, the narrow page index, engine choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import needs_dynamic
from ..functions.requests import mode_error
from ..functions.reuse import reuse
from ..functions.urls import key_of

# Engine names written into result metadata.
ENGINE_NAMES = {"static": "colly", "dynamic": "chromedp"}

STATIC, DYNAMIC = "static", "dynamic"
NOT_FOUND = "page not found"


def with_page_key(pages: DataFrame) -> DataFrame:
    """Pages with their key; a stored key is kept, as the store is bucketed by it."""
    return pages if "page_key" in pages.columns else pages.withColumn("page_key", key_of("url"))


def asked_pages(pages: DataFrame | None, keys: DataFrame) -> DataFrame | None:
    """The snapshots of the keys in ``keys(page_key)``: what is not asked for is
    dropped before its HTML is looked at. Over a page store only keys move."""
    return None if pages is None else with_page_key(pages).join(keys.distinct(), "page_key", "left_semi")


def _with_id(rendered: DataFrame) -> DataFrame:
    """Rendered snapshots need no id of their own; a content hash orders them."""
    if "error" not in rendered.columns:
        rendered = rendered.withColumn("error", F.lit(None).cast("string"))
    if "page_id" in rendered.columns:
        return rendered
    return rendered.withColumn("page_id", F.xxhash64("url", "html", "error"))


@reuse
def _static_columns() -> tuple[Column, ...]:
    html = F.coalesce(F.col("html"), F.lit(""))
    return (
        F.col("page_key"),
        F.col("page_id").alias("static_id"),
        F.when(html == "", F.lit("empty response")).alias("static_error"),
        needs_dynamic(html).alias("needs_dynamic"),
    )


def _static_flags(pages: DataFrame) -> DataFrame:
    return with_page_key(pages).select(*_static_columns())


def _dynamic_error() -> Column:
    failed = F.when(F.col("error").isNotNull() & (F.col("error") != ""), F.col("error"))
    return failed.when(F.coalesce(F.col("html"), F.lit("")) == "", F.lit("empty response from browser"))


def _dynamic_flags(rendered: DataFrame) -> DataFrame:
    return with_page_key(_with_id(rendered)).select(
        "page_key", F.col("page_id").alias("dynamic_id"), _dynamic_error().alias("dynamic_error")
    )


def page_index(pages: DataFrame | None, rendered: DataFrame | None = None) -> DataFrame:
    """One narrow row per page key: which snapshot stands for it and how each
    engine fares. HTML is read once and never shuffled; several snapshots of
    one key are settled by map-side combined minima (lowest id wins), so a key
    with very many copies costs one row per task.

    Missing relations stand for engines that are not configured.
    """
    return index_of(
        None if pages is None else _static_flags(pages), None if rendered is None else _dynamic_flags(rendered)
    )


def index_of(static: DataFrame | None, dynamic: DataFrame | None) -> DataFrame:
    """The page index from what was read of each snapshot: ``static(page_key,
    static_id, static_error, needs_dynamic)``, ``dynamic(page_key, dynamic_id,
    dynamic_error)``."""
    if static is not None:
        first = F.min(F.struct("static_id", "static_error", "needs_dynamic"))
        static = static.groupBy("page_key").agg(first.alias("s"), F.lit(True).alias("has_static"))
        static = static.select("page_key", "s.*", "has_static")
    if dynamic is not None:
        first = F.min(F.struct("dynamic_id", "dynamic_error"))
        dynamic = dynamic.groupBy("page_key").agg(first.alias("d"), F.lit(True).alias("has_dynamic"))
        dynamic = dynamic.select("page_key", "d.*", "has_dynamic")
    if static is None and dynamic is None:
        raise ValueError("a page table is needed")
    if dynamic is None:
        return static.withColumns(
            {
                "dynamic_id": F.lit(None).cast("bigint"),
                "dynamic_error": F.lit("dynamic scraper not configured"),
                "has_dynamic": F.lit(False),
                "has_static": F.lit(True),
            }
        )
    if static is None:
        return dynamic.withColumns(
            {
                "static_id": F.lit(None).cast("bigint"),
                "static_error": F.lit("static scraper not configured"),
                "needs_dynamic": F.lit(False),
                "has_static": F.lit(False),
            }
        )
    both = static.join(dynamic, "page_key", "full")
    return both.withColumns(
        {
            "static_error": F.when(F.col("has_static").isNull(), F.lit(NOT_FOUND)).otherwise(F.col("static_error")),
            "dynamic_error": F.when(F.col("has_dynamic").isNull(), F.lit(NOT_FOUND)).otherwise(
                F.col("dynamic_error")
            ),
            "needs_dynamic": F.coalesce(F.col("needs_dynamic"), F.lit(False)),
            "has_static": F.coalesce(F.col("has_static"), F.lit(False)),
            "has_dynamic": F.coalesce(F.col("has_dynamic"), F.lit(False)),
        }
    )


@reuse
def choice_for(static_missing: str, dynamic_missing: str) -> Column:
    """``choose_engine`` for rows left-joined with a page index; a row without
    index entry gets the missing errors."""
    absent = F.col("has_static").isNull() & F.col("has_dynamic").isNull()
    return choose_engine(
        F.col("mode"),
        F.col("screenshot"),
        F.when(absent, F.lit(static_missing)).otherwise(F.col("static_error")),
        F.coalesce(F.col("needs_dynamic"), F.lit(False)),
        F.when(absent, F.lit(dynamic_missing)).otherwise(F.col("dynamic_error")),
    )


@reuse
def chosen_page_id() -> Column:
    engine = F.col("_choice.engine")
    return F.when(engine == STATIC, F.col("static_id")).when(engine == DYNAMIC, F.col("dynamic_id"))


def missing_errors(pages: DataFrame | None, rendered: DataFrame | None) -> tuple[str, str]:
    """Errors of the two engines for a URL that is in no table."""
    return (
        NOT_FOUND if pages is not None else "static scraper not configured",
        NOT_FOUND if rendered is not None else "dynamic scraper not configured",
    )


def choose_engine(
    mode: Column, screenshot: Column, static_error: Column, shell: Column, dynamic_error: Column
) -> Column:
    """``struct(engine, error, cacheable)`` for one request.

    ``static`` and ``dynamic`` run their engine. ``smart`` runs the dynamic one
    when a screenshot is wanted (never cached) or when the static page is a
    script shell; a static failure is final, and so is a dynamic one.
    """
    smart = mode == "smart"
    early = smart & F.coalesce(screenshot, F.lit(False))
    escalated = smart & ~early & static_error.isNull() & shell
    dynamic = (mode == DYNAMIC) | early | escalated
    unknown = mode_error(mode)
    engine = F.when(unknown.isNotNull(), F.lit(None)).when(dynamic, F.lit(DYNAMIC)).otherwise(F.lit(STATIC))
    error = (
        F.when(unknown.isNotNull(), unknown).when(dynamic, dynamic_error).otherwise(static_error)
    )
    return F.struct(
        engine.alias("engine"), error.alias("error"), (error.isNull() & ~early).alias("cacheable")
    )


def documents_of(needed: DataFrame, pages: DataFrame | None, rendered: DataFrame | None) -> DataFrame:
    """HTML of the wanted snapshots: ``needed(page_key, engine, page_id)``.

    A semi join, so each document is read and carried once however many
    requests ask for it.
    """
    parts = []
    if pages is not None:
        want = needed.filter(F.col("engine") == STATIC).select("page_key", "page_id")
        parts.append(
            with_page_key(pages)
            .join(want.withColumnRenamed("page_id", "_wanted"), "page_key")
            .filter(F.col("page_id") == F.col("_wanted"))
            .select("page_key", F.lit(STATIC).alias("engine"), "html")
        )
    if rendered is not None:
        want = needed.filter(F.col("engine") == DYNAMIC).select("page_key", "page_id")
        found = with_page_key(_with_id(rendered)).join(want, ["page_key", "page_id"], "left_semi")
        if "page_id" not in rendered.columns:
            found = found.dropDuplicates(["page_key"])
        parts.append(found.select("page_key", F.lit(DYNAMIC).alias("engine"), "html"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lookup_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """URL rows with the HTML of their snapshot, or an error."""
    asked = urls.withColumn("page_key", key_of("url"))
    pages = asked_pages(pages, asked.select("page_key"))
    index = page_index(pages).select("page_key", "static_id", "static_error", "has_static")
    found = asked.join(index, "page_key", "left").withColumn(
        "error", F.when(F.col("has_static").isNull(), F.lit(NOT_FOUND)).otherwise(F.col("static_error"))
    )
    body = with_page_key(pages).select("page_key", F.col("page_id").alias("static_id"), "html")
    return found.join(body, ["page_key", "static_id"], "left").drop("static_id", "static_error", "has_static")
