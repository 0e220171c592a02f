"""Request normalisation, result shaping and small projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("static", "dynamic", "smart")
CACHE_TTL = "INTERVAL 7 DAYS"

# Defaults and caps of crawl and search requests.
DEFAULT_DEPTH, MAX_DEPTH = 2, 10
DEFAULT_LIMIT, MAX_LIMIT = 10, 100
FRESHNESS_DAYS = (1, 7, 30)


def resolve_mode(render: Column, mode: Column) -> Column:
    return (
        F.when(F.coalesce(render, F.lit(False)), F.lit("dynamic"))
        .when(mode.isNull() | (mode == ""), F.lit("smart"))
        .otherwise(mode)
    )


def mode_error(mode: Column) -> Column:
    return F.when(~mode.isin(*MODES), F.concat(F.lit("unknown mode: "), mode))


def clamp_depth(depth: Column) -> Column:
    return F.when(F.coalesce(depth, F.lit(0)) <= 0, F.lit(DEFAULT_DEPTH)).otherwise(
        F.least(depth, F.lit(MAX_DEPTH))
    )


def clamp_crawl_limit(limit: Column) -> Column:
    return F.when(F.coalesce(limit, F.lit(0)) <= 0, F.lit(DEFAULT_LIMIT)).otherwise(
        F.least(limit, F.lit(MAX_LIMIT))
    )


def clamp_search_limit(limit: Column) -> Column:
    """Zero means the default; a negative limit passes through unclamped."""
    return F.when(F.coalesce(limit, F.lit(0)) == 0, F.lit(DEFAULT_LIMIT)).otherwise(
        F.least(limit, F.lit(MAX_LIMIT))
    )


def clamp_offset(offset: Column) -> Column:
    return F.greatest(F.coalesce(offset, F.lit(0)), F.lit(0))


def prefer_text(query_value: Column, body_value: Column) -> Column:
    """A non-empty query-string value wins over the body."""
    return F.coalesce(F.nullif(query_value, F.lit("")), body_value)


def prefer_flag(query_value: Column, body_value: Column) -> Column:
    """Only the literal text ``true`` switches a flag on."""
    return (F.coalesce(query_value, F.lit("")) == "true") | F.coalesce(body_value, F.lit(False))


def prefer_int(query_value: Column, body_value: Column) -> Column:
    """Text that is not a whole number is ignored."""
    whole = F.when(query_value.rlike(r"^[+-]?[0-9]+\z"), query_value.try_cast("int"))
    return F.coalesce(whole, body_value)


def metadata_map(as_of: Column, engine: Column) -> Column:
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.create_map(F.lit("scraped_at"), stamp, F.lit("engine"), engine)


def mark_cached(metadata: Column) -> Column:
    kept = F.map_filter(metadata, lambda key, _: key != "cached")
    flag = F.create_map(F.lit("cached"), F.lit("true"))
    return F.when(metadata.isNull(), flag).otherwise(F.map_concat(kept, flag))


def cache_key(url: Column, mode: Column, screenshot: Column, images: Column) -> Column:
    flags = [F.coalesce(c, F.lit(False)).cast("string") for c in (screenshot, images)]
    mode = F.when(mode.isNull() | (mode == ""), F.lit("smart")).otherwise(mode)
    return F.concat_ws(":", F.lit("scrape"), url, mode, *flags)


def omit_empty(column: Column) -> Column:
    """NULL for values a JSON writer with omitted empties would leave out."""
    return F.nullif(column, F.lit(""))


def omit_empty_list(column: Column) -> Column:
    return F.when(F.size(column) > 0, column)


def result_fields(url: Column, markdown: Column, html: Column, metadata: Column, images: Column) -> Column:
    """One result as a struct whose empty optional fields are NULL."""
    return F.struct(
        url.alias("url"),
        F.coalesce(markdown, F.lit("")).alias("markdown"),
        omit_empty(html).alias("html"),
        F.when(F.size(metadata) > 0, metadata).alias("metadata"),
        omit_empty_list(images).alias("images"),
    )


def result_envelope(url: Column, markdown: Column, html: Column, metadata: Column, images: Column) -> Column:
    """JSON of one result without its empty optional fields."""
    return F.to_json(result_fields(url, markdown, html, metadata, images), {"ignoreNullFields": "true"})


def summary_line(url: Column) -> Column:
    return F.format_string("Scraped %s successfully", url)


def preview(text: Column, size: int = 200) -> Column:
    """Leading characters, with dots only when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def freshness_days(max_age: Column, mode: Column) -> Column:
    """Days a result may be old: 1, 7 and 30 are known ages, others mean no
    bound; an unbounded fast search looks one day back."""
    return F.when(max_age.isin(*FRESHNESS_DAYS), max_age).when(
        F.coalesce(mode, F.lit("")) == "fast", F.lit(1)
    )


def estimated_total(offset: Column, returned: Column, limit: Column) -> Column:
    return offset + returned + F.when((returned >= limit) & (limit > 0), F.lit(100)).otherwise(F.lit(0))


def has_more(offset: Column, limit: Column, total: Column) -> Column:
    return (offset + limit) < total


def next_offset(offset: Column, limit: Column) -> Column:
    return offset + limit
