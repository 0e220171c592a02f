"""Image lists and image bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import attribute, has_attribute, start_tags
from ..functions.media import encode_data_uri, image_mime
from ..functions.predicates import MAX_IMAGE_BYTES, is_tracking_pixel, is_valid_image_url, within_image_size
from ..functions.reuse import reuse
from ..functions.urls import base_of, explode_positions, image_url_with_parts

MAX_TOTAL_BLOB_BYTES = 20 * 1024 * 1024


def image_arrays(pages: DataFrame, keys: list[str], max_images: int = 10, base: str = "url") -> DataFrame:
    """``keys`` and ``images``: preview image first, then card images, then
    content images up to the cap. One row in, one row out, no shuffle."""
    max_images = max_images if max_images > 0 else 10
    out = pages
    for step in (_found_tags(base), _addressed(), _usable(), _urls(), _picked(max_images), _first_of_each()):
        out = out.select(*keys, *step)
    return out


@reuse
def _found_tags(base: str) -> tuple[Column, ...]:
    tags = start_tags(F.col("html"), "meta", "img")
    return (
        base_of(base).alias("_base"),
        F.filter(tags, lambda t: t.rlike(r"(?i)^meta[\s/]")).alias("_meta"),
        F.filter(tags, lambda t: t.rlike(r"(?i)^img[\s/]")).alias("_img"),
    )


def _described(tag: Column, address: str, source: str) -> Column:
    """Attributes of one tag; the address is resolved in a second pass, so
    each attribute is read once."""
    shown = source == "content"
    return F.struct(
        attribute(tag, address).alias("raw"),
        (attribute(tag, "alt") if shown else F.lit("")).alias("alt"),
        (attribute(tag, "title") if shown else F.lit("")).alias("title"),
        F.lit(source).alias("source"),
    )


def _resolved(entries: Column) -> Column:
    return F.transform(
        entries,
        lambda e: F.struct(
            image_url_with_parts(F.col("_base"), e.raw).alias("url"),
            e.alt.alias("alt"),
            e.title.alias("title"),
            e.source.alias("source"),
        ),
    )


@reuse
def _addressed() -> tuple[Column, ...]:
    """``_heads``: the first preview tag and all card tags, if they have a
    content; ``_content``: images with a source."""

    def with_content(found):
        return F.filter(found, lambda t: has_attribute(t, "content"))

    preview = F.slice(F.filter("_meta", lambda t: attribute(t, "property") == "og:image"), 1, 1)
    cards = F.filter(
        "_meta",
        lambda t: (attribute(t, "property") == "twitter:image") | (attribute(t, "name") == "twitter:image"),
    )
    heads = F.concat(
        F.transform(with_content(preview), lambda t: _described(t, "content", "og:image")),
        F.transform(with_content(cards), lambda t: _described(t, "content", "twitter:image")),
    )
    content = F.transform("_img", lambda t: _described(t, "src", "content"))
    return _resolved(heads).alias("_heads"), _resolved(F.filter(content, lambda e: e.raw != "")).alias("_content")


@reuse
def _usable() -> tuple[Column, ...]:
    return (
        F.filter("_heads", lambda i: i.url != "").alias("_heads"),
        F.filter("_content", lambda i: (i.url != "") & ~is_tracking_pixel(i.url)).alias("_content"),
    )


@reuse
def _urls() -> tuple[Column, ...]:
    return (
        F.concat("_heads", "_content").alias("_all"),
        F.array_distinct(F.transform("_heads", lambda i: i.url)).alias("_head_urls"),
        F.transform("_content", lambda i: i.url).alias("_content_urls"),
    )


@reuse
def _picked(max_images: int) -> tuple[Column, ...]:
    room = F.greatest(F.lit(max_images) - F.size("_head_urls"), F.lit(0))
    fresh = F.array_except("_content_urls", "_head_urls")
    return (
        F.col("_all"),
        F.transform("_all", lambda i: i.url).alias("_all_urls"),
        F.concat("_head_urls", F.slice(fresh, F.lit(1), room)).alias("_picked"),
    )


@reuse
def _first_of_each() -> tuple[Column, ...]:
    first = F.transform("_picked", lambda u: F.element_at("_all", F.array_position("_all_urls", u).cast("int")))
    return (first.alias("images"),)


def extract_images(pages: DataFrame, max_images: int = 10, base: str = "url", key: str = "page_id") -> DataFrame:
    """``key, pos, url, alt, title, source`` in priority order."""
    arrays = image_arrays(pages, [key], max_images, base)
    return explode_positions(arrays, [key], "images", "i").select(key, "pos", "i.*")


def encode_images(images: DataFrame, image_bytes: DataFrame) -> DataFrame:
    """Image rows with ``blob, mime_type, size_bytes, error``.

    ``image_bytes(url, status, content_type, content)`` holds one row per URL.
    Each stored image is encoded once, before it is attached to the rows that
    show it; a logo on very many pages is split by AQE's skew join. ``images``
    is read once, so it may be an extraction over raw pages.
    """
    stored = image_bytes.select(
        "url",
        F.col("status").alias("_status"),
        within_image_size(F.col("content")).alias("_fits"),
        F.octet_length("content").cast("bigint").alias("_size"),
        image_mime(F.col("content_type"), F.col("content")).alias("_mime"),
        "content",
    )
    encoded = stored.select(
        "url",
        "_status",
        "_fits",
        "_size",
        "_mime",
        F.when((F.col("_status") == 200) & F.col("_fits"), encode_data_uri(F.col("content"), F.col("_mime"))).alias(
            "_blob"
        ),
    )
    joined = images.join(encoded, "url", "left")
    error = (
        F.when(~is_valid_image_url(F.col("url")), F.concat(F.lit("invalid image URL: "), F.col("url")))
        .when(F.col("_status").isNull(), F.lit("fetch failed: no stored response"))
        .when(F.col("_status") != 200, F.concat(F.lit("fetch returned status "), F.col("_status").cast("string")))
        .when(~F.coalesce("_fits", F.lit(False)), F.lit(f"image exceeded size limit ({MAX_IMAGE_BYTES} bytes max)"))
    )
    ok = F.col("error").isNull()
    return joined.withColumn("error", error).select(
        *images.columns,
        F.when(ok, F.col("_blob")).alias("blob"),
        F.when(ok, F.col("_mime")).alias("mime_type"),
        F.when(ok, F.col("_size")).alias("size_bytes"),
        "error",
    )


def within_blob_budget(
    encoded: DataFrame, key: str = "page_id", budget: int = MAX_TOTAL_BLOB_BYTES
) -> DataFrame:
    """Running blob size per page in priority order and whether it still fits.
    A page has few images, so its window is small."""
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.coalesce("size_bytes", F.lit(0))).over(running)
    return encoded.withColumn("total_bytes", total).withColumn("within_budget", F.col("total_bytes") <= budget)
