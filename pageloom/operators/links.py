"""Link tables. All work on one page happens inside its own row, so a corpus
is turned into links without any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import (
    _COMMENT,
    _TAG_BODY,
    OTHER_TAGS,
    RAW_TEXT_ELEMENTS,
    _raw_text,
    attribute,
    decode_entities,
    start_tags,
    without_tags,
)
from ..functions.reuse import reuse
from ..functions.urls import (
    base_of,
    explode_positions,
    host_of,
    hostname,
    is_resource_file,
    is_skipped_href,
    key_of,
    normalize_url,
    resolve_with_parts,
    url_path,
)
from .pages import DYNAMIC, STATIC, with_page_key


def _decoded_path(url: Column) -> Column:
    path = url_path(url)
    return F.when(
        url.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    ).otherwise(path)


def link_arrays(pages: DataFrame, keys: list[str], base: str = "url", allowed_host: str | None = None) -> DataFrame:
    """``keys`` and ``links``: followable links of each page, first occurrence
    order, without fragments and duplicates."""
    host = F.col(allowed_host) if allowed_host else host_of(base)
    read = pages.select(*keys, base_of(base).alias("_base"), host.alias("_host"), _hrefs().alias("_hrefs"))
    return read.select(*keys, _followed().alias("links"))


@reuse
def _hrefs() -> Column:
    return F.transform(start_tags(F.col("html"), "a"), lambda tag: attribute(tag, "href"))


@reuse
def _followed() -> Column:
    """Links left of ``_hrefs`` on a page with ``_base`` and ``_host``."""
    hrefs = F.array_distinct(F.filter("_hrefs", lambda h: ~is_skipped_href(h)))
    resolved = F.transform(hrefs, lambda h: resolve_with_parts(F.col("_base"), h))
    followed = F.filter(
        resolved,
        lambda u: u.isNotNull() & (hostname(u) == F.col("_host")) & ~is_resource_file(_decoded_path(u)),
    )
    return F.array_distinct(followed)


def extract_links(
    pages: DataFrame, base: str = "url", allowed_host: str | None = None, keys: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """One row per followable link: ``keys, page_key, pos, link, link_norm``."""
    arrays = link_arrays(with_page_key(pages), [*keys, "page_key"], base, allowed_host)
    rows = explode_positions(arrays, [*keys, "page_key"], "links", "link")
    return rows.withColumn("link_norm", key_of("link"))


@reuse
def _norms() -> Column:
    return F.array_distinct(F.transform("links", lambda u: normalize_url(u)))


def page_links(pages: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``norms``: the keys of the pages that a crawl may go on to, in
    link order; links that differ in fragment or last slash are one."""
    return link_arrays(pages, keys, base).select(*keys, _norms().alias("norms"))


def crawl_links(pages: DataFrame | None, rendered: DataFrame | None = None) -> DataFrame:
    """Links a crawl follows: ``page_key, page_id, engine, pos, link_norm``.

    A crawled page is known by its key, so links are resolved against that.
    Build it once per corpus and keep it; crawls then never touch HTML.
    """
    from .pages import _with_id

    parts = []
    for table, engine in ((pages, STATIC), (rendered, DYNAMIC)):
        if table is None:
            continue
        keyed = with_page_key(_with_id(table) if engine == DYNAMIC else table).withColumn("engine", F.lit(engine))
        keys = ["page_key", "page_id", "engine"]
        parts.append(explode_positions(page_links(keyed, "page_key", keys), keys, "norms", "link_norm"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def link_details(pages: DataFrame, base: str = "url") -> DataFrame:
    """Every anchor with its text: ``page_id, pos, href, text, rel, is_internal``."""
    read = pages.select(
        "page_id", base_of(base).alias("_base"), host_of(base).alias("_host"), _anchors().alias("_anchors")
    )
    kept = read.select("page_id", "_host", _described_links().alias("links"))
    rows = explode_positions(kept, ["page_id", "_host"], "links", "a")
    return rows.select(
        "page_id",
        F.col("a.pos").alias("pos"),
        F.col("a.href").alias("href"),
        F.col("a.text").alias("text"),
        F.col("a.rel").alias("rel"),
        (host_of("a.href") == F.col("_host")).alias("is_internal"),
    )


@reuse
def _anchors() -> Column:
    anchor = rf"<(a(?=[\s/>]){_TAG_BODY}>.*?)(?:</a\s*>|(?=<a[\s>])|\z)"
    pattern = f"(?is){_COMMENT}|{_raw_text(RAW_TEXT_ELEMENTS, 1)}|{anchor}|{OTHER_TAGS}"
    return F.filter(F.regexp_extract_all("html", F.lit(pattern), F.lit(2)), lambda a: a != "")


@reuse
def _described_links() -> Column:
    read_tags = F.transform(
        "_anchors",
        lambda a: F.struct(
            F.regexp_extract(a, rf"(?is)^({_TAG_BODY})>", 1).alias("tag"),
            without_tags(F.regexp_replace(a, rf"(?is)^{_TAG_BODY}>", "")).alias("inner"),
        ),
    )
    described = F.transform(
        read_tags,
        lambda a, pos: F.struct(
            pos.alias("pos"),
            attribute(a.tag, "href").alias("raw"),
            attribute(a.tag, "rel").alias("rel"),
            F.trim(F.regexp_replace(decode_entities(a.inner), r"\s+", " ")).alias("text"),
        ),
    )
    resolved = F.transform(
        F.filter(described, lambda a: ~is_skipped_href(a.raw)),
        lambda a: F.struct(
            a.pos.alias("pos"),
            resolve_with_parts(F.col("_base"), a.raw, keep_fragment=True).alias("href"),
            a.text.alias("text"),
            a.rel.alias("rel"),
        ),
    )
    return F.filter(resolved, lambda a: a.href.isNotNull())
