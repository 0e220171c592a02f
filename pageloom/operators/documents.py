"""Page metadata, text formats and the extended page heuristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import main_text
from ..functions.html import (
    attribute,
    cleaned_html,
    decode_entities,
    first_element_text,
    meta_content,
    meta_entries,
    plain_text,
    start_tags,
    without_elements,
    without_tags,
)
from ..functions.predicates import (
    EXTENDED_SPA_MARKERS,
    ROOT_MARKERS,
    SSR_MARKERS,
    asks_for_javascript_extended,
    contains_any,
    is_ajax_heavy,
    is_app_shell_extended,
    is_tiny_script_page_extended,
    needs_dynamic,
)
from ..functions.reuse import reuse
from ..functions.urls import host_of

# Metadata fields read from meta elements (column, key).
META_FIELDS = (
    ("description", "description"),
    ("og_title", "og:title"),
    ("og_description", "og:description"),
    ("og_image", "og:image"),
    ("og_url", "og:url"),
    ("og_type", "og:type"),
    ("og_locale", "og:locale"),
    ("og_site_name", "og:site_name"),
    ("twitter_card", "twitter:card"),
    ("twitter_title", "twitter:title"),
    ("twitter_description", "twitter:description"),
    ("twitter_image", "twitter:image"),
    ("twitter_site", "twitter:site"),
    ("twitter_creator", "twitter:creator"),
    ("viewport", "viewport"),
    ("robots", "robots"),
    ("author", "author"),
    ("published_time", "article:published_time"),
    ("modified_time", "article:modified_time"),
    ("section", "article:section"),
    ("generator", "generator"),
)

# Frameworks by generator text, then by markup.
GENERATORS = ("docusaurus", "gatsby", "hugo", "jekyll", "wordpress", "next.js", "nuxt", "hexo", "vuepress", "mkdocs")
FRAMEWORK_MARKERS = (
    ("nextjs", ("__NEXT_DATA__", 'id="__next"')),
    ("nuxt", ("__NUXT__", 'id="__nuxt"')),
    ("gatsby", ('id="___gatsby"',)),
    ("angular", ("ng-version", "<app-root>", "ng-app")),
    ("react", ("data-reactroot", "data-reactid")),
    ("vue", ("data-v-app", "data-vue-meta")),
)

# Sites known to need scripts, and sites known not to.
KNOWN_DYNAMIC = ("twitter.com", "instagram.com", "linkedin.com", "tiktok.com", "discord.com", "reddit.com", "netflix.com")
KNOWN_STATIC = ("example.com", "wikipedia.org", "github.com", "news.ycombinator.com")


def detect_framework(html: Column, generator: Column) -> Column:
    lowered = F.lower(generator)
    out = F.when(F.lit(False), F.lit(""))
    for name in GENERATORS:
        out = out.when(lowered.contains(name), F.lit("nextjs" if name == "next.js" else name))
    for name, markers in FRAMEWORK_MARKERS:
        out = out.when(contains_any(html, markers), F.lit(name))
    return out


def page_metadata(pages: DataFrame) -> DataFrame:
    """One row per page with its head fields; NULL where a page has none."""
    tags = start_tags(F.col("html"), "meta", "link", "html")
    found = pages.select("page_id", "html", tags.alias("_tags"))
    read = found.select("page_id", "html", *_head_entries())
    return read.select("page_id", *_head_fields())


@reuse
def _head_entries() -> tuple[Column, ...]:
    links = F.transform(
        F.filter("_tags", lambda t: t.rlike(r"(?i)^link[\s/]")),
        lambda t: F.struct(F.lower(attribute(t, "rel")).alias("rel"), attribute(t, "href").alias("href")),
    )
    charsets = F.transform(
        F.filter("_tags", lambda t: t.rlike(r"(?i)^meta[\s/]")), lambda t: attribute(t, "charset")
    )
    languages = F.transform(
        F.filter("_tags", lambda t: t.rlike(r"(?i)^html(?:[\s/]|\z)")), lambda t: attribute(t, "lang")
    )
    return (
        meta_entries(F.col("_tags")).alias("_meta"),
        links.alias("_links"),
        F.get(F.filter(charsets, lambda c: c != ""), F.lit(0)).alias("charset"),
        F.nullif(F.get(languages, F.lit(0)), F.lit("")).alias("language"),
    )


@reuse
def _head_fields() -> tuple[Column, ...]:
    def linked(condition):
        return F.nullif(F.get(F.filter("_links", condition), F.lit(0)).getField("href"), F.lit(""))

    tags = F.filter("_meta", lambda m: m.property == "article:tag")
    return (
        F.nullif(first_element_text(F.col("html"), "title"), F.lit("")).alias("title"),
        *[meta_content(F.col("_meta"), key).alias(column) for column, key in META_FIELDS],
        F.transform(tags, lambda m: m.getField("content")).alias("tags"),
        linked(lambda link: link.rel == "canonical").alias("canonical"),
        linked(lambda link: link.rel.rlike(r"(?:^|\s)icon(?:\s|\z)")).alias("favicon"),
        F.col("charset"),
        F.col("language"),
        detect_framework(F.col("html"), meta_content(F.col("_meta"), "generator")).alias("framework"),
    )


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", plain_text(F.col("html")).alias("text"), cleaned_html(F.col("html")).alias("cleaned")
    )


def first_paragraph(pages: DataFrame, size: int = 200) -> DataFrame:
    """Summary fallback: the page's first paragraph with text, cut to size."""
    body = without_elements(F.col("html"), "script", "style", "noscript", "template", "head")
    inner = F.regexp_extract_all(
        body, F.lit(r"(?is)<p(?=[\s/>])[^>]*+(?:>(.*?)(?=</p\s*+>|<p[\s/>]|</(?:div|article|section|main|body)\s*+>|\z)|\z)"), F.lit(1)
    )
    texts = F.transform(
        inner, lambda p: F.trim(F.regexp_replace(decode_entities(without_tags(p)), r"\s+", " "))
    )
    first = F.get(F.filter(texts, lambda t: t != ""), F.lit(0))
    return pages.select("page_id", F.left(first, F.lit(size)).alias("summary"))


def body_text(html: Column) -> Column:
    """Characters a reader could see, white space collapsed."""
    kept = without_elements(html, "script", "style", "noscript", "template", "head")
    return F.trim(F.regexp_replace(decode_entities(without_tags(kept)), r"\s+", " "))


@reuse
def _main_text() -> Column:
    return main_text(F.col("html"))


def page_signals(pages: DataFrame) -> DataFrame:
    """Every signal of the extended and the scored heuristic.

    Text is taken out once per page and shared by all signals below.
    """
    read = pages.select("page_id", "url", "html", body_text(F.col("html")).alias("_text"))
    html, text = F.col("html"), F.col("_text")
    # containers are looked for only where a marker makes them count
    main = F.when(contains_any(html, EXTENDED_SPA_MARKERS), _main_text())
    scripts = F.regexp_count(html, F.lit(r"(?i)<script[\s/>]"))
    elements = F.regexp_count(html, F.lit(r"<[a-zA-Z]"))
    links = F.regexp_count(html, F.lit(r"(?i)<a[\s/>]"))
    signals = {
        "small": F.octet_length(html) < 4096,
        "low_density": F.length(text) < F.lit(0.02) * F.length(html),
        "short_text": F.length(text) < 400,
        "root_marker": contains_any(html, ROOT_MARKERS),
        "script_heavy": scripts * 4 > elements,
        "ssr_marker": contains_any(html, SSR_MARKERS),
        "no_main": ~html.rlike(r"(?i)<(?:main|article)[\s/>]"),
        "link_shell": (links * 2 > elements) & (F.length(text) < 400),
    }
    score = sum((F.col(name).cast("int") for name in signals), F.lit(0))
    return (
        read.select(
            "page_id",
            "url",
            *[c.alias(n) for n, c in signals.items()],
            needs_dynamic(html).alias("needs_dynamic"),
            asks_for_javascript_extended(html).alias("noscript_ext"),
            is_app_shell_extended(html, main).alias("shell_ext"),
            is_tiny_script_page_extended(html, text).alias("tiny_ext"),
            is_ajax_heavy(html).alias("ajax_heavy"),
            F.length(text).alias("text_length"),
        )
        .withColumn("score", score)
        .withColumn(
            "decision",
            F.when(F.col("score") >= 3, F.lit("dynamic")).when(F.col("score") == 2, F.lit("retry")).otherwise(F.lit("static")),
        )
    )


def domain_override(host: Column, decided: Column) -> Column:
    """Known sites settle the mode whatever the page looks like."""

    def listed(domains):
        out = F.lit(False)
        for d in domains:
            out = out | (host == d) | host.endswith("." + d)
        return out

    return F.when(listed(KNOWN_DYNAMIC), F.lit(True)).when(listed(KNOWN_STATIC), F.lit(False)).otherwise(decided)


def host_profile(pages: DataFrame) -> DataFrame:
    """Per host: pages, shares of dynamic, empty and short pages, alerts. Sums
    are combined map-side, so a host with a third of all pages costs no more."""
    text = body_text(F.coalesce(F.col("html"), F.lit("")))
    read = pages.select(
        host_of("url").alias("host"),
        needs_dynamic(F.coalesce(F.col("html"), F.lit(""))).alias("dynamic"),
        F.length(text).alias("n_text"),
    )
    n = F.count(F.lit(1))
    return (
        read.groupBy("host")
        .agg(
            n.alias("pages"),
            F.count_if("dynamic").alias("dynamic_pages"),
            F.count_if(F.col("n_text") == 0).alias("empty_pages"),
            F.count_if(F.col("n_text") < 100).alias("short_pages"),
        )
        .withColumn("alert_dynamic", F.col("dynamic_pages") * 10 > F.col("pages") * 3)
        .withColumn("alert_empty", F.col("empty_pages") * 10 > F.col("pages"))
    )
