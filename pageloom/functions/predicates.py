"""Page and image predicates, all native boolean expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds in bytes, and the marker texts looked for.
SHELL_BYTES = 5000
TINY_BYTES = 2000
MAX_IMAGE_BYTES = 5 * 1024 * 1024
NOSCRIPT_PHRASES = ("enable javascript", "need javascript", "requires javascript")
SPA_MARKERS = (
    'id="root"',
    'id="app"',
    'id="__next"',
    "data-reactroot",
    "__NEXT_DATA__",
    "ng-version",
    "<app-root>",
)
TRACKER_WORDS = ("pixel", "tracking", "beacon", "analytics", "1x1", "spacer", "blank")

# Fixed values of the extended heuristics.
EXTENDED_NOSCRIPT_PHRASES = NOSCRIPT_PHRASES + (
    "javascript is required",
    "javascript must be enabled",
    "please enable javascript",
    "you need to enable javascript",
)
EXTENDED_SPA_MARKERS = (
    'id="root"',
    'id="app"',
    "data-reactroot",
    'id="__next"',
    "__NEXT_DATA__",
    "data-v-",
    'id="__nuxt"',
    "ng-version",
    "<app-root>",
    "ng-app",
    "window.__INITIAL_STATE__",
    "window.__PRELOADED_STATE__",
    "window.__REDUX_STATE__",
)
AJAX_PATTERNS = ("XMLHttpRequest", "fetch(", "axios.", "$.ajax", "$.get", "$.post")
ROOT_MARKERS = (
    'id="root"',
    'id="app"',
    'id="__next"',
    "data-reactroot",
    "data-reactid",
    "ng-version",
    "ng-app",
    "data-v-app",
    "data-vue-meta",
)
SSR_MARKERS = ("window.__INITIAL_STATE__", "__NEXT_DATA__", "__NUXT__")


def contains_any(text: Column, words) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def count_contained(text: Column, words) -> Column:
    return sum((text.contains(word).cast("int") for word in words), F.lit(0))


def asks_for_javascript(html: Column, phrases=NOSCRIPT_PHRASES) -> Column:
    lowered = F.lower(html)
    return lowered.contains("<noscript>") & contains_any(lowered, phrases)


def is_app_shell(html: Column) -> Column:
    return (F.octet_length(html) < SHELL_BYTES) & contains_any(html, SPA_MARKERS)


def is_tiny_script_page(html: Column) -> Column:
    return (F.octet_length(html) < TINY_BYTES) & F.lower(html).contains("<script")


def needs_dynamic(html: Column) -> Column:
    """Whether a static page looks like a script shell; size tests come first
    because they are free."""
    return is_tiny_script_page(html) | is_app_shell(html) | asks_for_javascript(html)


def is_tracking_pixel(url: Column) -> Column:
    return contains_any(F.lower(url), TRACKER_WORDS)


def is_valid_image_url(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def within_image_size(content: Column, max_bytes: int = MAX_IMAGE_BYTES) -> Column:
    return F.octet_length(content) <= max_bytes


def asks_for_javascript_extended(html: Column) -> Column:
    return asks_for_javascript(html, EXTENDED_NOSCRIPT_PHRASES)


def is_app_shell_extended(html: Column, main_text: Column) -> Column:
    """Marker and small page, or marker and next to no main text."""
    return contains_any(html, EXTENDED_SPA_MARKERS) & (
        (F.octet_length(html) < SHELL_BYTES) | F.coalesce(F.length(main_text) < 100, F.lit(False))
    )


def is_tiny_script_page_extended(html: Column, body_text: Column) -> Column:
    return is_tiny_script_page(html) & (F.length(body_text) < 200)


def is_ajax_heavy(html: Column) -> Column:
    return count_contained(html, AJAX_PATTERNS) >= 2
