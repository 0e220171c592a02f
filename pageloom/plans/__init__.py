"""Registered queries, each beside its SQL twin."""

from . import cache_queries, crawl_queries, document_queries, media_queries, page_queries  # noqa: F401
from . import request_queries, scrape_queries, search_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
