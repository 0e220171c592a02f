"""Query registry and shared loaders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"

# SQL for the key and the host of a plain http(s) URL.
SQL_KEY = "rtrim(regexp_replace(url, '#.*$', ''), '/')"
SQL_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as its files are split; how they are is for the session to set."""
    return read_table(spark, folder, name)
