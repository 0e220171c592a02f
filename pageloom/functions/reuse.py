"""Keeps built column trees.

A column over named inputs does not depend on any DataFrame, but building a
long one takes a call into the JVM per node. Jobs that build the same columns
again and again (each micro-batch, each crawl level) keep them instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def reuse(build: Callable) -> Callable:
    """Keep what ``build`` returns per arguments (names and numbers) and JVM."""
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get
