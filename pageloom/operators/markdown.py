"""Page table to Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import only_elements, without_selected
from ..functions.markdown import markdown


def pages_to_markdown(
    pages: DataFrame, exclude_tags: tuple[str, ...] = (), include_tags: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``markdown``. Tag lists take element names, ``#id`` and ``.class``;
    the markup is narrowed in the JVM before the Arrow hop, so less text crosses
    over."""
    html = F.col("html")
    if include_tags:
        html = only_elements(html, *include_tags)
    if exclude_tags:
        html = without_selected(html, *exclude_tags)
    # exploded, so that the function's argument is a column and is made once
    narrowed = pages.withColumn("_markup", F.explode(F.array(html)))
    return narrowed.withColumn("markdown", markdown(F.col("_markup"))).drop("_markup")
