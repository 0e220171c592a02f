"""Joins for keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: list[str], share: int = 500) -> DataFrame:
    """Keys with at least ``1/share`` of all rows, and into how many salts each
    is to be dealt so that none of these holds more than that share.

    There can be at most ``share`` of them whatever the size of ``df``, which
    is the bound under which the result may be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    salts = F.ceil(F.col("_n") * share / total).cast("int").alias("_salts")
    return counts.filter(F.col("_n") * share >= total).select(*keys, salts)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    heavy: DataFrame,
    spread_by: list[str],
    how: str = "left",
) -> DataFrame:
    """Equi-join in which rows of heavy keys are spread over their salts.

    Only the right-hand rows of heavy keys are copied. The salt is a hash of
    ``spread_by``, so a recomputed task salts the same way.
    """
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    spread = F.pmod(F.xxhash64(*spread_by), salts).cast("int")
    left_salted = (
        left.join(F.broadcast(heavy), keys, "left")
        .withColumn("_salt", spread)
        .drop("_salts")
    )
    copies = F.sequence(F.lit(0), salts - 1)
    right_salted = (
        right.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    )
    return left_salted.join(right_salted, [*keys, "_salt"], how)
