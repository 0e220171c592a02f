"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def exact_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``group`` and one interpolated quantile column per entry of ``shares``.

    The built-in ``percentile`` holds all values of a group in one place. Here
    equal values are counted first, then the distinct ones are range-partitioned
    by group and value, which splits a large group over many tasks. Each task
    counts within its chunk; chunk totals (one row per task and group) give the
    offsets. Writes one intermediate table, because chunk numbers must not
    change under it.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    chunked = materialize(
        counted.repartitionByRange(group, value).withColumn("_chunk", F.spark_partition_id()), "quantile-chunks"
    )
    whole = Window.partitionBy(group)
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(group, "_chunk")
        .agg(F.sum("_n").alias("_m"))
        .select(
            group,
            "_chunk",
            F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
            F.sum("_m").over(whole).alias("_total"),
        )
    )
    inside = Window.partitionBy(group, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        chunked.withColumn("_upto", F.sum("_n").over(inside))
        .join(offsets, [group, "_chunk"])
        .withColumn("_end", F.col("_before") + F.col("_upto"))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    picks, results = [], []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_start") <= place) & (place < F.col("_end"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return placed.groupBy(group).agg(F.first("_total").alias("_total"), *picks).select(group, *results)
