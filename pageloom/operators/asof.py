"""As-of join: for each asked moment of a key, the newest entry at or before it.

Both sides become one stream of moments per key, sorted by time, through which
the newest entry is carried forward: every row is read once and no pair of
request and entry is made. A key that holds a large share of the rows is cut
into time slices of about equal size. A slice starts with the newest entry of
the slices before it, one value per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a heavy key; with the share below, none holds a thousandth of the rows.
SLICES = 64
SHARE = 500


def _cuts(moments: DataFrame, share: int) -> DataFrame:
    """(key, cuts): inner limits of the slices of each key with at least
    ``1/share`` of the rows, so at most ``share`` rows."""
    counts = moments.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    heavy = counts.filter(F.col("_key").isNotNull() & (F.col("_n") * share >= total)).select("_key")
    inner = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cuts = F.array_distinct(F.percentile_approx("_at", inner)).alias("_cuts")
    return moments.join(F.broadcast(heavy), "_key").groupBy("_key").agg(cuts)


def _sliced(moments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with their slice: how many limits lie before their moment. Rows of
    one moment stay together. Rows without key meet no entry and are spread."""
    placed = moments.join(F.broadcast(cuts), "_key", "left")
    slice_ = F.when(F.col("_key").isNull(), F.pmod(F.xxhash64("_row"), F.lit(SHARE))).otherwise(
        F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0))
    )
    return placed.withColumn("_slice", slice_.cast("int")).drop("_cuts")


def _carried(moments: DataFrame) -> DataFrame:
    """(key, slice, before): the newest entry of the earlier slices of a cut key.
    At most ``SHARE * SLICES`` rows."""
    newest = moments.filter(F.col("_row").isNull()).groupBy("_key", "_slice").agg(F.max("_at").alias("_newest"))
    later = F.explode(F.sequence(F.col("_slice") + 1, F.lit(SLICES)))
    return newest.select("_key", later.alias("_slice"), "_newest").groupBy("_key", "_slice").agg(F.max("_newest").alias("_before"))


def as_of(
    asked: DataFrame, entries: DataFrame, key: str, asked_at: str, entry_at: str, result: str, share: int = SHARE
) -> DataFrame:
    """``asked`` with the time ``result`` of the newest row of ``entries`` of the
    same key at or before ``asked_at``, NULL if there is none.

    Every row of ``asked`` comes back once. A NULL key or time meets no entry,
    and entries with a NULL in either count for nothing.
    """
    name = asked.columns
    rows = asked.select(
        F.col(key).alias("_key"), F.unix_micros(F.col(asked_at).cast("timestamp")).alias("_at"), F.struct(*name).alias("_row")
    )
    nothing = F.lit(None).cast(rows.schema["_row"].dataType)
    stored = entries.filter(F.col(key).isNotNull() & F.col(entry_at).isNotNull()).select(
        F.col(key).alias("_key"), F.unix_micros(F.col(entry_at).cast("timestamp")).alias("_at")
    )
    moments = rows.unionByName(stored.distinct().withColumn("_row", nothing))
    cuts = _cuts(moments.select("_key", "_at"), share)
    sliced = _sliced(moments, cuts)
    # only cut keys have slices before others
    carried = _carried(_sliced(moments.join(F.broadcast(cuts.select("_key")), "_key", "left_semi"), cuts))
    entry = F.when(F.col("_row").isNull(), F.col("_at"))
    # an entry serves a request of the same moment, so it comes first
    order = Window.partitionBy("_key", "_slice").orderBy("_at", F.col("_row").isNotNull())
    here = F.last(entry, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = sliced.withColumn("_here", here).filter(F.col("_row").isNotNull())
    found = found.join(F.broadcast(carried), ["_key", "_slice"], "left")
    newest: Column = F.when(F.col("_at").isNotNull(), F.timestamp_micros(F.coalesce("_here", "_before")))
    return found.select(*[F.col("_row")[c].alias(c) for c in name], newest.alias(result))
