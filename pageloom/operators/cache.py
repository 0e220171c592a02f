"""Result cache with a seven-day life from the write; reads do not extend it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .asof import as_of
from .joins import heavy_keys, salted_join

TTL_SECONDS = 7 * 24 * 3600


def _week(ts, ttl: int):
    return F.floor(F.unix_micros(ts) / F.lit(ttl * 1_000_000)).cast("bigint")


def match_cache(requests: DataFrame, cache: DataFrame, ts_column: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """``requests`` with ``cached_at`` of the newest entry valid at each, NULL on
    a miss. Entries do not outlive newer ones, so it is the newest entry at or
    before the request, unless that one has expired."""
    found = as_of(requests, cache, "cache_key", ts_column, "cached_at", "cached_at")
    alive = F.unix_micros(F.col(ts_column).cast("timestamp")) < F.unix_micros("cached_at") + ttl * 1_000_000
    return found.withColumn("cached_at", F.when(alive, F.col("cached_at")))


def lookup_cache(requests: DataFrame, cache: DataFrame, ts_column: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Requests with ``cached_at`` and ``result`` (NULL on a miss). Results are
    attached last, after the narrow match."""
    return with_results(match_cache(requests, cache, ts_column, ttl), cache)


def with_results(matched: DataFrame, cache: DataFrame) -> DataFrame:
    """Attach ``result`` by ``cache_key`` and ``cached_at``.

    Only entries that were hit are shuffled whole; of several of one key and
    time the one with the smallest hash of its result counts.
    """
    wanted = matched.filter(F.col("cached_at").isNotNull()).select("cache_key", "cached_at").distinct()
    order = F.xxhash64(F.to_json(F.struct("result")))
    store = (
        cache.join(wanted, ["cache_key", "cached_at"], "left_semi")
        .groupBy("cache_key", "cached_at")
        .agg(F.min_by("result", order).alias("result"))
    )
    return matched.join(store, ["cache_key", "cached_at"], "left")


def cache_anchors(
    requests: DataFrame, key: str, ts: str, tie: str, ttl: int = TTL_SECONDS, share: int = 500
) -> DataFrame:
    """Requests that miss the cache: per key the first one, then each first one
    at or after the last miss plus the life time. Returns ``key, ts, tie``.

    Time is cut into slots of one life time. A slot holds at most one miss per
    key, and it depends on earlier slots only through the last miss, so the
    slots are taken in order and each step reads its own slot: a minimum per
    key, combined map-side, over rows joined with one narrow state row per key.
    No group is ever collected, and rows of heavy keys are salted. The number
    of steps is the time span over the life time.
    """
    micros = ttl * 1_000_000
    kind = requests.schema[ts].dataType
    log = requests.select(key, F.col(ts).cast("timestamp").alias("_ts"), F.col(tie).alias("_tie")).withColumn(
        "_slot", _week(F.col("_ts"), ttl)
    )
    slots = sorted(row[0] for row in log.select("_slot").distinct().collect())
    if not slots:
        return log.select(key, F.col("_ts").cast(kind).alias(ts), F.col("_tie").alias(tie))
    heavy = materialize(heavy_keys(log, [key], share), "heavy-keys")
    found: dict[int, DataFrame] = {}
    earliest = F.min(F.struct("_ts", "_tie")).alias("_first")
    for slot in slots:
        start, end = (F.timestamp_micros(F.lit(s * micros)) for s in (slot, slot + 1))
        rows = log.filter((F.col("_ts") >= start) & (F.col("_ts") < end))
        if slot - 1 in found:
            # Misses of older slots have expired before this one begins.
            state = found[slot - 1].select(key, F.col("_ts").alias("_last"))
            rows = salted_join(rows, state, [key], heavy, ["_ts", "_tie"])
            rows = rows.filter(
                F.col("_last").isNull() | (F.unix_micros("_ts") >= F.unix_micros("_last") + micros)
            )
        anchors = rows.groupBy(key).agg(earliest).select(key, "_first._ts", "_first._tie")
        found[slot] = materialize(anchors, "cache-anchors")
    parts = list(found.values())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(key, F.col("_ts").cast(kind).alias(ts), F.col("_tie").alias(tie))


def cache_hit_flags(
    requests: DataFrame, key: str = "cache_key", ts: str = "ts", tie: str = "request_id", ttl: int = TTL_SECONDS
) -> DataFrame:
    """Requests with ``cache_hit``. Misses are matched by key, time and id, so
    the join key is unique and cannot be skewed."""
    anchors = cache_anchors(requests, key, ts, tie, ttl).withColumn("_miss", F.lit(True))
    return (
        requests.join(anchors, [key, ts, tie], "left")
        .withColumn("cache_hit", F.col("_miss").isNull())
        .drop("_miss")
    )


def newest_entries(cache: DataFrame) -> DataFrame:
    """Newest entry per key (compaction). The rank limit is applied map-side
    before the shuffle, so a key written very often costs one row per task."""
    rank = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("cached_at"), F.xxhash64(F.to_json(F.struct(*cache.columns)))))
    return cache.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
