"""Result cache over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cache import cache_hit_flags, match_cache, newest_entries
from .registry import load, query


def _log(spark, folder):
    return load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """WITH entries AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT r.event_id, epoch_us(max(e.ts)) AS cached_at FROM events r LEFT JOIN entries e
  ON r.user_id = e.user_id AND e.ts <= r.ts AND r.ts < e.ts + INTERVAL 7 DAY GROUP BY 1"""
)
def cache_lookup(spark, folder):
    """Newest entry valid at each request."""
    log = _log(spark, folder)
    key = F.col("user_id").cast("string")
    entries = log.filter(F.col("event_type") == "purchase").select(key.alias("cache_key"), F.col("ts").alias("cached_at"))
    asked = log.select("event_id", key.alias("cache_key"), "ts")
    return match_cache(asked, entries, "ts").select("event_id", F.unix_micros("cached_at").alias("cached_at"))


@query(
    """WITH RECURSIVE anchors AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL
  SELECT a.user_id, min(e.ts) FROM anchors a JOIN events e ON a.user_id = e.user_id AND e.ts >= a.ts + INTERVAL 7 DAY GROUP BY 1),
misses AS (SELECT min(e.event_id) AS event_id FROM anchors a JOIN events e USING (user_id, ts) GROUP BY a.user_id, a.ts)
SELECT event_id, user_id, event_id NOT IN (SELECT event_id FROM misses) AS cache_hit FROM events"""
)
def cache_hits(spark, folder):
    """Hits and misses of a cache whose entries live seven days."""
    flags = cache_hit_flags(_log(spark, folder), "user_id", "ts", "event_id")
    return flags.select("event_id", "user_id", "cache_hit")


@query("SELECT CAST(user_id AS VARCHAR) AS cache_key, epoch_us(max(ts)) AS cached_at FROM events GROUP BY 1")
def cache_compaction(spark, folder):
    """Newest entry per key."""
    entries = _log(spark, folder).select(F.col("user_id").cast("string").alias("cache_key"), F.col("ts").alias("cached_at"))
    return newest_entries(entries).select("cache_key", F.unix_micros("cached_at").alias("cached_at"))
