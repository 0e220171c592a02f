"""Run logs and request logs: status lookup, retention, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# The order in which queues are searched.
QUEUE_ORDER = ("default", "critical", "low")

# Error code, status, may be retried.
ERROR_CODES = (
    ("BAD_REQUEST", 400, False),
    ("INVALID_URL", 400, False),
    ("INVALID_MODE", 400, False),
    ("UNAUTHORIZED", 401, False),
    ("NOT_FOUND", 404, False),
    ("SCRAPE_FAILED", 422, False),
    ("TIMEOUT", 422, True),
    ("RATE_LIMITED", 429, True),
    ("INTERNAL_ERROR", 500, True),
    ("SERVICE_UNAVAILABLE", 503, True),
)


def _queue_rank(queue: Column) -> Column:
    return F.array_position(F.lit(list(QUEUE_ORDER)), queue)


def first_in_queue_order(run_log: DataFrame) -> DataFrame:
    """The row that answers a status question for every id. Queues that are
    not searched are left out; only the best row per id leaves a map task."""
    known = run_log.withColumn("_rank", _queue_rank(F.col("queue"))).filter(F.col("_rank") > 0)
    best = F.row_number().over(Window.partitionBy("id").orderBy("_rank", F.xxhash64(F.to_json(F.struct(*run_log.columns)))))
    return known.withColumn("_best", best).filter(F.col("_best") == 1).drop("_best", "_rank")


def crawl_status(run_log: DataFrame, run_id: str) -> DataFrame:
    """At most one row; none means not found."""
    return first_in_queue_order(run_log.filter(F.col("id") == run_id))


def retained(results: DataFrame, as_of: Column, days: int = 7, ts: str = "finished_at") -> DataFrame:
    """Rows still kept: a plain comparison, so it prunes date partitions."""
    return results.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def queue_depth(log: DataFrame, ts: str = "ts", state: str = "state", every: str = "1 minute") -> DataFrame:
    """Rows per state and minute; works on streams with a watermark too."""
    return (
        log.groupBy(F.window(ts, every), F.col(state).alias("state"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "state", "n")
    )


def request_metrics(
    log: DataFrame, ts: str = "ts", latency: str = "latency_ms", failed: str = "failed", every: str = "5 minutes"
) -> DataFrame:
    """Error rate and exact latency percentiles per window; a window may hold
    any share of the log."""
    rows = log.select(F.window(ts, every)["start"].alias("window_start"), failed, latency)
    counts = rows.groupBy("window_start").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col(failed)) / F.count(F.lit(1))).alias("error_rate")
    )
    quantiles = exact_quantiles(rows, "window_start", latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return counts.join(quantiles, "window_start", "left")


def metric_sketches(
    log: DataFrame, ts: str = "ts", latency: str = "latency_ms", failed: str = "failed", every: str = "5 minutes", k: int = 200
) -> DataFrame:
    """``window_start, n, failures, latencies`` per window, the latter a KLL sketch.

    Sketches merge, so a window is combined map-side and in the state of a stream
    and its size does not grow with the log; a window of up to ``k`` rows is kept
    as it is. Works on streams with a watermark.
    """
    return (
        log.groupBy(F.window(ts, every))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(failed)).alias("failures"),
            F.kll_sketch_agg_double(F.col(latency).cast("double"), k).alias("latencies"),
        )
        .select(F.col("window.start").alias("window_start"), "n", "failures", "latencies")
    )


def sketched_metrics(sketches: DataFrame, shares: dict[str, float], every: str | None = None) -> DataFrame:
    """``window_start, n, error_rate`` and a quantile per entry of ``shares`` from
    rows of ``metric_sketches``, merged to windows of ``every`` if given. Several
    rows of one window count together. A quantile is the least value that at
    least its share of the values does not exceed, within the sketch's error."""
    start = F.col("window_start") if every is None else F.window("window_start", every)["start"]
    merged = sketches.groupBy(start.alias("window_start")).agg(
        F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.kll_merge_agg_double("latencies").alias("_all")
    )
    values = F.kll_sketch_get_n_double("_all") > 0
    quantiles = [
        F.when(values, F.kll_sketch_get_quantile_double("_all", F.lit(share))).alias(name) for name, share in shares.items()
    ]
    return merged.select("window_start", "n", (F.col("failures") / F.col("n")).alias("error_rate"), *quantiles)


def classify_error(message: Column) -> Column:
    """Error code of a message, NULL for none."""
    text = F.lower(message)
    return (
        F.when(message.isNull() | (message == ""), F.lit(None))
        .when(text.startswith("unknown mode"), F.lit("INVALID_MODE"))
        .when(text.contains("invalid") & text.contains("url"), F.lit("INVALID_URL"))
        .when(text.contains("is required"), F.lit("BAD_REQUEST"))
        .when(text.contains("not found"), F.lit("NOT_FOUND"))
        .when(text.contains("timeout") | text.contains("timed out") | text.contains("deadline"), F.lit("TIMEOUT"))
        .when(text.contains("rate limit") | text.contains("429"), F.lit("RATE_LIMITED"))
        .when(text.contains("not configured") | text.contains("unavailable"), F.lit("SERVICE_UNAVAILABLE"))
        .when(text.contains("unauthorized") | text.contains("401"), F.lit("UNAUTHORIZED"))
        .when(
            text.contains("scrap") | text.contains("empty response") | text.contains("fetch"),
            F.lit("SCRAPE_FAILED"),
        )
        .otherwise(F.lit("INTERNAL_ERROR"))
    )


def _by_code(code: Column, pick: int) -> Column:
    out = F.lit(None)
    for row in reversed(ERROR_CODES):
        out = F.when(code == row[0], F.lit(row[pick])).otherwise(out)
    return out


def error_status(code: Column) -> Column:
    return _by_code(code, 1).cast("int")


def is_retryable(code: Column) -> Column:
    return _by_code(code, 2).cast("boolean")


def keep_recent(
    log: DataFrame, as_of: Column, partition: str = "queue", ts: str = "finished_at", tie: str = "id"
) -> DataFrame:
    """Finished runs kept: the newest 100 completed or those of 24 hours, the
    newest 50 failed or those of 48 hours.

    The age test needs no order at all, and ranks are only asked for up to a
    constant, which Spark cuts map-side; so a queue with very many runs is
    neither sorted nor gathered as a whole.
    """
    limits = (("completed", 100, 24), ("failed", 50, 48))
    by_age = F.lit(False)
    ranked = None
    for state, count, hours in limits:
        rows = log.filter(F.col("state") == state)
        by_age = by_age | ((F.col("state") == state) & (F.col(ts) >= as_of - F.make_dt_interval(hours=F.lit(hours))))
        rank = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(ts), F.desc(tie)))
        top = rows.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")
        ranked = top if ranked is None else ranked.unionByName(top)
    return log.filter(by_age).unionByName(ranked.filter(~by_age))
