"""Request normalisation, decoding and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import requests as R
from ..operators import runlog
from ..session import scratch_path
from ..sources.tables import read_results_json, write_results_json
from ..sources.tasks import NO_URL, decode_tasks
from .registry import AS_OF, load, query

_MODES = "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'static' WHEN 2 THEN 'dynamic' WHEN 3 THEN 'turbo' END"


def _mode(n):
    return F.when(n % 5 == 0, "").when(n % 5 == 1, "static").when(n % 5 == 2, "dynamic").when(n % 5 == 3, "turbo")


@query(
    f"""WITH r AS (
  SELECT event_id, event_id % 7 = 0 AS render, {_MODES} AS mode, event_id % 3 = 0 AS shot, event_id % 2 = 0 AS img,
    CAST(user_id AS INTEGER) % 17 - 3 AS depth, CAST(user_id AS INTEGER) - 20 AS lim, 'https://e.com/' || user_id AS url FROM events),
m AS (SELECT *, CASE WHEN render THEN 'dynamic' WHEN mode IS NULL OR mode = '' THEN 'smart' ELSE mode END AS resolved FROM r)
SELECT event_id, resolved AS mode, CASE WHEN resolved = 'turbo' THEN 'unknown mode: turbo' END AS error,
  CASE WHEN depth <= 0 THEN 2 WHEN depth > 10 THEN 10 ELSE depth END AS max_depth,
  CASE WHEN lim <= 0 THEN 10 WHEN lim > 100 THEN 100 ELSE lim END AS crawl_limit,
  CASE WHEN lim = 0 THEN 10 WHEN lim > 100 THEN 100 ELSE lim END AS search_limit,
  CASE WHEN lim < 0 THEN 0 ELSE lim END AS search_offset,
  'scrape:' || url || ':' || resolved || ':' || CASE WHEN shot THEN 'true' ELSE 'false' END || ':'
    || CASE WHEN img THEN 'true' ELSE 'false' END AS cache_key FROM m"""
)
def request_normalisation(spark, folder):
    """P1-P5, P10."""
    n, user = F.col("event_id"), F.col("user_id").cast("int")
    rows = load(spark, folder, "events").select(
        "event_id",
        R.resolve_mode(n % 7 == 0, _mode(n)).alias("mode"),
        (user % 17 - 3).alias("depth"),
        (user - 20).alias("lim"),
        F.concat(F.lit("https://e.com/"), user.cast("string")).alias("url"),
    )
    return rows.select(
        "event_id",
        "mode",
        R.mode_error(F.col("mode")).alias("error"),
        R.clamp_depth(F.col("depth")).alias("max_depth"),
        R.clamp_crawl_limit(F.col("lim")).alias("crawl_limit"),
        R.clamp_search_limit(F.col("lim")).alias("search_limit"),
        R.clamp_offset(F.col("lim")).alias("search_offset"),
        R.cache_key(F.col("url"), F.col("mode"), n % 3 == 0, n % 2 == 0).alias("cache_key"),
    )


@query(
    """WITH r AS (
  SELECT event_id, CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN NULL ELSE event_type END AS q,
    CASE WHEN user_id % 3 = 0 THEN '' ELSE 'alias' END AS alias, 'body' || user_id AS body,
    CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN '' END AS flag, event_id % 6 = 1 AS body_flag,
    CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN user_id || 'x' END AS num
  FROM events)
SELECT event_id, CASE WHEN q <> '' THEN q WHEN alias <> '' THEN alias ELSE body END AS query,
  coalesce(flag, '') = 'true' OR body_flag AS render, coalesce(try_cast(num AS INTEGER), -1) AS lim FROM r"""
)
def request_precedence(spark, folder):
    """Query string over body, alias second."""
    n, user = F.col("event_id"), F.col("user_id")
    q = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "click", F.col("event_type"))
    alias = F.when(user % 3 == 0, "").otherwise("alias")
    flag = F.when(n % 4 == 0, "true").when(n % 4 == 1, "TRUE").when(n % 4 == 2, "")
    number = F.when(n % 3 == 0, user.cast("string")).when(n % 3 == 1, F.concat(user.cast("string"), F.lit("x")))
    body = F.concat(F.lit("body"), user.cast("string"))
    return load(spark, folder, "events").select(
        "event_id",
        R.prefer_text(q, R.prefer_text(alias, body)).alias("query"),
        R.prefer_flag(flag, n % 6 == 1).alias("render"),
        R.prefer_int(number, F.lit(-1)).alias("lim"),
    )


def _tasks(spark, folder):
    n, user = F.col("event_id"), F.col("user_id")
    url = F.when(n % 10 == 9, F.lit("")).otherwise(F.concat(F.lit("https://e.com/"), user.cast("string")))
    scrape = F.to_json(F.struct(url.alias("url"), (n % 4 == 0).alias("render"), _mode(n).alias("mode")))
    crawl = F.to_json(
        F.struct(url.alias("url"), F.get_json_object("props", "$.k").cast("int").alias("maxDepth"), (user % 150).cast("int").alias("limit"))
    )
    payload = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("props")))
        .when(n % 2 == 0, scrape)
        .otherwise(crawl)
    )
    return load(spark, folder, "events").select(
        n.cast("string").alias("task_id"),
        F.when(n % 2 == 0, "scrape:url").otherwise("crawl:site").alias("task_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        payload.alias("payload"),
    )


@query(
    f"""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'scrape' ELSE 'crawl' END AS kind,
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 10 = 9 THEN '' ELSE 'https://e.com/' || user_id END END AS url,
  CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN event_id % 4 = 0 END AS render,
  CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN {_MODES} END AS mode,
  CASE WHEN event_type <> 'error' AND event_id % 2 = 1 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS depth,
  CASE WHEN event_type <> 'error' AND event_id % 2 = 1 THEN CAST(user_id % 150 AS INTEGER) END AS lim,
  CASE WHEN event_type = 'error' THEN 'failed to unmarshal payload' END AS error FROM events"""
)
def request_decode(spark, folder):
    """JSON payloads read as their task type says, bad ones with an error, in one scan."""
    tasks = decode_tasks(_tasks(spark, folder))
    return tasks.select(
        F.col("task_id").alias("id"),
        F.split_part("task_type", F.lit(":"), F.lit(1)).alias("kind"),
        F.coalesce("scrape.url", "crawl.url").alias("url"),
        "scrape.render",
        "scrape.mode",
        F.col("crawl.maxDepth").alias("depth"),
        F.col("crawl.limit").alias("lim"),
        F.when(F.col("error") != NO_URL, F.col("error")).alias("error"),
    )


@query(
    """SELECT CAST(event_id AS VARCHAR) AS request_id, CASE event_id % 10 WHEN 6 THEN 'media:url' WHEN 8 THEN NULL ELSE task_type END AS task_type, payload,
  CASE WHEN event_id % 10 IN (6, 8) THEN 'unknown task type' WHEN event_type = 'error' THEN 'failed to unmarshal payload'
    WHEN event_id % 10 = 9 THEN 'URL is required' END AS error
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'scrape:url' ELSE 'crawl:site' END AS task_type,
  CASE WHEN event_type = 'error' THEN '{broken ' || props END AS payload FROM events)"""
)
def request_required(spark, folder):
    """Accepted and rejected tasks of all types; rejects keep what they came with."""
    n = F.col("task_id").cast("bigint")
    task_type = F.when(n % 10 == 6, F.lit("media:url")).when(n % 10 != 8, F.col("task_type"))
    tasks = _tasks(spark, folder).withColumn("task_type", task_type)
    broken = F.when(F.col("payload").startswith("{broken"), F.col("payload"))
    return decode_tasks(tasks).select(F.col("task_id").alias("request_id"), "task_type", broken.alias("payload"), "error")


@query(
    """WITH r AS (SELECT event_id, CAST(event_id % 120 AS INTEGER) AS off, CAST(user_id % 30 + 1 AS INTEGER) AS lim,
    CAST(user_id % 31 AS INTEGER) AS returned FROM events),
t AS (SELECT *, off + returned + CASE WHEN returned >= lim THEN 100 ELSE 0 END AS total FROM r)
SELECT event_id, total, off + lim < total AS has_more, off + lim AS next_offset FROM t"""
)
def search_paging(spark, folder):
    """L3, A4."""
    rows = load(spark, folder, "events").select(
        "event_id",
        (F.col("event_id") % 120).cast("int").alias("off"),
        (F.col("user_id") % 30 + 1).cast("int").alias("lim"),
        (F.col("user_id") % 31).cast("int").alias("returned"),
    )
    total = R.estimated_total(F.col("off"), F.col("returned"), F.col("lim"))
    return rows.withColumn("total", total).select(
        "event_id",
        "total",
        R.has_more(F.col("off"), F.col("lim"), F.col("total")).alias("has_more"),
        R.next_offset(F.col("off"), F.col("lim")).alias("next_offset"),
    )


@query(
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
  'Scraped https://' || source || '/' || doc_id || ' successfully' AS summary FROM documents"""
)
def previews(spark, folder):
    """P13, S7."""
    docs = load(spark, folder, "documents")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", R.preview(F.col("text")).alias("preview"), R.summary_line(url).alias("summary"))


@query(
    """SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'md' || page_id END AS markdown,
  md5(html) AS html_md5, '2024-02-01T00:00:00Z' AS scraped_at, 'colly' AS engine,
  CASE WHEN page_id % 2 = 0 THEN 'true' END AS cached,
  NOT (page_id % 5 = 0) AS has_html FROM (SELECT * REPLACE (CASE WHEN page_id % 5 = 0 THEN NULL ELSE html END AS html) FROM pages)"""
)
def result_store(spark, folder):
    """Results written as gzip JSON without empty fields
    and read back."""
    n = F.col("page_id")
    metadata = R.metadata_map(F.lit(AS_OF).cast("timestamp"), F.lit("colly"))
    results = load(spark, folder, "pages").select(
        "page_id",
        "url",
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("md"), n.cast("string"))).alias("markdown"),
        R.omit_empty(F.when(n % 5 == 0, "").otherwise(F.col("html"))).alias("html"),
        F.when(n % 2 == 0, R.mark_cached(metadata)).otherwise(metadata).alias("metadata"),
    )
    path = scratch_path(spark, "result-store")
    write_results_json(results, path)
    schema = schemas._struct(
        page_id=schemas.LONG, url=schemas.STR, markdown=schemas.STR, html=schemas.STR, metadata=schemas.SCRAPE_RESULT["metadata"].dataType
    )
    back = read_results_json(spark, path, schema)
    return back.select(
        "page_id",
        "url",
        "markdown",
        F.md5(F.col("html").cast("binary")).alias("html_md5"),
        F.try_element_at("metadata", F.lit("scraped_at")).alias("scraped_at"),
        F.try_element_at("metadata", F.lit("engine")).alias("engine"),
        F.try_element_at("metadata", F.lit("cached")).alias("cached"),
        F.col("html").isNotNull().alias("has_html"),
    )


@query(
    """WITH log AS (
  SELECT CAST(user_id AS VARCHAR) AS id, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'default' ELSE 'other' END AS queue,
    event_id, event_type FROM events),
newest AS (SELECT id, queue, max(event_id) AS event_id FROM log GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE queue WHEN 'default' THEN 1 WHEN 'critical' THEN 2 ELSE 3 END) AS rn
  FROM newest WHERE queue <> 'other')
SELECT id, queue, event_id FROM best WHERE rn = 1"""
)
def run_status(spark, folder):
    """C4: the first queue that knows a run answers for it."""
    n = F.col("event_id")
    log = load(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.when(n % 4 == 0, "critical").when(n % 4 == 1, "low").when(n % 4 == 2, "default").otherwise("other").alias("queue"),
        "event_id",
    )
    newest = log.groupBy("id", "queue").agg(F.max("event_id").alias("event_id"))
    return runlog.first_in_queue_order(newest).select("id", "queue", "event_id")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'")
def retained_results(spark, folder):
    """Results of the last seven days."""
    kept = runlog.retained(load(spark, folder, "events"), F.lit(AS_OF).cast("timestamp").cast("timestamp_ntz"), ts="ts")
    return kept.select("event_id", "event_type")


@query(
    """SELECT epoch_us(date_trunc('minute', ts)) AS window_start, event_type AS state, count(*) AS n FROM events GROUP BY 1, 2"""
)
def queue_depths(spark, folder):
    """Rows per state and minute."""
    out = runlog.queue_depth(load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), state="event_type")
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query(
    """SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS window_start, count(*) AS n,
  round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1"""
)
def request_log_metrics(spark, folder):
    """Error rate and latency percentiles per five minutes."""
    log = load(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed")
    )
    out = runlog.request_metrics(log)
    return out.select(
        F.unix_micros("window_start").alias("window_start"), "n", *[F.round(c, 4).alias(c) for c in ("error_rate", "p50", "p95", "p99")]
    )


@query(
    """WITH log AS (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'active' END AS state,
    CAST(user_id % 5 AS VARCHAR) AS queue, ts FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY queue, state ORDER BY ts DESC, event_id DESC) AS rn FROM log)
SELECT event_id, queue, state FROM ranked
WHERE state = 'completed' AND (rn <= 100 OR ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR)
  OR state = 'failed' AND (rn <= 50 OR ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR)"""
)
def recent_runs(spark, folder):
    """Runs kept by count or age."""
    log = load(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("view", "click"), "completed").when(F.col("event_type") == "error", "failed").otherwise("active").alias("state"),
        (F.col("user_id") % 5).cast("string").alias("queue"),
        "ts",
    )
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return runlog.keep_recent(log, as_of, ts="ts", tie="event_id").select("event_id", "queue", "state")


_MESSAGES = (
    ("unknown mode: turbo", "INVALID_MODE", 400, "FALSE"),
    ("page not found", "NOT_FOUND", 404, "FALSE"),
    ("chromedp failed: Timeout", "TIMEOUT", 422, "TRUE"),
    ("empty response", "SCRAPE_FAILED", 422, "FALSE"),
    ("dynamic scraper not configured", "SERVICE_UNAVAILABLE", 503, "TRUE"),
    ("rate limit wait: x", "RATE_LIMITED", 429, "TRUE"),
    ("invalid seed URL", "INVALID_URL", 400, "FALSE"),
    ("something else", "INTERNAL_ERROR", 500, "TRUE"),
)
_CASES = {
    column: "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {value(row)}" for i, row in enumerate(_MESSAGES)) + " END"
    for column, value in (
        ("code", lambda r: f"'{r[1]}'"),
        ("status", lambda r: str(r[2])),
        ("retryable", lambda r: r[3]),
    )
}


@query(
    f"""SELECT event_id, {_CASES['code']} AS code, CAST({_CASES['status']} AS INTEGER) AS status, {_CASES['retryable']} AS retryable FROM events"""
)
def error_codes(spark, folder):
    """Messages to codes."""
    message = F.get(F.array(*[F.lit(row[0]) for row in _MESSAGES]), (F.col("event_id") % 9).cast("int"))
    rows = load(spark, folder, "events").select("event_id", runlog.classify_error(message).alias("code"))
    return rows.select(
        "event_id", "code", runlog.error_status(F.col("code")).alias("status"), runlog.is_retryable(F.col("code")).alias("retryable")
    )


@query(
    """SELECT event_id, CAST(CASE WHEN age IN (1, 7, 30) THEN age WHEN event_type = 'view' THEN 1 END AS INTEGER) AS days
FROM (SELECT event_id, event_type, CASE WHEN user_id % 4 = 0 THEN 7 WHEN user_id % 4 = 1 THEN 30 WHEN user_id % 4 = 2 THEN 5 END AS age FROM events)"""
)
def freshness(spark, folder):
    """age bounds of a search request."""
    user = F.col("user_id") % 4
    age = F.when(user == 0, 7).when(user == 1, 30).when(user == 2, 5)
    mode = F.when(F.col("event_type") == "view", "fast").otherwise("")
    return load(spark, folder, "events").select("event_id", R.freshness_days(age, mode).cast("int").alias("days"))


