"""Structured Streaming jobs over the whole tables; the SQL is the batch
answer they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crawl import crawl_graph
from ..operators.pages import page_index
from ..operators.runlog import sketched_metrics
from ..session import materialize, scratch_path
from ..sources.tables import read_results_json
from ..streaming.jobs import documents_folder, stream_cached_scrape, stream_crawl, stream_metrics, stream_scrape
from . import cache_queries  # noqa: F401  (registers the SQL reused below)
from .crawl_queries import _HEAD, DOCUMENT, SQL_DOCUMENTS, document_rows
from .inputs import marked_pages, rendered_pages, site_jobs, site_pages
from .registry import ORACLES, load, query
from .scrape_queries import _DECIDED, _requests


def _write_tasks(tasks: DataFrame, files: int) -> str:
    path = scratch_path(tasks.sparkSession, "tasks")
    tasks.repartitionByRange(files, "ts", "task_id").sortWithinPartitions("ts", "task_id").write.json(path)
    return path


#: Task files written at once, and taken by a batch, at most.
MOST_FILES = 1000


def _append_tasks(tasks: DataFrame, path: str) -> None:
    """As many files as the cluster writes side by side, however the input is split."""
    files = max(2, min(MOST_FILES, tasks.sparkSession.sparkContext.defaultParallelism))
    tasks.repartition(files, "task_id").write.mode("append").json(path)


def _finish(query_, spark: SparkSession, out: str) -> DataFrame:
    query_.awaitTermination()
    return spark.read.option("mergeSchema", "false").parquet(out).drop("batch_id")


@query(f"{_DECIDED} SELECT CAST(request_id AS VARCHAR) AS request_id, mode, engine, error FROM decided WHERE url <> ''")
def streamed_scrape(spark, folder):
    """JSON tasks through a stream equal the batch."""
    requests = _requests(spark, folder)
    payload = F.to_json(F.struct("url", "render", "mode", "screenshot", "images"))
    tasks = requests.select(
        F.col("request_id").cast("string").alias("task_id"),
        F.lit("scrape:url").alias("task_type"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ts"),
        payload.alias("payload"),
    )
    pages, rendered = marked_pages(spark, folder), rendered_pages(spark, folder)
    index = materialize(page_index(pages, rendered), "page-index")
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    q = stream_scrape(spark, _write_tasks(tasks, 4), pages, out, checkpoint, rendered, index, with_images=False)
    return _finish(q, spark, out).select("request_id", "mode", "engine", "error")


def _crawl_tasks(jobs: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct("url", "mode", "maxDepth", "limit"))
    return jobs.select(
        F.col("crawl_id").alias("task_id"),
        F.lit("crawl:site").alias("task_type"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ts"),
        payload.alias("payload"),
    )


def _streamed_crawls(spark: SparkSession, folder: str) -> str:
    """Output folder of a stream that ran all jobs, some of them cancelled."""
    jobs = site_jobs(spark, folder)
    pages = site_pages(spark, folder)
    index, links = crawl_graph(pages, jobs=jobs)
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    tasks = _write_tasks(_crawl_tasks(jobs), 2)
    stopped = materialize(jobs.filter("cancelled").select("crawl_id"), "cancelled")
    stream_crawl(spark, tasks, index, links, out, checkpoint, pages=pages, cancelled=stopped).awaitTermination()
    return out


@query(f"{_HEAD} SELECT * FROM visits")
def streamed_crawl(spark, folder):
    """R2: crawl jobs through a stream equal the batch."""
    rows = spark.read.parquet(_streamed_crawls(spark, folder))
    return rows.select("crawl_id", F.col("seq").cast("bigint").alias("seq"), "url", F.col("depth").cast("bigint").alias("depth"), "error")


@query(SQL_DOCUMENTS)
def streamed_crawl_documents(spark, folder):
    """The JSON documents that the stream writes, read back."""
    written = documents_folder(_streamed_crawls(spark, folder))
    return document_rows(read_results_json(spark, written, DOCUMENT))


@query(ORACLES["cache_hits"].replace("SELECT event_id, user_id,", "SELECT CAST(event_id AS VARCHAR) AS event_id,"))
def streamed_cache(spark, folder):
    """Requests in time order through a cached stream; hits and misses are
    those of the whole log."""
    log = load(spark, folder, "events")
    pages = log.groupBy("user_id").agg(F.min("event_id").alias("page_id")).select(
        "page_id",
        F.concat(F.lit("https://users.example.com/"), F.col("user_id").cast("string")).alias("url"),
        F.concat(F.lit("<p>user "), F.col("user_id").cast("string"), F.lit("</p>")).alias("html"),
    )
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("https://users.example.com/"), F.col("user_id").cast("string")).alias("url"),
            F.lit("static").alias("mode"),
        )
    )
    tasks = log.select(
        F.col("event_id").cast("string").alias("task_id"),
        F.lit("scrape:url").alias("task_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        payload.alias("payload"),
    )
    # One batch for each half of the time: the second half is written when the
    # first has been answered, and the stream goes on from its checkpoint.
    path = scratch_path(spark, "tasks")
    middle = F.lit("2024-01-13 00:00:00").cast("timestamp")
    out, checkpoint, cache = (scratch_path(spark, f"stream-{name}") for name in ("out", "checkpoint", "cache"))
    stored = materialize(pages, "pages")
    for half in (F.col("ts") < middle, F.col("ts") >= middle):
        _append_tasks(tasks.filter(half), path)
        q = stream_cached_scrape(spark, path, stored, cache, out, checkpoint, max_files=MOST_FILES)
        q.awaitTermination()
    return _finish(q, spark, out).select(F.col("request_id").alias("event_id"), F.col("cached").alias("cache_hit"))



@query(
    """WITH closed AS (SELECT *, time_bucket(INTERVAL '5 minutes', ts) AS start FROM events)
SELECT epoch_us(start) AS window_start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM closed WHERE start + INTERVAL '15 minutes' <= (SELECT max(ts) FROM events) GROUP BY start"""
)
def streamed_metrics(spark, folder):
    """Error rate and percentiles of a log stream, all windows that its
    watermark has closed. Windows of up to 200 rows are exact."""
    log = load(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed")
    )
    path = scratch_path(spark, "request-log")
    log.repartitionByRange(4, "ts").write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    out = scratch_path(spark, "stream-out")
    stream_metrics(stream, out, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    found = sketched_metrics(spark.read.parquet(out), {"p50": 0.5, "p95": 0.95})
    return found.select(F.unix_micros("window_start").alias("window_start"), "n", F.round("error_rate", 4).alias("error_rate"), "p50", "p95")
