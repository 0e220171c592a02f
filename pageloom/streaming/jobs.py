"""Continuous request processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.requests import mark_cached
from ..operators.cache import TTL_SECONDS, cache_hit_flags
from ..operators.crawl import crawl, crawl_documents
from ..operators.runlog import metric_sketches, queue_depth
from ..operators.scrape import cache_rows, scrape
from ..session import materialize
from ..sources.tables import expire_cache, read_cache, write_cache, write_results_json
from ..sources.tasks import CRAWL_TASK, SCRAPE_TASK, decode_tasks, rejected, runnable, stream_tasks


def _start(stream: DataFrame, handle, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _batch_path(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def rejects_of(out: str) -> str:
    """Where a stream that writes to ``out`` puts the tasks it cannot run."""
    return f"{out.rstrip('/')}-rejected"


def _take(batch: DataFrame, batch_id: int, task_type: str, id_column: str, out: str) -> DataFrame:
    """The tasks of a batch that can run. The batch is read and parsed once; its
    rejects, among them tasks of unknown type, are written with their payload."""
    decoded = materialize(decode_tasks(batch), "decoded-tasks")
    rejected(decoded, task_type).write.mode("overwrite").parquet(_batch_path(rejects_of(out), batch_id))
    return runnable(decoded, task_type, id_column)


def stream_scrape(
    spark: SparkSession,
    requests_dir: str,
    pages: DataFrame,
    out: str,
    checkpoint: str,
    rendered: DataFrame | None = None,
    index: DataFrame | None = None,
    once: bool = True,
    with_images: bool = True,
) -> StreamingQuery:
    """Task files in, results out, and tasks that cannot run under ``rejects_of(out)``. The page side is static: give a stored
    ``index`` and a page store so that a batch reads only what it asks for."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        requests = _take(batch, batch_id, SCRAPE_TASK, "request_id", out)
        results = scrape(requests, pages, rendered, index=index, with_images=with_images)
        results.write.mode("overwrite").parquet(_batch_path(out, batch_id))

    return _start(stream_tasks(spark, requests_dir), handle, checkpoint, once)


def documents_folder(out: str) -> str:
    """Where a crawl stream that writes to ``out`` puts one document per crawl."""
    return f"{out.rstrip('/')}-documents"


def stream_crawl(
    spark: SparkSession,
    jobs_dir: str,
    index: DataFrame,
    links: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = True,
    pages: DataFrame | None = None,
    rendered: DataFrame | None = None,
    cancelled: DataFrame | None = None,
) -> StreamingQuery:
    """Crawl tasks in, crawled pages out; all jobs of a batch run together.

    With ``pages`` (or ``rendered``) every crawl also becomes a JSON document
    under ``documents_folder(out)``, gzip. Jobs in ``cancelled(crawl_id)`` are not
    run; they have a document that says so. Keep ``index`` and ``links`` as
    ``crawl_graph`` makes them: a batch then moves its frontier only.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        jobs = _take(batch, batch_id, CRAWL_TASK, "crawl_id", out)
        if cancelled is not None:
            stopped = cancelled.select("crawl_id").distinct().withColumn("cancelled", F.lit(True))
            jobs = materialize(jobs.join(stopped, "crawl_id", "left"), "crawl-jobs")
        found = materialize(crawl(jobs, index, links), "crawled")
        found.drop("page_id").write.mode("overwrite").parquet(_batch_path(out, batch_id))
        if pages is not None or rendered is not None:
            documents = crawl_documents(found, jobs, pages, rendered)
            write_results_json(documents, _batch_path(documents_folder(out), batch_id), "overwrite")

    return _start(stream_tasks(spark, jobs_dir), handle, checkpoint, once)


def answer_repeats(first_pass: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch answers and the cache entries it makes, from its ``scrape``.

    Of the cacheable requests that the cache did not answer, those that miss
    make entries; later ones are answered from them. All rows of a request id
    that is answered so count as cached, and a request without id as neither.

    Whole rows move once, to meet their flag. Ids are looked at apart, narrow:
    only those whose rows differ are joined again, none where ids are unique.
    """
    fresh = first_pass.filter(~F.col("cached"))
    able = F.coalesce("cacheable", F.lit(False))
    unable = fresh.filter(~able).withColumn("cache_hit", F.lit(None).cast("boolean"))
    flagged = materialize(cache_hit_flags(fresh.filter(able)).unionByName(unable), "flags")
    hit, named = F.col("cache_hit"), F.col("request_id").isNotNull()
    ids = flagged.filter(named).groupBy("request_id").agg(
        F.bool_or(hit).alias("_repeated"), F.bool_or(~hit).alias("_missed"), F.bool_or(hit.isNull()).alias("_unable")
    )
    mixed = materialize(ids.filter("_repeated AND (_missed OR _unable)").drop("_unable"), "mixed-ids")
    marked = flagged.join(mixed, "request_id", "left")
    repeated = named & (F.coalesce(hit, F.lit(False)) | F.col("_repeated").isNotNull())
    entries = cache_rows(marked.filter(named & (~hit | F.col("_missed"))), F.col("ts"))
    metadata = F.when(repeated, mark_cached(F.col("metadata"))).otherwise(F.col("metadata"))
    again = marked.withColumns({"cached": repeated, "metadata": metadata}).select(*first_pass.columns)
    return first_pass.filter("cached").unionByName(again), entries


def stream_cached_scrape(
    spark: SparkSession,
    requests_dir: str,
    pages: DataFrame,
    cache_dir: str,
    out: str,
    checkpoint: str,
    rendered: DataFrame | None = None,
    once: bool = True,
    max_files: int = 1000,
) -> StreamingQuery:
    """As ``stream_scrape``, answering from a seven-day result cache.

    A batch first asks the cache entries of earlier batches. Of its remaining
    requests the first per key and life time is scraped and written to the
    cache folder of this batch; later ones are answered from it. Requests are
    expected in time order across batches.

    The cache lies by day, so a batch lists and reads the days within one life
    time of its requests, and drops those before them: its cost does not grow
    with the number of batches before. A batch that runs again sees what it saw
    the first time, as it reads earlier batches only and has dropped no day it
    needs.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = _take(batch, batch_id, SCRAPE_TASK, "request_id", out)
        life = F.make_dt_interval(secs=F.lit(TTL_SECONDS))
        day = [F.date_format(x, "yyyy-MM-dd") for x in (F.min("ts") - life, F.max("ts"))]
        oldest, newest = stored.agg(*day).first()
        cache = None if oldest is None else read_cache(spark, cache_dir, oldest, newest, before_batch=batch_id)
        first_pass = materialize(scrape(stored, pages, rendered, cache), "first-pass")
        answers, entries = answer_repeats(first_pass)
        write_cache(entries, cache_dir, batch_id)
        answers.write.mode("overwrite").parquet(_batch_path(out, batch_id))
        if oldest is not None:
            expire_cache(spark, cache_dir, oldest)

    return _start(stream_tasks(spark, requests_dir, max_files), handle, checkpoint, once)


def stream_queue_depth(tasks: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Tasks per type and minute on a stream, late rows up to the watermark."""
    return queue_depth(tasks.withWatermark("ts", watermark), state="task_type")


def stream_metrics(
    log: DataFrame, out: str, checkpoint: str, watermark: str = "10 minutes", every: str = "5 minutes", once: bool = True
) -> StreamingQuery:
    """Sketches of a request log per window, each written once, when the watermark
    has passed it; rows later than that are left out. ``sketched_metrics`` reads
    them, in windows as long as one likes."""
    sketches = metric_sketches(log.withWatermark("ts", watermark), every=every)
    writer = sketches.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
