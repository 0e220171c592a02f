import gzip
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.operators import quantiles as quantiles_module
from pageloom.operators.crawl import crawl_site
from pageloom.operators.images import encode_images
from pageloom.operators.quantiles import exact_quantiles
from pageloom.operators.runlog import request_metrics
from pageloom.operators.scrape import scrape
from pageloom.plans import QUERIES, stream_queries
from pageloom.session import materialize_counted, scratch_root
from pageloom.sources.tables import expire_cache, pages_from, read_cache, read_image_files, summaries, write_cache, write_results_json
from pageloom.streaming.jobs import answer_repeats, rejects_of, stream_cached_scrape, stream_queue_depth, stream_scrape
from pageloom.sources.tasks import decode_tasks, rejected, runnable, stream_tasks

PAD = "<p>Paragraph of meaningful content for testing purposes.</p>" * 100


def test_quantiles_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 30}", float(rng.choice([rng.randrange(50), rng.random() * 1000]))) for i in range(6000)]
    df = spark.createDataFrame(rows + [("one", 4.0), ("none", None)], "g string, v double").repartition(8)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: tuple(round(r[n], 9) for n in shares) for r in exact_quantiles(df, "g", "v", shares).collect()}
    frame = pd.DataFrame(rows + [("one", 4.0)], columns=["g", "v"]).groupby("g")["v"]
    want = {g: tuple(round(float(x), 9) for x in s.quantile(list(shares.values()))) for g, s in frame}
    assert got == want


def test_hot_group_is_split(spark, monkeypatch):
    """The only group's values end up in several chunks."""
    kept = []
    original = quantiles_module.materialize
    monkeypatch.setattr(quantiles_module, "materialize", lambda df, label: kept.append(original(df, label)) or kept[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(10_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
        row = exact_quantiles(df, "g", "v", {"p50": 0.5}).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert row.p50 == 4999.5 and kept[0].select("_chunk").distinct().count() > 1


def test_metrics(spark):
    log = spark.range(100).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 10).cast("int"))).alias("ts"),
        F.col("id").cast("double").alias("latency_ms"),
        (F.col("id") % 10 == 0).alias("failed"),
    )
    rows = request_metrics(log).orderBy("window_start").collect()
    assert [(r.n, r.error_rate, r.p50) for r in rows] == [(50, 0.2, 47.0), (50, 0.0, 52.0)]


def test_crawl_uses_rendered_snapshots(spark):
    """Smart crawls follow the links of the rendered page where the static one
    is a shell, and fail with its error where rendering failed."""
    shell = '<div id="root"></div><a href="/static">s</a>'
    pages = spark.createDataFrame(
        [(1, "https://e.com/", shell), (2, "https://e.com/r1", PAD), (3, "https://e.com/r2", shell), (4, "https://e.com/static", PAD)],
        "page_id long, url string, html string",
    )
    rendered = spark.createDataFrame(
        [("https://e.com/", '<a href="/r1">a</a><a href="/r2">b</a>', "dynamic", None), ("https://e.com/r2/", "x", "dynamic", "boom")],
        "url string, html string, engine string, error string",
    )
    jobs = spark.createDataFrame([("s", "https://e.com", "smart"), ("t", "https://e.com", "static")], "crawl_id string, url string, mode string")
    rows = crawl_site(jobs, pages, rendered).orderBy("crawl_id", "seq").collect()
    assert [(r.crawl_id, r.url, r.engine, r.error) for r in rows] == [
        ("s", "https://e.com", "dynamic", None),
        ("s", "https://e.com/r1", "static", None),
        ("s", "https://e.com/r2", "dynamic", "boom"),
        ("t", "https://e.com", "static", None),
        ("t", "https://e.com/static", "static", None),
    ]


def test_duplicate_snapshots_and_hot_url(spark):
    """Many requests for one page, which has several snapshots."""
    pages = spark.createDataFrame(
        [(5, "https://e.com/a/", "second" + PAD), (2, "https://e.com/a", "first" + PAD), (9, "https://e.com/a#x", "third" + PAD)],
        "page_id long, url string, html string",
    )
    requests = spark.range(500).select(F.col("id").alias("request_id"), F.lit("https://e.com/a").alias("url"))
    rows = scrape(requests, pages).collect()
    assert len(rows) == 500 and {r.html[:5] for r in rows} == {"first"}
    assert summaries(scrape(requests, pages)).first().summary == "Scraped https://e.com/a successfully"


def test_rendered_copies_are_settled(spark):
    pages = spark.createDataFrame([(1, "https://e.com/a", PAD)], "page_id long, url string, html string")
    twin = ("https://e.com/a", "r" + PAD, "dynamic", None)
    rendered = spark.createDataFrame([twin, twin], "url string, html string, engine string, error string")
    requests = spark.createDataFrame([(1, "https://e.com/a", "dynamic")], "request_id long, url string, mode string")
    assert [r.html[0] for r in scrape(requests, pages, rendered).collect()] == ["r"]


def test_page_producer(spark):
    def produce(frames):
        for frame in frames:
            yield frame.assign(html="<p>" + frame["url"] + "</p>")[["page_id", "url", "html"]]

    urls = spark.createDataFrame([(1, "u1"), (2, "u2")], "page_id long, url string")
    assert sorted(r.html for r in pages_from(urls, produce).collect()) == ["<p>u1</p>", "<p>u2</p>"]


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    (tmp_path / "big.png").write_bytes(bytes(5 * 1024 * 1024 + 1))
    stored = read_image_files(spark, str(tmp_path), "https://cdn/")
    images = spark.createDataFrame([(1, "https://cdn/a.png"), (2, "https://cdn/big.png")], "page_id int, url string")
    rows = encode_images(images, stored).orderBy("page_id").collect()
    assert [(r.mime_type, r.size_bytes) for r in rows] == [("image/png", 8), (None, None)]
    assert rows[1].error == "image exceeded size limit (5242880 bytes max)"


def entries_of(spark, *days):
    rows = spark.createDataFrame([("k", d) for d in days], "cache_key string, d int")
    return rows.select(
        "cache_key", F.expr("timestamp'2024-01-01 12:00:00' + make_dt_interval(d)").alias("cached_at"), F.lit("r").alias("result")
    )


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert read_cache(spark, path) is None and expire_cache(spark, path, "2024-01-05") == []
    write_cache(entries_of(spark, 1, 9), path)
    assert read_cache(spark, path).count() == 2
    assert read_cache(spark, path, "2024-01-05").count() == 1
    assert read_cache(spark, path, "2024-01-03", "2024-01-09") is None


def test_cache_by_batch(spark, tmp_path):
    path = str(tmp_path / "cache")
    for batch in range(4):
        write_cache(entries_of(spark, batch, batch + 10), path, batch)
    write_cache(entries_of(spark, 2, 12), path, 2)  # runs again
    assert read_cache(spark, path).count() == 8
    seen = read_cache(spark, path, "2024-01-02", "2024-01-12", before_batch=2)
    assert sorted(str(r.cached_at.date()) for r in seen.collect()) == ["2024-01-02", "2024-01-11", "2024-01-12"]
    plan = seen._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "cached_on" in filters and "batch_id" in filters
    # of the days written, 1 to 4 and 11 to 14, only the asked ones are listed
    assert {f.split("cached_on=")[1][8:10] for f in seen.inputFiles()} == {"02", "03", "04", "11", "12"}
    assert expire_cache(spark, path, "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert read_cache(spark, path).count() == 6


def test_cached_stream_over_many_days(spark, tmp_path):
    """One file a batch: every day a request for one page. Days that no later
    request can hit are dropped; hits and misses are those of the rule."""
    tasks, out, cache = (str(tmp_path / name) for name in ("tasks", "out", "cache"))
    days = [0, 1, 6, 7, 8, 13, 14, 15, 30, 31]
    pages = spark.createDataFrame([(1, "https://e.com/a", PAD)], "page_id long, url string, html string")
    payload = '{"url":"https://e.com/a","mode":"static"}'
    for day in days:
        row = spark.createDataFrame([(str(day), "scrape:url", payload, day)], "task_id string, task_type string, payload string, d int")
        at = F.expr("timestamp'2024-01-01 12:00:00' + make_dt_interval(d)").alias("ts")
        row.select("task_id", "task_type", at, "payload").coalesce(1).write.mode("append").json(tasks)
        stream_cached_scrape(spark, tasks, pages, cache, out, str(tmp_path / "cp"), max_files=1).awaitTermination()
    got = {int(r.request_id): r.cached for r in spark.read.parquet(out).collect()}
    assert got == {d: d not in (0, 7, 14, 30) for d in days}
    assert sorted(p.name for p in (tmp_path / "cache").glob("cached_on=*")) == ["cached_on=2024-01-31"]


def test_repeats_by_request_id(spark):
    """Rows of an id that is answered from the batch count as cached; without id, neither hit nor entry."""
    rows = [
        ("k", 0, "a", True, False), ("k", 1, "b", True, False), ("k", 8, "c", True, False), ("x", 0, "d", True, False),
        ("y", 0, "d", True, False), ("y", 1, "d", True, False), ("z", 0, None, True, False), ("z", 1, "e", True, False),
        ("w", 0, "f", False, False), ("v", 0, "b", False, False), ("u", 0, "g", True, False), ("u", 0, "g", True, False),
        ("k", 2, "h", False, True), ("t", 0, "i", None, False),
    ]
    first = spark.createDataFrame(rows, "cache_key string, d int, request_id string, cacheable boolean, cached boolean").select(
        "cache_key", F.expr("timestamp'2024-01-03 12:00:00' + make_dt_interval(d)").alias("ts"), "request_id", "cacheable", "cached",
        F.create_map(F.lit("engine"), F.lit("colly")).alias("metadata"), F.lit("u").alias("url"), F.lit("m").alias("markdown"),
        F.lit("<p>").alias("html"), F.lit(None).cast("array<string>").alias("page_images"), F.lit(None).cast("string").alias("error"),
    )
    answers, entries = answer_repeats(first)
    assert answers.columns == first.columns
    got = sorted((r.cache_key, r.ts.day - 3, r.request_id or "", r.cached, "cached" in r.metadata) for r in answers.collect())
    hits = {("k", 1, "b"), ("x", 0, "d"), ("y", 0, "d"), ("y", 1, "d"), ("z", 1, "e"), ("v", 0, "b")}
    assert got == sorted(
        (k, d, i or "", c or (k, d, i) in hits, (k, d, i) in hits) for k, d, i, _, c in rows
    )
    made = sorted((r.cache_key, r.cached_at.day - 3) for r in entries.collect())
    assert made == [("k", 0), ("k", 8), ("u", 0), ("u", 0), ("x", 0), ("y", 0), ("y", 1)]


def test_streamed_cache_writes_side_by_side(spark, data, monkeypatch):
    """Task files grow with the cluster, and each half of the time is a batch of its own."""
    seen, run = [], stream_queries.stream_cached_scrape

    def spy(spark_, path, *args, **named):
        seen.append(len(spark_.read.json(path).inputFiles()))
        return run(spark_, path, *args, **named)

    monkeypatch.setattr(stream_queries, "stream_cached_scrape", spy)
    QUERIES["streamed_cache"](spark, data)
    cores = spark.sparkContext.defaultParallelism
    assert cores > 2 and seen == [cores, 2 * cores]


def test_streamed_cache_of_a_late_log(spark, tmp_path):
    """No request in the first half: the rest is not dealt to two batches out of time order."""
    rows = spark.range(40).select(
        F.col("id").alias("event_id"), F.expr("timestamp'2024-01-14 00:00:00' + make_dt_interval(0, cast(id * 5 AS int))").alias("ts"), F.lit(7).cast("long").alias("user_id")
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {int(r.event_id): r.cache_hit for r in QUERIES["streamed_cache"](spark, str(tmp_path)).collect()}
    assert got == {i: i % 34 != 0 for i in range(40)}


def test_decode_tasks_in_one_scan(spark, tmp_path):
    rows = [
        ("a", "scrape:url", '{"url":"https://e.com/a","images":true,"maxDepth":"x"}'), ("b", "crawl:site", '{"url":"https://e.com/b","maxDepth":3}'),
        ("c", "crawl:site", '{"url":"https://e.com/b","maxDepth":"x"}'), ("d", "crawl:site", '{"limit":3}'), ("e", "scrape:url", None),
        ("f", "scrape:url", "{bad"), ("g", "media:url", '{"url":"https://e.com/m"}'), ("h", None, "{}"), ("i", "scrape:url", "[]"), ("j", "scrape:url", ""),
    ]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "task_id string, task_type string, payload string").withColumn("ts", F.lit(None).cast("timestamp")).write.parquet(path)
    decoded = decode_tasks(spark.read.parquet(path))
    assert decoded._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    errors = {r.task_id: r.error for r in decoded.collect()}
    bad, none, type_ = "failed to unmarshal payload", "URL is required", "unknown task type"
    assert errors == {"a": None, "b": None, "c": bad, "d": none, "e": bad, "f": bad, "g": type_, "h": type_, "i": bad, "j": bad}
    assert [tuple(r) for r in runnable(decoded, "crawl:site", "crawl_id").select("crawl_id", "url", "maxDepth").collect()] == [("b", "https://e.com/b", 3)]
    kept = {r.task_id: r.payload for r in rejected(decoded, "scrape:url").collect()}
    assert kept == {t: p for t, k, p in rows if t in "efghij"}


def test_counted_write_and_scratch(spark):
    out, n = materialize_counted(spark.range(7).toDF("x"), "t")
    assert n == 7 and out.count() == 7 and scratch_root(spark)


@pytest.fixture
def task_dir(spark, tmp_path):
    rows = [(str(i), "scrape:url", f"2024-01-01 00:0{i % 5}:00", '{"url":"https://e.com/a"}' if i % 4 else "{bad") for i in range(12)]
    tasks = spark.createDataFrame(rows, "task_id string, task_type string, ts string, payload string")
    path = str(tmp_path / "tasks")
    tasks.withColumn("ts", F.col("ts").cast("timestamp")).write.json(path)
    return path


def test_stream_is_replayable(spark, task_dir, tmp_path):
    """A second start on the same checkpoint adds nothing."""
    pages = spark.createDataFrame([(1, "https://e.com/a", PAD)], "page_id long, url string, html string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        stream_scrape(spark, task_dir, pages, out, checkpoint, with_images=False).awaitTermination()
        assert spark.read.parquet(out).count() == 9
        rejected = spark.read.parquet(rejects_of(out)).collect()
        assert sorted((r.task_id, r.error) for r in rejected) == [(i, "failed to unmarshal payload") for i in ("0", "4", "8")]


def test_stream_rejects_requests_without_url(spark, tmp_path):
    rows = [("a", '{"url":""}'), ("b", '{"mode":"static"}'), ("c", '{"url":"https://e.com/a"}')]
    tasks = spark.createDataFrame(rows, "task_id string, payload string")
    path, out = str(tmp_path / "tasks"), str(tmp_path / "out")
    tasks.select("task_id", F.lit("scrape:url").alias("task_type"), F.lit("2024-01-01").alias("ts"), "payload").write.json(path)
    pages = spark.createDataFrame([(1, "https://e.com/a", PAD)], "page_id long, url string, html string")
    stream_scrape(spark, path, pages, out, str(tmp_path / "cp"), with_images=False).awaitTermination()
    rejected = spark.read.parquet(rejects_of(out)).collect()
    assert sorted((r.task_id, r.error, r.payload) for r in rejected) == [("a", "URL is required", '{"url":""}'), ("b", "URL is required", '{"mode":"static"}')]
    assert [r.request_id for r in spark.read.parquet(out).collect()] == ["c"]


def test_queue_depth_stream(spark, task_dir, tmp_path):
    depth = stream_queue_depth(stream_tasks(spark, task_dir))
    q = depth.writeStream.format("memory").queryName("depth").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert spark.sql("SELECT sum(n), count(*) FROM depth").first()[:] == (12, 5)


@pytest.mark.parametrize("held, most", [(("10000", "67108864b"), (1000, 16 << 20)), (("300", "1000000"), (300, 1_000_000))])
def test_scrape_bounds_what_a_worker_holds(spark, held, most):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, held):
            spark.conf.set(name, value)
        pages = spark.createDataFrame([(1, "https://a.org/1", PAD)], "page_id long, url string, html string")
        asked = spark.createDataFrame([(1, "https://a.org/1", "static")], "request_id long, url string, mode string")
        assert scrape(asked, pages).first().markdown
        assert [int(spark.conf.get(name)) for name in names] == list(most)  # lower ones stay
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_json_documents_are_packed_fast(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["page", "of", "some", "site", "with", "words", str(rng.random())]) for _ in range(3000)), None) for i in range(30)]
    out = str(tmp_path / "documents")
    write_results_json(spark.createDataFrame(rows, "id int, html string, error string").coalesce(1), out)
    (file,) = (tmp_path / "documents").glob("*.json.gz")
    data = gzip.decompress(file.read_bytes())
    assert [json.loads(line) for line in data.splitlines()] == [{"id": i, "html": html} for i, html, _ in rows]
    fast, usual = (len(gzip.compress(data, level)) for level in (1, 6))
    size = file.stat().st_size
    assert abs(size - fast) < abs(size - usual)
