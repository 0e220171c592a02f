import datetime as dt

import pytest
from pyspark.sql import functions as F

from pageloom.operators import documents as D
from pageloom.operators import runlog
from pageloom.operators.runlog import metric_sketches, sketched_metrics
from pageloom.operators.search import ranked, search, search_and_scrape, search_page
from pageloom.sources.tasks import crawl_jobs, decode, provider_responses, scrape_requests
from pageloom import schemas
from pageloom.streaming.jobs import stream_metrics


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (i, f"T{i}", f"https://{'sub.' if i % 2 else ''}s{i % 3}.com/{i}", f"d{i}", "Spark " * (i % 7) + f"word{i} Native Speed", f"{'sub.' if i % 2 else ''}s{i % 3}.com")
        for i in range(150)
    ]
    ts = F.lit("2024-02-01 00:00:00").cast("timestamp") - F.make_dt_interval(F.col("id").cast("int"))
    return spark.createDataFrame(rows, "id long, title string, url string, description string, text string, domain string").withColumn("ts", ts)


def order(query, keep=lambda i: True):
    hits = [(i % 7, i) for i in range(150) if i % 7 and keep(i)]
    return [i for _, i in sorted(hits, key=lambda h: (-h[0], h[1]))]


def titles(df):
    return [int(r.title[1:]) for r in df.orderBy("idx").collect()]


def test_ranking_and_paging(corpus):
    assert titles(search(corpus, "SPARK", 0, 0)) == order("spark")[:10]
    assert titles(search(corpus, "spark", 10, 500)) == order("spark")[10:110]
    assert titles(search(corpus, "spark", 500, 10)) == []
    row = search(corpus, "spark", 5, 3).orderBy("idx").collect()[1]
    assert (row.id, row.relevance, row.domain) == ("spark_6", 0.95, row.url.split("/")[2])
    assert search(corpus, "spark", 0, 30).agg(F.min("relevance")).first()[0] == pytest.approx(1.0 - 29 * 0.05)
    with pytest.raises(ValueError):
        search(corpus, "spark", 0, -1)
    with pytest.raises(ValueError):
        search(corpus, "  ")


def test_filters(corpus):
    assert titles(search(corpus, "spark", 0, 100, include=["s1.com"])) == order("", lambda i: i % 3 == 1)
    assert titles(search(corpus, "spark", 0, 100, exclude=["sub.s0.com", "s1.com"])) == order("", lambda i: i % 3 == 2 or (i % 3 == 0 and i % 2 == 0))
    assert titles(search(corpus, "spark", required=["WORD33 ", "native"])) == [33]
    as_of = "2024-02-01 00:00:00"
    assert titles(search(corpus, "spark", 0, 100, max_age=7, as_of=as_of)) == order("", lambda i: i <= 7)
    assert titles(search(corpus, "spark", 0, 100, mode="fast", as_of=as_of)) == [1]
    assert len(titles(search(corpus, "spark", 0, 100, max_age=5))) == 100
    assert titles(search(corpus, "spark", 0, 3, scorer=F.col("id"))) == [149, 148, 147]
    assert ranked(corpus, "absent").count() == 0


def test_response_row(corpus):
    row = search_page(corpus, "spark", 0, 20).first()
    assert (row["count"], row.hasMore, row.nextOffset, len(row.results)) == (20, True, 20, 20)
    last = search_page(corpus, "spark", 120, 20).first()
    assert (last["count"], last.hasMore, last.nextOffset) == (len(order("")) - 120, False, 140)
    assert search_page(corpus, "nothing-like-it").first()["count"] == 0


def test_search_then_scrape(spark, corpus):
    pages = spark.createDataFrame([(1, "https://s0.com/6", "<h1>Six</h1>" + "<p>text</p>" * 300)], "page_id long, url string, html string")
    rows = search_and_scrape(corpus, pages, "spark").orderBy("idx").collect()
    assert [r.title for r in rows] == ["T6", "T13", "T20"]
    assert rows[0].error is None and rows[0].preview.startswith("# Six") and len(rows[0].preview) == 203
    assert {r.error for r in rows[1:]} == {"page not found"}


def test_decode(spark):
    rows = [
        ("1", "scrape:url", '{"url":"u","render":true,"mode":"static"}'),
        ("2", "scrape:url", "{broken"),
        ("3", "crawl:site", '{"url":"u","maxDepth":3,"limit":7}'),
        ("4", "crawl:site", None),
        ("5", "other", "{}"),
    ]
    tasks = spark.createDataFrame(rows, "task_id string, task_type string, payload string").withColumn("ts", F.lit(None).cast("timestamp"))
    good, bad = scrape_requests(tasks)
    assert [(r.request_id, r.url, r.render, r.images) for r in good.collect()] == [("1", "u", True, None)]
    assert [r.task_id for r in bad.collect()] == ["2"]
    good, bad = crawl_jobs(tasks)
    assert [(r.crawl_id, r.maxDepth, r.limit) for r in good.collect()] == [("3", 3, 7)]
    assert [r.task_id for r in bad.collect()] == ["4"]
    wrong_type, bad = decode(tasks.limit(1), "payload", schemas._struct(url=schemas.INT))
    assert wrong_type.count() == 0 and bad.count() == 1


def test_provider_responses(spark):
    body = '{"web":{"results":[{"title":"a","url":"http://x.com/1","description":"d"}]},"extra":1}'
    good, bad = provider_responses(spark.createDataFrame([(body,), ("nope",)], "body string"))
    assert good.selectExpr("response.web.results[0].title t").first().t == "a" and bad.count() == 1


def test_status_lookup(spark):
    rows = [("a", "low", "done"), ("a", "critical", "active"), ("b", "other", "done"), ("c", "default", "x"), ("c", "critical", "y")]
    log = spark.createDataFrame(rows, "id string, queue string, state string")
    assert [r.state for r in runlog.crawl_status(log, "a").collect()] == ["active"]
    assert runlog.crawl_status(log, "b").count() == 0
    assert {r.id: r.queue for r in runlog.first_in_queue_order(log).collect()} == {"a": "critical", "c": "default"}


def test_retention_and_recent(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(i, "q", "completed", now - dt.timedelta(hours=i)) for i in range(300)] + [(1000 + i, "q", "failed", now - dt.timedelta(hours=i)) for i in range(200)]
    log = spark.createDataFrame(rows, "id long, queue string, state string, finished_at timestamp")
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert runlog.retained(log, as_of).count() == 169 * 2
    kept = {r.id for r in runlog.keep_recent(log, as_of).collect()}
    assert kept == set(range(100)) | set(range(1000, 1050))
    dense = log.withColumn("finished_at", as_of)
    assert runlog.keep_recent(dense, as_of).count() == 500


def test_metadata(spark):
    page = (
        '<html lang="en"><head><title> A &amp; B </title><meta name="Description" content="x"><meta property="og:title" content="O">'
        '<meta property="article:tag" content="t1"><meta property="article:tag" content="t2"><meta name=generator content="Hugo 0.1">'
        '<link rel="canonical" href="/c"><link rel="shortcut icon" href="/f.ico"></head></html>'
    )
    row = D.page_metadata(spark.createDataFrame([(1, page)], "page_id int, html string")).first()
    assert (row.title, row.description, row.og_title, row.tags, row.canonical, row.favicon, row.language, row.framework, row.og_image) == (
        "A & B", "x", "O", ["t1", "t2"], "/c", "/f.ico", "en", "hugo", None,
    )


def test_first_paragraph_and_errors(spark, evaluate):
    page = "<p> </p><div><p>First <b>one</b></div><p>two"
    row = D.first_paragraph(spark.createDataFrame([(1, page)], "page_id int, html string"), 8).first()
    assert row.summary == "First on"
    codes = evaluate(["unknown mode: x", "page not found", None, "weird"], runlog.classify_error(F.col("v")))
    assert codes == ["INVALID_MODE", "NOT_FOUND", None, "INTERNAL_ERROR"]
    assert evaluate(["TIMEOUT", "BAD_REQUEST"], runlog.is_retryable(F.col("v"))) == [True, False]


def test_sketched_metrics_within_their_bound(spark):
    """A day of 40,000 rows in windows of five minutes, merged to hours and the day."""
    log = spark.range(40_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 86_400).alias("ts"),
        (F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double") / 7).alias("latency_ms"),
        (F.col("id") % 10 == 0).alias("failed"),
    )
    sketches = metric_sketches(log)
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for every in ("1 hour", "1 day"):
        got = {r.window_start: r for r in sketched_metrics(sketches, shares, every).collect()}
        exact = log.groupBy(F.window("ts", every)["start"].alias("w")).agg(F.array_sort(F.collect_list("latency_ms")).alias("v")).collect()
        assert len(got) == len(exact) and sum(r.n for r in got.values()) == 40_000
        for row in exact:
            for name, share in shares.items():
                rank = sum(v <= got[row.w][name] for v in row.v) / len(row.v)
                assert abs(rank - share) < 0.027, (every, name)  # twice the error of k = 200
    small = sketched_metrics(metric_sketches(log.filter("id < 150")), {"p50": 0.5}, "1 day").first()
    values = sorted(r.latency_ms for r in log.filter("id < 150").collect())
    assert (small.n, small.error_rate, small.p50) == (150, 0.1, values[74])
    empty = sketched_metrics(metric_sketches(log.filter("id < 3").withColumn("latency_ms", F.lit(None).cast("double"))), {"p50": 0.5}).first()
    assert empty.p50 is None and empty.n == 3


def test_metric_stream_and_late_rows(spark, tmp_path):
    """Each start of the stream takes a file; rows behind the watermark are left out."""
    path, out, checkpoint = (str(tmp_path / name) for name in ("log", "out", "cp"))
    schema = "ts timestamp, latency_ms double, failed boolean"

    def add(*minutes):
        rows = spark.createDataFrame([(m, float(m)) for m in minutes], "m int, latency_ms double")
        at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("m") * 60).alias("ts")
        rows.select(at, "latency_ms", (F.col("m") % 2 == 0).alias("failed")).coalesce(1).write.mode("append").parquet(path)
        stream_metrics(spark.readStream.schema(schema).parquet(path), out, checkpoint).awaitTermination()

    add(1, 2, 3, 8)
    add(4, 31)  # 4 is late, but within the watermark of minute 8
    add(2, 9, 40)  # behind the watermark of minute 31
    add(70)
    rows = sketched_metrics(spark.read.parquet(out), {"p50": 0.5}).orderBy("window_start").collect()
    assert [(r.window_start.minute, r.n, r.error_rate, r.p50) for r in rows] == [(0, 4, 0.5, 2.0), (5, 1, 1.0, 8.0), (30, 1, 0.0, 31.0), (40, 1, 1.0, 40.0)]
