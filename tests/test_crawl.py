import gzip
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pageloom.operators.crawl import (
    crawl,
    crawl_documents,
    crawl_graph,
    crawl_page,
    crawl_site,
    crawl_summary,
    explode_results,
)
from pageloom.sources.tables import write_results_json

E = "https://example.com"
PAD = "<p>Paragraph of meaningful content for testing purposes.</p>" * 100


def site(spark, graph):
    rows = [
        (i, E + path, "".join(f'<a href="{h}">x</a>' for h in hrefs) + PAD) for i, (path, hrefs) in enumerate(graph.items())
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


CASES = {
    # name: graph, maxDepth, limit, total, failed, status, depth and limit in the answer
    "depth": ({"/": ["/about", "/docs"], "/about": ["/team"], "/docs": ["/api"], "/team": [], "/api": []}, 2, 100, 5, [], "completed", (2, 100)),
    "max depth": ({"/": ["/level1"], "/level1": ["/level2"], "/level2": []}, 1, 100, 2, [], "completed", (1, 100)),
    "limit": ({"/": [f"/p{i}" for i in range(1, 6)], **{f"/p{i}": [] for i in range(1, 6)}}, 5, 3, 3, [], "completed", (5, 3)),
    "cycle": ({"/": ["/about"], "/about": ["/", "/about", "/about/", "/#x"]}, 10, 100, 2, [], "completed", (10, 100)),
    "partial": ({"/": ["/good", "/broken"], "/good": []}, 2, 100, 2, ["/broken"], "partial", (2, 100)),
    "all fail": ({"/other": []}, 2, 10, 0, [""], "failed", (2, 10)),
    "external": ({"/": ["/about", "https://evil.com/x", "https://google.com"], "/about": []}, 5, 100, 2, [], "completed", (5, 100)),
    "defaults": ({"/": []}, 0, 0, 1, [], "completed", (2, 10)),
    "caps": ({"/": []}, 99, 9999, 1, [], "completed", (10, 100)),
    "resources": ({"/": ["/page", "/f.pdf", "/i.png", "/s.css", "/d.json"], "/page": []}, 5, 100, 2, [], "completed", (5, 100)),
    "budget freed": ({"/": ["/bad", "/ok", "/x"], "/ok": ["/y"], "/x": [], "/y": []}, 5, 3, 3, ["/bad"], "partial", (5, 3)),
}


@pytest.fixture(scope="module")
def all_cases(spark):
    """Every case on a host of its own, crawled together."""
    pages, jobs = [], []
    for n, (graph, depth, limit, *_) in enumerate(CASES.values()):
        host = f"https://c{n}.example.com"
        for path, hrefs in graph.items():
            links = "".join(f'<a href="{h}">x</a>' for h in hrefs)
            pages.append((len(pages), host + path, links + PAD))
        jobs.append((str(n), host + "/", depth, limit, False))
    jobs.append(("cancelled", "https://c0.example.com", 5, 100, True))
    jobs.append(("again", "https://c0.example.com/#same", 2, 100, False))
    page_df = spark.createDataFrame(pages, "page_id long, url string, html string")
    job_df = spark.createDataFrame(jobs, "crawl_id string, url string, maxDepth int, limit int, cancelled boolean")
    found = crawl_site(job_df, page_df)
    return found, job_df, {r.crawl_id: r for r in crawl_summary(found, job_df).collect()}


@pytest.mark.parametrize("n, name", list(enumerate(CASES)))
def test_case(all_cases, n, name):
    _, _, _, total, failed, status, bounds = CASES[name]
    host = f"https://c{n}.example.com"
    row = all_cases[2][str(n)]
    assert (row.total, row.status, (row.maxDepth, row.limit)) == (total, status, bounds)
    assert [f.url for f in row.failedUrls or []] == [host + p for p in failed]


def test_budget_order(all_cases):
    row = all_cases[2][str(list(CASES).index("budget freed"))]
    assert [d.url.rsplit("com", 1)[1] for d in row.data] == ["", "/ok", "/y"]


def test_cancelled_and_repeated_jobs(all_cases):
    found, _, rows = all_cases
    assert rows["cancelled"].status == "cancelled" and rows["cancelled"].total == 0
    assert rows["again"].total == rows["0"].total == 5
    assert found.filter("crawl_id = 'again'").count() == 5


def test_explode_and_batches(all_cases):
    found, jobs, rows = all_cases
    summary = crawl_summary(found, jobs)
    assert explode_results(summary).count() == found.count()
    batch = {r.crawl_id: r for r in crawl_page(found, summary, offset=1, limit=2).collect()}
    assert batch["0"].pages == [d.url for d in rows["0"].data[1:3]]
    assert (batch["0"].next_offset, batch["0"].progress, batch["cancelled"].returned) == (3, 5, 0)


def sequential(graph, seed, depth, limit):
    """The rules, one page at a time."""
    queue, visited, out, done = deque([(seed, 0)]), {seed}, [], 0
    while queue and done < limit:
        url, d = queue.popleft()
        if url not in graph:
            out.append((url, d, "page not found"))
            continue
        done += 1
        out.append((url, d, None))
        if d < depth and done < limit:
            for link in graph[url]:
                if link not in visited and len(queue) + done < limit:
                    visited.add(link)
                    queue.append((link, d + 1))
    return out


def test_random_graphs(spark):
    """300 random sites with missing pages and small limits, crawled in one go
    and compared page by page with the sequential rules."""
    rng = random.Random(7)
    index, links, jobs, expected = [], [], [], {}
    for n in range(300):
        size = rng.randint(2, 30)
        graph = {}
        for v in range(size):
            if v == 0 or rng.random() > rng.choice([0.0, 0.3, 0.6]):
                graph[f"{n}/{v}"] = [f"{n}/{rng.randrange(size)}" for _ in range(rng.randint(0, 8))]
        for v, targets in graph.items():
            index.append((v, len(index), None, False, None, "dynamic scraper not configured", True, False))
            for pos, target in enumerate(dict.fromkeys(targets)):
                links.append((v, index[-1][1], "static", pos, target))
        depth, limit = rng.randint(1, 10), rng.randint(1, 12)
        jobs.append((str(n), f"{n}/0", "static", depth, limit))
        expected[str(n)] = sequential(graph, f"{n}/0", depth, limit)
    index_df = spark.createDataFrame(
        index,
        "page_key string, static_id long, static_error string, needs_dynamic boolean, dynamic_id long, dynamic_error string, has_static boolean, has_dynamic boolean",
    )
    link_df = spark.createDataFrame(links, "page_key string, page_id long, engine string, pos int, link_norm string")
    job_df = spark.createDataFrame(jobs, "crawl_id string, url string, mode string, maxDepth int, limit int")
    got = {}
    for row in crawl(job_df, index_df, link_df).orderBy("crawl_id", "seq").collect():
        got.setdefault(row.crawl_id, []).append((row.url, row.depth, row.error))
    assert got == expected


def test_many_links_on_one_page(spark):
    """More candidates than places: the first ones in link order are taken."""
    pages = site(spark, {"/": [f"/p{i}" for i in range(3000)], **{f"/p{i}": [f"/q{i}"] for i in range(0, 400, 2)}})
    jobs = spark.createDataFrame([("a", E, 3, 100)], "crawl_id string, url string, maxDepth int, limit int")
    rows = crawl_site(jobs, pages).orderBy("seq").collect()
    graph = {E: [f"{E}/p{i}" for i in range(3000)], **{f"{E}/p{i}": [f"{E}/q{i}"] for i in range(0, 400, 2)}}
    assert [(r.url, r.depth, r.error) for r in rows] == sequential(graph, E, 3, 100)


def test_patterns(spark):
    pages = site(spark, {"/": ["/blog/1", "/admin/x", "/docs"], "/blog/1": ["/blog/2", "/blog/logout"], "/blog/2": []})
    jobs = spark.createDataFrame([("a", E, 5, 10)], "crawl_id string, url string, maxDepth int, limit int")
    rows = crawl_site(jobs, pages, include_patterns=("/blog.*", "/docs"), exclude_patterns=(".*logout.*",)).collect()
    assert sorted(r.url for r in rows) == [E, f"{E}/blog/1", f"{E}/blog/2", f"{E}/docs"]


def test_summary_with_documents(spark):
    pages = site(spark, {"/": ["/a"], "/a": []})
    jobs = spark.createDataFrame([("a", E, 5, 10)], "crawl_id string, url string, maxDepth int, limit int")
    docs = spark.createDataFrame([(E, "static", "root"), (f"{E}/a", "static", "leaf")], "page_key string, engine string, markdown string")
    docs = docs.withColumn("metadata", F.create_map(F.lit("engine"), F.lit("colly")))
    row = crawl_summary(crawl_site(jobs, pages), jobs, docs).first()
    assert [(d.url, d.markdown, d.metadata) for d in row.data] == [(E, "root", {"engine": "colly"}), (f"{E}/a", "leaf", {"engine": "colly"})]


def test_seed_that_cannot_be_parsed(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", "<p>x</p>" * 300)], "page_id long, url string, html string")
    jobs = spark.createDataFrame([("bad", "http://[bad"), ("good", "https://e.com")], "crawl_id string, url string")
    rows = {r.crawl_id: r for r in crawl_site(jobs, pages).collect()}
    assert rows["bad"].error == 'invalid seed URL "http://[bad"' and rows["good"].error is None


def above(plan, table):
    """Nodes between a scan of ``table`` and the join above it, per scan."""
    lines = [(len(line) - len(line.lstrip(" :+-*")), line) for line in plan.splitlines()]
    found = []
    for i, (depth, line) in enumerate(lines):
        if "FileScan" in line and f".{table}_" in line:
            path = []
            for other, parent in reversed(lines[:i]):
                if other < depth:
                    depth = other
                    path.append(parent.strip(" :+-"))
                    if "Join" in parent:
                        break
            found.append(path)
    return found


def test_levels_move_the_frontier_only(spark, monkeypatch):
    """Three levels with broadcast off: no exchange over links or index."""
    import pageloom.operators.crawl as module

    plans = []
    original = module.materialize_counted

    def keep(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return original(df, label)

    monkeypatch.setattr(module, "materialize_counted", keep)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = site(spark, {"/": ["/a", "/b"], "/a": ["/c"], "/b": ["/d"], "/c": [], "/d": []})
        jobs = spark.createDataFrame([("a", E, 2, 50)], "crawl_id string, url string, maxDepth int, limit int")
        assert crawl_site(jobs, pages).count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    levels = [plan for label, plan in plans if label.startswith("crawl-level")]
    assert len(levels) >= 3
    for depth, plan in enumerate(levels):
        scans = above(plan, "page_index") + (above(plan, "crawl_links") if depth else [])
        assert len(scans) == (2 if depth else 1)
        for path in scans:
            assert "SortMergeJoin" in path[-1] and not [node for node in path if "Exchange" in node]


def test_html_is_read_once(spark, tmp_path):
    """One scan of the pages, with and without a broadcast of the hosts."""
    import pageloom.operators.crawl as module

    site(spark, {"/": ["/a"], "/a": []}).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    other = spark.createDataFrame([(9, "https://elsewhere.org/", PAD)], "page_id long, url string, html string")
    jobs = spark.createDataFrame([("a", E, 2, 50)], "crawl_id string, url string, maxDepth int, limit int")
    hosts = module.normalize_jobs(jobs).select(module.hostname(F.col("url")).alias("_host")).distinct()
    plan = module._read_pages(pages, None, F.broadcast(hosts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BroadcastHashJoin" in plan and "hashpartitioning(_host" not in plan.split("FileScan")[0].split("Broadcast")[0]
    for few in (0, 100):
        index, links = crawl_graph(pages.union(other), None, jobs, few_hosts=few)
        assert sorted(r.page_key for r in index.collect()) == [E, f"{E}/a"]
        assert [(r.page_key, r.link_norm) for r in links.collect()] == [(E, f"{E}/a")]


def test_documents(spark, tmp_path):
    body = '<img src="/i.png" alt="i"><a href="/a">x</a>'
    pages = spark.createDataFrame(
        [(1, E + "/", body + PAD), (2, E + "/a", PAD), (3, "https://two.org/", "<a href='/gone'>x</a>" + PAD)], "page_id long, url string, html string"
    )
    jobs = spark.createDataFrame(
        [("plain", E, False, False), ("pictures", E, True, False), ("stopped", E, True, True), ("partial", "https://two.org", False, False), ("none", "https://three.org", False, False)],
        "crawl_id string, url string, images boolean, cancelled boolean",
    )
    found = crawl_site(jobs, pages)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    write_results_json(crawl_documents(found, jobs, pages, as_of=at), str(tmp_path / "out"))
    lines = [json.loads(line) for path in (tmp_path / "out").glob("*.json.gz") for line in gzip.open(path, "rt")]
    rows = {row.pop("crawl_id"): row for row in lines}
    assert {k: (r["status"], r["total"]) for k, r in rows.items()} == {
        "plain": ("completed", 2), "pictures": ("completed", 2), "stopped": ("cancelled", 0), "partial": ("partial", 1), "none": ("failed", 0),
    }
    first = rows["pictures"]["data"][0]
    assert first["url"] == E and first["html"] == body + PAD and first["metadata"] == {"scraped_at": "2024-02-01T00:00:00Z", "engine": "colly"}
    assert [i["url"] for i in first["images"]] == [E + "/i.png"]
    assert [sorted(d) for d in rows["plain"]["data"]] == [["html", "markdown", "metadata", "url"]] * 2
    assert rows["partial"]["failedUrls"] == [{"url": "https://two.org/gone", "error": "page not found"}]
    assert "failedUrls" not in rows["plain"] and [d["url"] for d in rows["plain"]["data"]] == [E, f"{E}/a"]
    bare = crawl_documents(found, jobs, pages).filter("crawl_id = 'plain'").first()
    assert bare.data[0].metadata == {"engine": "colly"}
