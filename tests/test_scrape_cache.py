import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import requests as R
from pageloom.operators import cache as cache_module
from pageloom.operators.cache import cache_hit_flags, lookup_cache, newest_entries
from pageloom.operators.joins import heavy_keys, salted_join
from pageloom.operators.scrape import decide, normalize_requests, scrape, split_requests

URL = "https://example.com/p"
RICH = "<html><body><h1>Example</h1>" + "<p>The harbour master counts the boats at noon.</p>" * 100 + "</body></html>"
SHELL = '<html><body><div id="root"></div></body></html>'


def pages(spark, html=RICH):
    return spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")


def rendered(spark, html=RICH, error=None):
    return spark.createDataFrame([(URL, html, "dynamic", error)], "url string, html string, engine string, error string")


def request(spark, mode="", screenshot=False, url=URL, render=False):
    return spark.createDataFrame(
        [(1, url, render, mode, screenshot, False)], "request_id long, url string, render boolean, mode string, screenshot boolean, images boolean"
    )


TRUTH = [
    # mode, screenshot, static html, rendered (html, error), engine, error, cacheable
    ("static", False, RICH, (RICH, None), "static", None, True),
    ("static", False, "", (RICH, None), "static", "empty response", False),
    ("dynamic", False, RICH, (RICH, None), "dynamic", None, True),
    ("dynamic", False, RICH, (RICH, "boom"), "dynamic", "boom", False),
    ("dynamic", False, RICH, ("", None), "dynamic", "empty response from browser", False),
    ("smart", True, RICH, (RICH, None), "dynamic", None, False),
    ("smart", True, RICH, (RICH, "boom"), "dynamic", "boom", False),
    ("smart", False, "", (RICH, None), "static", "empty response", False),
    ("smart", False, RICH, (RICH, None), "static", None, True),
    ("smart", False, SHELL, (RICH, None), "dynamic", None, True),
    ("smart", False, SHELL, (RICH, "boom"), "dynamic", "boom", False),
    ("", False, SHELL, (RICH, None), "dynamic", None, True),
    ("turbo", False, RICH, (RICH, None), None, "unknown mode: turbo", False),
]


@pytest.mark.parametrize("mode, shot, html, dyn, engine, error, cacheable", TRUTH)
def test_truth_table(spark, mode, shot, html, dyn, engine, error, cacheable):
    row = decide(normalize_requests(request(spark, mode, shot)), pages(spark, html), rendered(spark, *dyn)).first()
    assert (row.engine, row.error, row.cacheable) == (engine, error, cacheable)


def test_missing_engines(spark):
    only_static = decide(normalize_requests(request(spark, "dynamic")), pages(spark), None).first()
    assert only_static.error == "dynamic scraper not configured"
    only_dynamic = decide(normalize_requests(request(spark, "static")), None, rendered(spark)).first()
    assert only_dynamic.error == "static scraper not configured"
    absent = decide(normalize_requests(request(spark, "dynamic", url=URL + "/no")), pages(spark), None).first()
    assert absent.error == "dynamic scraper not configured"
    nowhere = decide(normalize_requests(request(spark, "smart", url=URL + "/no")), pages(spark), rendered(spark)).first()
    assert nowhere.error == "page not found"


def test_scrape_result_and_cache(spark):
    as_of = "2024-02-01 00:00:00"
    row = scrape(request(spark), pages(spark), as_of=as_of).first()
    assert row.metadata == {"scraped_at": "2024-02-01T00:00:00Z", "engine": "colly"}
    assert row.markdown.startswith("# Example\n\nThe harbour") and row.html == RICH and not row.cached
    stored = scrape(request(spark), pages(spark), as_of=as_of)
    from pageloom.operators.scrape import cache_rows

    entries = cache_rows(stored, F.lit("2024-01-26 00:00:00").cast("timestamp"))
    hit = scrape(request(spark), pages(spark, "changed" + RICH), cache=entries, as_of=as_of).first()
    assert hit.cached and hit.html == RICH and hit.metadata["cached"] == "true"
    late = scrape(request(spark), pages(spark, "changed" + RICH), cache=entries, as_of="2024-02-02 00:00:00").first()
    assert not late.cached and late.html == "changed" + RICH


def test_requests_move_once(spark):
    """The asked forms are settled and given their documents before requests meet them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scrape(request(spark), pages(spark), rendered(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scanned = [line for line in plan.splitlines() if "Scan ExistingRDD" in line and "request_id" in line]
    joins = [line for line in plan.splitlines() if "Join" in line and "page_key" in line and "mode" in line and "screenshot" in line]
    assert len(scanned) == 1 and len(joins) == 1
    assert plan.splitlines().index(joins[0]) < min(i for i, line in enumerate(plan.splitlines()) if "Join" in line and line not in joins)


def test_modes(evaluate):
    got = evaluate([(True, ""), (False, ""), (False, None), (False, "static"), (False, "dynamic"), (True, "static")],
                   R.resolve_mode(F.col("r"), F.col("m")), "r boolean, m string")
    assert got == ["dynamic", "smart", "smart", "static", "dynamic", "dynamic"]


def test_clamps(evaluate):
    assert evaluate([0, -1, 5, 10, 99, None], R.clamp_depth(F.col("v")), "v int") == [2, 2, 5, 10, 10, 2]
    assert evaluate([0, -1, 5, 100, 9999, None], R.clamp_crawl_limit(F.col("v")), "v int") == [10, 10, 5, 100, 100, 10]
    assert evaluate([0, 200, 7, -4, None], R.clamp_search_limit(F.col("v")), "v int") == [10, 100, 7, -4, 10]
    assert evaluate([-10, 0, 3, None], R.clamp_offset(F.col("v")), "v int") == [0, 0, 3, 0]


def test_paging(evaluate):
    cases = [(0, 10, True, 10), (10, 10, True, 20), (20, 20, True, 40), (80, 10, True, 90), (90, 10, False, 100), (95, 5, False, 100), (100, 10, False, 110)]
    got = evaluate([(o, n) for o, n, *_ in cases], F.struct(R.has_more(F.col("o"), F.col("n"), F.lit(100)), R.next_offset(F.col("o"), F.col("n"))), "o int, n int")
    assert [tuple(r) for r in got] == [(more, nxt) for *_, more, nxt in cases]


def test_envelope_omits_empties(evaluate):
    out = R.result_envelope(F.col("v"), F.lit("m"), F.lit(""), F.create_map(), F.array())
    assert evaluate(["u"], out.cast("string"))[0] == '{"url":"u","markdown":"m"}'


def test_required_fields(spark):
    df = spark.createDataFrame([(1, "u"), (2, ""), (3, None)], "request_id int, url string")
    good, bad = split_requests(df)
    assert [r.request_id for r in good.collect()] == [1]
    assert {r.error for r in bad.collect()} == {"URL is required"} and bad.count() == 2


T0 = dt.datetime(2024, 1, 3, 5)


def log(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, ts timestamp, request_id long")


def days(n):
    return T0 + dt.timedelta(days=n)


def test_cache_life(spark):
    rows = [("k", days(d), i) for i, d in enumerate([0, 3, 6.9, 7.0, 13.9, 14.0])]
    got = [r.cache_hit for r in cache_hit_flags(log(spark, rows)).orderBy("ts").collect()]
    assert got == [False, True, True, False, True, False]


def greedy(rows):
    """One request after the other."""
    out, last = {}, {}
    for key, ts, rid in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        hit = key in last and ts < last[key] + dt.timedelta(days=7)
        out[rid] = hit
        if not hit:
            last[key] = ts
    return out


def random_log(seed, heavy=False):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        key = "hot" if heavy and rng.random() < 0.4 else f"k{rng.randrange(60)}"
        span = 400 if key == "k1" else 60
        rows.append((key, days(rng.randrange(span * 4) / 4), i))
    return rows


@pytest.mark.parametrize("heavy", [False, True])
def test_cache_flags_equal_greedy(spark, monkeypatch, heavy):
    rows = random_log(3, heavy)
    if heavy:
        # A key with a fifth of the rows is heavy, and none else.
        monkeypatch.setattr(cache_module, "heavy_keys", lambda df, keys, share: heavy_keys(df, keys, 5))
    got = {r.request_id: r.cache_hit for r in cache_hit_flags(log(spark, rows)).collect()}
    assert got == greedy(rows)


def test_lookup_takes_newest_valid_entry(spark):
    entries = spark.createDataFrame(
        [("k", days(0), "a"), ("k", days(5), "b"), ("k", days(20), "c"), ("x", days(1), "d")], "cache_key string, cached_at timestamp, result string"
    )
    asked = [("k", days(d), i) for i, d in enumerate([-1, 0, 4, 6.99, 11.9, 12, 20, 26.9, 27])]
    got = lookup_cache(log(spark, asked), entries, "ts").orderBy("request_id").collect()
    assert [r.result for r in got] == [None, "a", "a", "b", "b", None, "c", "c", None]
    assert {r.cache_key: r.result for r in newest_entries(entries).collect()} == {"k": "c", "x": "d"}


def test_salted_join_keeps_every_row(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    heavy = heavy_keys(left, ["k"], share=10)
    assert [(r.k, r["_salts"]) for r in heavy.collect()] == [(0, 4)]  # a third of the rows in tenths
    salted = salted_join(left, right, ["k"], heavy, ["id"]).select("id", "k", "v")
    plain = left.join(right, "k", "left").select("id", "k", "v")
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_precedence(evaluate):
    values = list(itertools.product(["true", "TRUE", "", None], [True, False, None]))
    got = evaluate(values, R.prefer_flag(F.col("q"), F.col("b")), "q string, b boolean")
    assert got == [q == "true" or bool(b) for q, b in values]
    got = evaluate(["5", "-3", "+7", "x", "5x", "", None, "99999999999"], R.prefer_int(F.col("v"), F.lit(1)))
    assert got == [5, -3, 7, 1, 1, 1, 1, 1]
