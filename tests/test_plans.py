"""Queries against their SQL, and the shape of important plans."""


import pytest
from pyspark.sql import functions as F

from pageloom.operators.pages import documents_of, lookup_pages, page_index
from pageloom.operators.search import documents_corpus, search
from pageloom.plans import ORACLES, QUERIES
from pageloom.sources.tables import write_page_store
from tools.compare import compare, connect

SLOW = {n for n in QUERIES if n.startswith(("crawl_", "streamed_"))} - {"streamed_scrape"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, con, data, name):
    ok, note = compare(spark, con, name, data)
    assert ok, note


@pytest.mark.parametrize("name", ["crawl_summaries", "streamed_crawl", "streamed_cache"])
def test_slow_query_equals_sql(spark, con, data, name):
    ok, note = compare(spark, con, name, data)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_link_and_image_tables_do_not_shuffle(spark, data):
    for name in ("link_table", "image_list"):
        assert "Exchange" not in plan_of(QUERIES[name](spark, data))


def test_index_shuffles_no_html(spark, data):
    plan = plan_of(page_index(spark.read.parquet(f"{data}/pages.parquet")))
    assert plan.count("Exchange hashpartitioning") == 1
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "html" not in exchange


def test_search_keeps_only_top_rows(spark, data):
    plan = plan_of(search(documents_corpus(spark.read.parquet(f"{data}/documents.parquet")), "the", 0, 10))
    assert "TakeOrderedAndProject" in plan


def test_page_store_joins_without_shuffling_pages(spark, data, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS store LOCATION '{tmp_path}/store'")
    write_page_store(spark.read.parquet(f"{data}/pages.parquet"), "store.pages", 4)
    store = spark.table("store.pages")
    asked = spark.read.parquet(f"{data}/pages.parquet").select(F.col("url").alias("page_key"), F.lit("static").alias("engine"), "page_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (documents_of(asked, store, None), lookup_pages(asked.select(F.col("page_key").alias("url")), store)):
            moved = [line for line in plan_of(df).splitlines() if "Exchange hashpartitioning" in line and "html" in line]
            assert not moved
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP DATABASE store CASCADE")


