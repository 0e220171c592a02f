import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators.postings import open_search_store, scores, write_search_store
from pageloom.operators.search import page_of, search

SCHEMA = "id long, title string, url string, description string, text string, domain string, ts timestamp"


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "Other", "aaaa", "aa", "banana,anana", "é", "Étéété", "a", "ab", "x.y", "THE", "there", "ba na", "\U0001f600th", "that's"]
    found = [rng.choice([" ", "\n", "\t \r"]).join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return [*found, None, "", " \n", "the " * 5000]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(i, f"t{i}", f"https://s{i % 3}.org/{i}", f"d{i}", t, f"s{i % 3}.org", None) for i, t in enumerate(texts(1))]
    corpus = spark.createDataFrame(rows, SCHEMA)
    corpus = corpus.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 86_400))
    # slots of 20 postings, so that frequent words fill several
    return write_search_store(corpus, "store_a", str(tmp_path_factory.mktemp("store")), slot_rows=20), corpus, rows


def occurrences(text, term):
    return (text or "").lower().count(term)


@pytest.mark.parametrize("few", [2000, 0])
@pytest.mark.parametrize("terms, required", [(["the"], []), (["a"], []), (["aa", "an"], ["the"]), (["été"], []), (["x.y", "that's"], ["é", "a"]), (["anana"], []), (["nothing"], []), (["\U0001f600"], [])])
def test_scores_are_substring_counts(store, terms, required, few):
    got = {r.id: r.score for r in scores(store[0], terms, required, None, few).collect()}
    want = {i: sum(occurrences(t, x) for x in terms) for i, *_, t, _, _ in store[2] if all(occurrences(t, r) for r in required)}
    assert got == {i: n for i, n in want.items() if n}


def test_store_equals_corpus(spark, store):
    opened = open_search_store(spark, "store_a")
    assert opened.slots == store[0].slots > 1 and opened.words.filter("salts > 1").count()
    as_of = "2023-11-14 22:13:20"
    for options in (
        {"query": "the AA"},
        {"query": "a", "offset": 7, "limit": 5},
        {"query": "an", "include": ["s1.org", "s2.org"], "exclude": ["s2.org"], "required": ["Other"]},
        {"query": "the", "max_age": 30, "as_of": as_of},
        {"query": "the", "mode": "fast", "as_of": as_of},
    ):
        assert sorted(search(opened, **options).collect()) == sorted(search(store[1], **options).collect()), options


def test_what_a_store_refuses(store):
    for options in ({"query": " "}, {"query": "a", "required": ["two words"]}, {"query": "a", "mode": "fast"}, {"query": "a", "limit": -1}):
        with pytest.raises(ValueError):
            search(store[0], **options)


def test_a_query_reads_its_slots(store):
    plan = scores(store[0], ["étéété"], [], None)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "store_a_postings" in line)
    chosen, of = (int(x) for x in scan.split("SelectedBucketsCount: ")[1].split(",")[0].split(" out of "))
    assert chosen < of and "word" in scan.split("PushedFilters: ")[1]
    assert plan.count("FileScan") == 1 and "text" not in plan
    shown = search(store[0], "the", 0, 5)._jdf.queryExecution().executedPlan().toString()
    assert "store_a_results" in shown and "PushedFilters: [In(id" in shown and "text" not in shown


def test_empty_corpus(spark, tmp_path):
    store = write_search_store(spark.createDataFrame([], SCHEMA), "store_empty", str(tmp_path / "s"))
    assert search(store, "the").count() == 0


@pytest.mark.parametrize("offset, limit", [(0, 7), (9_995, 10), (9_999, 100), (15_000, 30), (19_990, 30), (25_000, 10)])
def test_far_pages(spark, offset, limit):
    scored = spark.range(20_000).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"))
    rows = sorted(((r.id, r.score) for r in scored.collect()), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in page_of(scored, offset, limit, 700).collect()] == rows[offset : offset + limit]


def test_a_million_rows_before_the_page(spark):
    scored = spark.range(1_200_000).select("id", (F.col("id") % 7).alias("score"))
    page = page_of(scored, 1_000_000, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan
    limit = int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0])
    assert limit < 100_000  # of the ranges that hold the page
    every = [i for score in range(6, -1, -1) for i in range(score, 1_200_000, 7)]
    assert [r.id for r in page.collect()] == every[1_000_000:1_000_010]


def test_postings_are_never_moved_to_meet_words(spark, store):
    # the words of a term and of what is required, few or many, cost one reading and one shuffle by id
    for few, terms, required in ((2000, ["th"], ["a", "é"]), (0, ["th", "a"], []), (0, ["th"], ["a", "é"])):
        plan = scores(store[0], terms, required, None, few)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(id") == 1


def test_writing_a_store_moves_a_posting_once(spark, tmp_path, monkeypatch):
    from pageloom.operators import postings

    plans = []
    save = postings._save

    def kept(df, name, folder, part, *rest):
        plans.append((part, df._jdf.queryExecution().executedPlan().toString()))
        save(df, name, folder, part, *rest)

    monkeypatch.setattr(postings, "_save", kept)
    rows = [(1, "t", "u", "d", "B a b  a\na", "s", None), (1, "t", "u", "d", "a c", "s", None), (None, "t", "u", "d", "c C", "s", None)]
    written = write_search_store(spark.createDataFrame(rows, SCHEMA), "store_once", str(tmp_path / "s"))
    plan = dict(plans)["postings"]
    assert "Generate" in plan  # from the texts, not from counted rows that were written before
    assert "HashAggregate" not in plan and "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan
    sums = written.postings.groupBy("word", "id").agg(F.sum("n")).collect()
    assert {tuple(r) for r in sums} == {("a", 1, 4), ("b", 1, 2), ("c", 1, 1), ("c", None, 2)}
    assert {tuple(r) for r in scores(written, ["a", "c"], [], None).collect()} == {(1, 5), (None, 2)}
    assert {tuple(r) for r in scores(written, ["c"], ["c"], None).collect()} == {(1, 1)}
