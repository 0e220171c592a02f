import bisect
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pageloom.operators.asof import as_of


def newest(asked, entries):
    """Binary search per key."""
    times = defaultdict(list)
    for key, at in entries:
        if key is not None and at is not None:
            times[key].append(at)
    for at in times.values():
        at.sort()
    out = []
    for rid, key, at in asked:
        place = 0 if key is None or at is None else bisect.bisect_right(times[key], at)
        out.append((rid, times[key][place - 1] if place else None))
    return sorted(out, key=str)


def run(spark, asked, entries, share=500):
    moment = F.timestamp_seconds("at")
    left = spark.createDataFrame(asked, "rid long, k string, at long").withColumn("at", moment)
    right = spark.createDataFrame(entries, "k string, at long").select("k", moment.alias("stored"))
    out = as_of(left, right, "k", "at", "stored", "found", share)
    assert out.columns == ["rid", "k", "at", "found"]
    return sorted(((r.rid, r.found) for r in out.select("rid", F.unix_seconds("found").alias("found")).collect()), key=str)


def random_rows(seed, n, span=500):
    rng = random.Random(seed)

    def key():
        return rng.choice(["hot", "hot", "a", "b", f"k{rng.randrange(50)}", None])

    asked = [(i, key(), rng.choice([None, *range(0, span, 3)]) if i % 40 == 0 else rng.randrange(span)) for i in range(n)]
    entries = [(key(), rng.randrange(span) if i % 30 else None) for i in range(n // 3)]
    return asked, entries + entries[:20]


@pytest.mark.parametrize("seed, share", [(1, 500), (2, 5), (3, 2), (4, 10**9)])
def test_equals_binary_search(spark, seed, share):
    asked, entries = random_rows(seed, 1500)
    assert run(spark, asked, entries, share) == newest(asked, entries)


def test_one_moment_and_no_entries(spark):
    asked = [(i, "k", 7) for i in range(300)]
    assert run(spark, asked, [("k", 7)] * 50, 2) == newest(asked, [("k", 7)])
    assert run(spark, asked, [("k", 8)], 2) == newest(asked, [("k", 8)])
    assert run(spark, asked, []) == newest(asked, [])
    assert run(spark, [], [("k", 8)]) == []


def test_entries_in_an_early_slice_only(spark):
    """The carried entry reaches every later slice."""
    asked = [(i, "k", i) for i in range(2000)]
    assert run(spark, asked, [("k", 3)]) == newest(asked, [("k", 3)])


def test_hot_key_is_linear_and_split(spark):
    """100,000 requests and as many entries of one key in one life time."""
    n = 100_000
    left = spark.range(n).select("id", F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 5).alias("at"))
    right = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 5 + 2).alias("stored"))
    out = as_of(left, right, "k", "at", "stored", "found")
    gap = F.unix_seconds("at") - F.unix_seconds("found")
    row = out.agg(F.count("*").alias("n"), F.count("found").alias("hits"), F.min(gap).alias("least"), F.max(gap).alias("most")).first()
    assert (row.n, row.hits, row.least, row.most) == (n, n - 1, 3, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # rows of both sides meet in a sorted stream, the only joins are with the few limits of heavy keys
    assert "SortMergeJoin" not in plan and "hashpartitioning(_key" in plan and "_slice" in plan
