import pytest
from pyspark.sql import functions as F

from pageloom.sources.snapshots import SnapshotReader, read_snapshots


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshots") / "pages")
    rows = spark.range(300).select(
        F.col("id").alias("page_id"), F.format_string("https://h%02d.test/%d", F.col("id") % 20, "id").alias("url"),
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("<p>"), F.col("id").cast("string"))).alias("html"), F.lit(1).alias("extra"),
    )
    rows.repartitionByRange(6, "page_id").write.parquet(path)
    return path


# filter, partitions left
FILTERS = {
    "none": ("true", 6),
    "equal": ("page_id = 70", 1),
    "range": ("page_id > 140 and page_id <= 160", 2),
    "list": ("page_id in (3, 4, 290, 9999)", 2),
    "address": ("url = 'https://h03.test/3'", 6),
    "not taken": ("html like '%77%' or page_id = 5", 6),
    "nothing": ("page_id > 10000", 1),
}


@pytest.mark.parametrize("name", FILTERS)
def test_same_rows_as_parquet(spark, stored, name):
    keep, parts = FILTERS[name]
    got = read_snapshots(spark, stored).filter(keep)
    want = spark.read.parquet(stored).select("page_id", "url", "html").filter(keep)
    assert sorted(got.collect()) == sorted(want.collect())
    assert name == "address" or got.rdd.getNumPartitions() == parts


def test_columns_are_pruned_or_not_asked(spark, stored):
    pages = read_snapshots(spark, f"file://{stored}")
    assert pages.select("url").distinct().count() == 300 and pages.count() == 300
    assert pages.filter("page_id < 0").count() == 0


def test_row_groups_by_statistics(spark, stored):
    reader = SnapshotReader(stored, read_snapshots(spark, stored).schema)
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    left = list(reader.pushFilters([IsNotNull(("page_id",)), EqualTo(("page_id",), 70), In(("url",), ("https://h10.test/70", None)), EqualTo(("html",), "x")]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    parts = reader.partitions()
    assert len(parts) == 1
    assert [row for batch in reader.read(parts[0]) for row in batch.to_pylist()] == [{"page_id": 70, "url": "https://h10.test/70", "html": "<p>70"}]
