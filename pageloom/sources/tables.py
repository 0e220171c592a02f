"""Page tables and result stores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.predicates import MAX_IMAGE_BYTES
from ..functions.requests import summary_line
from ..operators.pages import with_page_key

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_page_store(pages: DataFrame, table: str, buckets: int) -> None:
    """Save pages with their key, bucketed and sorted by it: lookups of any
    size then shuffle only the asked URLs, never the HTML."""
    (
        with_page_key(pages)
        .write.bucketBy(buckets, "page_key")
        .sortBy("page_key")
        .option("compression", "zstd")
        .mode("overwrite")
        .saveAsTable(table)
    )


def write_results_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per row, gzip at its fastest; NULL fields are left out."""
    writer = results.write.mode(mode).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("ignoreNullFields", "true").json(path)


def read_results_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Gzip and plain files side by side; the file name tells which is which."""
    return spark.read.schema(schema).json(path)


#: Entries that no micro-batch wrote.
NO_BATCH = -1


def write_cache(entries: DataFrame, path: str, batch_id: int = NO_BATCH) -> None:
    """Entries by day and, below it, by the micro-batch that made them. A batch
    that runs again replaces what it wrote; entries without batch are added."""
    replay = batch_id != NO_BATCH
    (
        entries.withColumns({"cached_on": F.to_date("cached_at"), "batch_id": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite" if replay else "append")
        .option("partitionOverwriteMode", "dynamic" if replay else "static")
        .partitionBy("cached_on", "batch_id")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_cache(
    spark: SparkSession, path: str, oldest: str | None = None, newest: str | None = None, before_batch: int | None = None
) -> DataFrame | None:
    """Cache entries of the days from ``oldest`` to ``newest`` (``yyyy-MM-dd``)
    that batches before ``before_batch`` made; None if there are none.

    With both days given only their folders are listed, so the cost does not
    depend on how long the cache has been written.
    """
    folders = path
    if oldest is not None and newest is not None:
        days = spark.sql("SELECT array_join(sequence(to_date(:a), to_date(:b)), ',') AS d", {"a": oldest, "b": newest}).first().d
        folders = f"{path}/cached_on={{{days}}}"
    try:
        rows = spark.read.option("basePath", path).parquet(folders)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if oldest is not None:
        rows = rows.filter(F.col("cached_on") >= F.to_date(F.lit(oldest)))
    if newest is not None:
        rows = rows.filter(F.col("cached_on") <= F.to_date(F.lit(newest)))
    if before_batch is not None:
        rows = rows.filter(F.col("batch_id") < before_batch)
    return rows.drop("cached_on", "batch_id")


def expire_cache(spark: SparkSession, path: str, oldest: str) -> list[str]:
    """Drop the folders of days before ``oldest`` and return these days. No entry
    is read: a day goes as a whole once its last entry has expired."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    gone = []
    for status in files.listStatus(hadoop):
        name = status.getPath().getName()
        if name.startswith("cached_on=") and name.split("=")[1] < oldest:
            files.delete(status.getPath(), True)
            gone.append(name.split("=")[1])
    return sorted(gone)


def summaries(results: DataFrame) -> DataFrame:
    """Summary line of every request that succeeded."""
    done = results.filter(F.col("error").isNull())
    return done.select("request_id", summary_line(F.col("url")).alias("summary"))


def read_image_files(spark: SparkSession, path: str, url_prefix: str) -> DataFrame:
    """Stored image files as ``image_bytes``. Files over the cap keep their row
    but their bytes are never read: the length is known from the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def rows(kept, content):
        return files.filter(kept).select(
            F.concat(F.lit(url_prefix), F.element_at(F.split("path", "/"), -1)).alias("url"),
            F.lit(200).alias("status"),
            F.lit(None).cast("string").alias("content_type"),
            content.alias("content"),
        )

    fits = F.col("length") <= MAX_IMAGE_BYTES
    return rows(fits, F.col("content")).unionByName(rows(~fits, F.lit(None).cast("binary")))


def pages_from(urls: DataFrame, producer) -> DataFrame:
    """Pages made by a caller's function over batches of URL rows: it takes and
    gives iterators of pandas frames shaped like the page table."""
    return urls.mapInPandas(producer, schemas.PAGE)
