"""Queued requests: JSON tasks to typed rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

SCRAPE_TASK, CRAWL_TASK = "scrape:url", "crawl:site"
_CORRUPT = "_corrupt_record"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TASK).json(path)


def stream_tasks(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Task files as a stream; the file cap bounds a micro-batch."""
    return spark.readStream.schema(schemas.TASK).option("maxFilesPerTrigger", max_files).json(path)


def decode(rows: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows with the payload's fields, and the rejected rows with an error."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType(), True)])
    parsed = rows.withColumn(
        "_p", F.from_json(column, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    )
    bad = F.col(column).isNull() | F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull()
    good = parsed.filter(~bad).select(
        *rows.columns, *[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]
    )
    rejected = parsed.filter(bad).select(*rows.columns, F.lit("failed to unmarshal payload").alias("error"))
    return good, rejected


UNREADABLE, NO_URL, UNKNOWN_TYPE = "failed to unmarshal payload", "URL is required", "unknown task type"
_KINDS = {SCRAPE_TASK: ("scrape", schemas.SCRAPE_PAYLOAD), CRAWL_TASK: ("crawl", schemas.CRAWL_PAYLOAD)}


def decode_tasks(tasks: DataFrame) -> DataFrame:
    """Every task once, with its payload as struct ``scrape`` or ``crawl`` and an
    ``error`` where it cannot run. A payload is parsed as what its type says, in
    one pass over the tasks; what is wrong with a task keeps its row and payload."""
    out = tasks
    for task_type, (name, schema) in _KINDS.items():
        full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType(), True)])
        parsed = F.from_json("payload", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
        out = out.withColumn(name, F.when(F.col("task_type") == task_type, parsed))
    payload = F.coalesce(*[F.col(f"{name}.url") for name, _ in _KINDS.values()])
    corrupt = F.coalesce(*[F.col(f"{name}.{_CORRUPT}") for name, _ in _KINDS.values()])
    present = reduce(or_, [F.col(name).isNotNull() for name, _ in _KINDS.values()])
    known = F.coalesce(F.col("task_type").isin(*_KINDS), F.lit(False))
    error = (
        F.when(~known, F.lit(UNKNOWN_TYPE))
        .when(F.col("payload").isNull() | ~present | corrupt.isNotNull(), F.lit(UNREADABLE))
        .when(F.coalesce(payload, F.lit("")) == "", F.lit(NO_URL))
    )
    out = out.withColumn("error", error)
    for name, _ in _KINDS.values():
        readable = F.col("error").isNull() | (F.col("error") == NO_URL)
        out = out.withColumn(name, F.when(readable, F.col(name).dropFields(_CORRUPT)))
    return out


def runnable(decoded: DataFrame, task_type: str, id_column: str) -> DataFrame:
    """Decoded tasks of one type that can run, with their payload as columns."""
    name, _ = _KINDS[task_type]
    rows = decoded.filter((F.col("task_type") == task_type) & F.col("error").isNull())
    return _unfolded(rows, name, id_column)


def _unfolded(rows: DataFrame, name: str, id_column: str) -> DataFrame:
    inner = {n for n, _ in _KINDS.values()} | {"task_id", "task_type", "payload", "error"}
    return rows.select(F.col("task_id").alias(id_column), *[c for c in rows.columns if c not in inner], f"{name}.*")


def rejected(decoded: DataFrame, task_type: str) -> DataFrame:
    """Decoded tasks of one type, or of none that is known, that cannot run: all
    of their columns and the error."""
    known = F.coalesce(F.col("task_type").isin(*_KINDS), F.lit(False))
    mine = ~known | (F.col("task_type") == task_type)
    return decoded.filter(mine & F.col("error").isNotNull()).drop(*[name for name, _ in _KINDS.values()])


def _requests_of(tasks: DataFrame, task_type: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    decoded = decode_tasks(tasks.filter(F.col("task_type") == task_type))
    name, _ = _KINDS[task_type]
    bad = decoded.filter(F.col("error") == UNREADABLE).drop(*[n for n, _ in _KINDS.values()])
    good = decoded.filter(F.col("error").isNull() | (F.col("error") == NO_URL))
    return _unfolded(good, name, id_column), bad


def scrape_requests(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scrape tasks as request rows, and those that cannot be read."""
    return _requests_of(tasks, SCRAPE_TASK, "request_id")


def crawl_jobs(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _requests_of(tasks, CRAWL_TASK, "crawl_id")


def provider_responses(rows: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Stored search answers as ``response`` structs."""
    schema = T.StructType([T.StructField("web", schemas.SEARCH_PROVIDER_RESPONSE["web"].dataType, True)])
    good, bad = decode(rows, column, schema)
    return good.withColumn("response", F.struct("web")).drop("web"), bad
