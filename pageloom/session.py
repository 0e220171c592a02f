"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "pageloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and let spark-submit choose it. AQE
    sizes the reduce side, so no shuffle partition count is set here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes that a Python worker is given at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, whatever the session was built with; lower bounds stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key, None)
        held = int(held) if held and held.isdigit() else 0  # none, or with a unit: not known to be lower
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint directory exists (tests,
    a laptop) is a temporary folder made and registered with the context.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="pageloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), "pageloom", f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so an executor loss replays one step, and unlike an RDD
    checkpoint keeps column pruning and true file sizes, from which Catalyst
    decides by size whether a side may be broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows, counted by the write itself."""
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


#: Rows of a bucket, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 10_000


def materialize_bucketed(df: DataFrame, label: str, keys: list[str], rows: int) -> DataFrame:
    """``materialize`` as a table of one file per bucket of ``keys``: joins on all
    of ``keys`` read it where it lies and move the other side only. ``rows`` is
    about how many it has. The catalog of the session knows it under a name of
    its own; the files stay in the shared folder like other intermediates."""
    spark = df.sparkSession
    buckets = max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, *keys)
    spread.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)
