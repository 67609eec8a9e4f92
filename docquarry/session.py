"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # measured on compressed shuffles, in which neighbours' equal texts or white pixels take a fiftieth of what the driver would hold
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # few bytes of keys may stand for much work
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),  # rows may hold whole images
}


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the runtime settings to an existing session."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def installed_version(package: str) -> str:
    """The version of an installed package, or a note that there is none (on the driver only)."""
    from importlib.metadata import PackageNotFoundError, version

    try:
        return version(package)
    except PackageNotFoundError:
        return "not installed"


def shared_folder(spark: SparkSession) -> str:
    """A folder in that of spark.checkpoint.dir, which the driver and all executors share. Where that is unset and all runs in one
    process (local[...]), a folder of our own is set; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docquarry"


#: Spark's own setting: an execution's shuffle files go when it ends, not when the driver's memory is next swept.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back, for what several branches of a plan use: it is computed
    once, a lost executor costs only tasks, and the shuffle files behind it go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
