"""Shared helpers: reading tables, storing intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []

#: A side is broadcast only when its measured size is below this; beyond it the planner shuffles.
BROADCAST_BYTES = 48 << 20


#: Most bytes of a batch sent to a Python worker (Spark's setting; a longer text still goes whole).
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and everything runs in one process, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/docquarry/{label}-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(drop_stored)
    _STORED.append(path)
    return path


#: Spark's own setting: an execution's shuffle files go when it ends, not when the driver's memory is next swept.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting: shuffled bytes that a task of a stored table aims at, so that tables don't fall into small files
#: (where there are fewer bytes than that for every core, Spark makes the tasks smaller).
PART, PART_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 32 << 20


def store(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there,
    a lost executor costs only tasks, and the planner knows the table's size."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, label)
    settings = {CLEANUP: "true", PART: str(PART_BYTES)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later result reads."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)
        _STORED.remove(t.stored_at)


def tidy() -> None:
    """Gives the memory that a Python worker freed back to the machine; workers are reused, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def tidied(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run for mapInArrow, tidying up when its partition ends."""

    def tidied_run(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied_run


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored() -> None:
    """Deletes the stored tables of this session; registered for the driver's end."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    while _STORED:
        try:
            delete(spark, _STORED.pop())
        except Exception:  # noqa: BLE001 - the session may already be closing
            return


def stored_bytes(df: DataFrame) -> int:
    """The planner's size of a stored table (its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table may be broadcast. Parquet packs ids well, so the files count fourfold."""
    return 4 * stored_bytes(df) <= limit
