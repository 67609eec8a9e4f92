"""Incremental ingestion with Structured Streaming (an extension: there is no stream in the semantics to be matched)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..functions import text as X
from ..operators.numbering import numbered


def new_documents(spark: SparkSession, path: str, schema: str, watermark: str = "1 day", files_per_trigger: int = 64) -> DataFrame:
    """Documents arriving as Parquet files, each text once within the watermark (its state is bounded by it)."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    seen = raw.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", watermark)
    return seen.withColumn("file_hash", F.sha2(X.text(F.col("text")).cast("binary"), 256)).dropDuplicatesWithinWatermark(["file_hash"])


def chunked(documents: DataFrame, chunking: config.Chunking = config.Chunking()) -> DataFrame:
    """A row per chunk; stateless, so it runs in any output mode."""
    return documents.select("doc_id", "file_hash", F.posexplode(X.chunks(F.col("text"), chunking.size, chunking.overlap)).alias("i", "chunk")).withColumn("chunk_index", F.col("i") + 1).drop("i")


REGISTERED = "file_hash string, input_pos long, file_path string, size_bytes long, number long"


def register_batch(spark: SparkSession, files: DataFrame, batch_id: int, directory: str) -> None:
    """Adds a batch's files of new content to the registry in `directory` (a folder for each batch). What earlier batches hold
    is the state: the first file of each content and its number stay for good. Repeating a batch writes the same folder again.
    files: input_pos, file_path, size_bytes, file_hash."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    earlier = spark.read.schema(f"{REGISTERED}, batch long").parquet(directory).filter(F.col("batch") < batch_id) if there else spark.createDataFrame([], f"{REGISTERED}, batch long")
    first = files.groupBy("file_hash").agg(F.min(F.struct("input_pos", "file_path", "size_bytes")).alias("f")).select("file_hash", "f.*")
    new = first.join(earlier.select("file_hash"), "file_hash", "left_anti")
    start = earlier.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    numbered(new, ["input_pos", "file_path"], start=start).write.mode("overwrite").parquet(f"{directory}/batch={batch_id}")


def registry_query(files: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    """A stream of files into the registry; started again on the same checkpoint, it goes on where it ended."""
    each = lambda batch, batch_id: register_batch(batch.sparkSession, batch, batch_id, directory)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
