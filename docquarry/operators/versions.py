"""Tables saved together, atomically: a version is visible when its manifest is, and stays readable after later ones.

The tables of a version go to a folder of their own; then their rows and digests are measured from what was written and put
into a manifest, which one rename moves to its place. A writer that fails before leaves a folder that nobody reads; of two
writers of the same version, the second one's rename fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def measured(df: DataFrame) -> dict:
    """Rows, and an order-free digest over all columns."""
    n, digest = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return {"rows": int(n), "digest": str(digest)}


def versions(spark: SparkSession, directory: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    path, fs = _fs(spark, f"{directory}/manifests")
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def commit(directory: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], partition_by: dict[str, list[str]] | None = None) -> int:
    """Saves the tables as the next version and returns its number. A function makes its table from those written before it."""
    spark = next(iter(tables.values())).sparkSession
    number, folder = (versions(spark, directory) or [0])[-1] + 1, uuid.uuid4().hex
    found, written = {}, {}
    for name, df in tables.items():
        df = df if isinstance(df, DataFrame) else df(written)
        where = f"{directory}/versions/{folder}/{name}"
        df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(where)
        written[name] = spark.read.schema(df.schema).parquet(where).select(df.columns)
        found[name] = measured(written[name]) | {"columns": df.columns}
    _publish(spark, directory, number, {"version": number, "folder": folder, "tables": found})
    return number


def _publish(spark: SparkSession, directory: str, number: int, manifest: dict) -> None:
    jvm = spark.sparkContext._jvm
    staged, fs = _fs(spark, f"{directory}/manifests/.{manifest['folder']}.tmp")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final, _ = _fs(spark, f"{directory}/manifests/{number:010d}.json")
    qualified = [fs.makeQualified(p) for p in (staged, final)]
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(*qualified, no_overwrite)


def manifest(spark: SparkSession, directory: str, version: int | None = None) -> dict:
    known = versions(spark, directory)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {'' if version is None else version} in {directory}")
    path, fs = _fs(spark, f"{directory}/manifests/{known[-1] if version is None else version:010d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def load(spark: SparkSession, directory: str, version: int | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a version (default: the last one); verify compares rows and digests with the manifest."""
    kept = manifest(spark, directory, version)
    found = {name: spark.read.parquet(f"{directory}/versions/{kept['folder']}/{name}") for name in kept["tables"]}
    if verify:
        for name, known in kept["tables"].items():
            if measured(found[name].select(known["columns"])) | {"columns": known["columns"]} != known:
                raise RuntimeError(f"{name} differs from its manifest")
    return found
