"""Writes in parts that can be stopped and resumed, and their streaming form."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.storage import drop_folder, new_folder


class ManifestMismatch(ValueError):
    """The folder holds parts of another input or of other settings."""


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def guard_manifest(spark: SparkSession, folder: str, settings: dict) -> bool:
    """Writes the settings beside the parts, or checks them against those there.  True if there were some."""
    path, fs = _file(spark, f"{folder}/manifest.json")
    text = json.dumps(settings, sort_keys=True)
    if fs.exists(path):
        there = spark.read.text(str(path)).first()[0]
        if there != text:
            raise ManifestMismatch(f"{folder} was begun with other settings")
        return True
    out = fs.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()
    return False


def resumable_write(df: DataFrame, folder: str, key: str, parts: int, settings: dict, transform: Callable[[DataFrame], DataFrame]) -> int:
    """Applies ``transform`` to the rows of each unfinished part and writes it; returns how many parts ran.

    A row's part is a hash of its key, so it is the same in every run.  A part is finished
    when Spark's commit marker is there; others are overwritten.  The input is read once and
    dealt out to the unfinished parts in the shared folder.
    """
    spark = df.sparkSession
    guard_manifest(spark, folder, settings | {"parts": parts, "key": key})

    def there(path: str) -> bool:
        place, files = _file(spark, path)
        return files.exists(place)

    todo = [i for i in range(parts) if not there(f"{folder}/part={i}/_SUCCESS")]
    if not todo:
        return 0
    dealt = new_folder(spark, "parts")
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    df.withColumn("__part", part).filter(F.col("__part").isin(todo)).write.partitionBy("__part").parquet(dealt)
    for i in todo:
        rows = spark.read.schema(df.schema).parquet(f"{dealt}/__part={i}") if there(f"{dealt}/__part={i}") else spark.createDataFrame([], df.schema)
        transform(rows).write.mode("overwrite").parquet(f"{folder}/part={i}")
    drop_folder(spark, dealt)
    return len(todo)


def process_available(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 100) -> int:
    """Streams the files of ``source`` that have not been processed into ``sink``; a second call does nothing.

    Batch numbers name the folders, so a repeated batch replaces itself.  Returns the number of batches.
    """
    seen = []

    def write(batch: DataFrame, number: int) -> None:
        seen.append(number)
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(seen)


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in event-time windows with a watermark (an extension: works on streams and tables alike)."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
