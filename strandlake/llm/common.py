"""Broadcasts, scratch tables and file access for the operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.storage import drop_folder, is_small, new_folder, shared_root, ship, stage

#: Largest number of rows of a narrow table that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it (or the staged table ``of`` that it projects) is small in rows and bytes."""
    return F.broadcast(df) if is_small(df, rows, of=of) else df


__all__ = ["Scratch", "drop_folder", "filesystem", "is_small", "new_folder", "release", "shared_root", "ship", "slices", "small", "stage", "stage_and_free", "text_bytes", "text_hash", "text_offsets", "without_rows", "write_once"]


class Scratch:
    """Stages tables and deletes them again, but for those that results still read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        self.paths.append(out.staged_at)
        return out

    def drop(self, *kept: DataFrame) -> None:
        keep = {k.staged_at for k in kept}
        for path in self.paths:
            if path not in keep:
                drop_folder(self.spark, path)
        self.paths = []


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files of plans that nothing refers to any more go now and not at some later time.

    The gateway passes Python's dropped references on to the JVM once a second: they are waited for (3 s at most).
    """
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + 3
    while waiting and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(0.2)  # the last one may be on its way
    spark.sparkContext._jvm.System.gc()


def stage_and_free(df: DataFrame, name: str) -> DataFrame:
    """``stage``, after which the shuffle files of the write go at once (Spark's own setting; without it they go with ``release``).

    Only that write may have used them: the plan of ``df`` must not run again.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stage(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def text_hash(column):
    """64-bit hash of a text; null counts as empty.  With the identifier it names a row."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows named in ``gone`` (``doc_id, text_hash``); all columns stay."""
    names = small(stage(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "rows-gone"))
    return docs.join(names, F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash(F.col(text_col)) == F.col("__hash")), "left_anti")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_once(folder: str, name: str, write) -> str:
    """Calls ``write(stream)`` on a new file and returns its URI.

    The file gets a name of its own for every attempt of a task, so that retries and
    speculative copies never touch each other; only files named in a manifest count.
    """
    target = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    files, path = filesystem(target)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as out:
        write(out)
    return target


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_offsets(column: pa.Array):
    """Byte offsets of a string or binary column (length + 1)."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(column):
        return np.zeros(1, kind)
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind.itemsize)


def text_bytes(column: pa.Array):
    """(uint8 bytes, int64 offsets from 0) of a string or binary column; nulls are empty."""
    import numpy as np

    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    offsets = text_offsets(column).astype(np.int64)
    buffer = column.buffers()[2] if len(column) else None
    if buffer is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
