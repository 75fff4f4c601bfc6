"""The shared folder of a session, tables staged there to cut lineage, and code sent to the executors."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{top.name}/{p.relative_to(top).as_posix()}"), p.read_bytes())
    data = buffer.getvalue()
    folder = tempfile.mkdtemp(prefix="strandlake-code-")
    atexit.register(shutil.rmtree, folder, True)
    name = os.path.join(folder, f"{top.name}_{hashlib.sha1(data).hexdigest()[:10]}.zip")
    Path(name).write_bytes(data)
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder of its own (removed at exit);
    on a cluster a missing setting is an error, since a machine-local folder would lose files.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet created) below the shared folder."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _on_disk(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library made, through Spark's own file system layer."""
    target, files = _on_disk(spark, path)
    files.delete(target, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    target, files = _on_disk(spark, path)
    return files.getContentSummary(target).getLength()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs only the tasks that read the table.  The
    result's ``staged_at`` holds the path, ``staged_rows`` the rows counted while writing.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at, out.staged_rows = path, int(seen.get["n"])
    return out


def is_small(df: DataFrame, rows: int, size: int = 16 << 20, of: DataFrame | None = None) -> bool:
    """Whether a table (or the staged table ``of`` that it only renames or projects) is within both limits.

    A staged table is judged by the rows counted and the bytes on disk, without a job; any
    other by one aggregate of its rows and the bytes of its texts, without gathering rows.
    """
    known = of if of is not None else df
    if getattr(known, "staged_at", None) is not None:
        return known.staged_rows <= rows and folder_bytes(df.sparkSession, known.staged_at) <= size
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    width = 8 * len(df.columns) + sum(wide, F.lit(0))
    n, total = df.select(width.alias("w")).agg(F.count("*"), F.sum("w")).first()
    return n <= rows and (total or 0) <= 4 * size
