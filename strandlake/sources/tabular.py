"""Table sources: projected scans, filtered text scans, feature files, JSON lines, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GFF_SCHEMA = "Chromosome string, Source string, Feature string, Start long, End long, Score string, Strand string, Frame string, Attributes string"
#: Stars by review status.
GOLD_STARS = {
    "criteria provided, single submitter": 1,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, conflicting interpretations": 1,
    "reviewed by expert panel": 3,
    "practice guideline": 4,
}


def read_projected(spark: SparkSession, path: str, prefixes: list[str], keys: list[str]) -> DataFrame:
    """Key columns and column families only; Parquet reads no others."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if c in keys or c.startswith(tuple(prefixes))])


def late_columns(spark: SparkSession, path: str, keys: list[str], slim: list[str], keep: Column, wide: list[str], batch: int | None = None) -> DataFrame:
    """Filters on a slim projection first and reads the wide columns of the surviving rows only.

    Rows are told apart by their file and their number in it, which Parquet scans give, so
    repeated (or null) keys neither multiply nor lose rows.  With ``batch`` the wide columns
    are read so many at a time, which bounds the width of a scan.
    """
    row = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    out = spark.read.parquet(path).select(*dict.fromkeys([*keys, *slim]), *row).filter(keep).select(*keys, "__file", "__row")
    step = batch or max(1, len(wide))
    for i in range(0, len(wide), step):
        out = out.join(spark.read.parquet(path).select(*wide[i : i + step], *row), ["__file", "__row"])
    return out.drop("__file", "__row")


def sample_scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of one row group: those whose file and block come first, for a look at a large table.

    The feature is the look itself; nothing computed from it may stand for the table.
    """
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    rows = spark.read.parquet(path).select(*(columns or ["*"]), *block)
    first = rows.agg(F.min(F.struct("__file", "__block")).alias("f")).first().f
    return rows.filter((F.col("__file") == (first and first[0])) & (F.col("__block") == (first and first[1]))).drop("__file", "__block")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True, keep: Column | None = None) -> DataFrame:
    """Tab-separated text with a stated schema, filtered while it is read; gzip is not splittable, so convert large files to Parquet once."""
    rows = spark.read.csv(path, sep="\t", header=header, schema=schema, mode="PERMISSIVE")
    return rows if keep is None else rows.filter(keep)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, block, place``: the lines of text files with the start of their block and their number in it.

    The number is a scan's own, taken before any shuffle.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    first = lines.groupBy("file", "block").agg(F.min("n").alias("least"))
    return lines.join(F.broadcast(first), ["file", "block"]).select("value", "file", "block", (F.col("n") - F.col("least")).alias("place"))  # one row a block


def read_after_banner(spark: SparkSession, path: str, banner: int, sep: str = "\t") -> DataFrame:
    """A single text file with ``banner`` lines before its header line; all columns are text.

    Lines go by their number, so a data row that equals a banner line stays; rows shorter or
    longer than the header are padded or cut.
    """
    lines = numbered_lines(spark, path)
    top = (F.col("block") == 0) & (F.col("place") <= banner)
    head = [r.value for r in lines.filter(top).orderBy("place").collect()]
    names = head[banner].lstrip("#").split(sep) if len(head) > banner else []
    parts = F.split("value", sep, -1)
    return lines.filter(~top).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=GFF_SCHEMA)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """``doc`` (null if malformed), ``line`` and ``block, line_no`` (from 1, within the block of the file) of every non-blank line."""
    rows = numbered_lines(spark, path).withColumnRenamed("value", "line").filter(F.trim("line") != "")
    return rows.select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("doc"), "line", "block", (F.col("place") + 1).alias("line_no"))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as trimmed text, missing ones empty, alleles in upper case."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    return raw.select(*[(F.upper(cell(c)) if c in ("ref", "alt") else cell(c)).alias(c) for c in columns])


def read_through(spark: SparkSession, csv_path: str, parquet_path: str, schema: str) -> DataFrame:
    """The Parquet copy of a CSV file, written at the first call."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parquet_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.read.csv(csv_path, header=True, schema=schema).write.parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by their first alias present (compared trimmed, without case); absent ones are null text."""
    known = {c.lower().strip(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{known[n]}`") for n in names if n in known), F.lit(None).cast("string"))
    return df.select(*[pick(names).alias(out) for out, names in aliases.items()])


def gold_stars(status: Column) -> Column:
    """Stars of a review status; null where there are none."""
    return F.create_map(*[F.lit(x) for kv in GOLD_STARS.items() for x in kv])[status]


def clean_variants(df: DataFrame, require_valid_pos: bool = True) -> DataFrame:
    out = df.dropna(subset=["ref", "alt"])
    return out.filter(F.col("pos") > 0) if require_valid_pos else out


def saturation_variants(spark: SparkSession, chrom: str, start: int, end: int, sequence: Column) -> DataFrame:
    """Every single-letter change in ``chrom:start-end``; ``sequence`` is the column expression of that span."""
    places = spark.range(start, end + 1).select(F.lit(chrom).alias("chrom"), F.col("id").alias("pos"), F.upper(F.substring(sequence, (F.col("id") - start + 1).cast("int"), F.lit(1))).alias("ref"))
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    return places.filter(F.col("ref").isin(*"ACGT")).withColumn("alt", F.explode(bases)).filter("ref <> alt")


def select_tracks(metadata: DataFrame | None, key_marks: list[str], order: str = "idx", tracks: DataFrame | None = None) -> DataFrame:
    """The meaningful tracks of a dictionary (first row of a file counts), in model order.

    Without metadata (None, or not one row) all ``tracks`` stay.
    """
    from strandlake.operators.relational import keep_first

    if metadata is None or (tracks is not None and metadata.isEmpty()):
        if tracks is None:
            raise ValueError("neither metadata nor tracks")
        return tracks
    one = keep_first(metadata, ["file_id"], [F.col(order).asc()])
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    mark = F.lit(False)
    for m in key_marks:
        mark = mark | c("experiment_target").contains(m)
    keep = (c("assay").contains("ChIP") & mark & c("dataset").isin("encode_v3", "geo")) | ((c("assay").contains("ATAC") | c("assay").contains("DNase")) & (c("dataset") == "encode_v3"))
    keep = keep | c("dataset").isin("fantom5", "gtex") | c("assay").contains("CAGE")
    return one.filter(keep)


def with_track_metadata(long: DataFrame, metadata: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of a long table with the metadata of their track (the first row of a file counts); tracks without metadata stay."""
    from strandlake.operators.common import small
    from strandlake.operators.relational import keep_first

    rest = [c for c in metadata.columns if c not in long.columns]
    return long.join(small(keep_first(metadata, [key], [F.col(c) for c in rest]).select(key, *rest)), key, "left")


def track_group(assay: Column, target: Column, key_marks: list[str]) -> Column:
    """Histone mark, else the first assay family in the name; null for none."""
    out = F.when(assay.contains("ChIP") & target.isin(*key_marks), target)
    for a in ("DNase", "ATAC", "CAGE", "RNA"):
        out = out.when(assay.contains(a), F.lit(a))
    return out


def track_description(track: Column, tissue: Column, biosample: Column, assay: Column, target: Column) -> Column:
    """``tissue|biosample|assay[|target]``; the track's name if nothing is known."""
    known = F.coalesce(tissue, biosample, assay, target).isNotNull()
    return F.when(known, F.concat(F.concat_ws("|", F.coalesce(tissue, F.lit("Unknown")), F.coalesce(biosample, F.lit("")), F.coalesce(assay, F.lit(""))), F.when(F.length(target) > 0, F.concat(F.lit("|"), target)).otherwise(""))).otherwise(track)
