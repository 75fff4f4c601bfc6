"""Sinks: request lines, cell text, added columns, and writes that can be resumed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.text import csv_cell


def write_request_lines(df: DataFrame, path: str, key: str, prompt: str, model: str, max_tokens: int = 1024) -> None:
    """One JSON request a row."""
    body = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    df.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), body.alias("params")))).write.text(path)


def write_csv_cells(df: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """CSV in which lists, maps and structs are written as text; with a byte order mark before the header of each file if asked for."""
    mark = "\ufeff" if byte_order_mark else ""
    df.select(*[csv_cell(F.col(c), t).alias(c if i else mark + c) for i, (c, t) in enumerate(df.dtypes)]).write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_columns(df: DataFrame, path: str, columns: dict[str, Column]) -> None:
    """A copy of a table with further columns."""
    df.withColumns(columns).write.parquet(path)


def input_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A hash of the set of rows that does not depend on their order or partitioning."""
    row = F.xxhash64(*[F.col(c) for c in columns])
    n, x, s = df.select(row.alias("h")).agg(F.count("*"), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha1(json.dumps([columns, n, x, str(s)]).encode()).hexdigest()
