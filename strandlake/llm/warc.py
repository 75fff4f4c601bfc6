"""Operator 2: deduplicated WARC archives with revisit records.

Headers (identifier, digest, size) are shuffled by payload digest; of the records with equal
payloads of at least ``min_bytes`` bytes the one with the largest identifier stays a
response, the others become revisit records that refer to it.  Archives are ``.warc.gz``
files, one gzip member a record, with fresh headers.  Reading them back joins each revisit
to the response it names.

Special cases: a null payload is empty; a null identifier sorts before all others and is
written as ``null``; of rows with equal identifier and equal (large) payload one is the
response and the rest revisit it; small payloads are always responses; an empty table makes
no archive; control characters in a URL are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import filesystem, new_folder, ship, slices, small, stage, write_once

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORDS = "path string, record_id string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to_id string"


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"urn:strandlake:{kind}:{'null' if page_id is None else page_id}:{digest}"


def page_of(identifier: str) -> int | None:
    part = identifier.split(":")[3]
    return None if part == "null" else int(part)


def _uri(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or "")


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: str | None, refers_url: str | None, date: str) -> bytes:
    """One record as bytes, with fresh headers."""
    block = HTTP % len(payload) + payload if kind == "response" else HTTP[: HTTP.index(b"Content-Length")] + b"\r\n"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id(kind, page_id, digest)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", _base32(digest)),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", date)]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def find_originals(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``digest, original, original_url, copies`` for each large payload that occurs twice or more.

    ``headers`` has ``page_id, url, digest, payload_bytes``.  ``copies`` counts the rows of the
    original's own identifier.  Counts and maxima are combined before each shuffle, so a
    payload that holds a large share of all rows costs no more than others.
    """
    rows = headers.filter(F.col("payload_bytes") >= min_bytes)
    ids = rows.groupBy("digest", "page_id").agg(F.count("*").alias("c"), F.min("url").alias("u"))
    top = ids.groupBy("digest").agg(F.max(F.struct("page_id", "c", "u")).alias("m"), F.sum("c").alias("n")).filter("n > 1")
    return top.select("digest", F.col("m.page_id").alias("original"), F.col("m.u").alias("original_url"), F.col("m.c").alias("copies"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> DataFrame:
    """Writes deduplicated archives; returns the staged manifest ``path, n_records``.

    ``date`` is the record date of all fresh headers; the time of the call if not given.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    ship(spark)
    target = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    originals = stage(find_originals(rows.drop("payload"), min_bytes), "warc-originals")
    known = small(originals.withColumn("known", F.lit(True)))
    rows = rows.join(known, "digest", "left")
    own = F.col("known") & F.col("page_id").eqNullSafe(F.col("original"))
    if originals.filter("copies > 1").isEmpty():
        rows = rows.withColumn("first", F.col("known").isNull() | own)
    else:  # several rows could be the original: one of them is numbered 1
        tied = F.coalesce(own & (F.col("copies") > 1), F.lit(False))
        order = Window.partitionBy("digest").orderBy("url")
        rows = rows.filter(~tied).withColumn("first", F.col("known").isNull() | own).unionByName(rows.filter(tied).withColumn("first", F.row_number().over(order) == 1))
    rows = rows.select("page_id", "url", "digest", F.when(F.col("first"), F.col("payload")).alias("payload"), "first", "original", "original_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rest = slices(batches, "payload", 16 << 20)
        batch = next(rest, None)
        if batch is None:
            return
        count = 0

        def fill(stream):
            nonlocal batch, count
            while batch is not None:
                for x in batch.to_pylist():
                    kind = "response" if x["first"] else "revisit"
                    refers = None if x["first"] else record_id("response", x["original"], x["digest"])
                    raw = record(kind, x["page_id"], x["url"], x["digest"], x["payload"] or b"", refers, x["original_url"], date)
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    stream.write(squeeze.compress(raw) + squeeze.flush())
                    count += 1
                batch = next(rest, None)

        path = write_once(target, f"{TaskContext.get().partitionId():06d}.warc.gz", fill)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count]})

    return stage(rows.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Header fields of every record, sizes and digests of payloads computed anew (null size for revisits)."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = filesystem(path)
                with files.open_input_stream(place) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:
                    rows = []
                    for headers, block in read_records(stream):
                        name = headers["warc-record-id"].strip("<>")
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = None
                        if headers["warc-type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"payload of {name} is damaged")
                        refers = headers.get("warc-refers-to")
                        rows.append((path, name, headers["warc-type"], page_of(name), headers["warc-target-uri"], size, digest, refers and refers.strip("<>")))
                        if len(rows) == 4096:
                            yield _records(rows)
                            rows = []
                    if rows:
                        yield _records(rows)

    def _records(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to`` and, for revisits, the size of the response they refer to."""
    kept = stage(records, "warc-records")
    wanted = kept.filter(F.col("refers_to_id").isNotNull()).select(F.col("refers_to_id").alias("rid")).distinct()
    originals = kept.filter("record_type = 'response'").select(F.col("record_id").alias("rid"), F.col("payload_bytes").alias("original_bytes"), F.col("page_id").alias("refers_to"))
    originals = stage(originals.join(wanted, "rid", "left_semi"), "warc-referred")
    out = kept.join(small(originals), F.col("refers_to_id") == F.col("rid"), "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "original_bytes")).drop("rid", "original_bytes")
