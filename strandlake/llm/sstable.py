"""Operator 1: token ids as sorted string tables.

A shard is one file: data blocks, a sparse block index, a Bloom filter and a footer.

* Data block: entries ``varint shared, varint unshared, varint value length, key suffix,
  value``; a key is stored as what differs from the one before, whole at every 16th entry;
  the offsets of those restarts (uint32) and their number close the block.  Blocks are
  zstd-compressed and followed by the crc32 of the stored bytes.
* Index: last key, offset, stored length and number of entries of every block.
* Bloom filter: 10 bits a key, 7 probes.
* Footer: fixed size, at the end.

A value is the ids as little-endian uint16 (vocabularies up to 65,536) or uint32.
Keys are document identifiers, 8 bytes, big-endian with the sign bit turned, so that byte
order is numeric order; a null identifier is the empty key and comes first.

Special cases: null texts are empty documents (the end id alone); empty tables make no
shard; rows with equal identifiers are kept, in the order of their texts, and a lookup
returns them all; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import filesystem, new_folder, ship, slices, stage, write_once

MAGIC = b"SLSSTAB1"
FOOTER = struct.Struct("<8sIIQQQQQQI")
RESTART, BITS, PROBES = 16, 10, 7
MANIFEST = "path string, part long, piece long, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return (hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    """Writes entries, which must come in key order, to a binary stream."""

    def __init__(self, stream, width: int, block_bytes: int = 64 << 10):
        import zstandard

        self.stream, self.width, self.block_bytes = stream, width, block_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.offset = self.entries = self.tokens = 0
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self._new()

    def _new(self) -> None:
        self.block, self.size, self.restarts, self.count, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        import xxhash

        shared = 0
        if self.count % RESTART:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += (head, value)
        self.size += len(head) + len(value)
        self.count += 1
        self.last = key
        self.entries += 1
        self.tokens += len(value) // self.width
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        stored = self.zip.compress(raw)
        stored += struct.pack("<I", zlib.crc32(stored))
        self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QII", self.offset, len(stored), self.count))
        self.stream.write(stored)
        self.offset += len(stored)
        self._new()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, -(-len(self.hashes) * BITS // 8) * 8)
        filled = np.zeros(bits, np.uint8)
        if self.hashes:
            filled[_probes(np.array(self.hashes, np.uint64), bits).ravel()] = 1
        bloom = np.packbits(filled).tobytes()
        tail = (MAGIC, 1, self.width, self.offset, len(index), self.offset + len(index), len(bloom), self.entries, self.tokens)
        body = FOOTER.pack(*tail, 0)[:-4]
        self.stream.write(index)
        self.stream.write(bloom)
        self.stream.write(body + struct.pack("<I", zlib.crc32(index + bloom + body)))


class Table:
    """A shard opened for scans and lookups; holds its index and Bloom filter, not its blocks."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        end = file.size()
        footer = file.read_at(FOOTER.size, end - FOOTER.size)
        magic, _, self.width, index_at, index_len, bloom_at, bloom_len, self.entries, self.tokens, crc = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a sorted string table")
        index, bloom = file.read_at(index_len, index_at), file.read_at(bloom_len, bloom_at)
        if zlib.crc32(index + bloom + footer[:-4]) != crc:
            raise ValueError("damaged index, filter or footer")
        self.bits = np.unpackbits(np.frombuffer(bloom, np.uint8))
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        at = 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.keys.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QII", index, at + n))
            at += n + 16

    def _block(self, i: int) -> bytes:
        offset, size, _ = self.blocks[i]
        stored = self.file.read_at(size, offset)
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError(f"damaged block {i}")
        return self.unzip.decompress(stored[:-4])

    @staticmethod
    def _entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end = len(raw) - 4 - 4 * struct.unpack("<I", raw[-4:])[0]
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._entries(self._block(i))

    def may_hold(self, key: bytes) -> bool:
        import xxhash

        return bool(self.bits[_probes(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64), len(self.bits))].all())

    def get(self, key: bytes) -> list[bytes]:
        """Values of all entries with this key: filter, then binary search over blocks and restarts."""
        out: list[bytes] = []
        if not self.may_hold(key):
            return out
        for i in range(bisect.bisect_left(self.keys, key), len(self.blocks)):
            raw = self._block(i)
            count = struct.unpack("<I", raw[-4:])[0]
            restarts = struct.unpack(f"<{count}I", raw[-4 - 4 * count : -4])
            first = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at))[0])
            for found, value in self._entries(raw, restarts[max(0, first - 1)]):
                if found > key:
                    return out
                if found == key:
                    out.append(value)
            if self.keys[i] > key:
                break
        return out


def write_sstables(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 64 << 20) -> DataFrame:
    """Encodes every document and writes shards in ascending identifier order.

    Returns the staged manifest: ``path, part, piece, n_docs, n_tokens, start`` - ``start`` is
    the number of ids in all shards before.  A file of a failed or repeated task is never
    named there.  One shuffle by identifier range; a task holds one batch and one block.
    """
    spark = docs.sparkSession
    ship(spark)
    target = folder or new_folder(spark, "sstables")
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").drop("h")  # the hash spreads an identifier that very many rows share

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from strandlake.llm.tokens import encoder

        encode = encoder(tokenizer)
        width = np.dtype(np.uint16 if encode.size <= 1 << 16 and end_id < 1 << 16 else np.uint32)
        part, piece = TaskContext.get().partitionId(), 0

        def entries() -> Iterator[tuple[bytes, bytes]]:
            for batch in slices(batches, "t", 16 << 20):
                ids, offsets = encode.encode(batch.column(1), end_id)
                data, bounds = ids.astype(width).tobytes(), (offsets * width.itemsize).tolist()
                for i, k in enumerate(batch.column(0).to_pylist()):
                    yield key_of(k), data[bounds[i] : bounds[i + 1]]

        rest = entries()
        entry = next(rest, None)
        while entry is not None:
            done: list[int] = []

            def fill(stream, done=done):
                nonlocal entry
                writer = Writer(stream, width.itemsize)
                while entry is not None and writer.tokens < shard_tokens:
                    writer.add(*entry)
                    entry = next(rest, None)
                writer.close()
                done += (writer.entries, writer.tokens)

            path = write_once(target, f"{part:06d}-{piece:04d}", fill)
            yield pa.RecordBatch.from_pydict({"path": [path], "part": [part], "piece": [piece], "n_docs": [done[0]], "n_tokens": [done[1]]})
            piece += 1

    manifest = stage(rows.mapInArrow(write, MANIFEST), "sstable-manifest")
    order = Window.orderBy("part", "piece")  # one row a shard
    return manifest.withColumn("start", F.sum("n_tokens").over(order) - F.col("n_tokens"))


def read_sstables(manifest: DataFrame) -> DataFrame:
    """Reads the shards back: ``doc_id, start, n_tokens, ids`` (little-endian uint32, binary)."""
    ship(manifest.sparkSession)
    shards = stage(manifest.select("path", "start"), "sstable-shards")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, place = filesystem(path)
                with files.open_input_file(place) as file:
                    table, rows, size = Table(file), [], 0
                    wide = np.dtype(np.uint16 if table.width == 2 else np.uint32)
                    for key, value in table.scan():
                        n = len(value) // table.width
                        rows.append((id_of(key), start, n, np.frombuffer(value, wide).astype("<u4").tobytes()))
                        start += n
                        size += n
                        if size > 1 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        k, s, n, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, keys: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Point lookups of a few identifiers from the driver, by filter and binary search in each shard."""
    out: dict[int | None, list[np.ndarray]] = {k: [] for k in keys}
    for row in manifest.orderBy("part", "piece").select("path").toLocalIterator():
        files, place = filesystem(row.path)
        with files.open_input_file(place) as file:
            table = Table(file)
            for k in keys:
                out[k] += [np.frombuffer(v, np.uint16 if table.width == 2 else np.uint32) for v in table.get(key_of(k))]
    return out
