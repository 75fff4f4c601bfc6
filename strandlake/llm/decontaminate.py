"""Operator 3: benchmark decontamination with a positional inverted index.

The index is split by document: each segment (about 8 MB of text) holds, for every word of
its documents, the ascending positions.  The test items are prepared once, in files of about
``BLOCK`` bytes of text: distinct words, items as word numbers, and the windows listed by their
rarest word among the items.  A worker maps those files once.  In a segment only the windows
whose rarest word occurs there are looked at, and of these only those with all words there are
searched, from the word that is rarest in the segment on: positions of the next rarer word,
adjusted by its offset in the phrase, are intersected until none is left.  Nothing is
shuffled, and memory is bounded by a segment and the mapped pages of the items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  A window is ``window``
consecutive words of an item; a shorter item with a word is one window.

Special cases: null and empty texts have no words and no hits; an empty benchmark hits
nothing; repeated documents and items are treated each; a null item identifier counts as
the empty string; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import new_folder, ship, slices, stage, text_bytes, text_hash, write_once
from strandlake.llm.elias_fano import open_arrays, write_arrays
from strandlake.llm.words import LETTERS, split_words

INDEX = "doc_ids array<long>, hashes array<long>, first array<long>, vocabulary binary, bounds binary, counts binary, postings binary"
HITS = "doc_id long, text_hash long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:long,length:long>>"


class Segment:
    """Words of some documents with their ascending positions, counted over the segment."""

    def __init__(self, doc_ids, hashes, first: np.ndarray, vocabulary: pa.BinaryArray, counts: np.ndarray, postings: np.ndarray):
        self.doc_ids, self.hashes, self.first, self.vocabulary, self.postings = doc_ids, hashes, first, vocabulary, postings
        self.begin = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def of(cls, doc_ids, hashes, column: pa.Array) -> "Segment":
        words = split_words(column, LETTERS)
        keys = (words.codes.astype(np.int64) << 32) | np.arange(len(words.codes))
        keys.sort()
        return cls(doc_ids, hashes, words.first, words.vocabulary, np.bincount(words.codes, minlength=len(words.vocabulary)), keys & 0xFFFFFFFF)

    def row(self) -> dict:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        data, bounds = text_bytes(self.vocabulary)
        steps = np.diff(self.postings, prepend=0).astype("<i4")
        return {
            "doc_ids": self.doc_ids,
            "hashes": self.hashes,
            "first": self.first,
            "vocabulary": squeeze(data.tobytes()),
            "bounds": squeeze(np.diff(bounds).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()),
            "counts": squeeze(np.diff(self.begin).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()),
            "postings": squeeze(steps.view(np.uint8).reshape(-1, 4).T.tobytes()),
        }

    @classmethod
    def from_row(cls, row: dict) -> "Segment":
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        plain = lambda name, kind: np.ascontiguousarray(np.frombuffer(unzip(row[name]), np.uint8).reshape(4, -1).T).view(kind).ravel()
        data = unzip(row["vocabulary"])
        bounds = np.concatenate([[0], np.cumsum(plain("bounds", "<u4"), dtype=np.int64)]).astype(np.int32)
        vocabulary = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return cls(row["doc_ids"], row["hashes"], np.asarray(row["first"], np.int64), vocabulary, plain("counts", "<u4").astype(np.int64), np.cumsum(plain("postings", "<i4"), dtype=np.int64))

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.begin[term] : self.begin[term + 1]]

    def codes(self, words: pa.Array) -> np.ndarray:
        """Term numbers of words, -1 for those that the segment lacks."""
        return np.asarray(pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1)).astype(np.int64)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """First positions of exact occurrences of a phrase within one document."""
        sizes = self.begin[terms + 1] - self.begin[terms]
        order = np.argsort(sizes, kind="stable")
        found = self.positions(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            there = self.positions(terms[k])
            at = np.searchsorted(there, found + k)
            at[at == len(there)] = 0
            found = found[there[at] == found + k]
        return found[(found >= 0) & (self.doc_of(found) == self.doc_of(found + len(terms) - 1))]

    def near(self, terms: np.ndarray, within: int) -> list[tuple[int, int]]:
        """(first, last) positions of minimal spans of at most ``within`` words that hold all terms, in any order."""
        terms = np.unique(terms)
        sizes = self.begin[terms + 1] - self.begin[terms]
        rare = self.positions(terms[np.argmin(sizes)])
        rows = []
        for t in terms:
            there = self.positions(t)
            close = np.searchsorted(rare, there - within + 1) < np.searchsorted(rare, there + within - 1, "right")
            rows.append(np.stack([there[close], np.full(int(close.sum()), t)]))
        at, who = np.concatenate(rows, axis=1)
        order = np.argsort(at, kind="stable")
        last: dict[int, int] = {}
        out: list[tuple[int, int]] = []
        doc = -1
        for p, t, d in zip(at[order].tolist(), who[order].tolist(), self.doc_of(at[order]).tolist(), strict=True):
            if d != doc:
                last, doc = {}, d
            last[t] = p
            if len(last) == len(terms):
                begin = min(last.values())
                if p - begin < within and (not out or out[-1][0] != begin):
                    out.append((begin, p))
        return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the index of all documents and reads it again: one row a segment."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("vocabulary", "bounds", "counts", "postings"))])
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_pylist([Segment.of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)).row()], kinds)

    return stage(rows.mapInArrow(index, INDEX), "positional-index")


#: Bytes of item text in one file.
BLOCK = 16 << 20

_blocks: dict[str, "Block"] = {}


class Block:
    """Prepared test items: ``first`` and ``codes`` are the items' words as numbers in ``vocabulary``; ``listed[head[w]:head[w + 1]]`` are places where windows begin whose rarest word is w."""

    def __init__(self, arrays: list[np.ndarray]):
        data, bounds, self.codes, self.first, self.head, self.listed, names = arrays
        self.vocabulary = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        self.names = json.loads(names.tobytes())

    @staticmethod
    def arrays(batch: pa.RecordBatch, window: int) -> list[np.ndarray]:
        words = split_words(batch.column(1), LETTERS)
        codes, first, size = words.codes.astype(np.int64), words.first, len(words.vocabulary)
        n = words.lengths()
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        length = np.repeat(np.minimum(n, window), count)
        seen = np.bincount(codes, minlength=size)
        rank = np.empty(size, np.int64)
        rank[np.argsort(seen, kind="stable")] = np.arange(size)  # a rarer word has a lower rank
        least = np.full(len(begin), size, np.int64)
        for k in range(window):
            inside = length > k
            least[inside] = np.minimum(least[inside], rank[codes[begin[inside] + k]])
        word = np.argsort(rank, kind="stable")[least] if len(least) else least
        order = np.argsort(word, kind="stable")
        data, bounds = text_bytes(words.vocabulary)
        names = np.frombuffer(json.dumps([x or "" for x in batch.column(0).to_pylist()]).encode(), np.uint8)
        head = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=size))])
        return [data, bounds.astype(np.int32), codes.astype(np.uint32), first.astype(np.int64), head, begin[order], names]

    @classmethod
    def open(cls, uri: str) -> "Block":
        if uri not in _blocks:
            if len(_blocks) > 64:
                _blocks.clear()
            _blocks[uri] = cls(open_arrays(uri))
        return _blocks[uri]


def prepare_items(benchmark: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Writes the items' files to the shared folder, each word split once; returns their URIs (one for about ``BLOCK`` bytes)."""
    spark = benchmark.sparkSession
    ship(spark)
    folder = new_folder(spark, "benchmark-blocks")
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            path = write_once(folder, "items", lambda out, b=batch: write_arrays(out, Block.arrays(b, window)))
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [batch.num_rows]})

    return [r.path for r in rows.mapInArrow(write, "path string, n long").collect()]


def find_contamination(index: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Exact occurrences of benchmark windows in every indexed document.

    Returns ``doc_id, text_hash, n_words, n_hit`` (words inside an occurrence), ``n_items``, ``item_ids``
    (sorted as strings) and ``spans`` (maximal runs of hit words) for each document.
    """
    ship(index.sparkSession)
    paths = prepare_items(benchmark, window, id_col, text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment.from_row({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})
                yield _found(segment, map(Block.open, paths), window)

    return index.mapInArrow(search, HITS)


def _found(segment: Segment, blocks, window: int) -> pa.RecordBatch:
    n = int(segment.first[-1])
    edge = np.zeros(n + 1, np.int64)
    hits: dict[int, set[str]] = {}
    for block in blocks:
        terms = segment.codes(block.vocabulary)  # of each word of the items, -1 where the segment lacks it
        present = np.flatnonzero(terms >= 0)
        many = block.head[present + 1] - block.head[present]
        at = block.listed[np.repeat(block.head[present] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(present) else present
        item = np.searchsorted(block.first, at, "right") - 1
        size = np.minimum(window, block.first[item + 1] - at)
        whole = np.ones(len(at), bool)
        for k in range(window):
            inside = np.flatnonzero(whole & (size > k))
            whole[inside] = terms[block.codes[at[inside] + k]] >= 0
        for s, i, m in zip(at[whole].tolist(), item[whole].tolist(), size[whole].tolist(), strict=True):
            found = segment.phrase(terms[block.codes[s : s + m]])
            if len(found):
                np.add.at(edge, found, 1)
                np.add.at(edge, found + m, -1)
                for d in np.unique(segment.doc_of(found)).tolist():
                    hits.setdefault(d, set()).add(block.names[i])
    inside = np.cumsum(edge)[:n] > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    n_hit = np.diff(total[segment.first])
    items: list[list[str]] = [[]] * len(segment.doc_ids)
    spans: list[list[dict]] = [[]] * len(segment.doc_ids)
    for d, found in hits.items():
        items[d] = sorted(found)
        own = np.diff(np.concatenate([[0], inside[segment.first[d] : segment.first[d + 1]].astype(np.int8), [0]]))
        begin, end = np.flatnonzero(own == 1), np.flatnonzero(own == -1)
        spans[d] = [{"start": s, "length": e - s} for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(segment.doc_ids, pa.int64()), pa.array(segment.hashes, pa.int64()), pa.array(np.diff(segment.first)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
        names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "item_ids", "spans"],
    )


def find_near(index: DataFrame, phrases: list[str], within: int) -> DataFrame:
    """Proximity matches: ``phrase, doc_id, start, length`` of minimal spans of at most ``within`` words that hold all words of a phrase."""
    ship(index.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = split_words(pa.array(phrases, pa.string()), LETTERS)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment.from_row({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})
                terms = segment.codes(words.vocabulary)[words.codes] if len(words.codes) else np.zeros(0, np.int64)
                rows = []
                for k, phrase in enumerate(phrases):
                    own = terms[words.first[k] : words.first[k + 1]]
                    if len(own) and own.min() >= 0:
                        for a, z in segment.near(own, within):
                            d = int(segment.doc_of(np.array([a]))[0])
                            rows.append({"phrase": phrase, "doc_id": segment.doc_ids[d], "start": a - int(segment.first[d]), "length": z - a + 1})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("phrase", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))

    return index.mapInArrow(search, "phrase string, doc_id long, start long, length long")


def contaminated(n_words="n_words", n_hit="n_hit"):
    """A twentieth of a document's words, and one at least, is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
