"""Operator 8: order-preserving packing of token streams by dynamic programming.

Documents, in identifier order, form one stream of ids in each range partition.  The stream
is cut into windows of at most ``length`` ids.  Cuts may stand at document ends (free), at
sentence or line ends (``sentence_cost``) and, where those are further apart than ``grid``
ids, at every ``grid``-th id in between (``hard_cost``).  The cost of a window is
``sequence_cost``, its padding - nothing for full windows and for powers of two, which need
none - and the cost of its cut.  A window costs as much as a whole sequence of padding, so
short powers of two are no way round it.  The least total is found from left to right: the
best predecessor within reach comes from a monotone queue, those at a distance of a power
of two are looked up.

One program runs through a whole partition.  After each batch the windows that every best
way has in common are final and leave; the few ids behind them stay for the next batch.

Special cases: null texts are empty documents (the end id alone); an empty table has no
pieces; repeated rows are packed each; null identifiers come first (a hash of the text
spreads equal identifiers over partitions); other columns are ignored.  A task holds one
batch of about 16 MB of text, or one longer text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ship, slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_points(ends: np.ndarray, doc_ends: np.ndarray, grid: int, sentence_cost: float, hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) where windows may end.  ``ends`` is the mask of sentence ends over ids."""
    soft = np.unique(np.concatenate([np.flatnonzero(ends) + 1, doc_ends]))
    before = np.concatenate([[0], soft[:-1]])
    extra = (soft - before - 1) // grid
    hard = np.repeat(before, extra) + grid * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    at = np.concatenate([soft, hard])
    cost = np.concatenate([np.where(np.isin(soft, doc_ends, assume_unique=False), 0.0, sentence_cost), np.full(len(hard), float(hard_cost))])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


class Cutter:
    """The dynamic program over a growing stream of cut points."""

    def __init__(self, length: int, sequence_cost: float):
        self.length, self.sequence_cost = length, float(sequence_cost)
        self.powers = [p for p in (1 << k for k in range(length.bit_length())) if p <= length]
        self.pos, self.best, self.back = [0], [0.0], [0]
        self.value = [0.0]  # best + place, which the queue orders
        self.queue: deque[int] = deque([0])

    def extend(self, at: np.ndarray, cost: np.ndarray) -> None:
        """Adds cut points behind the last one; ``at`` ascends, with steps of at most ``length``."""
        first, n = len(self.pos), len(at)
        if not n:
            return
        place = np.concatenate([np.array(self.pos, np.int64), at])
        to, source = [], []
        for p in self.powers:
            want = place[first:] - p
            k = np.searchsorted(place, want)
            hit = place[np.minimum(k, len(place) - 1)] == want
            to.append(np.flatnonzero(hit))
            source.append(k[hit])
        to, source = np.concatenate(to), np.concatenate(source)
        order = np.argsort(to, kind="stable")
        source = source[order].tolist()
        upto = np.searchsorted(to[order], np.arange(n + 1)).tolist()
        pos, best, back, value, queue, length = self.pos, self.best, self.back, self.value, self.queue, self.length
        pos += at.tolist()
        for j, pay in enumerate((cost + self.sequence_cost).tolist()):
            p = pos[first + j]
            low = p - length
            while pos[queue[0]] < low:
                queue.popleft()
            i = queue[0]
            least = value[i] + length - p
            for k in range(upto[j], upto[j + 1]):
                s = source[k]
                if best[s] < least:
                    least, i = best[s], s
            least += pay
            best.append(least)
            back.append(i)
            v = least + p
            value.append(v)
            while queue and value[queue[-1]] >= v:
                queue.pop()
            queue.append(first + j)

    def _cuts_to(self, j: int) -> list[int]:
        """Ends of the windows of the best way to point ``j``; the stream goes on from there."""
        out, k = [], j
        while k:
            out.append(self.pos[k])
            k = self.back[k]
        self.pos, self.best, self.value = self.pos[j:], self.best[j:], self.value[j:]
        self.back = [0] + [max(0, k - j) for k in self.back[j + 1 :]]
        self.queue = deque(k - j for k in self.queue if k >= j)
        return out[::-1]

    def settled(self) -> list[int]:
        """The windows that all ways to points still within reach share."""
        from heapq import heapify, heappop, heappush

        low = self.pos[-1] - self.length
        near = [-j for j in range(len(self.pos) - 1, -1, -1) if self.pos[j] >= low]
        heapify(near)
        seen = set(near)
        while len(near) > 1:
            k = -self.back[-heappop(near)]
            if k not in seen:
                seen.add(k)
                heappush(near, k)
        return self._cuts_to(-near[0])

    def finish(self) -> list[int]:
        return self._cuts_to(len(self.pos) - 1)


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int, sequence_cost: float = 0.0) -> np.ndarray:
    """Ends of the windows of least total cost; ``at`` ascends, with steps of at most ``length``."""
    cutter = Cutter(length, sequence_cost)
    cutter.extend(np.asarray(at, np.int64), np.asarray(cost, float))
    return np.array(cutter.finish(), np.int64)


class _Stream:
    """Ids that wait for their window, with the documents they belong to."""

    def __init__(self):
        self.base, self.opened = 0, 0  # place of the first waiting id, and of the window that it lies in
        self.ids = np.zeros(0, "<u4")
        self.keys, self.totals = pa.array([], pa.int64()), np.zeros(0, np.int64)
        self.starts, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # within the document; place behind its last id

    def add(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        end = self.base + len(self.ids)
        self.ids = np.concatenate([self.ids, ids.astype("<u4", copy=False)])
        self.keys = pa.concat_arrays([self.keys, keys])
        self.totals = np.concatenate([self.totals, np.diff(offsets)])
        self.starts = np.concatenate([self.starts, np.zeros(len(offsets) - 1, np.int64)])
        self.ends = np.concatenate([self.ends, end + offsets[1:]])

    def take(self, cuts: list[int], sequence: int) -> Iterator[pa.RecordBatch]:
        """The pieces up to the last cut; the first cut ends the window numbered ``sequence``."""
        if not cuts:
            return
        cut = np.array(cuts, np.int64)
        last = cut[-1]
        whole = np.searchsorted(self.ends, last, "right")
        stops = np.union1d(cut, self.ends[:whole])
        begins = np.concatenate([[self.base], stops[:-1]])
        doc = np.searchsorted(self.ends, begins, "right")
        first = np.concatenate([[self.base], self.ends[:-1]])[doc]
        window = np.searchsorted(cut, begins, "right")
        opened = np.concatenate([[self.opened], cut])[window]
        for a in range(0, len(stops), 1 << 16):
            z = min(a + (1 << 16), len(stops))
            bounds = np.append(begins[a:z], stops[z - 1])
            blob = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(((bounds - bounds[0]) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.ids[bounds[0] - self.base : bounds[-1] - self.base]))])
            d = doc[a:z]
            yield pa.RecordBatch.from_arrays(
                [self.keys.take(pa.array(d)), pa.array(self.starts[d] + begins[a:z] - first[a:z]), pa.array(stops[a:z] - begins[a:z]), blob, pa.array(self.totals[d]), pa.array(sequence + window[a:z]), pa.array(begins[a:z] - opened[a:z])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
        before = self.ends[whole - 1] if whole else self.base  # a document that goes on has left some ids
        if whole < len(self.ends):
            self.starts[whole] += last - max(before, self.base)
        self.ids, self.base, self.opened = self.ids[last - self.base :], int(last), int(last)
        self.keys, self.totals, self.starts, self.ends = self.keys.slice(whole), self.totals[whole:], self.starts[whole:], self.ends[whole:]


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, grid: int = 32, sentence_cost: float = 1.0, hard_cost: float = 8.0, sequence_cost: float | None = None, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 16 << 20) -> DataFrame:
    """Packs every document; returns its pieces: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian uint32.  Sequences never span partitions; a partition closes
    its last one at a power of two where that saves padding.  ``sequence_id`` is unique and
    ascends with the stream.  ``sequence_cost`` is ``length`` if not given.
    """
    ship(docs.sparkSession)
    price = float(length) if sequence_cost is None else sequence_cost
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").drop("h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from strandlake.llm.tokens import encoder

        encode = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        cutter, stream = Cutter(length, price), _Stream()
        for batch in slices(batches, "t", slice_bytes):
            ids, offsets, ends = encode.encode(batch.column(1), end_id, boundaries=True)
            at, cost = cut_points(ends, offsets[1:], grid, sentence_cost, hard_cost)
            cutter.extend(at + stream.base + len(stream.ids), cost)
            stream.add(batch.column(0), ids, offsets)
            cuts = cutter.settled()
            yield from stream.take(cuts, sequence)
            sequence += len(cuts)
        yield from stream.take(cutter.finish(), sequence)

    return rows.mapInArrow(pack, PIECES)
