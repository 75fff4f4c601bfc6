"""Operator 6: an n-gram language model in an Elias-Fano trie.

Level 1 is the vocabulary: sorted 63-bit word hashes in ranges, with exact counts as the steps
of a monotone sequence of running sums.  All longer n-grams lie in shards: contiguous ranges
of the n-grams sorted by word numbers, cut by their first two words.  A shard is a trie of its
own in one file of compact, memory-mapped sequences: for each level monotone pointers from
the parents to their children, the children (parent's place and word) as one ascending
sequence, 8-bit codes of the discounted probabilities and of the back-off weights.  A lookup
takes the parent's range from the pointers and finds the word there by successor search.

Smoothing is interpolated absolute discounting: p(w | h) = max(c - D, 0) / C + D T / C * p(w | h'),
with D = n1 / (n1 + 2 n2) of the level in the shard; level 1 is the add-one-half estimate, which
gives unknown words their share.  Each context of two words or more lies in one shard; one word that
very many n-grams begin with is dealt out over several shards, and its weight D T / C is summed
over them, so all orders are normalised but for the 8-bit codes (2 % at most in the test).

Nothing holds the whole model.  Training: texts become slices of word codes (files in the shared
folder); their distinct words go to the ranges of level 1 and come back as numbers; their distinct
n-grams, counted in the slice, go to the shards, which merge them as they come.  Scoring asks
the same way: distinct words, then distinct n-grams of a slice, sorted, go to the range or shard that
answers them, and the answers go back to the slice.  A task opens one range or shard at a
time and only the pages that it needs; the driver holds the list of files, the shards' limits and
the weights of dealt-out words (a few bytes for ``shard_tokens`` training tokens).

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), then one end for each text; the end also
stands before the first word as its context.  Counting covers every training row.

Special cases: null texts are empty (one end); an empty training set gives every token the
unknown share; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, drop_folder, new_folder, release, ship, slices, stage_and_free, write_once
from strandlake.llm.elias_fano import EliasFano, open_arrays, write_arrays
from strandlake.llm.words import split_words

#: Hash of the end of a text; no word is empty.
END = 0
HASH_BITS = 63
#: Bytes of text in a slice.
SLICE = 6 << 20
#: N-grams that a shard gathers before it merges them.
MERGE = 1 << 20

_open_last: dict[str, list[np.ndarray]] = {}


def _open(uri: str) -> list[np.ndarray]:
    """The arrays of a file; only the last two files stay open."""
    if uri not in _open_last:
        while len(_open_last) > 1:
            _open_last.pop(next(iter(_open_last)))
        _open_last[uri] = open_arrays(uri)
    return _open_last[uri]


def _squeeze(a: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of their places."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _plain(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(a: np.ndarray) -> bytes:
    """An ascending sequence of 63-bit numbers."""
    return _squeeze(np.diff(a.astype(np.int64), prepend=0).astype("<u8"))


def _sums(raw: bytes) -> np.ndarray:
    return np.cumsum(_plain(raw, "<u8").astype(np.int64))


def _unique(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct rows in ascending order, the number of each row's own, how often each occurs) of columns of any numbers."""
    order = np.lexsort(cols[::-1])
    rows = [c[order] for c in cols]
    heads = _heads(rows)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(heads) - 1
    at = np.flatnonzero(heads)
    return [c[at] for c in rows], own, np.diff(np.append(at, len(order)))


def _heads(rows: list[np.ndarray]) -> np.ndarray:
    """Mask of sorted rows that differ from the one before."""
    heads = np.zeros(len(rows[0]), bool)
    heads[:1] = True
    for c in rows:
        heads[1:] |= c[1:] != c[:-1]
    return heads


@dataclass(frozen=True)
class Shape:
    """How n-grams are held: words below 2**bits, the first one ``base`` plus a number below 2**lead; as one 63-bit number each where they fit."""

    width: int
    bits: int
    lead: int
    base: int = 0

    @property
    def packed(self) -> bool:
        return self.lead + (self.width - 1) * self.bits <= 63


class Grams:
    """Ascending n-grams of word numbers."""

    def __init__(self, shape: Shape, rows: list[np.ndarray]):
        self.shape, self.rows = shape, rows

    def __len__(self) -> int:
        return len(self.rows[0])

    @classmethod
    def of(cls, cols: list[np.ndarray], shape: Shape) -> "Grams":
        if not shape.packed:
            return cls(shape, cols)
        key = cols[0] - shape.base
        for c in cols[1:]:
            key <<= shape.bits
            key |= c
        return cls(shape, [key])

    def distinct(self, inverse: bool = False) -> tuple["Grams", np.ndarray | None, np.ndarray]:
        """(distinct rows in order, the number of each row's own if asked for, how often each occurs)."""
        if not self.shape.packed:
            cols, own, many = _unique(self.rows)
        elif inverse:
            key, own, many = np.unique(self.rows[0], return_inverse=True, return_counts=True)
            cols = [key]
        else:
            key, own = np.sort(self.rows[0]), None
            at = np.flatnonzero(_heads([key]))
            cols, many = [key[at]], np.diff(np.append(at, len(key)))
        return Grams(self.shape, cols), own, many

    def first(self, k: int) -> list[np.ndarray]:
        """The first k words, as columns that ascend together."""
        return [self.rows[0] >> (self.shape.bits * (self.shape.width - k))] if self.shape.packed else self.rows[:k]

    def word(self, k: int) -> np.ndarray:
        if not self.shape.packed:
            return self.rows[k]
        x = self.rows[0] >> (self.shape.bits * (self.shape.width - 1 - k))
        return x & ((1 << self.shape.bits) - 1) if k else x + self.shape.base

    def heads(self, k: int) -> np.ndarray:
        """Rows whose first k words differ from the row before (rows are distinct)."""
        return np.arange(len(self)) if k == self.shape.width else np.flatnonzero(_heads(self.first(k)))

    def cut(self, a: int, z: int) -> "Grams":
        return Grams(self.shape, [c[a:z] for c in self.rows])

    def blob(self) -> bytes:
        parts = [_steps(self.rows[0]), *(_squeeze(c.astype("<u4")) for c in self.rows[1:])]
        return b"".join(len(x).to_bytes(4, "little") + x for x in parts)

    @classmethod
    def read(cls, blob: bytes, shape: Shape) -> "Grams":
        parts, at = [], 0
        while at < len(blob):
            size = int.from_bytes(blob[at : at + 4], "little")
            parts.append(blob[at + 4 : at + 4 + size])
            at += 4 + size
        return cls(shape, [_sums(parts[0]), *(_plain(x, "<u4").astype(np.int64) for x in parts[1:])])


@dataclass
class Model:
    """Where the levels lie, and the totals.

    ``words``: (uri, least hash, first number, words) of each range; ``bounds``: the least
    first two words of each shard as one number; ``shards``: their files (empty: no n-gram);
    ``dealt``: back-off weights of first words that several shards share; ``levels[k]`` names the shards;
    ``ranges``: which of the ``range_count`` ranges of hashes have words.
    """

    order: int
    words: list[tuple[str, int, int, int]] = field(default_factory=list)
    tokens: int = 0
    vocabulary: int = 0
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    shards: list[str] = field(default_factory=list)
    dealt: dict[int, float] = field(default_factory=dict)
    ranges: list[int] = field(default_factory=list)
    range_count: int = 1

    @property
    def levels(self) -> dict[int, list[str]]:
        return {k: self.shards for k in range(2, self.order + 1)}

    @property
    def unknown(self) -> int:
        """The number of words outside the vocabulary."""
        return self.vocabulary

    @property
    def nothing(self) -> int:
        """The number that stands behind the end of a text; the greatest."""
        return self.vocabulary + 1

    def shape(self, shard: int) -> Shape:
        """How a shard's n-grams are held: their first words lie close together."""
        wide = self.vocabulary + 2
        base = int(self.bounds[shard]) // wide
        last = (int(self.bounds[shard + 1]) - 1) // wide if shard + 1 < len(self.bounds) else self.vocabulary
        return Shape(self.order, (self.vocabulary + 1).bit_length(), max(1, (last - base).bit_length()), base)

    def lookup_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids or -1, counts) of word hashes; for a few lookups."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for uri, _, first, n in self.words:
            at, many = _find_words(uri, hashes)
            ids[at < n] = first + at[at < n]
            counts[at < n] = many[at < n]
        return ids, counts

    def shard_of(self, cols: list[np.ndarray]) -> np.ndarray:
        return np.searchsorted(self.bounds, cols[0] * (self.vocabulary + 2) + cols[1], "right") - 1

    def children(self, level: int, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in its shard or -1, discounted probability or 0, back-off weight) of ``words`` behind single words (level 2); for a few lookups."""
        if level != 2:
            raise ValueError("only contexts of one word")
        node, share, back = np.full(len(parents), -1, np.int64), np.zeros(len(parents)), np.ones(len(parents))
        which = self.shard_of([parents, words])
        for s in np.unique(which):
            own = np.flatnonzero(which == s)
            if self.shards[s]:
                bits = (self.vocabulary + 1).bit_length()
                asked, at, _ = Grams.of([parents[own], words[own]], Shape(2, bits, bits)).distinct(True)
                found, code, known, weight, book, weight_book = Shard(self.shards[s], self).look(asked)[0]
                of = np.searchsorted(asked.heads(1), np.arange(len(asked)), "right") - 1
                node[own], share[own], back[own] = found[at], np.where(found >= 0, book[code], 0)[at], np.where(known, weight_book[weight], 1)[of][at]
        for word, weight in self.dealt.items():
            back[parents == word] = weight
        return node, share, back


class Shard:
    """A trie of the n-grams whose first two words lie in a range.

    Questions come sorted and many at a time, so each sequence is decoded once and the
    successors within the context's children are found for all of them together.
    """

    def __init__(self, uri: str, model: Model):
        arrays = iter(_open(uri))
        sequence = lambda: EliasFano.from_arrays(*(next(arrays) for _ in range(4))).values()
        self.model, self.first = model, sequence()
        self.levels = []
        while (head := next(arrays, None)) is not None:
            pointers = EliasFano.from_arrays(head, *(next(arrays) for _ in range(3))).values()
            self.levels.append((pointers, sequence(), *(np.asarray(next(arrays)) for _ in range(4))))

    def look(self, asked: Grams) -> list[tuple]:
        """Answers to sorted n-grams, for each level k from 2 on, over their distinct prefixes.

        (place or -1 and code of each prefix of k words; context known and code of its weight of
        each prefix of k - 1 words; the books of codes and weights)
        """
        out, size = [], self.model.vocabulary
        heads = asked.heads(1)
        words = asked.word(0)[heads]
        at = np.searchsorted(self.first, words)
        place = np.where((at < len(self.first)) & (self.first[np.minimum(at, len(self.first) - 1)] == words), at, -1)
        for k, (pointers, grams, codes, book, weights, weight_book) in enumerate(self.levels, 2):
            if k > asked.shape.width:
                break
            own = np.flatnonzero(place >= 0)
            known, weight = np.zeros(len(place), bool), np.zeros(len(place), np.uint8)
            known[own] = pointers[place[own] + 1] > pointers[place[own]]
            weight[known] = weights[place[known]]
            new = asked.heads(k)
            many = np.diff(np.append(np.searchsorted(new, heads), len(new)))  # prefixes of k words under each of k - 1
            parent = np.repeat(np.arange(len(heads)), many)
            words = asked.word(k - 1)
            words = words if len(new) == len(words) else words[new]
            ask = np.flatnonzero(known[parent] & (words < size))
            key = place[parent[ask]] * size + words[ask]
            at = np.searchsorted(grams, key)
            there = np.minimum(at, len(grams) - 1)
            found = grams[there] == key if len(grams) else np.zeros(len(key), bool)
            node, code = np.full(len(new), -1, np.int64), np.zeros(len(new), np.uint8)
            node[ask[found]] = there[found]
            code[ask[found]] = codes[there[found]]
            out.append((node, code, known, weight, book, weight_book))
            heads, place = new, node
        return out


def _find_words(uri: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the range, or its size, count) of word hashes."""
    arrays = _open(uri)
    sequence, running = EliasFano.from_arrays(*arrays[:4]), EliasFano.from_arrays(*arrays[4:8])
    at, found = sequence.successor(hashes)
    own = np.flatnonzero(found)
    counts = np.zeros(len(hashes), np.int64)
    counts[own] = (running.get(at[own] + 1) - running.get(at[own])).astype(np.int64)
    return np.where(found, at, sequence.n), counts


def _tokens(column: pa.Array):
    """(vocabulary hashes with the end last, codes with an end before and after each text, first, lengths in tokens)."""
    words = split_words(column)
    hashes = np.append(words.hashes() >> np.uint64(1), np.uint64(END))
    n = words.lengths()
    first = np.concatenate([[0], np.cumsum(n + 2)])
    codes = np.full(first[-1], len(hashes) - 1, np.int64)
    place = np.arange(len(words.codes)) + np.repeat(1 + 2 * np.arange(len(n)), n)
    codes[place] = words.codes
    return hashes, codes, first, n + 1


def _book(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit codes, 256 levels): bins over the distinct values on the log scale, their geometric means.

    Bins share the distinct values, not the rows: the many equal small counts need few codes.
    """
    if not len(values):
        return np.zeros(0, np.uint8), np.ones(256)
    log = np.log(values)
    distinct = np.unique(np.concatenate([np.unique(np.round(log[at : at + 500_000], 4)) for at in range(0, len(log), 500_000)]))
    edges = (distinct[1:] + distinct[:-1]) / 2 if len(distinct) <= 256 else np.quantile(distinct, np.linspace(0, 1, 257)[1:-1])
    codes = np.searchsorted(edges, log, "right").astype(np.uint8)
    size = np.bincount(codes, minlength=256)
    mean = np.bincount(codes, log, minlength=256) / np.maximum(size, 1)
    return codes, np.where(size > 0, np.exp(mean), 1.0)



# --- slices ------------------------------------------------------------------------------------

def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _slice_texts(rows: DataFrame, folder: str, ranges: int) -> DataFrame:
    """Rows ``k`` (any type), ``t`` as slices: distinct word hashes and counts by range, and for each slice a row ``meta`` with its file and the k.

    ``r, meta, slice, path, ids, keys, counts``
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["k"].dataType
    arrow = pa.list_(to_arrow_type(kind))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        limits = np.array([-(-(r << HASH_BITS) // ranges) for r in range(ranges)] + [1 << HASH_BITS], np.uint64)
        for batch in slices(batches, "t", SLICE):
            hashes, codes, first, n = _tokens(batch.column(1))
            hashes, own = np.unique(hashes, return_inverse=True)
            codes = own[codes]
            many = np.bincount(codes, minlength=len(hashes))
            many[0] -= len(n)  # the end (hash 0) before a text is no token
            blobs = [np.frombuffer(x, np.uint8) for x in (_squeeze(n.astype("<u4")), _squeeze(codes.astype("<u4")))]
            path = write_once(folder, "slice", lambda out, b=blobs: write_arrays(out, b))
            edges = np.searchsorted(hashes, limits).tolist()
            out = [(r, False, number, None, None, _steps(hashes[a:z]), _squeeze(many[a:z].astype("<u4"))) for r, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]
            out.append((number % ranges, True, number, path, batch.column(0).to_pylist(), None, None))
            yield _batch(out, r=pa.int32(), meta=pa.bool_(), slice=pa.int64(), path=pa.string(), ids=arrow, keys=pa.binary(), counts=pa.binary())
            number += 1

    return rows.mapInArrow(cut, f"r int, meta boolean, slice long, path string, ids array<{kind.simpleString()}>, keys binary, counts binary")


def _rows_by(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Sorted rows in groups of equal ``key`` columns; a group is read as it comes."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True))
    yield from groupby(rows, key=lambda row: row[key])


def _read_slice(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, codes, first places of texts and the end)."""
    n, codes = (_plain(x.tobytes(), "<u4").astype(np.int64) for x in open_arrays(path))
    return n, codes, np.concatenate([[0], np.cumsum(n + 1)])


def _grams(codes: np.ndarray, numbers: np.ndarray, first: np.ndarray, model: Model, inverse: bool = False):
    """The n-grams of a slice, from its word codes and the model's numbers of its words (ascending but for unknown ones).

    (places where they begin - all but the last of each text -, their last words in the slice's own numbers,
    distinct n-grams in the slice's own numbers, number of each place's own, counts, the model's number of each own number)

    The slice's own numbers are small, so its n-grams fit one number each; they ascend as the
    model's numbers do.  Behind the end stands ``nothing``; the end (code 0) stands second or later only where a text ends.
    """
    known = numbers < model.vocabulary
    size = int(known.sum())
    own = np.where(known, np.cumsum(known) - 1, size)
    ids = own[codes]
    begins = np.ones(len(ids), bool)
    begins[first[1:] - 1] = False
    cols, over = [ids], np.zeros(len(ids), bool)
    for k in range(1, model.order):
        shifted = np.full(len(ids), size + 1, np.int64)
        shifted[: max(0, len(ids) - k)] = ids[k:]
        shifted[over] = size + 1
        cols.append(shifted)
        over[: max(0, len(ids) - k)] |= codes[k:] == 0
    cols = [c[begins] for c in cols]
    bits = (size + 1).bit_length()
    grams, which, many = Grams.of(cols, Shape(model.order, bits, bits)).distinct(inverse)
    return np.flatnonzero(begins), cols, grams, which, many, np.append(numbers[known], [model.unknown, model.nothing])


def _dealt_out(grams: Grams, numbers: np.ndarray, model: Model) -> list[tuple[int, int, int, bytes]]:
    """(shard, first, end, blob) of a slice's distinct n-grams with a known first word, in the model's numbers."""
    cols = [numbers[grams.word(k)] for k in range(model.order)]
    wide = model.vocabulary + 2
    edges = np.searchsorted(cols[0] * wide + cols[1], np.append(model.bounds, model.vocabulary * wide)).tolist()
    return [(s, a, z, Grams.of([c[a:z] for c in cols], model.shape(s)).blob()) for s, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]


# --- training ----------------------------------------------------------------------------------


def _build_words(parts: DataFrame, folder: str, ranges: int, shard_tokens: int) -> DataFrame:
    """The ranges of level 1 (``kind`` 0), what their words are called in each slice (1: ``a`` has the places) and the slices' files (2)."""
    names = dict(kind=pa.int32(), r=pa.int32(), slice=pa.int64(), path=pa.string(), a=pa.binary(), n=pa.int64(), tokens=pa.int64(), least=pa.int64(), **dict.fromkeys(("marks", "hot", "hot_count"), pa.list_(pa.int64())))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _rows_by(batches, 0):
            asked, many, passed = [], [], []
            for _, meta, number, path, keys, counts in rows:
                if meta:
                    passed.append((2, r, number, path, None, 0, 0, 0, [], [], []))
                else:
                    asked.append((number, _sums(keys)))
                    many.append(_plain(counts, "<u4").astype(np.int64))
            yield _batch(passed, **names)
            if not asked:
                continue
            hashes, own = np.unique(np.concatenate([x for _, x in asked]), return_inverse=True)
            total = np.bincount(own, np.concatenate(many), minlength=len(hashes)).astype(np.int64)
            running = np.concatenate([[0], np.cumsum(total)])
            arrays = [*EliasFano.of(hashes, 1 << HASH_BITS).arrays(), *EliasFano.of(running, int(running[-1]) + 1).arrays()]
            path = write_once(folder, f"words-{r:06d}", lambda out, x=arrays: write_arrays(out, x))
            # where shards may begin: the words behind which another quota of tokens is full; words beyond the quota by themselves
            marks = np.unique(np.searchsorted(running, np.arange(1, int(running[-1]) // shard_tokens + 1) * shard_tokens))
            hot = np.flatnonzero(total > shard_tokens)
            yield _batch([(0, r, None, path, None, len(hashes), int(total.sum()), int(hashes[0]), marks[marks < len(hashes)].tolist(), hot.tolist(), total[hot].tolist())], **names)
            ends = np.cumsum([len(x) for _, x in asked])
            yield _batch([(1, r, number, None, _steps(own[z - len(x) : z]), 0, 0, 0, [], [], []) for (number, x), z in zip(asked, ends.tolist(), strict=True)], **names)

    dealt = parts.select("r", "meta", "slice", "path", "keys", "counts").repartitionById(ranges, F.col("r")).sortWithinPartitions("r", "slice")
    return dealt.mapInArrow(build, "kind int, r int, slice long, path string, a binary, n long, tokens long, least long, marks array<long>, hot array<long>, hot_count array<long>")


def _shard_bounds(model: Model, ranges: list) -> tuple[np.ndarray, dict[int, int]]:
    """(least first two words of each shard, counts of the words that are dealt out) from the ranges' marks.

    A word beyond the quota is cut at second words that share its n-grams evenly if these are as
    frequent behind it as anywhere.
    """
    wide = model.vocabulary + 2
    first = {r.r: f for r, (_, _, f, _) in zip(ranges, model.words, strict=True)}
    starts = sorted({0, *(first[r.r] + m for r in ranges for m in r.marks)})
    hot = {first[r.r] + h: c for r in ranges for h, c in zip(r.hot, r.hot_count, strict=True)}
    bounds = {s * wide for s in starts}
    quota = max(1, model.tokens // max(1, len(starts)))
    for word, count in hot.items():
        bounds |= {word * wide, (word + 1) * wide}
        pieces = min(len(starts), -(-count // quota))
        if pieces > 1:
            bounds |= {word * wide + starts[len(starts) * k // pieces] for k in range(1, pieces)}
    limits = np.array(sorted(b for b in bounds if b < model.vocabulary * wide), np.int64)
    inner = limits[limits % wide > 0] // wide
    return limits, {int(w): hot[int(w)] for w in np.unique(inner)}


def _count_grams(rows: DataFrame, model: Model) -> DataFrame:
    """Distinct n-grams of each slice with their counts, by shard."""
    base = np.array([f for _, _, f, _ in model.words], np.int64)
    place_of = {r: i for i, r in enumerate(model.ranges)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _rows_by(batches, 0):
            codes = first = None
            ids = []
            for _, r, path, a in group:
                if r < 0:
                    _, codes, first = _read_slice(path)
                else:
                    ids.append(base[place_of[r]] + _sums(a))
            _, _, grams, _, many, numbers = _grams(codes, np.concatenate(ids), first, model)
            out = [(s, number, blob, _squeeze(many[a:z].astype("<u4"))) for s, a, z, blob in _dealt_out(grams, numbers, model)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "slice", "keys", "counts"])

    return rows.mapInArrow(count, "shard int, slice long, keys binary, counts binary")


class _Merger:
    """Distinct n-grams with their counts, merged as pieces come: memory follows the distinct rows, not the pieces."""

    def __init__(self, shape: Shape):
        self.shape, self.rows, self.many = shape, None, None
        self.waiting: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, grams: Grams, many: np.ndarray) -> None:
        self.waiting.append((grams.rows, many))
        self.size += len(many)
        if self.size > max(MERGE, 0 if self.many is None else len(self.many)):
            self.merge()

    def merge(self) -> None:
        pieces = ([] if self.many is None else [(self.rows, self.many)]) + self.waiting
        self.rows, self.many, self.waiting, self.size = None, None, [], 0
        rows = [np.concatenate([c[k] for c, _ in pieces]) for k in range(len(pieces[0][0]))]
        many = np.concatenate([m for _, m in pieces])
        del pieces
        order = np.argsort(rows[0]) if len(rows) == 1 else np.lexsort(rows[::-1])
        rows, many = [c[order] for c in rows], many[order]
        del order
        at = np.flatnonzero(_heads(rows))
        self.rows, self.many = [c[at] for c in rows], np.add.reduceat(many, at) if len(at) else many

    def result(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of words, and the counts."""
        if self.waiting:
            self.merge()
        grams, many = Grams(self.shape, self.rows), self.many
        self.rows = self.many = None
        return [grams.word(k) for k in range(self.shape.width)], many


def _write_shard(cols: list[np.ndarray], many: np.ndarray, model: Model, dealt: dict[int, int], folder: str, shard: int) -> tuple[str, dict[int, float]]:
    """Writes a shard; returns its file and, for dealt-out first words, their discounted mass here."""
    heads = np.flatnonzero(_heads(cols[:1]))
    parents = cols[0][heads]
    arrays = [*EliasFano.of(parents, model.vocabulary + 2).arrays()]
    owner = np.cumsum(_heads(cols[:1])) - 1  # the node of level k - 1 of each row
    mass: dict[int, float] = {}
    size = len(parents)
    for k in range(2, len(cols) + 1):
        real = cols[k - 1] < model.vocabulary
        if not real.all():
            cols, many, owner = [c[real] for c in cols], many[real], owner[real]
        new = _heads(cols[:k]) if k < len(cols) else np.ones(len(owner), bool)  # whole rows are distinct
        at = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        count = np.add.reduceat(many, at) if len(at) else many[:0]
        parent = owner[at]
        total = np.bincount(parent, count, minlength=size)
        pointers = np.searchsorted(parent, np.arange(size + 1))
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
        if k == 2:
            for i in np.flatnonzero(np.isin(parents, list(dealt))).tolist():
                total[i] = dealt[int(parents[i])]
                mass[int(parents[i])] = discount * float(pointers[i + 1] - pointers[i])
        codes, book = _book((count - discount) / total[parent])
        weights, weight_book = _book(np.where(total > 0, discount * np.diff(pointers) / np.maximum(total, 1), 1.0))
        arrays += [*EliasFano.of(pointers, len(at) + 1).arrays(), *EliasFano.of(parent * model.vocabulary + cols[k - 1][at], size * model.vocabulary).arrays(), codes, book, weights, weight_book]
        del count, parent, total, pointers, new
        owner, size = node, len(at)
        if not size:
            break
    return write_once(folder, f"shard-{shard:06d}", lambda out: write_arrays(out, arrays)), mass


def _build_shards(counted: DataFrame, model: Model, dealt: dict[int, int], folder: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _rows_by(batches, 0):
            merger = _Merger(model.shape(shard))
            for _, _, keys, counts in rows:
                merger.add(Grams.read(keys, merger.shape), _plain(counts, "<u4").astype(np.int64))
            cols, many = merger.result()
            del merger
            path, mass = _write_shard(cols, many, model, dealt, folder, shard)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([list(mass)], pa.list_(pa.int64())), pa.array([list(mass.values())], pa.list_(pa.float64()))], names=["shard", "path", "word", "mass"])

    parts = counted.repartitionById(len(model.bounds), F.col("shard")).sortWithinPartitions("shard", "slice")
    return parts.mapInArrow(build, "shard int, path string, word array<long>, mass array<double>")


def train(docs: DataFrame, order: int = 3, shard_tokens: int = 3 << 19, text_col: str = "text") -> Model:
    """Counts all n-grams of ``docs`` up to ``order`` and writes the trie to the shared folder.

    ``shard_tokens``: training tokens for each shard, which bounds a task's memory.
    Only the list of files, the shards' limits and the totals come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    folder, ranges = new_folder(spark, "trie"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.lit(None).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    words = scratch.stage(_build_words(_slice_texts(rows, f"{folder}/train", ranges), folder, ranges, shard_tokens), "lm-words")
    model = Model(order, range_count=ranges)
    files = words.filter("kind = 0").select("r", "path", "n", "tokens", "least", "marks", "hot", "hot_count").orderBy("r").collect()
    for r in files:
        model.words.append((r.path, r.least, model.vocabulary, r.n))
        model.vocabulary += r.n
        model.tokens += r.tokens
    if not model.tokens:
        return Model(1)
    model.ranges = [r.r for r in files]
    if order < 2:
        return model
    model.bounds, dealt = _shard_bounds(model, files)
    by_slice = words.filter("kind > 0").select("slice", F.when(F.col("kind") == 2, -1).otherwise(F.col("r")).alias("r"), "path", "a")
    counted = _count_grams(by_slice.repartition(ranges, "slice").sortWithinPartitions("slice", "r"), model)
    built = scratch.stage(_build_shards(counted, model, dealt, folder), "lm-shards").collect()
    scratch.drop()
    drop_folder(spark, f"{folder}/train")
    del rows, words, by_slice, counted
    release(spark)
    model.shards = [""] * len(model.bounds)
    for r in built:
        model.shards[r.shard] = r.path
        for word, mass in zip(r.word, r.mass, strict=True):
            model.dealt[word] = model.dealt.get(word, 0.0) + mass / dealt[word]
    return model


# --- scoring -----------------------------------------------------------------------------------


def _answer_words(asked: DataFrame, model: Model, ranges: int) -> DataFrame:
    """``slice, r, path, a, b, ids``: places (one beyond the last for unknown words) and counts; the slices' own rows pass with r = -1."""
    paths = dict(zip(model.ranges, (w[0] for w in model.words), strict=True))
    listed = asked.schema["ids"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = dict(slice=pa.int64(), r=pa.int32(), path=pa.string(), a=pa.binary(), b=pa.binary(), ids=to_arrow_type(listed))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _rows_by(batches, 0):
            for _, meta, number, path, ids, keys in rows:
                if meta:
                    yield _batch([(number, -1, path, None, None, ids)], **names)
                    continue
                hashes = _sums(keys)
                at, many = _find_words(paths[r], hashes) if r in paths else (np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64))
                yield _batch([(number, r, None, _squeeze(at.astype("<u4")) if r in paths else None, _squeeze(many.astype("<u8")), None)], **names)

    dealt = asked.select("r", "meta", "slice", "path", "ids", "keys").repartitionById(ranges, F.col("r")).sortWithinPartitions("r")
    return dealt.mapInArrow(answer, f"slice long, r int, path string, a binary, b binary, ids {listed.simpleString()}")


def _keep_numbers(rows: DataFrame, model: Model, folder: str) -> DataFrame:
    """``slice, path, words, ids``: for each slice its file, the file of its words' numbers and counts, and its ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    place, words = {r: i for i, r in enumerate(model.ranges)}, model.words
    listed = rows.schema["ids"].dataType
    names = dict(slice=pa.int64(), path=pa.string(), words=pa.string(), ids=to_arrow_type(listed))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _rows_by(batches, 0):
            ids, counts = [], []
            for _, r, path, a, b, own in group:
                if r < 0:
                    here, listed_ids = path, own
                    continue
                many = _plain(b, "<u8").astype(np.int64)
                if r in place:
                    at = _plain(a, "<u4").astype(np.int64)
                    _, _, begin, n = words[place[r]]
                    ids.append(np.where(at < n, begin + at, model.unknown))
                else:
                    ids.append(np.full(len(many), model.unknown))
                counts.append(many)
            ids, counts = np.concatenate(ids), np.concatenate(counts)
            blobs = [np.frombuffer(x, np.uint8) for x in (_squeeze(np.diff(ids, prepend=0).astype("<i8")), _squeeze(counts.astype("<u8")))]
            yield _batch([(number, here, write_once(folder, "ids", lambda out, x=blobs: write_arrays(out, x)), listed_ids)], **names)

    return rows.mapInArrow(keep, f"slice long, path string, words string, ids {listed.simpleString()}")


def _read_numbers(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(the model's numbers, counts) of a slice's words."""
    step, count = (_plain(x.tobytes(), kind).astype(np.int64) for x, kind in zip(open_arrays(path), ("<i8", "<u8"), strict=True))
    return np.cumsum(step), count


def _ask_grams(rows: DataFrame, model: Model) -> DataFrame:
    """Distinct n-grams of each slice by shard, and for each slice a row ``meta`` with its files and ids.

    ``shard, meta, slice, path, words, ids, keys``
    """
    from pyspark.sql.pandas.types import to_arrow_type

    shards = max(1, len(model.bounds))
    listed = rows.schema["ids"].dataType
    names = dict(shard=pa.int32(), meta=pa.bool_(), slice=pa.int64(), path=pa.string(), words=pa.string(), ids=to_arrow_type(listed), keys=pa.binary())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _rows_by(batches, 0):
            _, path, words, own = next(group)
            out = [(number % shards, True, number, path, words, own, None)]
            if model.order > 1:
                _, codes, first = _read_slice(path)
                _, _, grams, _, _, numbers = _grams(codes, _read_numbers(words)[0], first, model)
                out += [(s, False, number, None, None, None, blob) for s, _, _, blob in _dealt_out(grams, numbers, model)]
            yield _batch(out, **names)

    return rows.mapInArrow(ask, f"shard int, meta boolean, slice long, path string, words string, ids {listed.simpleString()}, keys binary")


def _answer_grams(asked: DataFrame, model: Model) -> DataFrame:
    """``slice, r, path, words, ids, a``: for each level what is known of the distinct prefixes, codes and weights, and the books; the slices' own rows pass with r = -1."""
    from pyspark.sql.pandas.types import to_arrow_type

    listed = asked.schema["ids"].dataType
    names = dict(slice=pa.int64(), r=pa.int32(), path=pa.string(), words=pa.string(), ids=to_arrow_type(listed), a=pa.binary())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _rows_by(batches, 0):
            shard = None
            for _, meta, number, path, words, ids, keys in rows:
                if meta:
                    yield _batch([(number, -1, path, words, ids, None)], **names)
                    continue
                if shard is None and model.shards and model.shards[s]:
                    shard = Shard(model.shards[s], model)
                asked_here = Grams.read(keys, model.shape(s))
                found = shard.look(asked_here) if shard else []
                parts = [np.array([len(asked_here), len(found)], "<u4").tobytes()]
                for node, code, known, weight, book, weight_book in found:
                    codes, weights = code[node >= 0], weight[known]
                    books = [b[: int(c.max(initial=0)) + 1].astype("<f4").tobytes() for b, c in ((book, codes), (weight_book, weights))]
                    for x in (_squeeze(np.packbits(node >= 0)), _squeeze(codes), books[0], _squeeze(np.packbits(known)), _squeeze(weights), books[1]):
                        parts.append(len(x).to_bytes(4, "little") + x)
                yield _batch([(number, s, None, None, None, b"".join(parts))], **names)

    dealt = asked.repartitionById(max(1, len(model.bounds)), F.col("shard")).sortWithinPartitions("shard", "meta")
    return dealt.mapInArrow(answer, f"slice long, r int, path string, words string, ids {listed.simpleString()}, a binary")


def _read_answer(blob: bytes, grams: Grams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from 2 on: (probability or 0, weight or 1 behind an unknown context) of the n-grams that were asked for."""
    n, levels = np.frombuffer(blob[:8], "<u4").tolist()
    at, out = 8, []

    def part() -> bytes:
        nonlocal at
        size = int.from_bytes(blob[at : at + 4], "little")
        at += 4 + size
        return blob[at - size : at]

    def spread(k: int, flags: bytes, codes: bytes, book: bytes, other: float) -> np.ndarray:
        heads = grams.heads(k)
        there = np.unpackbits(_plain(flags, "u1"), count=len(heads)).astype(bool)
        value = np.full(len(heads), other)
        value[there] = np.frombuffer(book, "<f4")[_plain(codes, "u1")]
        return value if len(heads) == n else np.repeat(value, np.diff(np.append(heads, n)))

    for k in range(2, levels + 2):
        flags, codes, book, known, weights, weight_book = (part() for _ in range(6))
        out.append((spread(k, flags, codes, book, 0.0), spread(k - 1, known, weights, weight_book, 1.0)))
    return out + [(np.zeros(n), np.ones(n))] * (grams.shape.width - 1 - levels)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every whole text (log10 probabilities).

    Words are looked up at once; the n-grams when the result is read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    folder, ranges = new_folder(spark, "lm-asked"), model.range_count
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out_type = to_arrow_type(rows.schema["k"].dataType)
    # the numbers of the words lie in files then: the shuffles that found them can go before the n-grams are asked for
    words = _answer_words(_slice_texts(rows, folder, ranges), model, ranges)
    known = stage_and_free(_keep_numbers(words.repartition(ranges, "slice").sortWithinPartitions("slice", "r"), model, folder), "lm-known")
    grams = _ask_grams(known.repartition(ranges, "slice").sortWithinPartitions("slice"), model)
    answered = _answer_grams(grams, model).repartition(ranges, "slice").sortWithinPartitions("slice", "r")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _rows_by(batches, 0):
            told = []
            for _, r, path, words, ids, a in group:
                if r < 0:
                    n, codes, first = _read_slice(path)
                    docs_ = ids
                    word, count = _read_numbers(words)
                else:
                    told.append(a)
            many = count[codes]
            base = (many + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1))
            p = base.copy()
            if told:
                places, cols, grams, own, _, numbers = _grams(codes, word, first, model, True)
                parts, at = [], 0
                for blob in told:
                    size = int.from_bytes(blob[:4], "little")
                    parts.append(_read_answer(blob, grams.cut(at, at + size)))
                    at += size
                rest = len(grams) - at  # n-grams behind an unknown word: nothing is known
                for level in range(2, model.order + 1):
                    share = np.concatenate([*(t[level - 2][0] for t in parts), np.zeros(rest)])
                    back = np.concatenate([*(t[level - 2][1] for t in parts), np.ones(rest)])
                    if level == 2 and model.dealt:
                        words, weights = np.array(sorted(model.dealt)), np.array([model.dealt[w] for w in sorted(model.dealt)])
                        begin = numbers[grams.word(0)]
                        i = np.minimum(np.searchsorted(words, begin), len(words) - 1)
                        back = np.where(words[i] == begin, weights[i], back)
                    at, g = places + (level - 1), own
                    if level > 2:  # an unknown context has no share and the weight 1
                        use = np.flatnonzero(cols[level - 1] != len(numbers) - 1)
                        at, g = at[use], g[use]
                    p[at] = share[g] + back[g] * p[at]
            token = np.ones(len(codes), bool)
            token[first[:-1]] = False
            total = lambda x: np.add.reduceat(np.where(token, x, 0), first[:-1])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, out_type), pa.array(n), pa.array(total(many > 0).astype(np.int64)), pa.array(total(np.log10(base))), pa.array(total(np.log10(p)))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return answered.mapInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    """The crc32 of the identifier as text, modulo ``folds``, is ``fold`` (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold
