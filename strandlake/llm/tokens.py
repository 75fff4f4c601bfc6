"""Encoding of Arrow text columns with a public tokenizer file, distinct chunks once.

Both supported pre-tokenizers never join text across certain white space, so a text is
cut there, every distinct chunk of a batch is encoded once by the ``tokenizers`` library,
and the ids are gathered back.  ``tests/llm`` holds this against encoding whole texts.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlake.llm.common import text_bytes
from strandlake.llm.words import NOT_SPACE, split_words

#: White space before which a byte-level text may be cut, if a character that is no white space stands before it.
_CUT = np.zeros(256, bool)
_CUT[[9, 10, 13, 32]] = True
#: Texts with other white space are encoded whole.
_ODD = "[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of this process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Encodes batches of texts.

    Chunks seen before are remembered as Arrow arrays, at most ``cache`` of them or
    ``cache_bytes`` of text; beyond that the memory starts anew with the last batch.
    """

    def __init__(self, path: str, cache: int = 2_000_000, cache_bytes: int = 48 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: White space is dropped by the pre-tokenizer, or kept in the tokens.
        self.drops_space = self.tokenizer.normalizer is not None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache, self.cache_bytes = cache, cache_bytes
        self.known = pa.array([], pa.binary())
        self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _lookup(self, chunks: pa.BinaryArray):
        """(flat ids, begin, size) of each distinct chunk."""
        at = pc.index_in(chunks, value_set=self.known)
        missing = np.asarray(at.is_null())
        at = np.asarray(pc.fill_null(at, 0)).astype(np.int64)
        at[missing] = len(self.known) + np.arange(int(missing.sum()))
        new = chunks.filter(pa.array(missing))
        found: list[bytes] = []
        words = new.to_pylist()
        for i in range(0, len(words), 20_000):
            part = [w.decode("utf-8", "replace") for w in words[i : i + 20_000]]
            found += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        sizes = np.append(self.sizes, np.fromiter((len(x) >> 2 for x in found), np.int32, len(found)))
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), np.uint32)])
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        known = pa.concat_arrays([self.known, new])
        if len(known) <= self.cache and known.nbytes <= self.cache_bytes:
            self.known, self.sizes, self.flat = known, sizes, flat
        else:
            self.known, self.sizes, self.flat = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        return flat, begin[at], sizes[at].astype(np.int64)

    def _chunks(self, column: pa.Array):
        """(codes, vocabulary, first) of the chunks, as of ``Words``."""
        if self.drops_space:
            words = split_words(column, NOT_SPACE, fold=False)
            return words.codes, words.vocabulary, words.first
        data, offsets = text_bytes(column)
        space = _CUT[data]
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        odd = np.asarray(pc.fill_null(pc.match_substring_regex(column, _ODD), False))
        for i in np.flatnonzero(odd):
            starts[offsets[i] : offsets[i + 1]] = False
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(starts)
        bounds = np.append(begin, len(data)).astype(np.int32)
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(begin, offsets)

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text; null is empty."""
        codes, vocabulary, first = self._chunks(column)
        _, _, sizes = self._lookup(vocabulary)
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=total[1:])
        return np.diff(total[first])

    def encode(self, column: pa.Array, end: int | None = None, boundaries: bool = False):
        """(ids uint32, offsets) of the texts; null is empty.  ``end`` is put after each text.

        With ``boundaries`` also a mask over ids: a sentence or line ends with this id.
        """
        codes, vocabulary, first = self._chunks(column)
        flat, begin, sizes = self._lookup(vocabulary)
        per = sizes[codes]
        stops = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(per, out=stops[1:])
        ids = np.empty(stops[-1], np.uint32)
        for a in range(0, len(codes), 1 << 18):
            z = min(a + (1 << 18), len(codes))
            source = np.repeat(begin[codes[a:z]] - stops[a:z], per[a:z])
            source += np.arange(stops[a], stops[z])
            ids[stops[a] : stops[z]] = flat[source]
        offsets = stops[first]
        ends = None
        if boundaries:
            data, bounds = text_bytes(vocabulary)
            last = data[np.maximum(bounds[1:] - 1, 0)] if len(data) else np.zeros(len(vocabulary), np.uint8)
            newline = np.asarray(pc.match_substring(vocabulary, "\n")) if len(vocabulary) else np.zeros(0, bool)
            stop = np.isin(last, np.frombuffer(b".!?", np.uint8))[codes]
            if len(codes):
                stop[:-1] |= newline[codes][1:]
            ends = np.zeros(len(ids), bool)
            at = stops[1:][stop] - 1
            ends[at[at >= 0]] = True
        if end is not None:
            ids = np.insert(ids, offsets[1:], end).astype(np.uint32, copy=False)
            if boundaries:
                ends = np.insert(ends, offsets[1:], True)
            offsets = offsets + np.arange(len(offsets))
        return (ids, offsets, ends) if boundaries else (ids, offsets)
