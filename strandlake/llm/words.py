"""Vectorised splitting of Arrow text columns into words, on their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from strandlake.llm.common import text_bytes

#: A-Z to a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True


@dataclass
class Words:
    """The words of a batch of texts, in order.

    ``codes`` index ``vocabulary`` (distinct words, exact bytes); words of text ``i`` are
    ``codes[first[i]:first[i + 1]]``.
    """

    codes: np.ndarray
    vocabulary: pa.BinaryArray
    first: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the vocabulary, the same in every batch."""
        return hash_words(self.vocabulary)


#: The lowest k bytes of eight, k from 0 to 8.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_words(words: pa.BinaryArray) -> np.ndarray:
    """64-bit hashes of byte strings: those of up to 16 bytes all at once from two words of eight bytes and the length, longer ones one by one."""
    data, offsets = text_bytes(words)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    size = np.diff(offsets)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    low = eight[offsets[:-1]] & _LOW[np.minimum(size, 8)]
    high = eight[offsets[:-1] + np.minimum(size, 8)] & _LOW[np.clip(size - 8, 0, 8)]
    out = mix(mix(low + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xD6E8FEB86659FD93)))
    long = np.flatnonzero(size > 16)
    if len(long):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(data[offsets[i] : offsets[i + 1]].tobytes()) for i in long.tolist()), np.uint64, len(long))
    return out


def split_words(column: pa.Array, kind: np.ndarray = NOT_SPACE, fold: bool = True) -> Words:
    """Splits each text into maximal runs of bytes of ``kind``; nulls have no words."""
    data, offsets = text_bytes(column)
    if fold:
        data = FOLD[data]
    inside = kind[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = inside[heads]
    begin = np.flatnonzero(starts)
    first = np.searchsorted(begin, offsets)
    lengths = np.add.reduceat(inside, begin, dtype=np.int32) if len(begin) else np.zeros(0, np.int32)
    bounds = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
