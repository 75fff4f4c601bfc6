"""Elias-Fano sequences over memory-mapped words, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) in each 64-bit word."""
    at = np.zeros(len(w), np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        low = w & np.uint64((1 << shift) - 1)
        c = np.bitwise_count(low).astype(np.int64)
        go = r >= c
        r = np.where(go, r - c, r)
        w = np.where(go, w >> np.uint64(shift), low)
        at += go * shift
    return at


class EliasFano:
    """An ascending sequence of n values below ``universe``: about 2 + log2(universe / n) bits each.

    ``low`` packs the lower ``bits`` bits of each value, ``high`` has a one for each value and
    a zero for each step of the upper part; ``zeros`` counts the zeros before each word.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros
        self.steps = len(high) * 64 - n  # zeros in all
        self._ones: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        size = n + (universe >> bits) + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[upper + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            v = values & np.uint64((1 << bits) - 1)
            place = np.arange(n, dtype=np.int64) * bits
            word, off = place >> 6, (place & 63).astype(np.uint64)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[starts]] = np.bitwise_or.reduceat(v << off, starts)
            over = np.flatnonzero(off + np.uint64(bits) > 64)  # one value at most runs into each next word
            low[word[over] + 1] |= v[over] >> (np.uint64(64) - off[over])
        return cls(n, bits, low, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def from_arrays(cls, head, low, high, zeros) -> "EliasFano":
        return cls(int(head[0]), int(head[1]), low, high, zeros)

    def values(self) -> np.ndarray:
        """The whole sequence as int64, for many successor searches at once."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        i = np.arange(self.n, dtype=np.int64)
        return ((ones - i) << self.bits) | self._lower(i).astype(np.int64)

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i * self.bits
        word, off = place >> 6, (place & 63).astype(np.uint64)
        first = self.low[word] >> off
        second = (self.low[word + 1] << _ONE) << (np.uint64(63) - off)
        return (first | second) & np.uint64((1 << self.bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        if self._ones is None:
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(self._ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self._ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._lower(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value not below x, whether it equals x) for each x of an ascending sequence without repeats."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        beyond = h >= self.steps
        h = np.where(beyond, 0, h)
        before = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        end = self._select0(h) - h
        want = x & np.uint64((1 << self.bits) - 1)
        a, z = before.copy(), end.copy()
        active = np.flatnonzero(a < z)
        while len(active):
            mid = (a[active] + z[active]) >> 1
            less = self._lower(mid) < want[active]
            a[active[less]] = mid[less] + 1
            z[active[~less]] = mid[~less]
            active = active[a[active] < z[active]]
        inside = np.flatnonzero(a < end)
        found = np.zeros(len(x), bool)
        found[inside] = self._lower(a[inside]) == want[inside]
        a[beyond], found[beyond] = self.n, False
        return a, found


def write_arrays(stream, arrays: list[np.ndarray]) -> None:
    """Arrays one after another, 8-byte aligned, behind a directory."""
    import json

    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    head += b" " * (-(len(head) + 8) % 8)
    stream.write(len(head).to_bytes(8, "little") + head)
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        stream.write(raw + b"\0" * (-len(raw) % 8))


def _split(data: np.ndarray) -> list[np.ndarray]:
    import json

    size = int.from_bytes(data[:8].tobytes(), "little")
    at, out = 8 + size, []
    for kind, n in json.loads(data[8 : 8 + size].tobytes()):
        width = np.dtype(kind).itemsize * n
        out.append(data[at : at + width].view(kind))
        at += width + (-width % 8)
    return out


def map_arrays(path: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped."""
    return _split(np.memmap(path, np.uint8, "r"))


def open_arrays(uri: str) -> list[np.ndarray]:
    """The arrays of a file in the shared folder: mapped, or read into memory where the store cannot be mapped; nothing is copied to a disk."""
    from strandlake.llm.common import filesystem

    files, path = filesystem(uri)
    if files.type_name == "local":
        return map_arrays(path)
    with files.open_input_stream(path) as source:
        return _split(np.frombuffer(source.read(), np.uint8))
