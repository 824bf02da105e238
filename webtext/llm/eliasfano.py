"""Elias-Fano sequences and a two-level n-gram trie over memory-mapped levels.

An Elias-Fano sequence holds n non-decreasing integers below u in about
``2 + log2(u / n)`` bits each: the low bits packed, the high bits in unary, with
a directory of a quarter bit for each unary bit.  Searches are vectorised and read
the mapped bytes: the unary part gives each query's bucket, a binary search over
the packed low bits finds the successor inside it.
"""

from __future__ import annotations

import os
import struct
import tempfile

import numpy as np

_U64 = np.uint64


def pack_fixed(values: np.ndarray, bits: int) -> bytes:
    """Fixed-width little-endian packing of integers below ``2 ** bits``."""
    if not bits or not len(values):
        return b""
    out = []
    for at in range(0, len(values), 1 << 16):      # a multiple of 8 values, so parts join on bytes
        raw = values[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(raw, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes())
    return b"".join(out)


def fixed_at(raw: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """The packed integers at ``places``; ``raw`` has 8 spare bytes at its end."""
    if not bits:
        return np.zeros(len(places), _U64)
    first = places.astype(np.int64) * bits
    byte, shift, out = first >> 3, (first & 7).astype(_U64), np.zeros(len(places), _U64)
    for k in range((bits + 14) // 8):
        out |= raw[byte + k].astype(_U64) << _U64(8 * k) if k < 8 else _U64(0)
    return (out >> shift) & _U64((1 << bits) - 1)


def _words(raw: np.ndarray) -> np.ndarray:
    return raw.view("<u8")


def _padded(raw: bytes) -> bytes:
    """Up to a multiple of 8 bytes, so that mapped integers stay aligned."""
    return raw + b"\0" * (-len(raw) % 8)


class EliasFano:
    """``buffer`` holds what :meth:`encode` made; it may be memory-mapped.
    Opening it reads the header alone.  Beside the unary bits lies a directory:
    for each block of ``BLOCK`` bits, the ones and the zeros before it.  The k-th
    one or zero is found by a search of the directory and a count inside one
    block, so nothing is unpacked but the blocks that a query touches."""

    MAX_LOW = 57          # low bits that one unaligned 8-byte window can hold
    BLOCK = 512
    SLICE = 1 << 14       # queries whose blocks are looked at together

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = values.astype(_U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = min(cls.MAX_LOW, max(0, ((top + 1) // max(1, n)).bit_length() - 1))
        high = (values >> _U64(low)).astype(np.int64)
        n_bits = n + (top >> low) + 1
        blocks = -(-n_bits // cls.BLOCK)
        bits = np.zeros(blocks * cls.BLOCK, np.uint8)
        bits[high + np.arange(n)] = 1
        ones = np.cumsum(bits.reshape(blocks, cls.BLOCK).sum(axis=1, dtype=np.int64)) if blocks else np.zeros(0, np.int64)
        ones = np.concatenate([[0], ones]).astype("<u8")
        zeros = (np.arange(blocks + 1) * cls.BLOCK - ones.astype(np.int64)).astype("<u8")
        lows = pack_fixed(values & _U64((1 << low) - 1), low)
        return b"".join([struct.pack("<QQQ", n, low, n_bits), ones.tobytes(), zeros.tobytes(),
                         np.packbits(bits, bitorder="little").tobytes(), _padded(lows + b"\0" * 8)])

    def __init__(self, buffer: np.ndarray) -> None:
        self.n, self.low, n_bits = struct.unpack("<QQQ", buffer[:24].tobytes())
        self.highs = n_bits - self.n               # high parts that occur or lie below one that does
        blocks = -(-n_bits // self.BLOCK)
        ends = np.cumsum([24, 8 * (blocks + 1), 8 * (blocks + 1), blocks * self.BLOCK // 8])
        self.ones, self.zeros, self.bits = (_words(buffer[x:y]) for x, y in zip(ends, ends[1:]))
        self.lows = buffer[ends[-1]:]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones or zeros among the unary bits."""
        directory, out = (self.ones if one else self.zeros), np.empty(len(k), np.int64)
        for at in range(0, len(k), self.SLICE):
            want = k[at:at + self.SLICE].astype(_U64)
            block = np.searchsorted(directory, want, side="right") - 1
            left = (want - directory[block]).astype(np.int64)
            words = self.bits[block[:, None] * (self.BLOCK // 64) + np.arange(self.BLOCK // 64)]
            words = words if one else ~words
            upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
            word, rows = (upto <= left[:, None]).sum(axis=1), np.arange(len(left))
            left -= np.where(word > 0, upto[rows, word - 1], 0)
            set_ = np.unpackbits(np.ascontiguousarray(words[rows, word]).astype("<u8").view(np.uint8).reshape(-1, 8),
                                 axis=1, bitorder="little")
            bit = (np.cumsum(set_, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
            out[at:at + self.SLICE] = block * self.BLOCK + word * 64 + bit
        return out

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part; 0 <= ``high`` <= ``highs``."""
        out, later = np.zeros(len(high), np.int64), np.flatnonzero(high > 0)
        out[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        places = np.asarray(places, np.int64)
        high = (self._select(places, True) - places).astype(_U64)
        return (high << _U64(self.low)) | fixed_at(self.lows, places, self.low)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether that value equals x)."""
        x = x.astype(_U64)
        high = np.minimum(x >> _U64(self.low), _U64(self.highs)).astype(np.int64)
        lo, hi = self._begin(high), self._begin(np.minimum(high + 1, self.highs))
        stop, want = hi.copy(), x & _U64((1 << self.low) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = fixed_at(self.lows, mid, self.low) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        inside = np.flatnonzero(lo < stop)
        equal = np.zeros(len(x), bool)
        equal[inside] = fixed_at(self.lows, lo[inside], self.low) == want[inside]
        return lo, equal


#: Probabilities are kept as 8-bit codes, even steps of their logarithm; 0: none.
#: The codes reach ``RANGE`` decades down, or as far as :func:`decades` says.
STEPS, RANGE = 254, 8.0


def decades(p: np.ndarray) -> float:
    """The range of codes that reaches the least of ``p``, by hundredths."""
    return max(RANGE, float(np.ceil(-100 * np.log10(p.min()) + 1e-6)) / 100) if len(p) else RANGE


def quantise(p: np.ndarray, reach: float = RANGE) -> np.ndarray:
    """Codes 1..255, rounded down, so that a context's sum does not pass 1; what
    lies below the range has code 0."""
    return np.clip(np.floor((np.log10(p) + reach) / reach * STEPS) + 1, 0, 255).astype(np.uint8)


def restore(codes: np.ndarray, reach: float = RANGE) -> np.ndarray:
    table = 10.0 ** ((np.arange(256) - 1) / STEPS * reach - reach)
    table[0] = 0.0
    return table[codes]


class Trie:
    """Level 1: sorted word hashes with counts and, as a monotone sequence, the
    place where each word's children begin.  Level 2: the children, each stored
    relative to its context as ``context number * 2**CHILD_BITS + hash``, which
    makes the whole level one monotone sequence; beside it the codes of their
    smoothed probabilities.  The levels lie in one file, mapped into memory; its
    header holds the range of the codes."""

    CHILD_BITS = 40

    @classmethod
    def write(cls, path: str, words: np.ndarray, counts: np.ndarray, begin: np.ndarray,
              children: np.ndarray, codes: np.ndarray, reach: float = RANGE) -> None:
        parts = [EliasFano.encode(words), counts.astype("<u8").tobytes(), EliasFano.encode(begin),
                 EliasFano.encode(children), _padded(codes.astype(np.uint8).tobytes())]
        with open(path, "wb") as f:
            f.write(struct.pack("<5Qd", *map(len, parts), reach))
            for p in parts:
                f.write(p)

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        *sizes, self.reach = struct.unpack("<5Qd", raw[:48].tobytes())
        ends = np.cumsum([48, *sizes])
        a, b, c, d, e = (raw[x:y] for x, y in zip(ends, ends[1:]))
        self.words, self.counts, self.begin = EliasFano(a), _words(b), EliasFano(c)
        self.children, self.codes = EliasFano(d), e

    def find(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 where a word is not in the trie."""
        place, there = self.words.successor(words)
        return np.where(there, place, -1)

    def child_codes(self, numbers: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Codes of children given as (context number, hash); 0 where not seen."""
        out, known = np.zeros(len(numbers), np.uint8), np.flatnonzero(numbers >= 0)
        key = (numbers[known].astype(_U64) << _U64(self.CHILD_BITS)) | child[known]
        place, there = self.children.successor(key)
        out[known[there]] = self.codes[place[there]]
        return out

    def n_children(self, numbers: np.ndarray) -> np.ndarray:
        out, known = np.zeros(len(numbers), np.int64), np.flatnonzero(numbers >= 0)
        out[known] = (self.begin.at(numbers[known] + 1) - self.begin.at(numbers[known])).astype(np.int64)
        return out


class MappedTrie:
    """A trie in a scratch file of this task, gone when the block ends."""

    def __init__(self, *levels: np.ndarray, reach: float = RANGE) -> None:
        self.levels, self.reach = levels, reach

    def __enter__(self) -> Trie:
        fd, self.path = tempfile.mkstemp(suffix=".trie")
        os.close(fd)
        Trie.write(self.path, *self.levels, self.reach)
        del self.levels
        return Trie(self.path)

    def __exit__(self, *_) -> None:
        os.unlink(self.path)
