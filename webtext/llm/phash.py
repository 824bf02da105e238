"""Minimal perfect hashing of 64-bit keys, vectorised with numpy.

Levelled construction: keys go to random bits of a level's bit array; keys that
are alone on their bit stay there, the others go on to the next level, which is
sized for them.  A key's number is the rank of its bit over all levels: a
bijection onto 0..n-1 that takes about three bits a key and holds no key.
"""

from __future__ import annotations

import struct

import numpy as np

_LOAD = 1.6      # bits per key and level
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) ^ np.uint64((salt * _GOLDEN) & (2 ** 64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """``numbers(keys)``: for a built key its number, for other keys any number
    or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.starts = np.cumsum([0, *sizes])
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct unsigned 64-bit integers."""
        left, sizes, parts, level = keys.astype(np.uint64), [], [], 0
        while len(left):
            m = max(64, -(-int(len(left) * _LOAD) // 64) * 64)
            at = (mix(left, level + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left, level = left[~alone[at]], level + 1
        return cls(sizes, np.concatenate(parts) if parts else np.empty(0, "<u8"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, m in enumerate(self.sizes):
            if not len(todo):
                break
            bit = (mix(keys[todo], level + 1) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, place = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> place) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << place[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[bit[hit] >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<I", len(self.sizes)) + struct.pack(f"<{len(self.sizes)}Q", *self.sizes)
        return head + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n, = struct.unpack_from("<I", data)
        sizes = list(struct.unpack_from(f"<{n}Q", data, 4))
        return cls(sizes, np.frombuffer(data, "<u8", offset=4 + 8 * n))
