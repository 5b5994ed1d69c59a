"""Minimal perfect hashes with their keys, built and asked on arrays.

A key's 64-bit hash picks a bit at each of several levels. Keys that are alone at their bit stay there, the others go on to the
next level; the rank of a key's bit is its slot, so n keys fill the slots 0 to n - 1. Strings that are no key get a
slot too, so the stored key decides.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: Bits per key that a level still has to place.
SPREAD = 2
_HEAD = "<QIII"  # seed, keys, levels, words
_PAD = bytes(8)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Byte strings inside one buffer, read eight bytes at a time."""

    def __init__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray):
        padded = np.frombuffer(data + _PAD, dtype=np.uint8)
        self.view = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        self.starts, self.sizes = starts.astype(np.int64), sizes.astype(np.int64)

    def word(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of each row, zeros past its end. Rows must be longer than 8 k bytes."""
        rest = np.minimum(self.sizes[rows] - 8 * k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        return self.view[self.starts[rows] + 8 * k] & mask

    def hashes(self, seed: int = 0) -> np.ndarray:
        h = mixed(self.sizes.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rows, k = np.flatnonzero(self.sizes > 0), 0
        while len(rows):
            h[rows] = mixed(h[rows] ^ self.word(rows, k)) + np.uint64(k)
            k += 1
            rows = rows[self.sizes[rows] > 8 * k]
        return h

    def same(self, rows: np.ndarray, other: Words, others: np.ndarray) -> np.ndarray:
        """Whether row i of `rows` holds the bytes of row i of `others` in `other`."""
        equal = self.sizes[rows] == other.sizes[others]
        at, k = np.flatnonzero(equal & (self.sizes[rows] > 0)), 0
        while len(at):
            right = self.word(rows[at], k) == other.word(others[at], k)
            equal[at[~right]] = False
            at, k = at[right], k + 1
            at = at[self.sizes[rows[at]] > 8 * k]
        return equal


def of_list(keys: list[bytes]) -> tuple[bytes, Words]:
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    data = b"".join(keys)
    return data, Words(data, np.cumsum(sizes) - sizes, sizes)


def _bit(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mixed(h + np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    seed: int
    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # 64-bit words of all levels
    before: np.ndarray  # set bits before each word
    keys: Words
    largest: int

    @property
    def n(self) -> int:
        return len(self.keys.sizes)

    def slots(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """The slot of each string, -1 for strings that are no key. `hashes` are those of `words` by this seed."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        rows = np.flatnonzero(words.sizes <= self.largest)
        base = 0
        for level, bits in enumerate(self.sizes):
            place = base + _bit(hashes[rows], level, int(bits))
            at, shift = place >> 6, (place & 63).astype(np.uint64)
            word = self.bits[at]
            hit = (word >> shift) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[rows[hit]] = self.before[at[hit]] + np.bitwise_count(below)
            rows, base = rows[~hit], base + int(bits)
        found = np.flatnonzero(out >= 0)
        out[found[~words.same(found, self.keys, out[found])]] = -1
        return out


def build(keys: list[bytes]) -> bytes:
    """The perfect hash of distinct keys as bytes: head, level sizes, bits, key sizes and keys in slot order."""
    data, words = of_list(keys)
    seed = 1
    while len(np.unique(hashes := words.hashes(seed))) < len(keys):
        seed += 1
    sizes, levels, slot_rows = [], [], []
    rows = np.arange(len(keys))
    while len(rows):
        bits = 64 * max(1, -(-SPREAD * len(rows) // 64))
        place = _bit(hashes[rows], len(sizes), bits)
        alone = np.bincount(place, minlength=bits)[place] == 1
        flags = np.zeros(bits, dtype=np.uint8)
        flags[place[alone]] = 1
        levels.append(np.packbits(flags, bitorder="little"))
        slot_rows.append(rows[alone][np.argsort(place[alone])])
        sizes.append(bits)
        rows = rows[~alone]
    order = np.concatenate(slot_rows) if slot_rows else rows
    packed = b"".join(x.tobytes() for x in levels)
    head = struct.pack(_HEAD, seed, len(keys), len(sizes), len(packed) // 8)
    lengths = words.sizes[order].astype("<i8")
    return b"".join([head, np.array(sizes, dtype="<i8").tobytes(), packed, lengths.tobytes(), *(keys[i] for i in order)])


def load(blob: bytes) -> PerfectHash:
    seed, n, levels, n_words = struct.unpack_from(_HEAD, blob)
    at = struct.calcsize(_HEAD)
    sizes = np.frombuffer(blob, "<i8", levels, at)
    at += 8 * levels
    bits = np.frombuffer(blob, "<u8", n_words, at)
    at += 8 * n_words
    lengths = np.frombuffer(blob, "<i8", n, at)
    at += 8 * n
    counts = np.bitwise_count(bits).astype(np.int64)
    keys = Words(blob[at:], np.cumsum(lengths) - lengths, lengths)
    return PerfectHash(seed, sizes, bits, np.cumsum(counts) - counts, keys, int(lengths.max()) if n else 0)


def stored_keys(blob: bytes) -> list[bytes]:
    """The keys in slot order."""
    made = load(blob)
    data = blob[len(blob) - int(made.keys.sizes.sum()):]
    return [data[a : a + n] for a, n in zip(made.keys.starts.tolist(), made.keys.sizes.tolist())]
