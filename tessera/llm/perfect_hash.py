"""A minimal perfect hash: distinct keys of 128 bits get the places 0..n-1.

Each level is a field of bits somewhat longer than the keys that reach it. A key that alone falls on a bit of its level sets it and is
done; keys that fall together go on to the next level, with another hash. A key's place is the number of set bits before its own, over all levels.
No keys are stored, so a key that was not among them gets some place too, or none: what is kept at the places has to tell it apart.

Defined cases: no keys make no levels, and nothing is found in them; equal keys are not allowed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.llm.wordhash import mix

#: Bits of a level for each key that reaches it.
ROOM = 1.5


def _fall(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of the level on which each key falls."""
    salt = mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (mix(mix(high ^ salt) + low) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    levels: list[np.ndarray]

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash of distinct keys (high, low), and the place of each."""
        levels, place = [], np.empty(len(high), np.int64)
        left, before = np.arange(len(high)), 0
        while len(left):
            size = int(ROOM * len(left)) + 8
            at = _fall(high[left], low[left], len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            alone = bits[at]
            place[left[alone]] = before + np.cumsum(bits)[at[alone]] - 1
            before += int(alone.sum())
            levels.append(bits)
            left = left[~alone]
        return cls(levels), place

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where no level has a bit for it."""
        place = np.full(len(high), -1)
        left, before = np.arange(len(high)), 0
        for k, bits in enumerate(self.levels):
            at = _fall(high[left], low[left], k, len(bits))
            here = bits[at]
            ranks = np.cumsum(bits)
            place[left[here]] = before + ranks[at[here]] - 1
            before += int(ranks[-1])
            left = left[~here]
        return place

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        levels, at = [], 8 * (n + 1)
        for size in np.frombuffer(data, np.int64, n, 8).tolist():
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels)
