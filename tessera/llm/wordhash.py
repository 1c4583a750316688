"""Words of many texts at once, as numpy arrays over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tables(seed: int) -> tuple[np.ndarray, np.uint64]:
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table[_SPACE] = 0
    return table, np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)


_TABLES = {seed: _tables(seed) for seed in (1, 2)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts. ``data``: their bytes; word w is data[start[w]:end[w]]; text d has words first[d]:first[d+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    rows: slice

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        table, base = _TABLES[seed]
        gaps = np.diff(self.start, append=len(self.data))
        powers = np.full(int(gaps.max()), base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        lead = int(self.start[0])
        offsets = np.arange(len(self.data) - lead) - np.repeat(self.start - lead, gaps)
        values = table[self.data[lead:]] * powers[offsets]
        return mix(np.add.reduceat(values, self.start - lead))

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one blank, and where each word begins in them."""
        lengths = self.end - self.start + 1
        offset = np.concatenate([[0], np.cumsum(lengths)])
        if not len(lengths):
            return b"", offset
        out = np.append(self.data, np.uint8(32))[np.repeat(self.start - offset[:-1], lengths) + np.arange(int(offset[-1]))]
        out[offset[1:] - 1] = 32
        return out.tobytes(), offset

    def windows(self, hashes: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows of each text, and where each text's windows begin among them.
        short: a text of fewer words, but not none, has its whole sequence as one window."""
        counts = np.diff(self.first)
        per_text = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype) if short else 0)
        edge = np.concatenate([[0], np.cumsum(per_text)])
        total = int(edge[-1])
        at = np.arange(total) + np.repeat(self.first[:-1] - edge[:-1], per_text)
        left = np.repeat(self.first[1:], per_text)
        out = np.zeros(total, np.uint64)
        padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
        factor = 1
        for j in range(n):
            factor = (factor * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)
            part = (padded[at + j] + np.uint64(1)) * np.uint64(factor | 1)
            out += part if not short else np.where(at + j < left, part, np.uint64(0))
        return mix(out), edge


def find_words(data: np.ndarray, offsets: np.ndarray, rows: slice, lower: bool) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts data[offsets[i]:offsets[i+1]]."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], (offsets - base).astype(np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), rows)


def byte_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of the column, null as empty, in slices of at most ``most`` bytes or one row."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield slice(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def text_slices(column: pa.Array, lower: bool, most: int = SLICE_BYTES) -> Iterator[Words]:
    """The column's rows, null as empty, in slices of at most ``most`` bytes or one row."""
    for rows, data, offsets in byte_slices(column, most):
        yield find_words(data, offsets, rows, lower)
