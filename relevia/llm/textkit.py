"""Vectorised words and hashes over Arrow text columns.

Texts of a batch are laid end to end, each followed by one separator byte, and cut into
slices of about ``SLICE_BYTES``; a text is never cut, so memory follows the longest text.
Word hashes come from prefix sums of a polynomial hash, a few array operations per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true in the given ranges, ends included."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))
#: words of `[^\x20\x09-\x0D]+`
NON_BLANK = ~BLANKS
#: words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased: digits, letters and all beyond ASCII
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def slices(column: pa.Array | pa.ChunkedArray, separator: str = "\n") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) per slice; starts has one entry per text and the end. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    joined = [pa.scalar(x, pa.large_string()) for x in ("", separator)]
    ended = pc.binary_join_element_wise(column, *joined)
    _, offsets, data = ended.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(data, dtype=np.uint8)
    first = 0
    while first < len(ended):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    # a worker that waits for its next task need not keep room for a batch
    del column, joined, ended, offsets, data
    pa.default_memory_pool().release_unused()


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes whose flag is set; the last byte must not be in a run."""
    flags = inside[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edges = np.concatenate(([0], edges))
    return edges[::2], edges[1::2]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of a public 64-bit hash)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Hasher:
    """64-bit hashes of byte ranges; equal ranges have equal hashes in every task."""

    def __init__(self, seed: int = 1, fold_case: bool = True) -> None:
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + _MULTIPLIER)
        if fold_case:
            self.codes[65:91] = self.codes[97:123]
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, length: int) -> None:
        if len(self.powers) < length + 1:
            inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
            for name, base in (("powers", _MULTIPLIER), ("inverses", inverse)):
                values = np.full(length + 1, base, dtype=np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))

    def factors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers for ``length`` places, and their inverses for one more."""
        self._grow(length)
        return self.powers[:length], self.inverses[: length + 1]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums before each byte, to be cut into ranges by ``ranges``."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(
    data: np.ndarray, starts: np.ndarray, hasher: Hasher, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a slice's words, the index of each text's first word (and the end), word starts and ends."""
    first, last = spans(data, inside)
    hashes = hasher.ranges(hasher.prefix(data), first, last)
    return hashes, np.searchsorted(first, starts), first, last


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of values as a list column."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
