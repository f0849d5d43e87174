"""Vectorised work on the byte buffers of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
STEP_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


class Powers:
    """Powers of an odd number modulo 2**64, as long as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(max(n, CHUNK_BYTES), self.base, dtype=np.uint64)
            steps[0] = 1
            self.values = np.multiply.accumulate(steps)
        return self.values[:n]


FORWARD, BACKWARD = Powers(STEP), Powers(STEP_INVERSE)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls; offsets start at 0."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row stands alone."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes that are not ASCII white space."""
    solid = ~BLANK[data]
    inner = np.zeros(len(data) + 1, dtype=bool)
    inner[1:-1] = solid[1:] & solid[:-1]
    inner[offsets] = False  # a row's first byte never continues a word
    starts = np.flatnonzero(solid & ~inner[:-1])
    ends = np.flatnonzero(solid & ~inner[1:]) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from one running sum over the buffer."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * FORWARD.upto(n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * BACKWARD.upto(n)[starts])


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each row number."""
    return np.bincount(rows, weights=values, minlength=n)


def per_span(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over each row of ``offsets``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
