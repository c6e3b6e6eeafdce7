"""Vectorised text primitives over the bytes of many documents at once (numpy, no Python loop over words).

A batch is one ``uint8`` buffer and ``offsets`` (document d has the bytes offsets[d] to offsets[d + 1]).
Words are runs of bytes other than ASCII white space, which is the same on bytes as on code points.
Hashes have 64 bits; equal inputs have equal hashes on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Seeds of the hashes: any values do, changing them changes every sketch.
_SEED = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C13)  # odd
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF97)
#: Bytes of text taken together; a longer document is taken alone and whole.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits each depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        grown = np.full(max(n, CHUNK + 1), base, np.uint64)
        grown[0] = 1
        if n > 4 * CHUNK:  # not kept: one very long text is not worth the memory
            return np.multiply.accumulate(grown)
        _powers[key] = np.multiply.accumulate(grown)
    return _powers[key][:n]


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a binary column, about CHUNK bytes at a time."""
    done = 0
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(array):
            continue
        array = array.cast(pa.large_binary()) if array.null_count == 0 else array.fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
        i = 0
        while i < len(array):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            yield done + i, done + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        done += len(array)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (one more at the end)."""
    inside = ~SPACE[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts])


def prefix_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each place of each run of ``codes`` the hash of what stands before it in its run."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes + _STEP) * _power(_BASE, len(codes)), out=sums[1:])
    return mix((sums[:-1] - np.repeat(sums[starts], lengths)) * np.repeat(_power(_BASE_INVERSE, len(codes) + 1)[starts], lengths))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct shingle hashes: ``size`` words each, after A-Z became a-z; a text
    of fewer words is one shingle, a text without words has none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = len(hashes)
    weights = np.power(np.full(size, _STEP, np.uint64), np.arange(size, dtype=np.uint64))
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size if n >= size else 0):
        rolled += hashes[k : n - size + 1 + k] * weights[k]
    rolled = mix(rolled)
    out = []
    for d in range(len(offsets) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = (hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(mix(np.array([short], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    """``k`` coordinates; coordinate c of a set is the smallest value of its c-th hash over the set."""

    def __init__(self, k: int):
        seeds = np.random.Generator(np.random.PCG64(20260202))
        self.k = k
        self.masks = seeds.integers(0, 2**64, k, dtype=np.uint64)
        self.factors = seeds.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 64-bit (coordinate, value) tokens for each set, none of which may be empty."""
        out = np.empty((len(sets), self.k), np.uint64)
        if not sets:
            return out
        joined = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        i = 0
        while i < len(sets):  # a part at a time stays in the processor's cache
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + 32768, "right")) - 1)
            part = joined[starts[i] : starts[j]]
            at = starts[i:j] - starts[i]
            for c in range(self.k):
                out[i:j, c] = np.minimum.reduceat((part ^ self.masks[c]) * self.factors[c], at)
            i = j
        return mix(out ^ mix(np.arange(1, self.k + 1, dtype=np.uint64)))
