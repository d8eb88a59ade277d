"""Vectorised byte work on batches of texts: slices of bounded size, prefix hashes, words and shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
#: Random byte codes and odd bases of two independent polynomial hashes modulo 2^64.
CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2^64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            steps.append(np.cumprod(step, dtype=np.uint64))
        have = _powers[which] = tuple(steps)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Hashes of any substring of a buffer in constant time, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, which: int = 0, codes: np.ndarray | None = None):
        up, self.down = powers(which, len(data) + 1)
        terms = (CODES[which] if codes is None else codes)[data]
        terms *= up[: len(data)]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's bytes begin (one more than rows); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(bounds: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` bytes together, or one row."""
    row, n = 0, len(bounds) - 1
    while row < n:
        end = int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = CODES.copy()
_LOWER[:, 65:91] = CODES[:, 97:123]
_CASE = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_TURNS = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
#: Longer words are hashed by BLAKE2: a polynomial modulo 2^64 gives some pairs of long words the same hash whatever its base.
LONG_WORD = 48


def word_hashes(data: np.ndarray, bounds: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of each row (A-Z lower-cased), and where each row's words begin; ``which`` of two independent hashes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    ink = ~_WHITE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    start = np.flatnonzero(ink & (np.concatenate(([True], ~ink[:-1])) | first[:n]))
    end = np.flatnonzero(ink & (np.concatenate((~ink[1:], [True])) | first[1:])) + 1
    h = mix(PrefixHash(data, which, _LOWER[which]).of(start, end) + (end - start).astype(np.uint64) * _TURNS[5])
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        word = data[start[k] : end[k]].tobytes().translate(_CASE)
        h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([which])).digest(), "little")
    return h, np.searchsorted(start, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = 4, which: int = 0):
    """For each row the sorted distinct hashes of its n-word shingles; fewer words make one shingle, none an empty set."""
    if not 1 <= n <= 5:
        raise ValueError("shingles have 1 to 5 words")
    for a, b in slices(bounds, 1 << 20):
        words, at = word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], which)
        if len(words) >= n:
            together = np.zeros(len(words) - n + 1, dtype=np.uint64)
            for k in range(n):
                together += words[k : len(words) - n + 1 + k] * _TURNS[k]
            together = mix(together + np.uint64(n))
        for k in range(b - a):
            s, e = int(at[k]), int(at[k + 1])
            if e - s >= n:
                yield np.unique(together[s : e - n + 1])
            elif e > s:
                yield mix((words[s:e] * _TURNS[: e - s]).sum(keepdims=True, dtype=np.uint64) + np.uint64(e - s))
            else:
                yield np.zeros(0, dtype=np.uint64)
