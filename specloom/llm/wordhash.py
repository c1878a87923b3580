"""Vectorised 64-bit hashes of words and of word windows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D (these never occur inside a UTF-8 sequence). Hashes are
polynomials modulo 2**64 over prefix sums, finished by a bijective mixer, so that one pass of numpy gives the hash of
every window of a text, whatever its length.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers (fractions of the golden ratio and of square roots); the first is for bytes, the others for words.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBB67AE8584CAA73B)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            out = []
            for b in (base, inverse):
                p = np.full(size, U(b), dtype=U)
                p[0] = U(1)
                out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words:
    """The words of a run of texts: hashes, byte spans in data, and each text's first word (offsets, one more than texts)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[data]
        first = inside[1:] & ~inside[:-1]
        last = inside[:-1] & ~inside[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word may not run from one text into the next
        first[cuts] = True
        last[cuts] = True
        self.data, self.start, self.end = data, np.flatnonzero(first), np.flatnonzero(last)
        self.offsets = np.searchsorted(self.start, bounds)
        self.hashes = _hash_spans(data, self.start, self.end)

    def windows(self, width: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the windows of width words that start at the given words."""
        return self.runs(at, at + width, which)

    def runs(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the runs of words [start, end); which picks one of two functions."""
        n = len(self.hashes)
        up, down = _power(BASES[1 + which], n + 1)
        total = np.zeros(n + 1, dtype=U)
        with np.errstate(over="ignore"):
            np.cumsum((self.hashes ^ U(BASES[2 - which])) * up[:n], out=total[1:])
            return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=U)
    up, down = _power(BASES[0], len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(BASES[1]))


def slices(column, most: int = 1 << 20):
    """Cut an Arrow text column into runs of whole texts of about most bytes: (first row, bytes, bounds). Null: empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1)
        yield row, data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        row = to
