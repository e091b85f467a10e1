"""Whole batches of texts as one byte array: word bounds and hashes of any substring without a loop over texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1


class Rolling:
    """hash(a, b) of bytes a to b in one subtraction: sums of byte codes times falling powers of an odd base, modulo 2^64.

    Equal substrings have equal hashes wherever they stand. Strings hashed here are shorter than the 1,024 bytes from which
    structured inputs can defeat this modulus; two Rolling with other seeds make a 128-bit identity.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, MASK, 256, dtype=np.uint64, endpoint=True)
        self.base = int(rng.integers(1, MASK, dtype=np.uint64)) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n + n // 4 + 1, base & MASK, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def feed(self, data: np.ndarray) -> Rolling:
        self._powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=self.sums[1:])
        return self

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.up[a]

    def runs(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.up[:n] if n > 0 else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the offsets of its rows."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Parts of a batch whose texts together hold about `most` bytes; one longer text makes a part of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    _, off = view(col)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in each text, and the number of words before each text (one more at the end)."""
    n = len(data)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    at = off[(off > 0) & (off < n)]
    first[at] = word[at]
    last[at - 1] = word[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)
