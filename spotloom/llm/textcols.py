"""Column-at-a-time text kernels: words, rolling hashes and sliding minima over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that a kernel takes at once, besides one document that is longer.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a polynomial hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class PrefixHash:
    """Polynomial prefix hashes of a sequence; the hash of any range takes constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k values, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `size` bytes of text each, or one row."""
    _, offsets = utf8(batch[text])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one row after the other, and each row's offset; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of [^\\x20\\x09-\\x0D], and the first word of each row (one entry more than rows)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """Row number of each item, from the number of the first item of each row."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of ranges one after the other, and for each the number of its range."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.arange(len(owner)) - first[owner] + starts[owner], owner


def sliding_argmin(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the position of its least one, the leftmost among equals.

    The upper 33 bits decide, so that equal windows choose alike wherever they stand.
    """
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 31) - 1)
    v = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    v = np.concatenate([v, np.full(-len(v) % w, ~np.uint64(0), np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)


def anchors(prefix: PrefixHash, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their anchor, the least of the grams in a window.

    Equal windows have equal anchors at equal places. Returns for each run: hash of the anchor, first window, number of
    windows, place of the anchor in the first window, row. Windows lie within rows (offsets).
    """
    at = sliding_argmin(prefix.windows(gram), window - gram + 1)
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    starts, row = ranges(offsets[:-1], sizes)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    s0, p = starts[first], at[first]
    return prefix.of(p, p + gram), s0, count, p - s0, row[first]
