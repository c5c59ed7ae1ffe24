"""Suffix sorting by prefix polynomial hashes, in memory of one task."""

from __future__ import annotations

import numpy as np

from spotloom.llm.textcols import PrefixHash


class HashedText:
    """Bytes whose ranges compare in logarithmic time: binary search over prefix hashes finds a common extension."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.prefix = raw, PrefixHash(raw)

    def common(self, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
        """Length of the common extension of the suffixes at x and y, `depth` at most; both must have that many bytes."""
        out = np.full(len(x), depth, np.int64)
        todo = np.flatnonzero(self.prefix.raw(x, x + depth) != self.prefix.raw(y, y + depth))
        a, b = x[todo], y[todo]
        low, high = np.zeros(len(todo), np.int64), np.full(len(todo), depth, np.int64)  # low agrees, high does not
        while len(todo) and (gap := high - low).max() > 1:
            mid = low + gap // 2
            same = self.prefix.raw(a, a + mid) == self.prefix.raw(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid)
        out[todo] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray, depth: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y by its first `depth` bytes; where those agree, or_equal."""
        at = self.common(x, y, depth)
        same = at == depth
        at[same] = 0
        return np.where(same, or_equal, self.raw[x + at] < self.raw[y + at])

    def agree(self, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
        """Byte-wise check that ranges which hash alike are alike. Where the ranges one byte before are a checked pair as
        well, only the last byte is new."""
        order = np.lexsort((x, y - x))
        x, y = x[order], y[order]
        follows = np.zeros(len(x), bool)
        follows[1:] = (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1)
        ok = np.ones(len(x), bool)
        ok[follows] = self.raw[x[follows] + depth - 1] == self.raw[y[follows] + depth - 1]
        heads = np.flatnonzero(~follows)
        for k in range(0, len(heads), 1 << 14):
            h = heads[k : k + (1 << 14)]
            span = np.arange(depth)
            ok[h] = (self.raw[x[h][:, None] + span] == self.raw[y[h][:, None] + span]).all(axis=1)
        out = np.empty(len(x), bool)
        out[order] = ok
        return out


def merge_sort(text: HashedText, suffixes: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Order of suffixes by their first `depth` bytes within each bucket (ascending runs of equal numbers), stably.

    Bottom-up merge sort of all buckets at once: an element's place in a merged run is its place in its own run plus its
    rank in the other one, found by binary search with hash-compared suffixes.
    """
    n = len(suffixes)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(start, n))
    base, size = np.repeat(start, sizes), np.repeat(sizes, sizes)
    order, width = np.arange(n), 1
    while n and width < sizes.max():
        local = np.arange(n) - base
        block = local // width
        other = (block ^ 1) * width
        low = np.zeros(n, np.int64)
        high = np.clip(size - other, 0, width)
        right = (block & 1).astype(bool)  # among equals the left run comes first
        todo = np.flatnonzero(high > 0)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            probe = suffixes[order[base[todo] + other[todo] + mid]]
            before = text.less(probe, suffixes[order[todo]], depth, right[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        place = base + (block // 2) * 2 * width + local % width + low
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, width * 2
    return order


def repeated(raw: np.ndarray, suffixes: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes share their first `depth` bytes with another one of their bucket."""
    text = HashedText(raw)
    by_bucket = np.argsort(bucket, kind="stable")
    s, b = suffixes[by_bucket], bucket[by_bucket]
    order = merge_sort(text, s, b, depth)
    s = s[order]
    pair = np.flatnonzero(b[1:] == b[:-1])
    same = text.common(s[pair], s[pair + 1], depth) == depth
    pair = pair[same]
    if not text.agree(s[pair], s[pair + 1], depth).all():  # a collision: sort these by their bytes instead
        whole = raw.tobytes()
        keys = [(k, whole[x : x + depth]) for k, x in zip(b.tolist(), s.tolist(), strict=True)]
        counts: dict = {}
        for k in keys:
            counts[k] = counts.get(k, 0) + 1
        hit = np.array([counts[k] > 1 for k in keys], bool)
    else:
        hit = np.zeros(len(s), bool)
        hit[pair] = hit[pair + 1] = True
    out = np.zeros(len(s), bool)
    out[by_bucket[order]] = hit
    return out
