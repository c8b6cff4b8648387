"""Shingle sets of many texts at once, and their circulant MinHash signatures."""

from __future__ import annotations

import numpy as np

from .words import LOWER, MIX1, MIX2, hashes, join, mix, runs, words

#: Shingles whose signatures are computed at once, to stay in a core's cache.
CHUNK = 1 << 15


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repetition, and their offsets."""
    out, sizes = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        v = np.sort(values[a:b])
        if len(v) > 1:
            v = v[np.concatenate(([True], v[1:] != v[:-1]))]
        out.append(v)
        sizes.append(len(v))
    return (np.concatenate(out) if out else values[:0]), np.cumsum([0, *sizes])


def word_shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, A-Z lower-cased; texts of fewer words have their whole sequence as one."""
    start, end, at = words(buf, off)
    h = hashes(LOWER[buf], start, end)
    count = np.diff(at)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.cumsum(np.concatenate(([0], made)))
    first = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], made)
    whole = np.repeat(count >= n, made)
    out = np.empty(len(first), np.uint64)
    out[whole] = runs(h, n)[first[whole]]
    short = np.flatnonzero((count > 0) & (count < n))
    some = h[at[short]]
    for k in range(1, n - 1):
        more = count[short] > k
        some[more] = join(some[more], h[at[short][more] + k])
    out[~whole] = mix(some ^ count[short].astype(np.uint64))
    return distinct(out, bounds)


def signatures(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash, one row of `size` numbers for each non-empty set (rows of empty ones are 0).

    Two permutations of the 32-bit numbers are used: the first scatters the shingles (the high half of their mixed
    hashes), the second, shifted circularly by k, gives coordinate k: min over x of second(first(x) - k)."""
    out = np.zeros((len(at) - 1, size), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    first = (values >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + CHUNK)))
        a, b = int(at[full[i]]), int(at[full[j - 1] + 1])
        x, begin = first[a:b], at[full[i:j]] - a
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(size):
            np.subtract(x, np.uint32(k), out=y)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 0)):
                np.right_shift(y, np.uint32(shift), out=z)
                np.bitwise_xor(y, z, out=y)
                if factor:
                    np.multiply(y, np.uint32(factor), out=y)
            out[full[i:j], k] = np.minimum.reduceat(y, begin)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    s = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX1, s.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ (s[:, :, r] * MIX2 + np.uint64(r + 1)))
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct values."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
