"""Words of many texts at once: spans and 64-bit hashes by numpy over the texts' bytes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

# Odd multipliers; any would do, but they fix what hashes come out.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Spans of more bytes are hashed one by one.
LONG = 512
#: What is left of eight bytes of which the first k count.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The bytes \x20 and \x09 to \x0D, which alone separate words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Letters' and digits' bytes, those of UTF-8 sequences included.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes buf[start:end] for each pair; different spans of eight bytes or less have different ones.

    Eight bytes of every span a round, each round mixed; no sum of bytes, which texts built for it would bring to collide."""
    size = end - start
    h = mix(size.astype(np.uint64) * MIX1 + np.uint64(seed))
    data = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", data.data, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, rest = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & FIRST[np.minimum(rest, 8)]) * MIX2)
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxh3_64_intdigest(data[start[i] : end[i]].data, seed)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two things, in order, from theirs."""
    return mix(mix(a + MIX1) ^ b * MIX2)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i : i + n] for each i, by runs of 1, 2, 4 and so on."""
    out, got, whole, have = None, 0, h, 1
    count = len(h) - n + 1
    if count <= 0:
        return h[:0]
    while True:
        if n & have:
            part = whole[got : got + count]
            out = part if out is None else join(out, part)
            got += have
        if 2 * have > n:
            return out
        whole = join(whole[: len(whole) - have], whole[have:])
        have *= 2


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes, cut at the texts' ends: start and end of each, and offsets of each text's runs."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~BLANK[buf], off)
