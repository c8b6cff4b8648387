"""Lossless WebP images (VP8L in RIFF): an encoder for payloads of bytes and a decoder for the whole format.

The decoder reads prefix codes, meta prefix codes, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Images of one group of codes are decoded many at a time, one
pixel of each per step; others one by one.

The encoder gives images of few colours a palette, several pixels to one; copies what occurred before, three pixels and more; and uses a
colour cache where enough of the other pixels hit it. What it chooses depends on the image alone.

Payloads: the bytes, 255 appended up to a positive multiple of 576, are red, green and blue samples in rows of 192 pixels; every
STRIP_ROWS rows are an image of their own, and the stored form is these RIFF files one after another.

Defined results: null texts are empty; empty texts give one row of 255; equal texts give equal bytes; texts of any length are as many
images as they need.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, free, schema_of, sub_batches, table

UNIT, STRIP_ROWS, PAD = 576, 32, 255
WIDTH = UNIT // 3
#: The longest prefix code that the encoder makes; the format allows 15.
LONGEST = 12
#: Bytes of texts or images that are worked on at once; some hundred bytes of memory are needed for each.
SLICE, LOAD_SLICE = 2 << 20, 6 << 20
#: The least and most pixels that the encoder copies at once; the format allows 4096.
LEAST_COPY, MOST_COPY = 3, 4096
#: Colour caches by an image's pixels (from so many on, bits), and the share of pixels that must hit it.
CACHES, CACHE_SHARE = ((1024, 8), (128, 7), (32, 5)), 1 / 16
#: Colours of an image that gets a palette, at most.
PALETTE = 16

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (columns to the left, rows up) of the distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40

REVERSED = [np.array([int(format(i, f"0{n}b")[::-1], 2) if n else 0 for i in range(1 << n)], np.uint32) for n in range(LONGEST + 1)]


class BadImage(ValueError):
    """The bytes are not a lossless WebP image."""


# Prefix codes


def canonical(lengths: list[int]) -> tuple[dict[int, tuple[int, int]], int]:
    """Symbol to (code as it is read, bit by bit from the lowest; length) and the longest length."""
    most = max(lengths, default=0)
    code, out = 0, {}
    for n in range(1, most + 1):
        for s, k in enumerate(lengths):
            if k == n:
                out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
                code += 1
        code <<= 1
    return out, most


class Code:
    """A prefix code to read by: a table of 2^bits entries of length << 16 | symbol."""

    def __init__(self, lengths: list[int]):
        n = np.array(lengths)
        used = n.nonzero()[0]
        if not len(used):
            raise BadImage("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.table, self.only = 0, None, int(used[0])
            return
        n = n[used]
        self.only, self.bits = None, int(n.max())
        # Filled in the order of the codes' bits, then read through reversed indexes.
        order = np.argsort(n, kind="stable")
        room = np.left_shift(1, self.bits - n)
        if int(room.sum()) != 1 << self.bits:
            raise BadImage("a prefix code that is not complete")
        flat = np.repeat((n << 16 | used).astype(np.uint32)[order], room[order])
        self.table = flat[_reversed(self.bits)]

    @cached_property
    def entries(self) -> list[int]:
        return [self.only] if self.only is not None else self.table.tolist()


@lru_cache(4096)
def small_code(lengths: tuple[int, ...]) -> Code:
    """Codes that come again and again: those for code lengths, and those of one or two symbols."""
    return Code([*lengths])


@lru_cache(1024)
def single(symbol: int) -> Code:
    return small_code((0,) * symbol + (1,))


@lru_cache(4096)
def length_code(n: int, lengths: int) -> Code:
    """The code for code lengths, of which n have three bits each."""
    own = [0] * 19
    for i in range(n):
        own[CODE_LENGTH_ORDER[i]] = lengths >> 3 * i & 7
    return Code(own)


def _reversed(bits: int) -> np.ndarray:
    while len(REVERSED) <= bits:
        n = len(REVERSED)
        REVERSED.append(np.array([int(format(i, f"0{n}b")[::-1], 2) for i in range(1 << n)], np.uint32))
    return REVERSED[bits]


def code_lengths(counts: np.ndarray, most: int = LONGEST) -> list[int]:
    """Lengths of a Huffman code, none above most: rare symbols count for more until it fits."""
    used = np.flatnonzero(counts)
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[int(used[0])] = 1
        return lengths
    least = 1
    while True:
        weight = np.maximum(counts[used], least)
        order = np.argsort(weight, kind="stable")
        # Two queues: the leaves in order, and the nodes, which come out in order too.
        leaves = weight[order].tolist()
        n = len(leaves)
        w, parent = leaves + [0] * (n - 1), [0] * (2 * n - 1)
        i, j = 0, n
        for k in range(n, 2 * n - 1):
            if i < n and (j >= k or w[i] <= w[j]):
                a, i = i, i + 1
            else:
                a, j = j, j + 1
            if i < n and (j >= k or w[i] <= w[j]):
                b, i = i, i + 1
            else:
                b, j = j, j + 1
            w[k] = w[a] + w[b]
            parent[a] = parent[b] = k
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            for s, d in zip(used[order].tolist(), depth):
                lengths[s] = d
            return lengths
        least *= 2


# Bits


class Bits:
    """Reads a stream from its lowest bit on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.size = data, at, 8 * len(data)

    def read(self, k: int) -> int:
        a = self.at
        if a + k > self.size:
            raise BadImage("the stream ends early")
        self.at = a + k
        b = a >> 3
        return (int.from_bytes(self.data[b : b + 6], "little") >> (a & 7)) & ((1 << k) - 1)

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        b = self.at >> 3
        e = int(code.table[(int.from_bytes(self.data[b : b + 4], "little") >> (self.at & 7)) & ((1 << code.bits) - 1)])
        self.at += e >> 16
        if self.at > self.size:
            raise BadImage("the stream ends early")
        return e & 0xFFFF


class Writer:
    def __init__(self):
        self.n = self.at = 0

    def put(self, value: int, k: int) -> None:
        self.n |= value << self.at
        self.at += k

    def bytes(self) -> bytes:
        return self.n.to_bytes(-(-self.at // 8), "little")


# Decoder


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return single(first)
        second = bits.read(8)
        return single(first) if first == second else small_code(tuple(int(i in (first, second)) for i in range(256)))
    n = 4 + bits.read(4)
    code = length_code(n, bits.read(min(3 * n, 30)) | (bits.read(3 * n - 30) << 30 if n > 10 else 0))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths: list[int] = []
    last = 8
    data, table, mask = bits.data, code.entries, (1 << code.bits) - 1
    window = used = 0
    full = -64
    while len(lengths) < size and left:
        left -= 1
        if used > full:
            bits.at += used
            window = int.from_bytes(data[bits.at >> 3 : (bits.at >> 3) + 128], "little") >> (bits.at & 7)
            used, full = 0, 960
        e = table[window & mask]
        k = e >> 16
        s = e & 0xFFFF
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + (window >> k & 3))
            k += 2
        elif s == 17:
            lengths += [0] * (3 + (window >> k & 7))
            k += 3
        else:
            lengths += [0] * (11 + (window >> k & 127))
            k += 7
        window >>= k
        used += k
    bits.at += used
    if len(lengths) > size or bits.at > bits.size:
        raise BadImage("too many code lengths, or too few bits")
    return Code(lengths + [0] * (size - len(lengths)))


def _extra(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    k = (s - 2) >> 1
    return ((2 + (s & 1)) << k) + bits.read(k) + 1


class Head:
    """What stands before an image's pixels: size, transforms, colour cache, prefix codes."""

    def __init__(self, bits: Bits, width: int, height: int, top: bool):
        self.full_width, self.width, self.height, self.transforms = width, width, height, []
        while top and bits.read(1):
            kind = bits.read(2)
            if any(kind == t[0] for t in self.transforms):
                raise BadImage("a transform that comes twice")
            if kind in (0, 1):
                k = bits.read(3) + 2
                self.transforms.append((kind, self.width, k, image(bits, -(-self.width >> k), -(-height >> k), False)))
            elif kind == 2:
                self.transforms.append((kind, self.width))
            else:
                n = bits.read(8) + 1
                deltas = image(bits, n, 1, False).view(np.uint8).reshape(n, 4)
                palette = np.cumsum(deltas, 0, dtype=np.uint8)
                k = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, self.width, k, np.ascontiguousarray(palette).view(np.uint32).ravel()))
                self.width = -(-self.width >> k)
        self.cache = bits.read(4) if bits.read(1) else 0
        if self.cache > 11:
            raise BadImage("a colour cache of more than 11 bits")
        self.meta = None
        groups = 1
        if top and bits.read(1):
            k = bits.read(3) + 2
            self.meta = (k, -(-self.width >> k), (image(bits, -(-self.width >> k), -(-height >> k), False) >> 8) & 0xFFFF)
            groups = int(self.meta[2].max()) + 1
        more = 1 << self.cache if self.cache else 0
        self.codes = [[read_code(bits, n) for n in (256 + LENGTHS + more, 256, 256, 256, DISTANCES)] for _ in range(groups)]


def pixels(bits: Bits, h: Head) -> np.ndarray:
    """The pixels as stored, alpha << 24 | red << 16 | green << 8 | blue, one after another."""
    width, n = h.width, h.width * h.height
    out, at = [0] * n, 0
    cache, shift, kept = [0] * (1 << h.cache), 32 - h.cache, 0
    codes = h.codes[0]
    while at < n:
        if h.meta:
            k, across, groups = h.meta
            codes = h.codes[groups[(at // width >> k) * across + (at % width >> k)]]
        s = bits.symbol(codes[0])
        if s < 256:
            r = bits.symbol(codes[1])
            b = bits.symbol(codes[2])
            out[at] = bits.symbol(codes[3]) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + LENGTHS:
            length = _extra(bits, s - 256)
            d = _extra(bits, bits.symbol(codes[4]))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)
            if d > at or at + length > n:
                raise BadImage("a copy from outside")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            if not h.cache:
                raise BadImage("a colour cache that is not there")
            while kept < at:
                cache[(CACHE_FACTOR * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
    return np.array(out, np.uint32)


def image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    h = Head(bits, width, height, top)
    return undo(h, pixels(bits, h))


def undo(h: Head, px: np.ndarray) -> np.ndarray:
    for t in reversed(h.transforms):
        px = (_predictor, _cross, _green, _palette)[t[0]](px, h.height, *t[1:])
    return px


def _channels(px: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(px, "<u4").view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha


def _green(px: np.ndarray, height: int, width: int) -> np.ndarray:
    c = _channels(px).copy()
    c[:, 0] += c[:, 1]
    c[:, 2] += c[:, 1]
    return c.view("<u4").ravel()


def _palette(px: np.ndarray, height: int, width: int, k: int, palette: np.ndarray) -> np.ndarray:
    index = _channels(px)[:, 1].reshape(height, -1)
    if k:
        each = 8 >> k
        index = (index[:, :, None] >> (np.arange(1 << k, dtype=np.uint8) * each)) & ((1 << each) - 1)
        index = index.reshape(height, -1)[:, :width]
    table256 = np.zeros(256, np.uint32)
    table256[: len(palette)] = palette
    return table256[index].ravel()


def _cross(px: np.ndarray, height: int, width: int, k: int, plan: np.ndarray) -> np.ndarray:
    c = _channels(px).copy()
    y, x = np.divmod(np.arange(width * height), width)
    e = _channels(plan)[(y >> k) * -(-width >> k) + (x >> k)].view(np.int8).astype(np.int16)
    delta = lambda t, v: (t * v.view(np.int8).astype(np.int16)) >> 5
    green = c[:, 1].copy()
    red = (c[:, 2] + delta(e[:, 0], green)).astype(np.uint8)
    blue = (c[:, 0] + delta(e[:, 1], green) + delta(e[:, 2], red)).astype(np.uint8)
    c[:, 2], c[:, 0] = red, blue
    return c.view("<u4").ravel()


def _predictor(px: np.ndarray, height: int, width: int, k: int, plan: np.ndarray) -> np.ndarray:
    c = [tuple(x) for x in _channels(px).tolist()]
    modes = (_channels(plan)[:, 1] & 15).tolist()
    across = -(-width >> k)
    mean = lambda a, b: tuple((p + q) >> 1 for p, q in zip(a, b))
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    black = (0, 0, 0, 255)
    out: list[tuple] = []
    for i, d in enumerate(c):
        y, x = divmod(i, width)
        if y == 0:
            p = out[i - 1] if x else black
        elif x == 0:
            p = out[i - width]
        else:
            m = modes[(y >> k) * across + (x >> k)]
            # The pixel up and right of a row's last is this row's first.
            left, up, corner, right = out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1]
            if m == 0:
                p = black
            elif m <= 4:
                p = (left, up, right, corner)[m - 1]
            elif m == 5:
                p = mean(mean(left, right), up)
            elif m <= 7:
                p = mean(left, (corner, up)[m - 6])
            elif m <= 9:
                p = mean(up, (corner, right)[m - 8])
            elif m == 10:
                p = mean(mean(left, corner), mean(up, right))
            elif m == 11:
                to_left = sum(abs(u - q) for u, q in zip(up, corner))
                to_up = sum(abs(v - q) for v, q in zip(left, corner))
                p = left if to_left < to_up else up
            elif m == 12:
                p = tuple(clamp(a + b - q) for a, b, q in zip(left, up, corner))
            elif m == 13:
                p = tuple(clamp(a + int((a - q) / 2)) for a, q in zip(mean(left, up), corner))
            else:
                p = black
        out.append(tuple((a + b) & 255 for a, b in zip(d, p)))
    return np.array(out, np.uint8).view("<u4").ravel()


def open_webp(data: bytes) -> tuple[bytes, int]:
    """The VP8L stream of the first RIFF file in the bytes, and where that file ends."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("no RIFF file of WebP")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    at = 12
    while at + 8 <= end:
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + n], end
        at += 8 + n + (n & 1)
    raise BadImage("no lossless image in the file")


def start(stream: bytes) -> tuple[Bits, Head]:
    if stream[:1] != b"\x2f":
        raise BadImage("no signature")
    bits = Bits(stream, 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("another version")
    return bits, Head(bits, width, height, True)


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file to an array (height, width, 4) of red, green, blue and alpha."""
    bits, h = start(open_webp(data)[0])
    c = _channels(undo(h, pixels(bits, h)))
    return np.ascontiguousarray(c[:, [2, 1, 0, 3]].reshape(h.height, h.full_width, 4))


def _flat(code: Code, bits: int) -> np.ndarray:
    """A code's table, or that of its only symbol, which takes no bits, filled up to 2^bits entries."""
    table = np.array([code.only], np.uint32) if code.only is not None else code.table
    return np.tile(table, 1 << (bits - code.bits))


def _prefixed(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of symbols, the extra bits from the lowest of each window on; and how many bits these were."""
    s = symbol.astype(np.int64)
    k = np.where(s < 4, 0, (s - 2) >> 1)
    more = (window & ((np.uint64(1) << k.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(s < 4, s + 1, ((2 + (s & 1)) << k) + more + 1), k


def pixels_together(streams: list[bytes], heads: list[tuple[Bits, Head]]) -> list[np.ndarray]:
    """pixels() of many images of one group of codes, none of them longer than LONGEST bits."""
    n = len(streams)
    if not n:
        return []
    order = sorted(range(n), key=lambda i: -heads[i][1].width * heads[i][1].height)
    head = [heads[i][1] for i in order]
    sizes = np.array([h.width * h.height for h in head])
    across = np.array([h.width for h in head])
    begin = np.cumsum([0, *(len(streams[i]) for i in order)])
    data = np.frombuffer(b"".join([streams[i] for i in order]) + bytes(16), np.uint8)
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    at = begin[:-1] * 8 + [heads[i][0].at for i in order]
    limit = begin[1:] * 8
    tables, rows, masks = [], [], []
    for kind in range(5):
        width = max(h.codes[0][kind].bits for h in head)
        tables.append(np.concatenate([_flat(h.codes[0][kind], width) for h in head]))
        rows.append(np.arange(n) << width)
        masks.append(np.uint64((1 << width) - 1))
    cache_bits = np.array([h.cache for h in head])
    has_cache = cache_bits > 0
    room = np.cumsum([0, *(1 << cache_bits)])
    shift, cache = (32 - cache_bits).astype(np.uint64), np.zeros(int(room[-1]), np.uint32)
    room = room[:-1]
    near = np.array(NEAR)
    where = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, any_cache = n, bool(has_cache.any())

    def symbol(kind: int, lanes: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = tables[kind][rows[kind][lanes] + (window & masks[kind]).astype(np.int64)]
        k = e >> np.uint32(16)
        return e & np.uint32(0xFFFF), k.astype(np.int64), window >> k.astype(np.uint64)

    for t in range(int(sizes[0])):
        while sizes[live - 1] <= t:
            live -= 1
        now = where[:live] + t
        read = (left[:live] == 0).nonzero()[0]
        if len(read):
            a = at[read]
            s, used, window = symbol(0, read, eight[a >> 3] >> (a & 7).astype(np.uint64))
            literal = (s < 256).nonzero()[0]
            if len(literal):
                lanes, w = read[literal], window[literal]
                red, k1, w = symbol(1, lanes, w)
                blue, k2, w = symbol(2, lanes, w)
                alpha, k3, _ = symbol(3, lanes, w)
                out[now[lanes]] = alpha << np.uint32(24) | red << np.uint32(16) | s[literal] << np.uint32(8) | blue
                used[literal] += k1 + k2 + k3
            if len(literal) < len(read):
                copy = ((s >= 256) & (s < 256 + LENGTHS)).nonzero()[0]
                if len(copy):
                    lanes, w = read[copy], window[copy]
                    length, k1 = _prefixed(s[copy] - np.uint32(256), w)
                    d, k2, w = symbol(4, lanes, w >> k1.astype(np.uint64))
                    d, k3 = _prefixed(d, w)
                    small = d <= len(NEAR)
                    x, y = near[np.where(small, d, 1) - 1].T
                    d = np.where(small, np.maximum(1, x + y * across[lanes]), d - len(NEAR))
                    if (d > t).any() or (t + length > sizes[lanes]).any():
                        raise BadImage("a copy from outside")
                    left[lanes], back[lanes] = length, d
                    used[copy] += k1 + k2 + k3
                hit = (s >= 256 + LENGTHS).nonzero()[0]
                if len(hit):
                    lanes = read[hit]
                    if not has_cache[lanes].all():
                        raise BadImage("a colour cache that is not there")
                    out[now[lanes]] = cache[room[lanes] + s[hit].astype(np.int64) - 256 - LENGTHS]
            a += used
            if (a > limit[read]).any():
                raise BadImage("the stream ends early")
            at[read] = a
        if len(read) < live or left[:live].any():
            lanes = left[:live].nonzero()[0]
            out[now[lanes]] = out[now[lanes] - back[lanes]]
            left[lanes] -= 1
        if any_cache:
            px = out[now]
            slot = ((px.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> shift[:live]
            cache[room[:live] + slot.astype(np.int64)] = px
    found: list = [None] * n
    for i, b, k in zip(order, where.tolist(), sizes.tolist()):
        found[i] = out[b : b + k]
    return found


def decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """The pixels of many images, alpha << 24 | red << 16 | green << 8 | blue."""
    heads = [start(s) for s in streams]
    together = [i for i, (_, h) in enumerate(heads) if not h.meta and all(c.bits <= LONGEST for c in h.codes[0])]
    out: list = [None] * len(streams)
    for i, px in zip(together, pixels_together([streams[i] for i in together], [heads[i] for i in together])):
        out[i] = px
    for i, (bits, h) in enumerate(heads):
        out[i] = undo(h, pixels(bits, h) if out[i] is None else out[i])
    return out


# Encoder

GREENS = 256 + LENGTHS + (1 << CACHES[0][1])
#: Lengths of the code for code lengths: 17 and 18 (runs of zeros) in 3 bits, 1 and 2 in 5, 0 and 3 to 12 in 4 bits.
OWN = [4, 5, 5, *[4] * 10, *[0] * 4, 3, 3]
#: A code that is not in short, with 19 lengths of its own code, and no bound on the symbols.
OWN_HEAD = 15 << 1 | sum(OWN[s] << 5 + 3 * i for i, s in enumerate(CODE_LENGTH_ORDER))
OWN_TEXT = {s: f"{code:0{k}b}"[::-1] for s, (code, k) in canonical(OWN)[0].items()}


def prefix_codes(counts: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Lengths of a Huffman code, and by symbol how many bits it takes (none, where it is the only one) and these bits."""
    lengths = code_lengths(counts) if counts.any() else [1, *[0] * (len(counts) - 1)]
    k = np.array(lengths)
    order = np.flatnonzero(k)
    bits, codes = np.zeros(len(k), np.int64), np.zeros(len(k), np.uint64)
    if len(order) > 1:
        order = order[np.argsort(k[order], kind="stable")]
        kk = k[order]
        most = int(kk[-1])
        code = np.concatenate(([0], np.cumsum(np.left_shift(1, most - kk))[:-1])) >> (most - kk)
        bits[order] = kk
        codes[order] = _reversed(most)[code << (most - kk)]
    return lengths, bits, codes


def put_code(w: Writer, lengths: list[int]) -> None:
    """A prefix code: that of a single symbol in short, others by their lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        w.put(1 | 0 << 1 | 1 << 2 | used[0] << 3, 11)
        return
    w.put(OWN_HEAD, 5 + 3 * len(OWN) + 1)
    # As text, from the lowest bit on: quicker than a number that grows.
    out, last = [], -1
    for s in used:
        if s > last + 1:
            out.append(_zeros(s - last - 1))
        out.append(OWN_TEXT[lengths[s]])
        last = s
    out.append(_zeros(len(lengths) - last - 1))
    text = "".join(out)
    w.put(int(text[::-1], 2), len(text))


@lru_cache(4096)
def _zeros(n: int) -> str:
    """The code lengths of n symbols that do not occur."""
    out = ""
    while n:
        if n >= 11:
            run = min(n, 138)
            out += OWN_TEXT[18] + f"{run - 11:07b}"[::-1]
        elif n >= 3:
            run = n
            out += OWN_TEXT[17] + f"{run - 3:03b}"[::-1]
        else:
            run = 1
            out += OWN_TEXT[0]
        n -= run
    return out


def put_palette(w: Writer, colours: np.ndarray) -> None:
    """The palette transform: its colours as an image of one row, each less the one before."""
    w.put(1 | 3 << 1, 3)
    w.put(len(colours) - 1, 8)
    w.put(0, 1)  # no cache
    c = _channels(colours)
    deltas = np.concatenate((c[:1], c[1:] - c[:-1]))
    codes = [prefix_codes(np.bincount(deltas[:, j], minlength=256 + (LENGTHS if j == 1 else 0))) for j in (1, 2, 0, 3)]
    for lengths, _, _ in codes:
        put_code(w, lengths)
    put_code(w, [1])
    for row in deltas.tolist():
        for j, (_, bits, value) in zip((1, 2, 0, 3), codes):
            w.put(int(value[row[j]]), int(bits[row[j]]))


def prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and these, for lengths or distances from 1 on."""
    x = np.maximum(v - 1, 1)
    top = np.frexp(x)[1] - 1
    k = np.maximum(top - 1, 0)
    big = v > 4
    return np.where(big, 2 * top + (x >> k & 1), v - 1), np.where(big, k, 0), np.where(big, x & ((1 << k) - 1), 0)


def _before(key: np.ndarray) -> np.ndarray:
    """For each place the last one before it with its key, or -1."""
    order = np.argsort(key, kind="stable")
    out = np.full(len(key), -1, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def copies(px: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where copies begin, how long they are and from how far; px: pixels of images one after another, of: the image of each."""
    n = len(px) - LEAST_COPY + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    x = px.astype(np.uint64)
    key = of[:n].astype(np.uint64)
    for j in range(LEAST_COPY):
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + x[j : j + n] * np.uint64(0x9E3779B97F4A7C15)
    prior = _before(key)
    i = np.arange(n)
    ok = (prior >= 0) & (of[:n] == of[LEAST_COPY - 1 :]) & (of[prior] == of[:n])
    for j in range(LEAST_COPY):
        ok &= px[np.maximum(prior, 0) + j] == px[i + j]
    far = np.where(ok, i - prior, 0)
    new = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1])))
    end = np.concatenate((new[1:], [n]))
    real = far[new] > 0
    first, end, far = new[real], end[real] + LEAST_COPY - 1, far[new[real]]
    if not len(first):
        return none, none, none
    first = np.maximum(first, np.concatenate(([0], np.maximum.accumulate(end)[:-1])))
    size = np.minimum(end - first, MOST_COPY)
    keep = size >= LEAST_COPY
    return first[keep], size[keep], far[keep]


def encode_all(payloads: list[np.ndarray]) -> list[bytes]:
    """RIFF files of images, each a payload of samples, red, green and blue, in rows of WIDTH pixels."""
    n = len(payloads)
    if not n:
        return []
    writers, images = [], []
    for p in payloads:
        c = p.reshape(-1, 3).astype(np.uint32)
        px = np.uint32(0xFF000000) | c[:, 0] << np.uint32(16) | c[:, 1] << np.uint32(8) | c[:, 2]
        w = Writer()
        w.put(0x2F | WIDTH - 1 << 8 | len(px) // WIDTH - 1 << 22, 40)  # no alpha, version 0
        if len(np.unique(px[:64])) <= PALETTE and len(colours := np.unique(px)) <= PALETTE:
            put_palette(w, colours)
            k = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
            index = np.searchsorted(colours, px).astype(np.uint32).reshape(-1, 1 << k)
            px = (index << (np.arange(1 << k, dtype=np.uint32) * np.uint32(8 >> k))).sum(1, dtype=np.uint32) << np.uint32(8)
        w.put(0, 1)  # no further transform
        writers.append(w)
        images.append(px)
    sizes = np.array([len(px) for px in images])
    begin = np.cumsum(sizes) - sizes
    flat, of = np.concatenate(images), np.repeat(np.arange(n), sizes)
    first, size, far = copies(flat, of)
    inside = np.zeros(len(flat) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, first + size, -1)
    free = np.cumsum(inside[:-1]) == 0
    cache_bits = np.zeros(n, np.int64)
    for least, bits in reversed(CACHES):
        cache_bits[sizes >= least] = bits
    slot = (((flat.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> (32 - cache_bits[of]).astype(np.uint64)).astype(np.int64)
    prior = _before(of << CACHES[0][1] | slot)
    hit = free & (prior >= 0) & (flat[prior] == flat)
    cache_bits[np.add.reduceat(hit, begin, dtype=np.int64) < CACHE_SHARE * np.maximum(1, np.add.reduceat(free, begin, dtype=np.int64))] = 0
    hit &= cache_bits[of] > 0
    # One token for each free pixel and each copy.
    kind = np.where(hit, 1, 0)
    kind[first] = 2
    token = np.flatnonzero(free | (kind == 2))
    kind, image, px = kind[token], of[token], flat[token]
    length, far_of = (np.ones(len(flat), np.int64) for _ in range(2))
    length[first], far_of[first] = size, far + len(NEAR)
    ls, lk, lx = prefix_of(length[token])
    ds, dk, dx = prefix_of(far_of[token])
    green = np.choose(kind, ((px >> np.uint32(8) & np.uint32(255)).astype(np.int64), 256 + LENGTHS + slot[token], 256 + ls))
    red, blue = (px >> np.uint32(16) & np.uint32(255)).astype(np.int64), (px & np.uint32(255)).astype(np.int64)
    is_literal, is_copy = kind == 0, kind == 2
    count = lambda s, chosen, most: np.bincount((image * most + s)[chosen], minlength=n * most).reshape(n, most)
    tallies = count(green, slice(None), GREENS), count(red, is_literal, 256), count(blue, is_literal, 256), count(ds, is_copy, DISTANCES)
    bits = [np.zeros(t.shape, np.int64) for t in tallies]
    codes = [np.zeros(t.shape, np.uint64) for t in tallies]
    for i, w in enumerate(writers):
        b = int(cache_bits[i])
        w.put(1 | b << 1 if b else 0, 5 if b else 1)
        w.put(0, 1)  # one group of codes
        greens = 256 + LENGTHS + (1 << b if b else 0)
        for j in (0, 1, 2, 4, 3):
            if j == 4:
                put_code(w, [*[0] * int(images[i][0] >> np.uint32(24)), 1])
                continue
            lengths, bits[j][i, :greens], codes[j][i, :greens] = prefix_codes(tallies[j][i, :greens])
            put_code(w, lengths)
    zero = np.zeros(len(token), np.int64)
    pick = lambda table, s: table.ravel()[image * table.shape[1] + s]
    choose = lambda lit, cop: np.where(is_literal, lit, np.where(is_copy, cop, zero.astype(cop.dtype)))
    k = np.stack([pick(bits[0], green), choose(pick(bits[1], red), lk), choose(pick(bits[2], blue), pick(bits[3], ds)), np.where(is_copy, dk, 0)], 1).ravel()
    value = np.stack([pick(codes[0], green), choose(pick(codes[1], red), lx.astype(np.uint64)), choose(pick(codes[2], blue), pick(codes[3], ds)), np.where(is_copy, dx, 0).astype(np.uint64)], 1).ravel()
    return _streams(writers, value, k, np.searchsorted(image, np.arange(n)) * 4)


def _streams(writers: list[Writer], value: np.ndarray, k: np.ndarray, first: np.ndarray) -> list[bytes]:
    """RIFF files: what each writer has, then the values of its image, k bits each; an image's values begin at first."""
    total = np.add.reduceat(k, first)
    lead = np.array([w.at for w in writers])
    size = -(-(lead + total) // 64) + 1  # in words
    begin = np.cumsum(size) - size
    pos = np.cumsum(k) - k
    pos += np.repeat(begin * 64 + lead - pos[first], np.diff(np.append(first, len(k))))
    half = pos >> 5
    new = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
    sums = np.add.reduceat(value << (pos & 31).astype(np.uint64), new)
    buf = np.zeros(int(size.sum()) * 2 + 1, np.uint64)
    buf[half[new]] += sums & np.uint64(0xFFFFFFFF)
    buf[half[new] + 1] += sums >> np.uint64(32)
    raw, out = buf.astype("<u4").tobytes(), []
    for w, b, t in zip(writers, begin.tolist(), total.tolist()):
        body = bytearray(raw[8 * b : 8 * b + -(-(w.at + t) // 8)])
        lead = w.bytes()
        body[: len(lead)] = (int.from_bytes(body[: len(lead)], "little") | w.n).to_bytes(len(lead), "little")
        odd = len(body) & 1
        out.append(b"RIFF" + struct.pack("<I", 12 + len(body) + odd) + b"WEBPVP8L" + struct.pack("<I", len(body)) + bytes(body) + bytes(odd))
    return out


# Payloads


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of padded payloads."""
    strips, owner = [], []
    for i, p in enumerate(payloads):
        a = np.frombuffer(p, np.uint8)
        for k in range(0, len(a), UNIT * STRIP_ROWS):
            strips.append(a[k : k + UNIT * STRIP_ROWS])
            owner.append(i)
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, f in zip(owner, encode_all(strips)):
        out[i].append(f)
    return [b"".join(x) for x in out]


def load(media: list[bytes]) -> list[bytes]:
    """Payloads from their stored form."""
    streams, owner = [], []
    for i, m in enumerate(media):
        while m:
            s, end = open_webp(m)
            streams.append(s)
            owner.append(i)
            m = m[end:]
    out: list[list[bytes]] = [[] for _ in media]
    for i, px in zip(owner, decode_all(streams)):
        out[i].append(_channels(px)[:, 2::-1].tobytes())
    return [b"".join(x) for x in out]


def feature(payload: bytes) -> str:
    """Sixteen brightness bins, each's share of the samples as 0 to 255, and the mean step between neighbours."""
    a = np.frombuffer(payload, np.uint8)
    share = np.bincount(a >> 4, minlength=16) * 255 // len(a)
    return share.astype(np.uint8).tobytes().hex() + f"-{float(np.abs(np.diff(a.astype(np.int16))).mean()):.4f}"


def to_media(df: DataFrame, column: str = "text", to: str = "media") -> DataFrame:
    """Adds the stored form of a text column, with __ before its name where there is such a column."""
    (to,) = free([to], df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, column, SLICE):
                media = store([padded((t or "").encode()) for t in part.column(column).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=[*part.schema.names, to])

    return df.mapInArrow(run, schema_of(df, f"`{to}` binary"))


def from_media(df: DataFrame, column: str = "media", to: str = "pixels", tell: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """Adds the samples of a column of stored forms, with __ before its name where there is such a column; or gives what tell makes, by
    this schema, of rows and their samples, which then never leave the task that decodes them."""
    (to,) = free([to], df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, column, LOAD_SLICE):
                found = load([m or b"" for m in part.column(column).to_pylist()])
                yield tell(part, found) if tell else pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, to])

    return df.mapInArrow(run, schema if tell else schema_of(df, f"`{to}` binary"))


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document as lossless WebP, a column of a table, reads that back, and tells what was read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "text")
    held = Scratch(spark, "media").keep(to_media(docs).drop("text"), "media")

    def tell(x: pa.RecordBatch, back: list[bytes]) -> pa.RecordBatch:
        media = x.column("media").to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                x.column("doc_id"), x.column("n_bytes"), pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array([feature(p) for p in back], pa.string()),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    return from_media(held, tell=tell, schema="doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
