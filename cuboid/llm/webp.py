"""Media columns: lossless WebP written and read in numpy.

A payload becomes rows of 16 RGBA pixels (64 bytes); each ``HIGHEST`` rows are one WebP file, and the
stored form is these files one after another.  Files are written and read many at once (``webp_batch``):
each has the transform that suits it best, copies, a colour cache where it helps, and fitted prefix
codes.  Here are the format's parts and a plain reader, symbol by symbol, of the whole lossless format:
canonical prefix codes in groups, back-references, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms.

Cases: a null or empty text is one block of 64 zero bytes; repeated rows give repeated results; an
empty table gives an empty result; other columns are not read; memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm import common

ROW, BLOCK, HIGHEST = 16, 64, 64
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES = 24, 40

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# --- bits ------------------------------------------------------------------------------------------


class Writer:
    """Bits in the order of the format: the first bit is a byte's lowest."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.small: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.small += [value >> i & 1 for i in range(n)]

    def code(self, code: int, n: int) -> None:
        """A prefix code goes from its highest bit."""
        self.small += [code >> i & 1 for i in range(n - 1, -1, -1)]

    def many(self, bits: np.ndarray) -> None:
        self.parts += [np.array(self.small, np.uint8), bits.ravel()]
        self.small = []

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate([*self.parts, np.array(self.small, np.uint8)]), bitorder="little").tobytes()


class Reader:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        self.data, self.at = data + bytes(8), 0

    def peek(self, n: int) -> int:
        byte, off = divmod(self.at, 8)
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> off) & ((1 << n) - 1)

    def get(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the stream ends too early")
        return x

    def take(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise ValueError("the stream ends too early")
        self.at += n
        return self.bits[self.at - n : self.at]


# --- prefix codes ----------------------------------------------------------------------------------


class Code:
    """A canonical prefix code by the lengths of its symbols; a code of one symbol takes no bits."""

    __slots__ = ("symbols", "lengths", "width", "table", "longest")

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        """symbols: those in use, by length and then by value; lengths: theirs."""
        self.symbols, self.lengths, self.table = symbols, lengths, None
        if not len(symbols):
            self.symbols, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.longest = 0 if len(self.symbols) == 1 else int(self.lengths[-1])
        if self.longest and (1 << (self.longest - self.lengths)).sum() != 1 << self.longest:
            raise ValueError("not a complete prefix code")
        self.width = self.longest if len(self.symbols) == 1 << self.longest else -1

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        return cls(used, lengths[used])

    def codes(self) -> dict[int, tuple[int, int]]:
        """(code, length) of each symbol."""
        if not self.longest:
            return {int(self.symbols[0]): (0, 0)}
        at = np.concatenate([[0], np.cumsum(1 << (self.longest - self.lengths))[:-1]])
        return {int(s): (int(a) >> (self.longest - int(n)), int(n)) for s, a, n in zip(self.symbols, at, self.lengths)}

    def read(self, r: Reader) -> int:
        if not self.longest:
            return int(self.symbols[0])
        if self.table is None:
            n = self.longest
            spread = np.repeat(np.arange(len(self.symbols)), 1 << (n - self.lengths))
            index = np.arange(1 << n)
            turned = np.zeros(1 << n, np.int64)
            for i in range(n):
                turned |= (index >> i & 1) << (n - 1 - i)
            pick = spread[turned]
            self.table = list(zip(self.symbols[pick].tolist(), self.lengths[pick].tolist()))
        symbol, n = self.table[r.peek(self.longest)]
        r.at += n
        return symbol


def read_code(r: Reader, alphabet: int) -> Code:
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        symbols = [r.get(8 if wide else 1)] + ([r.get(8)] if two else [])
        if max(symbols) >= alphabet:
            raise ValueError("a symbol outside its alphabet")
        return Code(np.array(sorted(set(symbols))), np.ones(len(set(symbols)), np.int64))
    first = np.zeros(19, np.int64)
    for k in CODE_LENGTH_ORDER[: 4 + r.get(4)]:
        first[k] = r.get(3)
    by = Code.of(first)
    limit = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else alphabet
    if by.longest <= 1 and by.symbols.max() < 16 and limit >= alphabet:  # as many bits as symbols
        bits = r.take(alphabet) if by.longest else np.zeros(alphabet, np.uint8)
        return Code.of(by.symbols[bits])
    lengths, before, at = np.zeros(alphabet, np.int64), 8, 0
    while at < alphabet and limit:
        limit -= 1
        s = by.read(r)
        if s < 16:
            lengths[at] = s
            before, at = s or before, at + 1
            continue
        value, n = (before, 3 + r.get(2)) if s == 16 else (0, 3 + r.get(3) if s == 17 else 11 + r.get(7))
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = value
        at += n
    return Code.of(lengths)


def write_code(w: Writer, lengths: np.ndarray) -> Code:
    """Writes the code of these lengths; those of one or two symbols below 256 take the short form."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        return Code(np.array(symbols), np.ones(len(symbols), np.int64))
    values = np.unique(lengths)
    first = np.zeros(19, np.int64)
    if len(values) <= 2:
        first[values] = 1
    else:
        first = huffman(np.bincount(lengths, minlength=19), 7)
    w.put(0, 1)
    order = [int(first[k]) for k in CODE_LENGTH_ORDER]
    n = max(4, max(i for i, x in enumerate(order) if x) + 1)
    w.put(n - 4, 4)
    for x in order[:n]:
        w.put(x, 3)
    w.put(0, 1)
    by = Code.of(first)
    if by.longest == 1:
        w.many((lengths == by.symbols[1]).astype(np.uint8))
    elif by.longest:
        codes = by.codes()
        for x in lengths.tolist():
            w.code(*codes[x])
    return Code.of(lengths)


def huffman(counts: np.ndarray, longest: int) -> np.ndarray:
    """Code lengths of at most ``longest``: counts are levelled until they fit."""
    counts = counts.astype(np.int64)
    while True:
        lengths = np.zeros(len(counts), np.int64)
        heap = [(int(c), int(s), (int(s),)) for s, c in enumerate(counts) if c]
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
            return lengths
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if lengths.max(initial=0) <= longest:
            return lengths
        counts = np.where(counts > 0, (counts >> 1) + 1, 0)


# --- reading ---------------------------------------------------------------------------------------


def _number(prefix: int, r: Reader) -> int:
    """A length or distance from its prefix symbol and the extra bits behind it."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.get(extra) + 1


def _read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, one for each pixel."""
    cache_bits = r.get(4) if r.get(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_bits, groups, n_groups = 0, None, 1
    if main and r.get(1):
        group_bits = r.get(3) + 2
        across = -(-width >> group_bits)
        groups = _read_pixels(r, across, -(-height >> group_bits), False) >> 8 & 0xFFFF
        n_groups = int(groups.max()) + 1
        groups = groups.tolist()
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [[read_code(r, n) for n in sizes] for _ in range(n_groups)]
    total = width * height
    out, cache, n = [0] * total, [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits
    across = -(-width >> group_bits) if group_bits else 0
    here = codes[0]
    while n < total:
        if groups is not None:
            y, x = divmod(n, width)
            here = codes[groups[(y >> group_bits) * across + (x >> group_bits)]]
        s = here[0].read(r)
        if s < 256:
            red, blue, alpha = here[1].read(r), here[2].read(r), here[3].read(r)
            out[n] = pixel = alpha << 24 | red << 16 | s << 8 | blue
            n += 1
            if cache_bits:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        elif s < 256 + LENGTH_CODES:
            length = _number(s - 256, r)
            far = _number(here[4].read(r), r)
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > n or n + length > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(length):
                out[n] = pixel = out[n - far]
                n += 1
                if cache_bits:
                    cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        else:
            out[n] = pixel = cache[s - 256 - LENGTH_CODES]
            n += 1
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        if r.at > len(r.bits):
            raise ValueError("the stream ends too early")
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) of A, R, G, B."""
    return argb.astype(">u4").view(np.uint8).reshape(-1, 4)


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view(">u4").ravel().astype(np.uint32)


def _predict(mode: int, left, top, corner, right) -> list[int]:
    """One pixel's prediction, as a list of four channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda x: min(255, max(0, x))
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode < 10:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        to_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner)]
    return [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner)]


def _predicted(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray, invert: bool) -> np.ndarray:
    """Adds predictions to residuals (invert) or takes them from pixels; both as (n, 4) channels."""
    given, n = pixels.tolist(), len(pixels)
    out = [[0] * 4 for _ in range(n)]
    known = out if invert else given
    across = -(-width >> bits)
    modes = modes.tolist()
    sign = 1 if invert else -1
    for i in range(n):
        y, x = divmod(i, width)
        if not i:
            guess = [255, 0, 0, 0]
        elif not y:
            guess = known[i - 1]
        elif not x:
            guess = known[i - width]
        else:
            guess = _predict(modes[(y >> bits) * across + (x >> bits)], known[i - 1], known[i - width], known[i - width - 1], known[i - width + 1])
        out[i] = [(a + sign * b) & 255 for a, b in zip(given[i], guess)]
    return np.array(out, np.uint8)


def _crossed(ch: np.ndarray, width: int, bits: int, elements: np.ndarray, invert: bool) -> np.ndarray:
    n = len(ch)
    y, x = np.divmod(np.arange(n), width)
    e = _channels(elements)[(y >> bits) * (-(-width >> bits)) + (x >> bits)].astype(np.int8).astype(np.int32)
    red_to_blue, green_to_blue, green_to_red = e[:, 1], e[:, 2], e[:, 3]
    green = ch[:, 2].astype(np.int8).astype(np.int32)
    out, sign = ch.astype(np.int32), 1 if invert else -1
    out[:, 1] = (out[:, 1] + sign * (green_to_red * green >> 5)) & 255
    red = (out if invert else ch)[:, 1].astype(np.uint8).astype(np.int8).astype(np.int32)
    out[:, 3] = (out[:, 3] + sign * ((green_to_blue * green >> 5) + (red_to_blue * red >> 5))) & 255
    return out.astype(np.uint8)


def _greened(ch: np.ndarray, sign: int) -> np.ndarray:
    out = ch.astype(np.int16)
    out[:, 1] += sign * out[:, 2]
    out[:, 3] += sign * out[:, 2]
    return (out & 255).astype(np.uint8)


def _packing(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _coloured(ch: np.ndarray, height: int, across: int, bits: int, data: np.ndarray) -> np.ndarray:
    """Colours of a palette by their indexes, several of which may be packed in one pixel."""
    index = ch[:, 2].reshape(height, -1)
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> (np.arange(1 << bits) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :across]
    table = np.zeros((256, 4), np.uint8)
    table[: len(data)] = data
    return table[index.ravel()]


def read_image(file: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: (height, width, 4) of R, G, B, A."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", file[16:20])[0]
    r = Reader(file[20 : 20 + size])
    if r.get(8) != 0x2F:
        raise ValueError("no signature")
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    steps, now = [], width
    while r.get(1):
        kind = r.get(2)
        if any(kind == k for k, *_ in steps):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.get(3) + 2
            steps.append((kind, now, bits, _read_pixels(r, -(-now >> bits), -(-height >> bits), False)))
        elif kind == PALETTE:
            n = r.get(8) + 1
            colours = np.cumsum(_channels(_read_pixels(r, n, 1, False)), axis=0, dtype=np.uint8)
            steps.append((kind, now, _packing(n), colours))
            now = -(-now >> _packing(n))
        else:
            steps.append((kind, now, 0, None))
    ch = _channels(_read_pixels(r, now, height, True))
    for kind, across, bits, data in reversed(steps):
        if kind == PREDICTOR:
            ch = _predicted(ch, across, bits, data >> 8 & 255, True)
        elif kind == CROSS_COLOUR:
            ch = _crossed(ch, across, bits, data, True)
        elif kind == SUBTRACT_GREEN:
            ch = _greened(ch, 1)
        else:
            ch = _coloured(ch, height, across, bits, data)
    return ch[:, [1, 2, 3, 0]].reshape(height, width, 4)


# --- writing ---------------------------------------------------------------------------------------


def _file(data: bytes) -> bytes:
    data_padded = data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data_padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data_padded


def _start(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    return w


def flat(pixels: np.ndarray) -> bytes:
    """A file whose symbols of each channel take as many bits as their number needs: (height, width, 4) of R, G, B, A."""
    height, width = pixels.shape[:2]
    w = _start(width, height)
    w.put(0, 3)  # no transform, no cache, one group
    columns = []
    for c, alphabet in ((1, 256 + LENGTH_CODES), (0, 256), (2, 256), (3, 256)):
        plane = pixels[:, :, c].ravel()
        present = np.bincount(plane, minlength=256) > 0
        k = (int(present.sum()) - 1).bit_length()
        spare = np.flatnonzero(~present)
        present[spare[: (1 << k) - int(present.sum())]] = True
        lengths = np.zeros(alphabet, np.int64)
        lengths[:256][present] = max(k, 1)
        write_code(w, lengths)
        rank = (np.cumsum(present) - 1).astype(np.uint8)[plane]
        columns += [rank >> i & 1 for i in range(k - 1, -1, -1)]
    write_code(w, np.zeros(DISTANCE_CODES, np.int64))
    w.many(np.column_stack(columns) if columns else np.zeros(0, np.uint8))
    return _file(w.bytes())


def _prefix(n: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and their value for a length or distance."""
    if n <= 4:
        return n - 1, 0, 0
    n -= 1
    high = n.bit_length() - 1
    second = n >> (high - 1) & 1
    extra = high - 1
    return 2 * high + second, extra, n & ((1 << extra) - 1)


def _write_pixels(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, back: bool = False, group_bits: int = 0) -> None:
    pixels = argb.tolist()
    w.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    height, groups, across = len(pixels) // width, None, 0
    if main:
        w.put(1 if group_bits else 0, 1)
        if group_bits:
            across = -(-width >> group_bits)
            groups = np.arange(across * -(-height >> group_bits)) % 3
            w.put(group_bits - 2, 3)
            _write_pixels(w, (groups << 8).astype(np.uint32), across, False)
            groups = groups.tolist()
    tokens, cache, seen, i = [], [None] * (1 << cache_bits), {}, 0
    slot = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(pixels):
        group = groups[(i // width >> group_bits) * across + (i % width >> group_bits)] if groups else 0
        length = 0
        if back and (j := seen.get(tuple(pixels[i : i + 3]))) is not None:
            while i + length < len(pixels) and length < 4096 and pixels[j + length] == pixels[i + length]:
                length += 1
        if length >= 3:
            far = i - j
            near = next((k + 1 for k, (dx, dy) in enumerate(NEAR) if max(1, dx + dy * width) == far), far + len(NEAR))
            tokens.append((group, "copy", length, near))
        elif cache_bits and cache[slot(pixels[i])] == pixels[i]:
            tokens.append((group, "cache", slot(pixels[i]), 0))
            length = 1
        else:
            tokens.append((group, "pixel", pixels[i], 0))
            length = 1
        for k in range(i, i + length):
            seen[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[slot(pixels[k])] = pixels[k]
        i += length
    n_groups = max(groups) + 1 if groups else 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(n_groups)]
    for g, kind, a, b in tokens:
        if kind == "pixel":
            for c, v in zip(counts[g], (a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                c[v] += 1
        elif kind == "cache":
            counts[g][0][256 + LENGTH_CODES + a] += 1
        else:
            counts[g][0][256 + _prefix(a)[0]] += 1
            counts[g][4][_prefix(b)[0]] += 1
    codes = [[write_code(w, huffman(c, 15)).codes() for c in group] for group in counts]
    for g, kind, a, b in tokens:
        here = codes[g]
        if kind == "pixel":
            for c, v in zip(here, (a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                w.code(*c[v])
        elif kind == "cache":
            w.code(*here[0][256 + LENGTH_CODES + a])
        else:
            for c, base, n in ((here[0], 256, a), (here[4], 0, b)):
                symbol, extra, value = _prefix(n)
                w.code(*c[base + symbol])
                w.put(value, extra)


def full(pixels: np.ndarray, transforms: tuple[int, ...] = (), bits: int = 2, mode: int = 11, cache_bits: int = 0, back: bool = True, group_bits: int = 0) -> bytes:
    """A file with prefix codes fitted to the image, back-references, a colour cache and any of the transforms.

    mode: the first block's predictor; the following blocks take the following ones.
    """
    height, width = pixels.shape[:2]
    w, now = _start(width, height), width
    ch = pixels.reshape(-1, 4)[:, [3, 0, 1, 2]]
    for kind in transforms:
        w.put(1 | kind << 1, 3)
        n = -(-now >> bits) * -(-height >> bits)
        if kind == PREDICTOR:
            modes = (np.arange(n) + mode) % 14
            w.put(bits - 2, 3)
            _write_pixels(w, (modes << 8 | 0xFF000000).astype(np.uint32), -(-now >> bits), False)
            ch = _predicted(ch, now, bits, modes, False)
        elif kind == CROSS_COLOUR:
            elements = (np.arange(n, dtype=np.uint32) * 0x050B17 + 0xFF21F305) | np.uint32(0xFF000000)
            w.put(bits - 2, 3)
            _write_pixels(w, elements, -(-now >> bits), False)
            ch = _crossed(ch, now, bits, elements, False)
        elif kind == SUBTRACT_GREEN:
            ch = _greened(ch, -1)
        else:
            colours, index = np.unique(_argb(ch), return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(colours) - 1, 8)
            table = _channels(colours)
            _write_pixels(w, _argb(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours), False)
            pack = _packing(len(colours))
            index = index.reshape(height, now)
            wide = np.zeros((height, -(-now >> pack) << pack), np.int64)
            wide[:, :now] = index
            now = -(-now >> pack)
            green = (wide.reshape(height, now, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2)
            ch = _channels((green.ravel() << 8 | 0xFF000000).astype(np.uint32))
    w.put(0, 1)
    _write_pixels(w, _argb(ch), now, True, cache_bits, back, group_bits)
    return _file(w.bytes())


# --- columns ---------------------------------------------------------------------------------------


def payload(text: bytes) -> bytes:
    """The bytes and then zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Payloads as lossless WebP files, one for each ``HIGHEST`` rows, one after another."""
    from cuboid.llm import webp_batch

    pictures, times = [], []
    for data in payloads:
        rows = np.frombuffer(data, np.uint8).reshape(-1, ROW, 4)
        parts = [rows[at : at + HIGHEST] for at in range(0, len(rows), HIGHEST)]
        pictures += parts
        times.append(len(parts))
    files, at, out = webp_batch.write_images(pictures)[0], 0, []
    for n in times:
        out.append(b"".join(files[at : at + n]))
        at += n
    return out


def store(data: bytes) -> bytes:
    return store_many([data])[0]


def load_many(stored: list[bytes]) -> list[np.ndarray]:
    """The pixels of all files of each stored form, row under row."""
    from cuboid.llm import webp_batch

    files, times = [], []
    for media in stored:
        at = n = 0
        while at < len(media):
            size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
            files.append(media[at : at + size])
            at += size
            n += 1
        times.append(n)
    images, at, out = webp_batch.read_images(files), 0, []
    for n in times:
        out.append(images[at] if n == 1 else np.concatenate(images[at : at + n]))
        at += n
    return out


def load(media: bytes) -> np.ndarray:
    return load_many([media])[0]


def feature(pixels: np.ndarray) -> str:
    """Height, then mean and deviation of each channel, then the entropy of all samples in bits."""
    flat_ = pixels.reshape(-1, 4)
    mean, dev = flat_.mean(axis=0, dtype=np.float64), flat_.std(axis=0, dtype=np.float64)
    share = np.bincount(flat_.ravel(), minlength=256) / flat_.size
    share = share[share > 0]
    numbers = [*mean.tolist(), *dev.tolist(), abs(float(-(share * np.log2(share)).sum()))]
    return f"{len(pixels)}:" + ",".join(f"{x:.3f}" for x in numbers)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: Bytes of payloads that are written and read together, one text at least.
_TOGETHER = 2 << 20


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + _TOGETHER, "right")))
            part, rows = batch.slice(low, high - low), []
            texts = [x.as_py() or b"" for x in part.column(1)]
            stored = store_many([payload(t) for t in texts])
            for text, media, pixels in zip(texts, stored, load_many(stored)):
                back = pixels.tobytes()
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)
            low = high


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document with digests of its stored form and of what is read back from it."""
    return common.texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_columns, SCHEMA)


def op10_webp(spark, sf_dir: str) -> DataFrame:
    return media_columns(common.table(spark, sf_dir, "documents"))
