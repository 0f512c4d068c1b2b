"""Many lossless WebP files at once, in numpy.

Writing: each image takes the transform that makes its channels' entropy least (none, subtract-green, a
predictor, cross-colour or a palette); then pixels that repeat are copies found by hashed triples, recent
colours come from the colour cache, and all symbols get prefix codes fitted to the image.

Reading: files are lanes that go on side by side.  In each step every lane decodes one symbol of its own
stream: a pixel, a cached colour or a copy.  Code lengths are read alike, and predictors are undone alike.
Images with more than one group of prefix codes are left to the plain reader, symbol by symbol.
"""

from __future__ import annotations

import struct

import numpy as np

from cuboid.llm import webp
from cuboid.llm.webp import CACHE_FACTOR, CODE_LENGTH_ORDER, CROSS_COLOUR, DISTANCE_CODES, LENGTH_CODES, NEAR, PALETTE, PREDICTOR, SUBTRACT_GREEN

_LONGEST, _QUICK = 15, 10
_CACHE_BITS, _HITS = 8, 16
_BLOCK_BITS = 9
_U = np.uint64
#: Modes that the writer tries: the left pixel and the one above.
_LEFT, _ABOVE = 1, 2


def _reversal(width: int) -> np.ndarray:
    index, out = np.arange(1 << width), np.zeros(1 << width, np.int64)
    for i in range(width):
        out |= (index >> i & 1) << (width - 1 - i)
    return out


_REVERSED = {n: _reversal(n) for n in (7, _QUICK, _LONGEST)}


# --- prefix codes for many images ------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of complete prefix codes of at most ``longest`` bits, a row for each code: from the symbols' shares, and then the most frequent ones get what room is left."""
    used = counts > 0
    n = counts.sum(axis=1, keepdims=True)
    counts = np.where(used, np.maximum(counts, -(-n >> (longest - 1))), 0)
    n = counts.sum(axis=1, keepdims=True)
    out = np.where(used, np.maximum(np.ceil(np.log2(np.maximum(n, 1) / np.maximum(counts, 1))), 1), 0).astype(np.int64)
    many = used.sum(axis=1)
    room = np.where(many > 1, (1 << longest) - np.where(used, 1 << (longest - out), 0).sum(axis=1), 0)
    order = np.argsort(-counts, axis=1, kind="stable")
    rows = np.arange(len(counts))
    while (room > 0).any():
        open_ = np.flatnonzero(room > 0)
        for rank in range(int(many[open_].max())):
            symbol, own = order[open_, rank], rows[open_]
            length = out[own, symbol]
            gain = np.where(length > 1, 1 << (longest - np.maximum(length, 1)), 1 << 40)
            fits = gain <= room[open_]
            out[own, symbol] = length - fits
            room[open_] -= np.where(fits, gain, 0)
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by rank, start of each in a space of 15 bits); symbols without a code come last."""
    order = np.argsort(np.where(lengths > 0, lengths, 99).astype(np.int8), axis=1, kind="stable")[:, : max(1, int((lengths > 0).sum(axis=1).max(initial=0)))]
    own = np.take_along_axis(lengths, order, 1)
    weight = np.where(own > 0, 1 << (_LONGEST - own), 0)
    return order, np.cumsum(weight, axis=1) - weight


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code with its first bit lowest, bits) of each symbol; the only symbol of a code takes none."""
    order, start = _canonical(lengths)
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, _REVERSED[_LONGEST][np.minimum(start, (1 << _LONGEST) - 1)], 1)
    one = (lengths > 0).sum(axis=1, keepdims=True) == 1
    return np.where(one | (lengths == 0), 0, out), np.where(one, 0, lengths)


class _Tables:
    """Look-up of the next symbol for each lane: by its next bits, or by search for codes that are longer."""

    def __init__(self, lengths: np.ndarray, width: int) -> None:
        self.width, used = width, (lengths > 0).sum(axis=1)
        if (used == 0).any():
            lengths = lengths.copy()
            lengths[used == 0, 0] = 1
            used = np.maximum(used, 1)
        self.order, self.start = _canonical(lengths)
        own = np.take_along_axis(lengths, self.order, 1)
        self.lengths = np.where((used == 1)[:, None], 0, own)
        if (np.where(own > 0, 1 << (_LONGEST - own), 0).sum(axis=1)[used > 1] != 1 << _LONGEST).any():
            raise ValueError("not a complete prefix code")
        short = (own > 0) & (own <= width)
        times = np.where(short, 1 << np.maximum(width - own, 0), 0)
        times[used == 1] = 0
        times[used == 1, 0] = 1 << width
        values = np.where(short | (used == 1)[:, None], self.order << 4 | self.lengths, -1)
        times = np.concatenate([times, (1 << width) - times.sum(axis=1, keepdims=True)], axis=1)
        values = np.concatenate([values, np.full((len(values), 1), -1)], axis=1)
        self.table = np.repeat(values.ravel(), times.ravel()).reshape(len(lengths), 1 << width)[:, _REVERSED[width]].astype(np.int32).ravel()
        self.start = np.where(own > 0, self.start, 1 << 30)
        self.all_short = bool((own <= width).all())

    def read(self, lane: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, bits that it takes) for the lanes, given their next bits."""
        found = self.table[(lane << self.width) + (bits & _U((1 << self.width) - 1)).astype(np.int64)]
        if not self.all_short and (found < 0).any():
            at = np.flatnonzero(found < 0)
            value = _REVERSED[_LONGEST][(bits[at] & _U((1 << _LONGEST) - 1)).astype(np.int64)]
            rank = (self.start[lane[at]] <= value[:, None]).sum(axis=1) - 1
            found = found.copy()
            found[at] = self.order[lane[at], rank] << 4 | self.lengths[lane[at], rank]
        return found >> 4, found & 15


# --- writing ---------------------------------------------------------------------------------------


class _Bits:
    """Values of given numbers of bits, each at its bit offset in one buffer."""

    def __init__(self, size: int) -> None:
        self.words = np.zeros(size // 64 + 3, np.uint64)

    def put(self, at: np.ndarray, value: np.ndarray) -> None:
        value, shift = value.astype(np.uint64), (at & 63).astype(np.uint64)
        np.add.at(self.words, at >> 6, value << shift)
        np.add.at(self.words, (at >> 6) + 1, (value >> _U(1)) >> (_U(63) - shift))


def _before(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(_before(sizes), sizes)


def _prefixes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, numbers of extra bits and their values of lengths or distances."""
    m = np.maximum(n - 1, 1)
    high = np.frexp(m.astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(n <= 4, 0, high - 1)
    symbol = np.where(n <= 4, n - 1, 2 * high + (m >> np.maximum(high - 1, 0) & 1))
    return symbol, extra, np.where(n <= 4, 0, m & ((1 << np.maximum(extra, 0)) - 1))


class _Images:
    """Entropy-coded images one after another: their pixels (ARGB), widths, whether they are a file's main one, and the bits that stand before them."""

    def __init__(self, pixels: list[np.ndarray], widths: list[int], main: list[bool], before: list[tuple[int, int]]) -> None:
        self.sizes = np.array([len(p) for p in pixels], np.int64)
        self.pixels = np.concatenate(pixels).astype(np.uint32)
        self.widths, self.main = np.array(widths, np.int64), np.array(main)
        self.before = before
        self.first = _before(self.sizes)
        self.image = np.repeat(np.arange(len(pixels)), self.sizes)

    def _copies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, distance) of copies: repeated triples, as long as they go on, the first one that fits at each place."""
        p, n = self.pixels.astype(np.uint64), len(self.pixels)
        none = np.zeros(0, np.int64)
        if n < 6:
            return none, none, none
        key = (p[:-2] * _U(0x9E3779B97F4A7C15) + p[1:-1] * _U(0xC2B2AE3D27D4EB4F) + p[2:] * _U(0x165667B19E3779F9) + self.image[:-2].astype(np.uint64) * _U(0xD6E8FEB86659FD93)) >> _U(16)
        order = np.argsort(key, kind="stable")
        twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        at, back = order[twin + 1], order[twin]
        good = (self.image[at + 2] == self.image[back]) & (self.image[at] == self.image[back])
        for k in range(3):
            good &= p[at + k] == p[back + k]
        at, back = at[good], back[good]
        if not len(at):
            return none, none, none
        by = np.argsort(at)
        at, far = at[by], (at - back)[by]
        goes_on = np.append((at[1:] == at[:-1] + 1) & (far[1:] == far[:-1]) & (self.image[at[1:]] == self.image[at[:-1]]), False)
        ends = np.flatnonzero(~goes_on)
        length = np.minimum(at[ends[np.searchsorted(ends, np.arange(len(at)))]] - at + 3, 4096)
        # One after another: a copy starts behind the one before it.
        chosen, place, following = [], 0, np.searchsorted(at, at + length).tolist()
        while place < len(following):
            chosen.append(place)
            place = following[place]
        c = np.array(chosen)
        return at[c], length[c], far[c]

    def _cached(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether the slot holds the pixel's colour when its turn comes) for every pixel."""
        slot = ((self.pixels.astype(np.uint64) * _U(CACHE_FACTOR) & _U(0xFFFFFFFF)) >> _U(32 - _CACHE_BITS)).astype(np.int64)
        order = np.argsort(self.image << _CACHE_BITS | slot, kind="stable")
        key, colour = (self.image << _CACHE_BITS | slot)[order], self.pixels[order]
        hit = np.zeros(len(order), bool)
        hit[order[1:]] = (key[1:] == key[:-1]) & (colour[1:] == colour[:-1])
        return slot, hit

    def write(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, bit at which each image starts, bits of each): images start where the one before ends, those of a new file at a word."""
        m, n = len(self.sizes), len(self.pixels)
        start, length, far = self._copies()
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, start, 1)
        np.add.at(covered, start + length, -1)
        token = np.cumsum(covered[:-1]) == 0
        slot, hit = self._cached()
        hits = np.bincount(self.image[token & hit], minlength=m)
        cached = (hits >= _HITS) & self.main
        from_cache = token & hit & cached[self.image]
        literal = token & ~from_cache
        # Symbols.
        ch = [(self.pixels >> s & 255).astype(np.int64) for s in (8, 16, 0, 24)]
        alphabet = 256 + LENGTH_CODES + (1 << _CACHE_BITS)
        green = np.where(from_cache, 256 + LENGTH_CODES + slot, ch[0])
        size_symbol, size_extra, size_value = _prefixes(length)
        width = self.widths[self.image[start]]
        far_symbol, far_extra, far_value = _prefixes(_distance_codes(far, width))
        green[start] = 256 + size_symbol
        is_copy = np.zeros(n, bool)
        is_copy[start] = True
        spoken = token | is_copy
        counts = [np.bincount(self.image[spoken] * alphabet + green[spoken], minlength=m * alphabet).reshape(m, alphabet)]
        for c in ch[1:]:
            counts.append(np.bincount(self.image[literal] * 256 + c[literal], minlength=m * 256).reshape(m, 256))
        counts.append(np.bincount(self.image[start] * DISTANCE_CODES + far_symbol, minlength=m * DISTANCE_CODES).reshape(m, DISTANCE_CODES))
        lengths = [code_lengths(c, _LONGEST) for c in counts]
        codes = [_codes(x) for x in lengths]
        # Bits of each pixel's token.
        at = np.flatnonzero(spoken)
        own = self.image[at]
        value, bits = codes[0][0][own, green[at]].astype(np.uint64), codes[0][1][own, green[at]]
        said = literal[at]
        for (code, size), c in zip(codes[1:4], ch[1:]):
            more, k = np.where(said, code[own, c[at]], 0), np.where(said, size[own, c[at]], 0)
            value |= more.astype(np.uint64) << bits.astype(np.uint64)
            bits = bits + k
        copy = np.flatnonzero(is_copy[at])
        for code, size in ((size_value, size_extra), (codes[4][0][own[copy], far_symbol], codes[4][1][own[copy], far_symbol]), (far_value, far_extra)):
            value[copy] |= code.astype(np.uint64) << bits[copy].astype(np.uint64)
            bits[copy] += size
        head_image, head_value, head_bits = self._heads(lengths, cached)
        head = np.bincount(head_image, head_bits, minlength=m).astype(np.int64)
        body = np.bincount(own, bits, minlength=m).astype(np.int64)
        total = head + body
        # A main image is its file's last one.
        new = np.append(True, self.main[:-1])
        begin, place = np.zeros(m, np.int64), 0
        for i, (fresh, k) in enumerate(zip(new.tolist(), total.tolist())):
            if fresh:
                place = -(-place // 64) * 64
            begin[i] = place
            place += k
        out = _Bits(place)
        low = _before(head_bits)
        low -= np.repeat(low[np.searchsorted(head_image, np.arange(m))], np.bincount(head_image, minlength=m))
        out.put(begin[head_image] + low, head_value)
        low = _before(bits)
        per = np.bincount(own, minlength=m)
        low -= np.repeat(low[np.searchsorted(own, np.arange(m))], per)
        out.put((begin + head)[own] + low, value)
        return out.words, begin, total

    def _heads(self, lengths: list[np.ndarray], cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(image, value, bits) of all that stands before the pixels, in order."""
        m = len(self.sizes)
        codes = [_code_headers(x if k else x[:, : 256 + LENGTH_CODES], None if k else (x, cached)) for k, x in enumerate(lengths)]
        start = [(v, b) for v, b in self.before]
        flags = np.where(cached, 1 | _CACHE_BITS << 1, 0)
        flag_bits = np.where(cached, 5, 1) + self.main  # one group of codes
        image = [np.repeat(np.arange(m), 2), *(c[0] for c in codes)]
        value = [np.column_stack([[v for v, _ in start], flags]).ravel(), *(c[1] for c in codes)]
        bits = [np.column_stack([[b for _, b in start], flag_bits]).ravel(), *(c[2] for c in codes)]
        image = np.concatenate(image)
        order = np.argsort(image, kind="stable")
        return image[order], np.concatenate([v.astype(np.uint64) for v in value])[order], np.concatenate(bits)[order]


def _distance_codes(far: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Codes of distances: those of near pixels have short ones, by the width of the image."""
    out = far + len(NEAR)
    for w in np.unique(width).tolist():
        near: dict[int, int] = {}
        for k, (dx, dy) in enumerate(NEAR):
            near.setdefault(max(1, dx + dy * w), k + 1)
        table = np.zeros(max(near) + 1, np.int64)
        table[list(near)] = list(near.values())
        at = np.flatnonzero((width == w) & (far < len(table)))
        short = table[far[at]]
        out[at[short > 0]] = short[short > 0]
    return out


def _code_headers(lengths: np.ndarray, green: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) that tell the codes of all rows.  ``green``: that alphabet with cache symbols, and the rows that have them."""
    whole, wide = (lengths, np.zeros(len(lengths), bool)) if green is None else green
    used = (whole > 0).sum(axis=1)
    first = np.argmax(whole > 0, axis=1)
    last = whole.shape[1] - 1 - np.argmax(whole[:, ::-1] > 0, axis=1)
    simple = (used <= 2) & ((used == 0) | (last < 256))
    rows = np.flatnonzero(simple)
    two = used[rows] == 2
    s0 = np.where(used[rows] > 0, first[rows], 0)
    out = [(rows, np.where(two, 7, 5) | s0 << 3 | np.where(two, last[rows], 0) << 11, np.where(two, 19, 11))]
    rows = np.flatnonzero(~simple)
    if len(rows):
        size = np.where(wide[rows], whole.shape[1], lengths.shape[1])
        flat = whole[rows][np.arange(whole.shape[1]) < size[:, None]]
        row = np.repeat(np.arange(len(rows)), size)
        zero = flat == 0
        begins = np.append(True, (row[1:] != row[:-1]) | ~zero[1:] | ~zero[:-1])
        at = np.flatnonzero(begins)
        run, own = np.diff(np.append(at, len(flat))), row[at]
        length = flat[at]
        blank = length == 0
        most, rest = np.where(blank, run // 138, 0), run % 138
        times = np.where(blank, most + np.where(rest >= 3, 1, rest), 1)
        which = np.repeat(np.arange(len(at)), times)
        more = _within(times) >= most[which]
        rest = rest[which]
        symbol = np.where(~blank[which], length[which], np.where(~more | (rest >= 11), 18, np.where(rest >= 3, 17, 0)))
        extra = np.where(symbol == 18, np.where(more, rest - 11, 127), np.where(symbol == 17, rest - 3, 0))
        own = own[which]
        by = code_lengths(np.bincount(own * 19 + symbol, minlength=len(rows) * 19).reshape(len(rows), 19), 7)
        code, bits = _codes(by)
        inorder = by[:, CODE_LENGTH_ORDER]
        told = np.maximum(4, 19 - np.argmax(inorder[:, ::-1] > 0, axis=1))
        packed = (inorder << (3 * np.arange(19))).sum(axis=1)
        out += [(rows, (told - 4) << 1, np.full(len(rows), 5)), (rows, packed, 3 * told + 1)]  # the last bit: all symbols are told
        out.append((rows[own], code[own, symbol] | extra << bits[own, symbol], bits[own, symbol] + np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))))
    row = np.concatenate([x[0] for x in out])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([x[1] for x in out])[order], np.concatenate([x[2] for x in out])[order]


def _entropy(ch: np.ndarray, image: np.ndarray, m: int) -> np.ndarray:
    """Bits that each image's channels take by their own shares of values."""
    out = np.zeros(m)
    n = np.maximum(np.bincount(image, minlength=m), 1)
    for c in range(4):
        counts = np.bincount(image * 256 + ch[:, c], minlength=m * 256).reshape(m, 256)
        out += n * np.log2(n) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)
    return out


def _multipliers(ch: np.ndarray, image: np.ndarray, m: int, on: int) -> np.ndarray:
    """For each image how a channel (1 red, 3 blue) follows green, in 32ths: a regression on signed bytes."""
    x, y = ch[:, 2].astype(np.int8).astype(np.float64), ch[:, on].astype(np.int8).astype(np.float64)
    n = np.maximum(np.bincount(image, minlength=m), 1)
    mean = lambda v: np.bincount(image, v, minlength=m) / n
    slope = (mean(x * y) - mean(x) * mean(y)) / np.maximum(mean(x * x) - mean(x) ** 2, 1e-9)
    return np.clip(np.rint(32 * slope), -127, 127).astype(np.int64)


def write_images(pictures: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """(files, kind of transform of each, -1 for none) of images: (height, width, 4) of R, G, B, A."""
    m = len(pictures)
    if not m:
        return [], np.zeros(0, np.int64)
    heights, widths = (np.array([p.shape[k] for p in pictures], np.int64) for k in (0, 1))
    sizes = heights * widths
    ch = np.concatenate([p.reshape(-1, 4) for p in pictures])[:, [3, 0, 1, 2]]
    image, first = np.repeat(np.arange(m), sizes), _before(sizes)
    place = _within(sizes)
    y, x = np.divmod(place, widths[image])
    argb = webp._argb(ch)
    # What each transform would leave.
    at = np.arange(len(ch))
    guess = lambda source: np.where((place > 0)[:, None], ch[np.maximum(source, 0)], np.array([255, 0, 0, 0], np.uint8))
    left, above = np.where(x > 0, at - 1, at - widths[image]), np.where(y > 0, at - widths[image], at - 1)
    to_red, to_blue = _multipliers(ch, image, m, 1), _multipliers(ch, image, m, 3)
    signed = ch[:, 2].astype(np.int8).astype(np.int64)
    crossed = ch.copy()
    crossed[:, 1] -= (to_red[image] * signed >> 5).astype(np.uint8)
    crossed[:, 3] -= (to_blue[image] * signed >> 5).astype(np.uint8)
    left_, above_ = ch - guess(left), ch - guess(above)
    ways = [(-1, ch, 0), (SUBTRACT_GREEN, webp._greened(ch, -1), 3), (PREDICTOR, left_, 64), (PREDICTOR, above_, 64), (CROSS_COLOUR, crossed, 64)]
    cost = np.array([_entropy(c, image, m) + more for _, c, more in ways])
    # Palettes: by the number of colours, and their shares.
    key = image.astype(np.uint64) << _U(32) | argb.astype(np.uint64)
    colours, index, times = np.unique(key, return_inverse=True, return_counts=True)
    owner = (colours >> _U(32)).astype(np.int64)
    n_colours = np.bincount(owner, minlength=m)
    palette = sizes * np.log2(np.maximum(sizes, 1)) - np.bincount(owner, times * np.log2(times), minlength=m) + 26.0 * n_colours + 11
    cost = np.vstack([cost, np.where(n_colours <= 256, palette, np.inf)])
    best = cost.argmin(axis=0)
    kinds = np.array([-1, SUBTRACT_GREEN, PREDICTOR, PREDICTOR, CROSS_COLOUR, PALETTE])[best]
    out = np.zeros_like(ch)
    for k, (_, c, _) in enumerate(ways):
        chosen = best[image] == k
        out[chosen] = c[chosen]
    out = webp._argb(out)
    low = _before(n_colours)
    pixels, across, main, before = [], [], [], []
    for i in range(m):
        w, h, kind = int(widths[i]), int(heights[i]), int(kinds[i])
        head, bits = 0x2F | (w - 1) << 8 | (h - 1) << 22 | 1 << 36, 40
        own = out[first[i] : first[i] + sizes[i]]
        if kind >= 0:
            head, bits = head | (1 | kind << 1) << bits, bits + 3
        if kind in (PREDICTOR, CROSS_COLOUR):
            blocks = -(-w >> _BLOCK_BITS), -(-h >> _BLOCK_BITS)
            if kind == PREDICTOR:
                element = 0xFF000000 | (_LEFT if best[i] == 2 else _ABOVE) << 8
            else:
                element = 0xFF000000 | (int(to_blue[i]) & 255) << 8 | int(to_red[i]) & 255
            pixels.append(np.full(blocks[0] * blocks[1], element, np.uint32))
            across.append(blocks[0])
            main.append(False)
            before.append((head | (_BLOCK_BITS - 2) << bits, bits + 3))
            head, bits = 0, 0
        elif kind == PALETTE:
            n = int(n_colours[i])
            table = webp._channels(colours[low[i] : low[i] + n].astype(np.uint32))
            pixels.append(webp._argb(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))))
            across.append(n)
            main.append(False)
            before.append((head | (n - 1) << bits, bits + 8))
            head, bits = 0, 0
            pack = webp._packing(n)
            wide = np.zeros((h, -(-w >> pack) << pack), np.int64)
            wide[:, :w] = (index[first[i] : first[i] + sizes[i]] - low[i]).reshape(h, w)
            w = -(-w >> pack)
            packed = (wide.reshape(h, w, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2)
            own = (packed.ravel() << 8 | 0xFF000000).astype(np.uint32)
        pixels.append(own)
        across.append(w)
        main.append(True)
        before.append((head, bits + 1))
    words, begin, total = _Images(pixels, across, main, before).write()
    data, files, start = words.tobytes(), [], 0
    for i in np.flatnonzero(main).tolist():
        files.append(webp._file(data[int(begin[start]) // 8 : int(begin[i] + total[i] + 7) // 8]))
        start = i + 1
    return files, kinds


# --- reading ---------------------------------------------------------------------------------------


class _Streams:
    """Bits of many streams in one buffer."""

    def __init__(self, parts: list[bytes]) -> None:
        sizes = np.array([len(p) for p in parts], np.int64)
        self.data = b"".join(parts) + bytes(16)
        self.first = _before(sizes) * 8
        self.end = self.first + sizes * 8
        raw = np.frombuffer(self.data, np.uint8)
        # Eight bytes from each place on.
        self.words = np.lib.stride_tricks.sliding_window_view(raw, 8)[:, :].copy().view("<u8").ravel()

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next bits from each place, 57 at least."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (at & 7).astype(np.uint64)

    def get(self, at: int, n: int) -> int:
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)) & ((1 << n) - 1)


def _low(bits: np.ndarray, n: int) -> np.ndarray:
    return (bits & _U((1 << n) - 1)).astype(np.int64)


def _read_codes(s: _Streams, at: np.ndarray, alphabet: np.ndarray) -> _Tables:
    """The next prefix code of each lane; ``at`` moves behind it."""
    lengths = np.zeros((len(at), int(alphabet.max())), np.int64)
    bits = s.peek(at)
    simple = _low(bits, 1) == 1
    i = np.flatnonzero(simple)
    if len(i):
        b = bits[i]
        two, wide = _low(b >> _U(1), 1), _low(b >> _U(2), 1)
        s0 = np.where(wide == 1, _low(b >> _U(3), 8), _low(b >> _U(3), 1))
        behind = np.where(wide == 1, 11, 4)
        s1 = _low(b >> behind.astype(np.uint64), 8)
        if (s0 >= alphabet[i]).any() or (s1 >= alphabet[i])[two == 1].any():
            raise ValueError("a symbol outside its alphabet")
        lengths[i, s0] = 1
        lengths[i[two == 1], s1[two == 1]] = 1
        at[i] += behind + 8 * two
    i = np.flatnonzero(~simple)
    if len(i):
        told = 4 + _low(bits[i] >> _U(1), 4)
        at[i] += 5
        first, by = s.peek(at[i]), np.zeros((len(i), 19), np.int64)
        for k, symbol in enumerate(CODE_LENGTH_ORDER):
            by[:, symbol] = np.where(k < told, _low(first >> _U(3 * k) if k < 18 else s.peek(at[i] + 54), 3), 0)
        at[i] += 3 * told
        tables = _Tables(by, 7)
        bits = s.peek(at[i])
        some = _low(bits, 1) == 1
        n = 2 + 2 * _low(bits >> _U(1), 3)
        limit = np.where(some, 2 + (bits >> _U(4) & ((_U(1) << n.astype(np.uint64)) - _U(1))).astype(np.int64), alphabet[i])
        at[i] += np.where(some, 4 + n, 1)
        lane, place, last = np.arange(len(i)), np.zeros(len(i), np.int64), np.full(len(i), 8)
        where, size = at[i], alphabet[i]
        while len(lane):
            bits = s.peek(where[lane])
            symbol, took = tables.read(lane, bits)
            rest = bits >> took.astype(np.uint64)
            repeat = symbol >= 16
            extra = np.where(repeat, np.array([2, 3, 7])[np.maximum(symbol - 16, 0)], 0)
            times = np.where(repeat, np.array([3, 3, 11])[np.maximum(symbol - 16, 0)] + (rest & ((_U(1) << extra.astype(np.uint64)) - _U(1))).astype(np.int64), 1)
            value = np.where(symbol == 16, last[lane], np.where(repeat, 0, symbol))
            if (place[lane] + times > size[lane]).any():
                raise ValueError("too many code lengths")
            filled = np.flatnonzero(value > 0)
            own = np.repeat(lane[filled], times[filled])
            lengths[i[own], np.repeat(place[lane[filled]], times[filled]) + _within(times[filled])] = np.repeat(value[filled], times[filled])
            last[lane] = np.where(repeat | (symbol == 0), last[lane], symbol)
            where[lane] += took + extra
            place[lane] += times
            limit[lane] -= 1
            lane = lane[(place[lane] < size[lane]) & (limit[lane] > 0)]
        at[i] = where
    return _Tables(lengths, _QUICK)


def _numbers(prefix: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols and the bits behind them, and the number of those."""
    extra = np.maximum((prefix - 2) >> 1, 0)
    more = (bits & ((_U(1) << extra.astype(np.uint64)) - _U(1))).astype(np.int64)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), np.where(prefix < 4, 0, extra)


def _decode(s: _Streams, at: np.ndarray, end: np.ndarray, widths: np.ndarray, heights: np.ndarray, main: bool) -> list[np.ndarray]:
    """The pixels of one entropy-coded image of each lane; ``at`` moves behind them."""
    n_lanes = len(at)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n_lanes
    bits = s.peek(at)
    flag = _low(bits, 1)
    cache_bits = np.where(flag == 1, _low(bits >> _U(1), 4), 0)
    if (cache_bits > 11).any():
        raise ValueError("the colour cache is too large")
    behind = at + np.where(flag == 1, 5, 1)
    lanes = np.arange(n_lanes)
    if main:
        grouped = np.flatnonzero(_low(s.peek(behind), 1) == 1)
        for i in grouped.tolist():
            r = webp.Reader(s.data[: int(end[i] + 7) // 8])
            r.at = int(at[i])
            out[i] = webp._read_pixels(r, int(widths[i]), int(heights[i]), True)
            at[i] = r.at
        behind = behind + 1
        lanes = np.setdiff1d(lanes, grouped)
    if not len(lanes):
        return out
    pos, width, cb = behind[lanes], widths[lanes], cache_bits[lanes]
    total = width * heights[lanes]
    base = _before(total)
    green_size = 256 + LENGTH_CODES + np.where(cb > 0, 1 << cb, 0)
    fixed = lambda n: np.full(len(lanes), n)
    tables = [_read_codes(s, pos, size) for size in (green_size, fixed(256), fixed(256), fixed(256), fixed(DISTANCE_CODES))]
    pixels = np.zeros(int(total.sum()), np.uint32)
    slots = 1 << int(cb.max())
    cache = np.zeros(len(lanes) * slots, np.uint32)
    shift = (32 - cb).astype(np.uint64)
    near = np.array(NEAR, np.int64)
    done, live = np.zeros(len(lanes), np.int64), np.flatnonzero(total > 0)
    any_cache = bool((cb > 0).any())

    def remember(lane: np.ndarray, colour: np.ndarray) -> None:
        if any_cache:  # of equal slots the last one stays
            slot = ((colour.astype(np.uint64) * _U(CACHE_FACTOR) & _U(0xFFFFFFFF)) >> shift[lane]).astype(np.int64)
            cache[lane * slots + slot] = colour

    while len(live):
        where = pos[live]
        bits = s.peek(where)
        symbol, took = tables[0].read(live, bits)
        where += took
        step = np.ones(len(live), np.int64)
        lit = np.flatnonzero(symbol < 256)
        if len(lit):
            own = live if len(lit) == len(live) else live[lit]
            place = where[lit]
            colour = symbol[lit].astype(np.uint32) << np.uint32(8)
            bits = bits[lit] >> took[lit].astype(np.uint64)
            for k, to in ((1, 16), (2, 0), (3, 24)):
                if k == 3:  # three codes of 15 bits are in what was peeked, not four
                    bits = s.peek(place)
                value, size = tables[k].read(own, bits)
                colour |= value.astype(np.uint32) << np.uint32(to)
                place += size
                bits = bits >> size.astype(np.uint64)
            where[lit] = place
            pixels[base[own] + done[own]] = colour
            remember(own, colour)
        if len(lit) < len(live):
            kept = np.flatnonzero(symbol >= 256 + LENGTH_CODES)
            if len(kept):
                own = live[kept]
                colour = cache[own * slots + symbol[kept] - 256 - LENGTH_CODES]
                pixels[base[own] + done[own]] = colour
                remember(own, colour)
            copy = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_CODES))
            if len(copy):
                own, place = live[copy], where[copy]
                length, extra = _numbers(symbol[copy] - 256, s.peek(place))
                place += extra
                bits = s.peek(place)
                prefix, size = tables[4].read(own, bits)
                far, extra = _numbers(prefix, bits >> size.astype(np.uint64))
                where[copy] = place + size + extra
                short = far <= len(NEAR)
                dx, dy = near[np.minimum(far, len(NEAR)) - 1].T
                far = np.where(short, np.maximum(1, dx + dy * width[own]), far - len(NEAR))
                if (far > done[own]).any() or (done[own] + length > total[own]).any():
                    raise ValueError("a back-reference outside the image")
                k = _within(length)
                target = np.repeat(base[own] + done[own], length)
                far_ = np.repeat(far, length)
                colour = pixels[target - far_ + k % far_]
                pixels[target + k] = colour
                remember(np.repeat(own, length), colour)
                step[copy] = length
        pos[live] = where
        done[live] += step
        live = live[done[live] < total[live]]
    if (pos > end[lanes]).any():
        raise ValueError("the stream ends too early")
    at[lanes] = pos
    for i, a, n in zip(lanes.tolist(), base.tolist(), total.tolist()):
        out[i] = pixels[a : a + n]
    return out


def _unpredicted(residuals: list[np.ndarray], widths: list[int], bits: list[int], modes: list[np.ndarray]) -> list[np.ndarray]:
    """Adds predictions to residuals, pixel by pixel in all images side by side; (n, 4) channels."""
    sizes = np.array([len(r) for r in residuals])
    width, base = np.array(widths), _before(sizes)
    flat = np.concatenate(residuals).astype(np.int32)
    own = np.repeat(np.arange(len(sizes)), sizes)
    y, x = np.divmod(_within(sizes), width[own])
    block = np.array(bits)
    first = _before(np.array([len(m) for m in modes]))
    across = -(-width >> block)
    mode = np.concatenate(modes)[first[own] + (y >> block[own]) * across[own] + (x >> block[own])]
    mode = np.where(y == 0, 1, np.where(x == 0, 2, np.where(mode > 13, 0, mode)))
    half = lambda a, b: (a + b) >> 1
    live = np.arange(len(sizes))
    for k in range(int(sizes.max())):
        live = live[sizes[live] > k]
        at = base[live] + k
        if not k:
            guess = np.tile(np.array([255, 0, 0, 0], np.int32), (len(at), 1))
        else:
            m, w = mode[at], width[live]
            left, top = flat[at - 1], flat[np.maximum(at - w, 0)]
            guess = np.where((m == 2)[:, None], top, left)
            other = np.flatnonzero((m != 1) & (m != 2))
            if len(other):
                left, top, m = left[other], top[other], m[other][:, None]
                corner, right = flat[np.maximum((at - w)[other] - 1, 0)], flat[np.maximum((at - w)[other] + 1, 0)]
                to_left = np.abs(top - corner).sum(axis=1, keepdims=True)
                to_top = np.abs(left - corner).sum(axis=1, keepdims=True)
                mean = half(left, top)
                change = mean - corner
                ways = [
                    np.broadcast_to(np.array([255, 0, 0, 0], np.int32), left.shape), left, top, right, corner,
                    half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right),
                    half(half(left, corner), half(top, right)), np.where(to_left < to_top, left, top),
                    np.clip(left + top - corner, 0, 255), np.clip(mean + np.sign(change) * (np.abs(change) >> 1), 0, 255),
                ]
                guess[other] = np.choose(m, ways)
        flat[at] = (flat[at] + guess) & 255
    return [flat[a : a + n].astype(np.uint8) for a, n in zip(base.tolist(), sizes.tolist())]


def read_images(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files: (height, width, 4) of R, G, B, A each."""
    if not files:
        return []
    parts = []
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size = struct.unpack("<I", f[16:20])[0]
        parts.append(f[20 : 20 + size])
        if len(parts[-1]) < 5 or parts[-1][0] != 0x2F:
            raise ValueError("no signature")
    s, m = _Streams(parts), len(parts)
    at, widths, heights = s.first.copy(), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i in range(m):
        head = s.get(int(at[i]) + 8, 32)
        if head >> 29:
            raise ValueError("unknown version")
        widths[i], heights[i] = (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1
    at += 40
    now = widths.copy()
    steps: list[list[tuple]] = [[] for _ in range(m)]
    open_ = list(range(m))
    while open_:
        wanted = []
        for i in open_:
            while True:
                b = s.get(int(at[i]), 14)
                if not b & 1:
                    at[i] += 1
                    break
                kind = b >> 1 & 3
                if any(kind == k for k, *_ in steps[i]):
                    raise ValueError("a transform stands twice")
                if kind == SUBTRACT_GREEN:
                    at[i] += 3
                    steps[i].append((kind, int(now[i]), 0, None))
                    continue
                if kind == PALETTE:
                    at[i] += 11
                    wanted.append((i, kind, (b >> 3 & 255) + 1, 1, 0))
                else:
                    at[i] += 6
                    bits = (b >> 3 & 7) + 2
                    wanted.append((i, kind, -(-int(now[i]) >> bits), -(-int(heights[i]) >> bits), bits))
                break
        open_ = [w[0] for w in wanted]
        if wanted:
            where = at[open_]
            found = _decode(s, where, s.end[open_], np.array([w[2] for w in wanted]), np.array([w[3] for w in wanted]), False)
            at[open_] = where
            for (i, kind, n, _, bits), data in zip(wanted, found):
                if kind == PALETTE:
                    steps[i].append((kind, int(now[i]), webp._packing(n), np.cumsum(webp._channels(data), axis=0, dtype=np.uint8)))
                    now[i] = -(-now[i] >> webp._packing(n))
                else:
                    steps[i].append((kind, int(now[i]), bits, data))
    channels = [webp._channels(p) for p in _decode(s, at, s.end, now, heights, True)]
    # The last transform is undone first; predictors that are next go together.
    while any(steps):
        due = [i for i in range(m) if steps[i] and steps[i][-1][0] == PREDICTOR]
        if due:
            args = [steps[i].pop() for i in due]
            done = _unpredicted([channels[i] for i in due], [a[1] for a in args], [a[2] for a in args], [(a[3] >> 8 & 255).astype(np.int64) for a in args])
            for i, ch in zip(due, done):
                channels[i] = ch
        for i in range(m):
            while steps[i] and steps[i][-1][0] != PREDICTOR:
                kind, across, bits, data = steps[i].pop()
                if kind == CROSS_COLOUR:
                    channels[i] = webp._crossed(channels[i], across, bits, data, True)
                elif kind == SUBTRACT_GREEN:
                    channels[i] = webp._greened(channels[i], 1)
                else:
                    channels[i] = webp._coloured(channels[i], int(heights[i]), across, bits, data)
    return [c[:, [1, 2, 3, 0]].reshape(h, w, 4) for c, h, w in zip(channels, heights.tolist(), widths.tolist())]
