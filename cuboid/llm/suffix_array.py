"""Suffix sorting in two stages, in numpy.

Suffixes smaller than their successors (here: rising) are sorted directly.  All others follow: going
through the first symbols in rising order, each suffix in place puts the one that starts one symbol
before it at the next free place of its own bucket, if that one isn't rising.  A bucket's scan is a
stable sort of predecessors by their symbol; runs of one symbol take a round for each of its length.
"""

from __future__ import annotations

import numpy as np

_WORD = 7


def _words(s: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position its next seven bytes and, last, how many of them its text has: numbers that sort as the strings do."""
    n = len(s)
    value = np.append(np.maximum(s - 1, 0), np.zeros(_WORD, s.dtype)).astype(np.uint64)
    out = value[:n].copy()
    for i in range(1, _WORD):
        out = out << np.uint64(8) | value[i : i + n]
    size = np.minimum(left, _WORD).astype(np.uint64)
    cut = (np.uint64(_WORD) - size) * np.uint64(8)
    return out >> cut << cut << np.uint64(8) | size


def _word(words: np.ndarray, at: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of the suffixes at these positions; 0 beyond a text's end."""
    if not k:
        return words[at]
    return np.where(left > k * _WORD, words[np.minimum(at + k * _WORD, len(words) - 1)], np.uint64(0))


def rising(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, before nothing, isn't."""
    n = len(s)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.append(s[:-1] != s[1:], True)
    # Each position looks at the next one where a symbol meets another one.
    following = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    up = np.append(s[:-1] < s[1:], False)
    return up[following]


def _direct(words: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` symbols, by position among equals: words are compared only where those before are equal."""
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for k in range(-(-depth // _WORD)):
        if not len(open_):
            break
        some = order[open_]
        word, held = _word(words, at[some], left[some], k), group[open_]
        new = np.lexsort((word, held)) if k else np.argsort(word, kind="stable")
        order[open_] = some[new]
        word = word[new]
        same = np.zeros(len(open_), bool)
        same[1:] = (word[1:] == word[:-1]) & (held[1:] == held[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(open_))))
        group[open_] = open_[first]
        many = same.copy()
        many[:-1] |= same[1:]
        open_ = open_[many]
    return at[order]


def suffix_array(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in rising order, their words, symbols left in its text) of all suffixes of the texts, in order at least by ``depth`` symbols.

    The texts stand one after another, each behind it a symbol 0; those of the texts are one more than their bytes.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    s = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 1
    ends = np.cumsum(lengths + 1) - 1
    s[ends] = 0
    left = np.repeat(ends, lengths + 1) - np.arange(len(s))
    up = rising(s)
    up[ends] = False
    seeds = np.flatnonzero(up)
    symbol_width = 257
    words = _words(s, left)
    seeds = _direct(words, seeds, left[seeds], depth)
    first = s[seeds]
    bounds = np.searchsorted(first, np.arange(symbol_width + 1))
    pending: list[list[np.ndarray]] = [[] for _ in range(symbol_width)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, symbol: int) -> np.ndarray:
        """Hands the predecessors to their buckets; those of the same bucket are returned."""
        before = found[found > 0] - 1
        before = before[~up[before] & (s[before] >= max(symbol, 1))]
        own = s[before]
        order = np.argsort(own, kind="stable")
        before, own = before[order], own[order]
        cuts = np.flatnonzero(np.diff(own)) + 1
        same = before[:0]
        for part in np.split(before, cuts):
            if len(part):
                if s[part[0]] == symbol:
                    same = part
                else:
                    pending[s[part[0]]].append(part)
        return same

    for symbol in range(symbol_width):
        if symbol == 0:
            falling = ends  # ends are smaller than all and have no successor of their text
            out.append(falling)
            induce(falling, 0)
        else:
            now = np.concatenate(pending[symbol]) if pending[symbol] else seeds[:0]
            pending[symbol] = []
            while len(now):
                out.append(now)
                now = induce(now, symbol)
        # Rising suffixes of this bucket are larger than its falling ones.
        own = seeds[bounds[symbol] : bounds[symbol + 1]]
        if len(own):
            out.append(own)
            induce(own, symbol)
    return np.concatenate(out), words, left


def common_prefixes(order: np.ndarray, words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix and the one before it in order share ``depth`` symbols of their texts."""
    out = np.zeros(len(order), bool)
    enough = left[order] >= depth
    at = np.flatnonzero(enough[1:] & enough[:-1]) + 1
    for low in range(0, depth, _WORD):
        if not len(at):
            break
        # A word that would pass the depth is taken further back: what it repeats is equal already.
        back = max(0, low + _WORD - depth)
        if back > low:
            cut = np.uint64(8 * (_WORD - depth + 1))
            same = words[order[at]] >> cut == words[order[at - 1]] >> cut
        else:
            same = words[order[at] + low - back] >> np.uint64(8) == words[order[at - 1] + low - back] >> np.uint64(8)
        at = at[same]
    out[at] = True
    return out
