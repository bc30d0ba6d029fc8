"""Sets of word shingles as 64-bit hashes, for whole Arrow columns at a time."""

import numpy as np

from sentilake.llm.bytehash import mix, parts, string_column, string_hashes

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(9, 14)]] = True


def word_ranges(data, offsets):
    """(text, start, end) of every word of every text."""
    inside = ~SPACES[data] if len(data) else np.zeros(0, dtype=bool)
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begin[1 : len(data)]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1 : len(data)]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, starts, ends


def words(data, offsets, lower=True):
    """(text, hash) of every word of every text."""
    if lower and len(data):
        capital = (data >= 65) & (data <= 90)
        data = np.where(capital, data + 32, data).astype(np.uint8)
    text, starts, ends = word_ranges(data, offsets)
    return text, string_hashes(data, starts, ends)


def shingle_sets(column, size, lower=True):
    """Sorted distinct hashes of each text's shingles of so many words; of all its words if it has fewer."""
    data, offsets = string_column(column)
    out = []
    for a, b in parts(offsets):
        out += _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size, lower)
    return out


def _sets(data, offsets, size, lower):
    text, h = words(data, offsets, lower)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(size - 1, -1, -1):
        rolled = mix(h[i : i + n] + rolled * np.uint64(3))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = np.array([b - a], dtype=np.uint64)
            for i in range(b - 1, a - 1, -1):
                one = mix(h[i : i + 1] + one * np.uint64(5))
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
