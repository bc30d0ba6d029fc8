"""Minimal perfect hashing of 64-bit keys: n keys to 0..n-1, at some four bits a key, whole arrays at a time.

Keys are hashed into a bit array of ``GAMMA`` places a key; those alone at their place are done, the others go on to the next
level. A key's number is how many bits are set before its own, over all levels. What is left after ``LEVELS`` is kept sorted.
"""

import numpy as np

from sentilake.llm.bytehash import mix

GAMMA = 2
LEVELS = 24


def _places(keys, level, size):
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return mix(keys.astype(np.uint64) ^ seed) % np.uint64(size)


def bucket_of(keys, buckets):
    """Which of so many buckets a key belongs to; unlike its place in any level."""
    return _places(keys, LEVELS, buckets).astype(np.int64)


class PerfectHash:
    def __init__(self, keys):
        """keys: distinct, as int64 or uint64."""
        left, self.levels, done = np.asarray(keys), [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-GAMMA * len(left) // 64) * 64
            at = _places(left, level, size).astype(np.int64)
            met = np.bincount(at, minlength=size)
            alone = met == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            before = done + np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))[:-1]
            self.levels.append((size, words, before.astype(np.int32 if done + size < 2**31 else np.int64)))
            done += int(alone.sum())
            left = left[~alone[at]]
        self.rest, self.first = np.sort(left), done
        self.n = done + len(left)

    def index(self, keys):
        """Number of each key; any number of 0..n-1 for a key that was not there."""
        out = np.zeros(len(keys), dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            at = _places(keys[open_], level, size)
            word = (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            value = words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value & ((np.uint64(1) << bit) - np.uint64(1))
            number = before[word].astype(np.int64) + np.bitwise_count(below)
            out[open_[hit]] = number[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = self.first + place
        return out
