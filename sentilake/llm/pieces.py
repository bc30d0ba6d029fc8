"""Ids of pieces of text that were met before, for whole batches of pieces at a time."""

import itertools

import numpy as np

from sentilake.llm.bytehash import mix, span_hashes


class PieceStore:
    """Gives each piece, a range of a byte buffer, its ids; ``tokenize`` turns a list of new pieces into lists of ids.

    An open hash table leads from a piece's hash to its bytes and ids. A hash only says where to look: the bytes are compared
    on every hit, and a piece whose hash is taken by another one goes on to a further hash.
    """

    def __init__(self, tokenize, cached):
        self.tokenize, self.cached = tokenize, cached
        self.forget()

    def forget(self):
        self.slots = 1 << max(10, (4 * self.cached - 1).bit_length())
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        # Of each slot: where ids start, how many, where the piece's bytes start, how many.
        self.places = np.zeros((self.slots, 4), dtype=np.int64 if self.slots > 1 << 26 else np.int32)
        self.flat, self.used, self.held = np.zeros(1 << 16, dtype=np.int32), 0, 0
        self.text, self.text_used = np.zeros(1 << 18, dtype=np.uint8), 0

    def shrink(self):
        """Empty the store once it holds more pieces than it is meant to."""
        if self.held > self.cached:
            self.forget()

    def _find(self, keys):
        """Slot of each key: the one that holds it or else the free one where the search ends."""
        mask = np.uint64(self.slots - 1)
        at = (keys & mask).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.slots - 1)
            there = self.keys[at[open_]]
            open_ = open_[(there != keys[open_]) & (there != 0)]
        return at

    def _same(self, data, starts, sizes, at):
        """Whether each piece has the bytes that its slot holds; data has eight bytes beyond the last piece."""
        begin, held = self.places[at, 2].astype(np.int64), self.places[at, 3]
        same = held == sizes
        words = [np.ndarray((len(x) - 7,), dtype="<u8", buffer=x, strides=(1,)) for x in (data, self.text)]
        live, done = np.flatnonzero(same), 0
        while len(live):
            left = np.minimum(sizes[live] - done, 8).astype(np.uint64)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
            ok = (words[0][starts[live] + done] ^ words[1][begin[live] + done]) & mask == 0
            same[live[~ok]] = False
            done += 8
            live = live[ok]
            live = live[sizes[live] > done]
        return same

    def _add(self, data, keys, starts, sizes):
        """Store pieces under keys that the table lacks, one piece a key."""
        raw = data[gather(starts, sizes)]
        ends = np.cumsum(sizes)
        whole = raw.tobytes()
        found = self.tokenize([whole[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)])
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(count.sum()))
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.text = _room(self.text, self.text_used + len(raw) + 8)
        self.text[self.text_used : self.text_used + len(raw)] = raw
        places = np.stack([self.used + np.cumsum(count) - count, count, self.text_used + ends - sizes, sizes], axis=1)
        self.used += len(ids)
        self.text_used += len(raw)
        while 2 * (self.held + len(keys)) > self.slots:
            self._grow()
        self._place(keys, places)
        self.held += len(keys)

    def _place(self, keys, places):
        """Put keys into free slots; of those that meet in one the first stays and the others look on."""
        while len(keys):
            at, first = np.unique(self._find(keys), return_index=True)
            self.keys[at], self.places[at] = keys[first], places[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, places = keys[rest], places[rest]

    def _grow(self):
        """One text may hold more pieces than the store is sized for."""
        full = np.flatnonzero(self.keys)
        keys, places = self.keys[full], self.places[full]
        self.slots *= 2
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.places = np.zeros((self.slots, 4), dtype=np.int64 if self.slots > 1 << 26 else np.int32)
        self._place(keys, places)

    def lookup(self, data, starts, ends):
        """Where the ids of each piece data[start:end] stand in ``flat``, and how many they are; no piece is empty."""
        sizes = ends - starts
        padded = np.append(data, np.zeros(8, dtype=np.uint8))
        keys = span_hashes(data, starts, ends) | np.uint64(1)
        where, count = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            at = self._find(keys[open_])
            missing = open_[self.keys[at] == 0]
            if len(missing):
                new, first = np.unique(keys[missing], return_index=True)
                self._add(data, new, starts[missing[first]], sizes[missing[first]])
                at = self._find(keys[open_])
            same = self._same(padded, starts[open_], sizes[open_], at)
            where[open_[same]], count[open_[same]] = self.places[at[same], 0], self.places[at[same], 1]
            open_ = open_[~same]
            keys[open_] = mix(keys[open_]) | np.uint64(1)
        return where, count


def _room(array, size):
    """The array, or one at least twice as long with its content."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


def gather(starts, sizes):
    """Indices of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
