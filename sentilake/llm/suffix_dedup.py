"""Removal of long repeated byte strings, by column-wise construction of a collection's Burrows-Wheeler order.

The classical construction inserts one symbol of every document a round, from the right, and keeps two sequences up to
date: the order of the suffixes inserted so far and the common prefix of each with its neighbour. A window of ``WINDOW``
bytes is repeated if and only if the suffix that starts with it shares ``WINDOW`` bytes with a neighbour in that order.

To run it on many machines the collection is cut so that strings which can share a window meet:

1. Every window has an anchor: of its ``GRAM``-byte grams, the one with the least hash, the first if several have it.
   Equal windows have equal anchors at the same place. An anchor that the corpus holds once settles its windows.
2. For every other anchor the bytes around it that its windows cover become one string of the collection. Strings go by
   the anchor's hash, sorted, into sequential shuffle files; a task reads them in order, a bounded batch at a time.
3. In a batch the construction runs over columns aligned at the anchor: first those right of it, from the far end, then
   those left of it. A round orders all strings by their next symbol, keeping the order they had, and derives the new
   common prefixes as minima over the old ones. Suffixes in different columns cannot hold the same window, so only the
   current column's order is kept. Right columns, the anchor (equal in a group) and left columns make the suffix.

With ``words`` the same construction also runs over word symbols: every word of a text becomes ``WORD`` bytes of its hash,
and the window is so many words. Texts lose what either window covers.

Strings met twice in one text are settled there and enter the collection once; equal texts enter once. An anchor with
more than ``HOT`` occurrences is not collected: its windows are counted by digest, with partial sums before the shuffle.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sentilake.llm.bytehash import SEGMENT, gram_hashes, mix, parts, string_column, string_hashes
from sentilake.llm.common import discard, in_one, small_batches, stage
from sentilake.llm.shingles import word_ranges

WINDOW = 400
GRAM = 160
HOT = 2000
BATCH_STRINGS = 20_000
HOT_STRINGS = 64  # strings of hot anchors whose windows are listed at a time
END = 0xFF  # no byte of UTF-8, nor of a word's symbol
WORD = 8
WORD_GRAM = 20  # words


def word_symbols(data, offsets):
    """Texts as strings of WORD bytes a word, and their offsets; words are what stands between ASCII spaces, by case."""
    symbols, ends = [np.zeros(0, dtype=np.uint8)], [np.zeros(1, dtype=np.int64)]
    done = 0
    for a, b in parts(offsets):
        text, starts, stops = word_ranges(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        h = string_hashes(data[offsets[a] : offsets[b]], starts, stops)
        digits = np.stack([h // np.uint64(END**i) % np.uint64(END) for i in range(WORD)], axis=1)
        symbols.append(digits.astype(np.uint8).ravel())
        ends.append(done + np.searchsorted(text, np.arange(b - a), side="right") * WORD)
        done += len(h) * WORD
    return np.concatenate(symbols), np.concatenate(ends)


def _window_anchors(data, ends, window, gram):
    """(hash, place, first window, last window) of each anchor of a buffer of several texts; ends[i]: end of the text at i."""
    hashes = gram_hashes(data, gram)
    width = window - gram + 1
    low = np.uint64(SEGMENT * 2 - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    from_left = np.minimum.accumulate(grid, axis=1).ravel()
    from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - window + 1
    place = (np.minimum(from_right[:n], from_left[width - 1 : width - 1 + n]) & low).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + window <= ends[:n])
    if not len(starts):
        return None
    place = place[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return hashes[place[first]], place[first], starts[first], starts[last]


def text_anchors(data, offsets, window=WINDOW, gram=GRAM):
    """Anchors of each text: (text, hash, place, first window, last window, met again), and spans settled in the text.

    Of strings that one text holds several times only the first is listed, marked as met again; the spans cover them all.
    """
    found, n_texts = [], len(offsets) - 1
    lengths = np.diff(offsets)
    text = 0
    while text < n_texts:
        # As many whole texts as a segment holds; a longer one goes in overlapping segments.
        stop = max(text + 1, int(np.searchsorted(offsets, offsets[text] + SEGMENT, side="right")) - 1)
        begin, end = int(offsets[text]), int(offsets[stop])
        rows = np.repeat(np.arange(text, stop), lengths[text:stop])
        ends = np.repeat(offsets[text + 1 : stop + 1] - begin, lengths[text:stop])
        for at in range(0, max(1, end - begin - window + 1), SEGMENT):
            piece = data[begin + at : min(end, begin + at + SEGMENT + window - 1)]
            if len(piece) < window:
                continue
            got = _window_anchors(piece, np.minimum(ends[at : at + len(piece)] - at, len(piece)), window, gram)
            if got is not None:
                h, place, lo, hi = got
                row = rows[at + lo]
                base = begin + at
                found.append((row, h, place + base, lo + base, hi + base))
        text = stop
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return (empty, empty.astype(np.uint64), empty, empty, empty, empty.astype(bool)), (empty, empty, empty)
    row, h, place, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    sides = string_hashes(data, lo, hi + window)
    content = mix(sides ^ mix((place - lo).astype(np.uint64)) ^ row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, back, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
    again = times[back] > 1
    keep = np.zeros(len(row), dtype=bool)
    keep[first] = True
    spans = merged(row[again], lo[again] - offsets[row[again]], hi[again] + window - offsets[row[again]])
    shift = offsets[row]
    listed = tuple(x[keep] for x in (row, h, place - shift, lo - shift, hi - shift, again))
    return listed, spans


def merged(keys, starts, ends):
    """Union of the spans of each key as (key, start, end); touching spans are one."""
    if not len(keys):
        return keys, starts, ends
    order = np.lexsort((starts, keys))
    keys, starts, ends = keys[order], starts[order], ends[order]
    # Ends accumulate within a key: shift every key's places above those of the keys before.
    rank = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
    lift = rank * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + lift)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = starts[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1
    return keys[first], starts[first], reach[last] - lift[last]


def _least(levels, lo, hi):
    """Minimum of the values in each range lo..hi, both included; levels[j][i]: the minimum of 2**j values from i."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=levels[0].dtype)
    for j in range(int(level.max()) + 1 if len(level) else 0):
        at = level == j
        out[at] = np.minimum(levels[j][lo[at]], levels[j][hi[at] - (1 << j) + 1])
    return out


def _insert(order, common, groups, symbols, most):
    """One round: put a symbol before every suffix. Returns the new order and common prefixes."""
    by_symbol = np.argsort(symbols[order], kind="stable")
    perm = by_symbol[np.argsort(groups[order[by_symbol]], kind="stable")]
    new = order[perm]
    got = np.zeros(len(order), dtype=np.int16)
    same = (groups[new[1:]] == groups[new[:-1]]) & (symbols[new[1:]] == symbols[new[:-1]])
    at = np.flatnonzero(same) + 1
    if len(at):
        lo, hi = perm[at - 1] + 1, perm[at]
        best = common[hi]
        apart = np.flatnonzero(hi > lo)
        if len(apart):
            gap = int((hi[apart] - lo[apart]).max()) + 1
            levels = [common]
            while 2 << (len(levels) - 1) <= gap:
                below, step = levels[-1], 1 << (len(levels) - 1)
                levels.append(np.minimum(below[:-step], below[step:]))
            best[apart] = _least(levels, lo[apart], hi[apart])
        got[at] = np.minimum(best + 1, most)
    return new, got


def repeated_windows(groups, left, right, n_left, n_right, span=WINDOW - GRAM):
    """Which windows stand twice or more in their group: [string, bytes left of the anchor].

    left[j] and right[j] hold each string's byte j + 1 places from the anchor, END beyond the string. groups ascend.
    """
    m = len(groups)
    groups = groups.astype(np.uint16 if groups[-1] < 1 << 16 else np.int64)
    out = np.zeros((m, span + 1), dtype=bool)
    order, common = np.arange(m), np.zeros(m, dtype=np.int16)
    for j in range(span - 1, -1, -1):
        order, common = _insert(order, common, groups, right[j], span)
    for i in range(span + 1):
        if i:
            order, common = _insert(order, common, groups, left[i - 1], span)
        whole = common >= span
        hit = whole.copy()
        hit[:-1] |= whole[1:]
        if span == 0:
            hit = groups[order] == np.roll(groups[order], 1)
        out[order[hit], i] = True
    i = np.arange(span + 1)
    return out & (i <= n_left[:, None]) & (span - i <= n_right[:, None])


def pack(place, lo, hi, again):
    """Place, its distances to the first and last window, and the mark, in one number."""
    return (place << 22) | ((place - lo) << 12) | ((place - hi) << 2) | again.astype(np.int64)


def unpack(packed):
    place = packed >> 22
    return place, place - ((packed >> 12) & 1023), place - ((packed >> 2) & 1023)


def _anchor_rows(window, gram, words=False):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_column(batch.column(1))
            if words:
                data, offsets = word_symbols(data, offsets)
            (row, h, place, lo, hi, again), spans = text_anchors(data, offsets, window, gram)
            keys = batch.column(0)
            kind = np.concatenate([np.zeros(len(row), dtype=np.int8), np.ones(len(spans[0]), dtype=np.int8)])
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.concatenate([row, spans[0]]))),
                    pa.array(np.concatenate([h.view(np.int64), spans[1]])),
                    pa.array(np.concatenate([pack(place, lo, hi, again), spans[2]])),
                    pa.array(kind),
                ],
                names=["k", "h", "packed", "kind"],
            )

    return rows


def _string_rows(window, gram, words=False):
    """Text and its anchors to strings: the bytes its windows cover, left of the anchor, then right of it."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for k, text, anchors in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = text.as_buffer()
                data = memoryview(raw)
                if words:
                    data = memoryview(word_symbols(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0])
                h = anchors.values.field("h").to_numpy(zero_copy_only=False)
                packed = anchors.values.field("packed").to_numpy(zero_copy_only=False)
                place, lo, hi = unpack(packed)
                sides = [
                    bytes(data[x:p]) + bytes(data[p + gram : y + window])
                    for p, x, y in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()] * len(h), pa.binary()), pa.array(h), pa.array(packed), pa.array(sides, pa.binary())],
                    names=["k", "h", "packed", "sides"],
                )

    return rows


def _columns(data, offsets, begin, size, span, step):
    """[j, string]: byte j of each string's part, counted from begin in the given direction; END beyond its size."""
    out = np.full((span, len(offsets)), END, dtype=np.uint8)
    at = offsets + begin
    for j in range(span):  # all places at once would take ten times the columns' memory and more
        inside = np.flatnonzero(j < size)
        out[j, inside] = data[at[inside] + step * j]
    return out


def _spans_of(part, window, gram):
    """Repeated spans of a batch of strings sorted by anchor: (row of the batch, start, end)."""
    h, packed, data, offsets = part
    span = window - gram
    _, groups, sizes = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(sizes[groups] > 1)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    at = at[np.argsort(groups[at], kind="stable")]
    groups = np.unique(groups[at], return_inverse=True)[1]
    place, lo, hi = unpack(packed[at])
    a, b = place - lo, hi + window - place - gram
    starts = offsets[:-1][at]
    left = _columns(data, starts, a - 1, a, span, -1)
    right = _columns(data, starts, a, b, span, 1)
    dup = repeated_windows(groups, left, right, a, b, span)
    edge = np.diff(np.pad(dup, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, i0 = np.nonzero(edge == 1)
    _, i1 = np.nonzero(edge == -1)
    return at[rows], place[rows] - (i1 - 1), place[rows] - i0 + window


def _repeat_rows(window, gram, batch_strings):
    """Strings of a partition, sorted by anchor, to repeated spans; a batch ends where an anchor ends."""

    def rows(batches):
        import pyarrow as pa

        held = []

        def run(table):
            table = table.combine_chunks()
            data, offsets = string_column(table.column("sides"))
            h, packed = (table.column(c).to_numpy() for c in ("h", "packed"))
            row, start, end = _spans_of((h, packed, data, offsets), window, gram)
            keys = table.column("k").take(pa.array(row)).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys, pa.array(start), pa.array(end)], names=["k", "s", "e"]
            )

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= batch_strings:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if cut:
                    yield run(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield run(pa.Table.from_batches(held))

    return rows


def _window_rows(window, gram):
    """Strings of hot anchors to one digest of 128 bits for each window."""

    def rows(batches):
        import pyarrow as pa

        for batch in (whole.slice(at, HOT_STRINGS) for whole in batches for at in range(0, whole.num_rows, HOT_STRINGS)):
            keys, out = [], ([], [], [])
            h, packed = (batch.column(i).to_numpy() for i in (1, 2))
            place, lo, hi = unpack(packed)
            for i, (sides, p, x, y) in enumerate(zip(batch.column(3).to_pylist(), place.tolist(), lo.tolist(), hi.tolist(), strict=True)):
                a = p - x
                for w in range(x, y + 1):
                    got = sides[w - x : w - x + window - gram]
                    digest = hashlib.blake2b(got, digest_size=16, key=(a - (w - x)).to_bytes(4, "little") + int(h[i]).to_bytes(8, "little", signed=True)).digest()
                    out[0].append(digest)
                    out[1].append(w)
                    keys.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())], names=["k", "w", "s"]
            )

    return rows


def _word_spans(data, s, e):
    """Spans over word symbols to spans of bytes, up to the next word."""
    _, starts, _ = word_ranges(data, np.array([0, len(data)]))
    first, last = -(-s // WORD), e // WORD
    bounds = np.append(starts, len(data))
    return bounds[first], bounds[last]


def _cut_rows(window, words, cut_words):
    """Text and its repeated spans to what is left of it; a copy of another text that holds a window goes whole.

    Spans of words are counted by the bytes from their first word to their last, and cut too if asked for.
    """

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for k, text, spans, copies in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
                s = e = from_word = to_word = np.zeros(0, dtype=np.int64)
                if spans.is_valid and len(spans):
                    s, e, by_word = (spans.values.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "by_word"))
                    by_word = by_word.astype(bool)
                    if by_word.any():
                        from_word, to_word = _word_spans(data, s[by_word], e[by_word])
                        s, e = s[~by_word], e[~by_word]
                whole = np.zeros(1, dtype=np.int64), np.full(1, len(data))
                if copies.as_py() > 1 and len(data) >= window:
                    s, e = whole
                if copies.as_py() > 1 and words and len(word_ranges(data, np.array([0, len(data)]))[1]) >= words:
                    from_word, to_word = whole
                _, first, last = merged(np.zeros(len(from_word), dtype=np.int64), from_word, to_word)
                if cut_words:
                    s, e = np.concatenate([s, first]), np.concatenate([e, last])
                _, s, e = merged(np.zeros(len(s), dtype=np.int64), s, e)
                gone = np.zeros(len(data) + 1, dtype=np.int8)
                gone[s] += 1
                gone[e] -= 1
                kept = data[np.cumsum(gone[:-1]) == 0].tobytes()
                digest = hashlib.sha256(kept).hexdigest()
                out.append((k.as_py(), len(data), int((e - s).sum()), len(s), digest, int((last - first).sum()), kept.decode("utf-8", "ignore")))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)],
                names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept_text"],
            )

    return rows


def text_key(column):
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256), 1, 32))


def _repeats(rows, texts, name, window, gram, hot, batch_strings, by_word=False):
    """(k, s, e, by_word) of the repeated spans of texts, in bytes, or in word symbols."""
    spark = rows.sparkSession
    least = window // WORD * 2 - 1 if by_word else window
    found = stage(
        rows.filter(F.octet_length("t") >= least).select("k", "t").mapInArrow(_anchor_rows(window, gram, by_word), "k binary, h long, packed long, kind byte"),
        name,
    )
    anchors = found.filter("kind = 0").select("k", "h", "packed")
    settled = found.filter("kind = 1").select("k", F.col("h").alias("s"), F.col("packed").alias("e")).distinct()
    # An anchor is met again if its occurrences differ in text or place: two 64-bit digests of one anchor's rows.
    place = F.xxhash64("k", "packed")
    met = anchors.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n"))
    met = met.filter("lo <> hi").select("h", (F.col("n") > hot).alias("hot"))
    near = anchors.join(met, "h").groupBy("k", "h", "packed").agg(F.first("hot").alias("hot"))
    near = near.groupBy("k").agg(F.collect_list(F.struct("h", "packed", "hot")).alias("a"))
    with_anchors = texts.join(near, "k")
    cut = lambda flag: with_anchors.select("k", "t", F.filter("a", lambda x: x["hot"] == F.lit(flag)).alias("a")).filter(F.size("a") > 0)
    strings = _string_rows(window, gram, by_word)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = cut(False).mapInArrow(strings, "k binary, h long, packed long, sides binary").repartition(n, "h").sortWithinPartitions("h")
    spans = grouped.mapInArrow(_repeat_rows(window, gram, batch_strings), "k binary, s long, e long")
    windows = cut(True).mapInArrow(in_one(strings, _window_rows(window, gram)), "k binary, w binary, s long")
    twice = windows.groupBy("w").count().filter("count > 1").select("w")
    hot_spans = windows.join(twice, "w").select("k", "s", (F.col("s") + window).alias("e"))
    spans = stage(spans.unionByName(hot_spans).unionByName(settled).withColumn("by_word", F.lit(by_word)), "spans")
    discard(spark, found)
    return spans


def remove_repeats(docs, id_col="doc_id", text_col="text", window=WINDOW, gram=GRAM, hot=HOT, batch_strings=BATCH_STRINGS, words=None, word_gram=WORD_GRAM, cut_words=True):
    """Texts without the bytes that a repeated string of ``window`` bytes, or of ``words`` words if given, covers.

    Words are equal by bytes, whatever white space stands between them; the space from a cut word to the next goes with it.
    One row for each row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes (those that repeated
    strings of words cover, which stay in the text without ``cut_words``), kept_text (an UTF-8 character of which
    a removal left only a part is dropped there, not in the digest). Null text counts as empty; texts shorter than each
    window stay whole; rows with equal text, also repeated rows, are copies of each other, so long ones are removed whole;
    null and repeated ids are carried as they are. Other columns of docs are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = rows.groupBy("k").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    spans = _repeats(rows, texts, "anchors", window, gram, hot, batch_strings)
    if words:
        spans = spans.unionByName(_repeats(rows, texts, "word-anchors", words * WORD, word_gram * WORD, hot, batch_strings, by_word=True))
    per_text = spans.groupBy("k").agg(F.collect_list(F.struct("s", "e", "by_word")).alias("spans"))
    kept = (
        texts.join(per_text, "k", "left")
        .select("k", "t", "spans", "copies")
        .mapInArrow(_cut_rows(window, words, cut_words), "k binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept_text string")
    )
    return rows.select("id", "k"), kept


def kept_texts(docs, id_col="doc_id", text_col="text", with_text=True, **settings):
    """remove_repeats() by row of docs; without the texts only the narrow digests travel."""
    ids, kept = remove_repeats(docs, id_col, text_col, **settings)
    kept = kept if with_text else kept.drop("kept_text")
    return ids.join(kept, "k").drop("k").withColumnRenamed("id", id_col)
