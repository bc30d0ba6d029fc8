"""Alignment of two tokenizers over the same texts, with corpus-wide counts of the id pairs that overlap.

A is a byte-level BPE, B a piece model that writes blanks as U+2581 and puts one before the text; A reads the text with that
blank. Both give ids whose bytes tile the text, so tokens overlap where their byte ranges do, and end together at the cuts
between groups.

The first pass encodes and aligns all documents; a task keeps their ids, two bytes each, and passes on each id pair with the
number of its documents that hold it linked. The distinct pairs get numbers 0..n-1 by minimal perfect hashing, a bucket of keys a
group. Tasks add their counts into dense vectors by that number, and blocks of the vectors are summed in two levels. Numbers, keys
and counts then go to all tasks, and a second pass over the kept ids aligns them again and looks every link up, comparing its key.
``MAX_PAIRS`` bounds what is sent; with more distinct pairs the second pass gives each distinct text's pairs instead, and these are
joined to the counts. No text is encoded twice.

Both encoders work in bulk: each distinct piece, or word of B with the blanks before it, goes to the library once a worker.
"""

import pickle

import numpy as np
from pyspark.sql import functions as F

from sentilake.llm import bpe
from sentilake.llm.bytehash import SEGMENT, parts, string_column
from sentilake.llm.common import small_batches, stage
from sentilake.llm.perfect_hash import PerfectHash, bucket_of
from sentilake.llm.pieces import PieceStore, gather
from sentilake.operators.skew import join_unique

CACHED_PIECES = 200_000
MAX_PAIRS = 4_000_000  # distinct pairs that go to every task: at most 70 MB
BUCKET = 250_000  # keys that one perfect hash is built over
BLOCK = 8192  # counts in a block of a dense vector
HELD_PAIRS = 1_000_000  # distinct pairs a task holds before it passes them on
SALTS = 16
HOT_LINKS = 100_000  # rows of one pair that are dealt out in the join
BLANK = "▁"


def piece_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Encodes texts as the piece library does; texts are given with the blank that it puts before them."""

    def __init__(self, path, cached=CACHED_PIECES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        rules = model.normalizer_spec
        pieces = [p.piece for p in model.pieces]
        self.vocabulary = len(pieces)
        # Words are encoded apart if no piece holds a blank behind another character and texts are taken as they are.
        self.by_word = (
            BLANK in pieces
            and not any(BLANK in p.lstrip(BLANK) for p in pieces)
            and (rules.name, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces) == ("identity", True, False, True)
        )
        self.blank = pieces.index(BLANK) if BLANK in pieces else None
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        self.byte_sizes = np.array([len(p) for p in raw], dtype=np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.store = PieceStore(self._tokenize, cached)

    def _tokenize(self, words):
        """Ids of words that begin with a blank, the one that the library adds; nothing but that blank is the blank's own piece."""
        ids = self.library.encode([w[1:].decode() for w in words], num_threads=1)
        return [x if len(w) > 1 else [self.blank] for x, w in zip(ids, words, strict=True)]

    def encode(self, data, offsets):
        """(ids of all texts, where each text's ids begin); no text is empty."""
        self.store.shrink()
        if self.by_word:
            blank = data == 32
            start = blank.copy()
            start[1:] &= ~blank[:-1]
            start[offsets[:-1]] = True
            starts = np.flatnonzero(start)
            where, sizes = self.store.lookup(data, starts, np.append(starts[1:], len(data)))
            total = np.append(0, np.cumsum(sizes))
            return self.store.flat[gather(where, sizes)], total[np.searchsorted(starts, offsets)]
        texts = [data[a:b].tobytes()[1:].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = self.library.encode(texts, num_threads=1)
        return np.array([x for one in ids for x in one], dtype=np.int32), np.append(0, np.cumsum([len(x) for x in ids]))


def _spelled(encoder, ids, at, data, offsets):
    """Which texts the bytes of their tokens spell."""
    sizes = encoder.byte_sizes[ids]
    ends = np.append(0, np.cumsum(sizes))
    good = ends[at[1:]] - ends[at[:-1]] == np.diff(offsets)
    keep = np.repeat(good, np.diff(at))
    told = encoder.byte_data[gather(encoder.byte_starts[ids[keep]], sizes[keep])]
    asked = data[np.repeat(good, np.diff(offsets))]
    wrong = np.append(0, np.cumsum(told != asked))
    length = np.where(good, np.diff(offsets), 0)
    end = np.cumsum(length)
    return good & (wrong[end] == wrong[end - length])


class Aligner:
    """Tokens, groups and links of texts, some hundred kilobytes of them at a time."""

    def __init__(self, path_a, path_b):
        self.a = bpe.encoder(path_a, plain=True, cached=CACHED_PIECES)
        self.b = _piece_encoder(path_b)
        self.vocabulary = self.b.vocabulary
        # How kept ids are written.
        self.kinds = [np.min_scalar_type(len(e.byte_sizes) - 1).newbyteorder("<") for e in (self.a, self.b)]
        numbers = [str(i).encode() + b"," for i in range(max(len(self.a.byte_sizes), self.vocabulary))]
        self.digits = np.frombuffer(b"".join(numbers), dtype=np.uint8)
        self.digit_sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        self.digit_starts = np.cumsum(self.digit_sizes) - self.digit_sizes

    def align(self, raw):
        """Alignment of texts in UTF-8: those that have no tokens are not in ``good``, ids and places are of the others."""
        texts = [b" " + r for r in raw if r]
        good = np.array([bool(r) for r in raw], dtype=bool)
        out = Alignment(self, good)
        if not texts:
            return out
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        coded = self.a.encode(data, offsets)
        a = np.concatenate([ids for ids, _ in coded])
        a_at = np.append(0, np.cumsum([len(ids) for ids, _ in coded]))
        b, b_at = self.b.encode(data, offsets)
        same = _spelled(self.a, a, a_at, data, offsets) & _spelled(self.b, b, b_at, data, offsets)
        good[np.flatnonzero(good)] = same
        out.place(a[np.repeat(same, np.diff(a_at))], np.diff(a_at)[same], b[np.repeat(same, np.diff(b_at))], np.diff(b_at)[same])
        return out

    def restored(self, columns):
        """(first row, alignment) of runs of rows, from the columns of kept ids of A and B."""
        (a, a_at), (b, b_at) = (_ids(c, kind) for c, kind in zip(columns, self.kinds, strict=True))
        n_a, n_b = np.diff(a_at), np.diff(b_at)
        for i, j in parts(a_at, SEGMENT // 4) if len(n_a) else ():
            good = n_a[i:j] > 0
            out = Alignment(self, good)
            out.place(a[a_at[i] : a_at[j]], n_a[i:j][good], b[b_at[i] : b_at[j]], n_b[i:j][good])
            yield i, out


def _ids(column, kind):
    """Ids that a binary column holds, and where each row's begin."""
    data, offsets = string_column(column)
    return data.view(kind), offsets // kind.itemsize


class Alignment:
    def __init__(self, aligner, good):
        self.aligner, self.good = aligner, good
        none = np.zeros(0, dtype=np.int64)
        self.place(none, none, none, none)

    def place(self, a, n_a, b, n_b):
        self.a, self.b, self.n_a, self.n_b = a.astype(np.int64), b.astype(np.int64), n_a, n_b
        a_size, b_size = self.aligner.a.byte_sizes[self.a], self.aligner.b.byte_sizes[self.b]
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        self.a_at, self.b_at = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        first = np.searchsorted(b_end, a_end - a_size, side="right")
        count = np.searchsorted(b_end - b_size, a_end, side="left") - first
        self.links_of_a, self.first_b = count, first
        # Groups end where both do.
        self.a_last = b_end[np.minimum(first + count - 1, len(b) - 1)] == a_end if len(b) else np.zeros(0, bool)
        self.b_last = np.zeros(len(b), dtype=bool)
        self.b_last[(first + count - 1)[self.a_last]] = True

    def kept(self):
        """(ids of A, ids of B) of each text as bytes."""
        runs = []
        for ids, at, kind in zip((self.a, self.b), (self.a_at, self.b_at), self.aligner.kinds, strict=True):
            whole, at = ids.astype(kind).tobytes(), (at * kind.itemsize).tolist()
            runs.append([whole[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
        return zip(*runs, strict=True)

    def totals(self, of_a):
        """Sums over each text's tokens of A, of whole numbers."""
        run = np.append(0, np.cumsum(of_a))
        return run[self.a_at[1:]] - run[self.a_at[:-1]]

    def links(self):
        """(text, key of the id pair) of all links, text by text."""
        of_a = np.repeat(np.arange(len(self.a)), self.links_of_a)
        text = np.repeat(np.repeat(np.arange(len(self.n_a)), self.n_a), self.links_of_a)
        return text, self.a[of_a] * self.aligner.vocabulary + self.b[gather(self.first_b, self.links_of_a)]

    def groups(self):
        """Text of each text's groups, ids in decimal: those of A, a bar, those of B; semicolons between groups."""
        if not len(self.n_a):
            return []
        t = self.aligner
        before_a, before_b = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        ends_a, ends_b = np.append(0, np.flatnonzero(self.a_last) + 1), np.append(0, np.flatnonzero(self.b_last) + 1)
        order = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        mark = np.zeros(len(order), dtype=np.uint8)
        at = np.arange(len(self.a)) + ends_b[before_a]
        order[at], mark[at] = self.a, np.where(self.a_last, ord("|"), ord(","))
        at = np.arange(len(self.b)) + ends_a[before_b + 1]
        order[at], mark[at] = self.b, np.where(self.b_last, ord(";"), ord(","))
        sizes = t.digit_sizes[order]
        text = t.digits[gather(t.digit_starts[order], sizes)]
        ends = np.cumsum(sizes)
        text[ends - 1] = mark
        stops = np.append(0, ends[np.cumsum(self.n_a + self.n_b) - 1])
        whole = text.tobytes()
        return [whole[a : b - 1].decode() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


_encoders, _aligners = {}, {}


def _piece_encoder(path):
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def aligner(path_a, path_b):
    """One a worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _alignments(one, column):
    """(first row, alignment) of runs of a column's texts."""
    data, offsets = string_column(column)
    for a, b in parts(offsets) if len(column) else ():
        yield a, one.align([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)])


def _combined(held):
    keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, keys
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(np.concatenate([n for _, n in held])[order], new)


def _token_rows(paths):
    """(id, a, b) with the kept ids of each row, null without tokens; and, in rows of their own, (key, n): each id pair with the
    number of the task's texts that hold it linked."""

    def rows(batches):
        import pyarrow as pa

        one = aligner(*paths)
        space = len(one.a.byte_sizes) * one.vocabulary
        held, size = [], 0

        def out():
            keys, n = _combined(held)
            return record(pa.nulls(len(keys), kind), [None] * len(keys), [None] * len(keys), pa.array(keys), pa.array(n))

        def record(ids, a, b, keys, n):
            return pa.RecordBatch.from_arrays([ids, pa.array(a, pa.binary()), pa.array(b, pa.binary()), keys, n], names=["id", "a", "b", "key", "n"])

        for batch in batches:
            kind, none = batch.column(0).type, pa.nulls(batch.num_rows, pa.int64())
            a, b = [None] * batch.num_rows, [None] * batch.num_rows
            for first, got in _alignments(one, batch.column(1)):
                for i, (x, y) in zip((first + np.flatnonzero(got.good)).tolist(), got.kept(), strict=True):
                    a[i], b[i] = x, y
                text, key = got.links()
                once = np.unique(text * space + key) % space
                keys, n = np.unique(once, return_counts=True)
                held.append((keys, n.astype(np.int64)))
                size += len(keys)
                if size > 2 * HELD_PAIRS:
                    held = [_combined(held)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS:
                        yield out()
                        held, size = [], 0
            yield record(batch.column(0), a, b, none, none)
        if held:
            yield out()

    return rows


def _bucketed(buckets):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            bucket = bucket_of(batch.column(0).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0)], names=["bucket", "key"])

    return rows


def _hash_rows(batches):
    """Rows sorted by bucket to one row each: its perfect hash and its keys by number."""
    import pyarrow as pa

    bucket, held = None, []

    def done():
        keys = np.concatenate(held)
        made = PerfectHash(keys)
        placed = np.zeros(len(keys), dtype=np.int64)
        placed[made.index(keys)] = keys
        return pa.RecordBatch.from_pylist([{"bucket": bucket, "hash": pickle.dumps(made), "keys": placed.tobytes()}])

    for batch in batches:
        of, keys = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True):
            if held and of[a] != bucket:
                yield done()
                held = []
            bucket = int(of[a])
            held.append(keys[a:b])
    if held:
        yield done()


class PairNumbers:
    """Number of each known pair, over all buckets, and the pair of each number."""

    def __init__(self, hashes, keys):
        self.hashes, self.keys = hashes, np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.first = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int64)

    def index(self, keys):
        """Numbers of pairs; every one is compared with its key."""
        if not len(keys):
            return np.zeros(0, dtype=np.int64)
        out = np.zeros(len(keys), dtype=np.int64)
        bucket = bucket_of(keys, len(self.hashes)) if self.hashes else None
        for b in np.unique(bucket).tolist() if self.hashes else []:
            at = np.flatnonzero(bucket == b)
            if self.hashes[b] is not None:
                out[at] = self.first[b] + self.hashes[b].index(keys[at])
        if not self.hashes or not (self.keys[np.minimum(out, len(self.keys) - 1)] == keys).all():
            raise ValueError("a document holds a pair that no document held before: the table has changed")
        return out


def _dense_rows(numbers, total):
    """Counts by pair to the task's dense vector, in blocks; blocks of nothing but zeros are left out."""

    def rows(batches):
        import pyarrow as pa

        vector = None
        for batch in batches:
            if vector is None:
                vector = np.zeros(-(-total // BLOCK) * BLOCK, dtype=np.int64)
            np.add.at(vector, numbers.value.index(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        if vector is not None:
            blocks = vector.reshape(-1, BLOCK)
            there = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([blocks[i].tobytes() for i in there], pa.binary())], names=["block", "v"])

    return rows


def _summed_rows(batches):
    """Rows sorted by block to one sum a block."""
    import pyarrow as pa

    block, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "v"])

    for batch in batches:
        for b, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = np.frombuffer(v.as_buffer(), dtype=np.int64)
            if b == block:
                total = total + v
            else:
                if block is not None:
                    yield done()
                block, total = b, v
    if block is not None:
        yield done()


def _tree_sum(dense, n):
    """Blocks of the same number added up: first those of a salt, then what the salts gave."""
    kind = "block long, v binary"
    salted = dense.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.repartition(n, "block", "salt").sortWithinPartitions("block").select("block", "v").mapInArrow(_summed_rows, kind)
    return some.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_summed_rows, kind)


def pair_numbers(pairs, total, bucket=BUCKET):
    """PairNumbers of the distinct keys of pairs, hashed bucket by bucket on the executors; total is how many they are."""
    buckets = -(-total // bucket)
    if not buckets:
        return PairNumbers([], [])
    placed = pairs.select("key").distinct().mapInArrow(_bucketed(buckets), "bucket long, key long")
    n = min(buckets, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = placed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_hash_rows, "bucket long, hash binary, keys binary")
    got = {r.bucket: r for r in made.collect()}
    hashes = [pickle.loads(got[b].hash) if b in got else None for b in range(buckets)]
    return PairNumbers(hashes, [np.frombuffer(got[b]["keys"], dtype=np.int64) if b in got else np.zeros(0, np.int64) for b in range(buckets)])


STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _aligned_rows(paths, found):
    """(id, k, stats, groups) of each row of (id, k, a, b); without the pairs' counts the last two stats are zero."""

    def rows(batches):
        import pyarrow as pa

        one = aligner(*paths)
        numbers, counts, best = found.value if found is not None else (None, None, None)
        for batch in batches:
            stats = np.zeros((len(STATS), batch.num_rows), dtype=np.int64)
            groups = [""] * batch.num_rows
            for first, got in one.restored(batch.columns[2:4]):
                rows_of = first + np.flatnonzero(got.good)
                stats[:4, rows_of] = got.n_a, got.n_b, got.totals(got.a_last), got.totals(got.links_of_a)
                if numbers is not None:
                    _, keys = got.links()
                    distinct, back = np.unique(keys, return_inverse=True)
                    number = numbers.index(distinct)
                    at = np.append(0, np.cumsum(stats[3, rows_of]))
                    for row, values in ((4, best[number]), (5, counts[number])):
                        run = np.append(0, np.cumsum(values[back], dtype=np.int64))
                        stats[row, rows_of] = run[at[1:]] - run[at[:-1]]
                for i, text in zip(rows_of.tolist(), got.groups(), strict=True):
                    groups[i] = text
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(s) for s in stats), pa.array(groups, pa.string())], names=["id", "k", *STATS, "groups"])

    return rows


def _link_rows(paths):
    """(k, key, m) of each row of (k, a, b): how many links it has of each pair."""

    def rows(batches):
        import pyarrow as pa

        one = aligner(*paths)
        space = len(one.a.byte_sizes) * one.vocabulary
        for batch in batches:
            for first, got in one.restored(batch.columns[1:3]):
                text, key = got.links()
                both, m = np.unique(text * space + key, return_counts=True)
                of = pa.array((first + np.flatnonzero(got.good))[both // space])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(both % space), pa.array(m.astype(np.int64))], names=["k", "key", "m"])

    return rows


def _joined_counts(rows, pairs, paths, vocabulary):
    """(k, n_best, count_sum) of each distinct text, by joins: the way for pairs too many to send to every task."""
    counts = pairs.groupBy("key").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("key") / vocabulary))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = stage(counts.join(top, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts")
    texts = rows.filter(F.col("k").isNotNull()).groupBy("k").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    links = stage(texts.mapInArrow(_link_rows(paths), "k binary, key long, m long"), "pair-links")
    found = join_unique(links, counts, "key", "inner", HOT_LINKS)
    return found.groupBy("k").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))


def align(docs, id_col="doc_id", text_col="text", path_a=None, path_b=None, max_pairs=MAX_PAIRS, bucket=BUCKET):
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of docs.

    groups: the ids of A and B between two cuts, as ``a1,a2|b1;a3|b2,b3``. n_links: pairs of an A and a B token whose bytes
    overlap. An id pair's count is the number of rows that hold it linked; count_sum adds it over a row's links, and n_best is
    how many links have the highest count of their A id, ties included. Strings of special tokens are plain text. A text that is
    null or empty, or that the bytes of either tokenizer's tokens don't spell, has no tokens: zeros, and '' as groups. Rows that
    repeat a text or an id count each; null ids are carried. Other columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    paths = path_a or bpe.vocabulary_path(), path_b or piece_path()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()
    tokens = stage(texts.mapInArrow(_token_rows(paths), f"id {kind}, a binary, b binary, key long, n long"), "tokens", compression="zstd")
    pairs = tokens.filter(F.col("key").isNotNull()).select("key", "n")
    rows = tokens.filter(F.col("key").isNull()).select("id", F.lit(None).cast("binary").alias("k"), "a", "b")
    total = pairs.select("key").distinct().count()
    schema = f"id {kind}, k binary, {', '.join(f'{c} long' for c in STATS)}, groups string"
    if total > max_pairs:
        rows = rows.withColumn("k", F.unhex(F.substring(F.sha2("a", 256), 1, 32)))  # ids spell the text, so they tell it
        known = _joined_counts(rows, pairs, paths, _piece_encoder(paths[1]).vocabulary)
        out = rows.mapInArrow(_aligned_rows(paths, None), schema).drop("n_best", "count_sum").join(known, "k", "left")
        out = out.na.fill(0, ["n_best", "count_sum"])
    else:
        numbers = pair_numbers(pairs, total, bucket)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dense = pairs.mapInArrow(_dense_rows(spark.sparkContext.broadcast(numbers), total), "block long, v binary")
        counts = np.zeros(-(-total // BLOCK) * BLOCK, dtype=np.int64)
        for r in _tree_sum(dense, n).collect():
            counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.v, dtype=np.int64)
        counts = counts[:total]
        a = numbers.keys // _piece_encoder(paths[1]).vocabulary
        top = np.zeros(int(a.max(initial=0)) + 1, dtype=np.int64)
        np.maximum.at(top, a, counts)
        found = spark.sparkContext.broadcast((numbers, counts, counts == top[a]))
        out = rows.mapInArrow(_aligned_rows(paths, found), schema)
    return out.select(F.col("id").alias(id_col), *STATS, "groups")
