"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is cut into leaves that tasks encode in parallel. Two neighbours are joined by encoding a window around the cut
again: from a piece boundary that the left side has settled to one of the right side. The window grows, by doubling, until
its pieces meet a boundary of the right side; from there on both sides agree. A boundary is settled when ``LOOKAHEAD``
characters follow it, more than any rule of the splitter looks ahead. Where one unsplit piece runs through the cut the
window lies inside it, and both sides agree when the window gives back its first token on the left and its last one on the
right: a token sequence is the encoding of a piece if each two neighbours are the encoding of their own bytes.

Leaves are encoded in bulk: the splitter's rules run over arrays of character classes, each distinct piece goes to the
library's model once a worker, and ids are gathered by piece, whose bytes are compared. Classes are asked of the library, a character at a time.
"""

import hashlib
import os

import numpy as np
from pyspark.sql import functions as F

from sentilake.llm.bytehash import string_column
from sentilake.llm.common import in_one, small_batches
from sentilake.llm.pieces import PieceStore, gather
from sentilake.llm.suffix_dedup import text_key

LEAF = 32_768
CHUNK = 1 << 18
LOOKAHEAD = 3
CACHED_PIECES = 200_000
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def vocabulary_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts as the library does with add_special_tokens=False; keeps a bounded store of pieces met."""

    def __init__(self, path, cached=CACHED_PIECES, plain=False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = [] if plain else added  # with plain their strings are text like any other
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.token_bytes(added)
        self.store = PieceStore(self._tokenize, cached)

    def _tokenize(self, pieces):
        tokenize = self.library.model.tokenize
        whole, out, at = b"".join(pieces).decode("latin-1").translate(self.letters), [], 0
        for p in pieces:
            out.append([t.id for t in tokenize(whole[at : at + len(p)])])
            at += len(p)
        return out

    def token_bytes(self, added):
        """Bytes of every token, concatenated, and where each begins."""
        from tokenizers.pre_tokenizers import ByteLevel

        # The byte level's alphabet stands for bytes in this order: printable ones as themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        assert set(letters) == set(ByteLevel.alphabet())
        self.letters = {b: c for c, b in letters.items()}
        special = set(added)
        vocab = self.library.get_vocab(True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.byte_sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_data = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode_bytes(self, ids):
        if not len(ids):
            return b""
        return self.byte_data[gather(self.byte_starts[ids], self.byte_sizes[ids])].tobytes()

    def _classify(self, codes):
        pieces = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        for c in np.unique(codes[self.classes[codes] == UNKNOWN]).tolist():
            x = chr(c)
            self.classes[c] = (
                LETTER if pieces("a" + x) == 1 else NUMBER if pieces("1" + x) == 1 else OTHER if pieces("!" + x) == 1 else SPACE
            )

    def split(self, codes, begins):
        """First characters of the pieces of texts that begin at the given characters."""
        self._classify(codes)
        kind, n = self.classes[codes], len(codes)
        first = np.zeros(n + 1, dtype=bool)  # of a text
        first[begins] = True
        first[n] = True
        run = first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(run)[:-1]
        end = np.append(at[1:], n)
        spaces = kind[at] == SPACE
        start = np.zeros(n + 1, dtype=bool)
        start[at[spaces]] = True
        last = end[spaces] - 1
        start[last[~first[last + 1]]] = True  # before other characters the last of a run of spaces stands alone
        words = at[~spaces]
        after_space = (words > 0) & (codes[words - 1] == 32) & ~first[words]
        start[words[~after_space]] = True
        quote = words[~after_space & (codes[words] == 39) & run[words + 1]]
        if len(quote):
            padded = np.append(codes, [0, 0, 0])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            one &= ~first[quote + 1]
            two &= ~first[quote + 1] & ~first[np.minimum(quote + 2, n)]
            start[quote[one | two] + 1] = False
            start[quote[one] + 2] = True
            start[quote[two] + 3] = True
        start[first] = True
        return np.flatnonzero(start[:n])

    def _chunk(self, data, offsets):
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.searchsorted(leads, offsets[:-1][offsets[:-1] < offsets[1:]])
        at = self.split(codes, begins)
        starts = leads[at]
        ends = np.append(starts[1:], len(data))
        where, sizes = self.store.lookup(data, starts, ends)
        ids = self.store.flat[gather(where, sizes)]
        opens = np.zeros(len(ids) + 1, dtype=bool)
        total = np.append(0, np.cumsum(sizes))
        opens[total[:-1]] = True
        return ids, total[np.searchsorted(starts, offsets)], opens[:-1]

    def encode(self, data, offsets):
        """For texts given as bytes and offsets: (ids, whether a token opens a piece) of each."""
        out, text, n = [], 0, len(offsets) - 1
        while text < n:
            stop = max(text + 1, int(np.searchsorted(offsets, offsets[text] + CHUNK, side="right")) - 1)
            part = data[offsets[text] : offsets[stop]]
            self.store.shrink()
            if len(part) and any(s.encode() in part.tobytes() for s in self.special):
                for i in range(text, stop):
                    got = self.library.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False)
                    words = np.array([-1 if w is None else w for w in got.word_ids], dtype=np.int64)
                    opens = np.ones(len(words), dtype=bool)
                    opens[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
                    out.append((np.array(got.ids, dtype=np.int32), opens))
            elif len(part):
                ids, at, opens = self._chunk(part, offsets[text : stop + 1] - offsets[text])
                out += [(ids[at[i] : at[i + 1]], opens[at[i] : at[i + 1]]) for i in range(stop - text)]
            else:
                out += [(np.zeros(0, np.int32), np.zeros(0, bool))] * (stop - text)
            text = stop
        return out

    def encode_text(self, raw):
        data = np.frombuffer(raw, dtype=np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0]


_encoders = {}


def encoder(path, **kind):
    """One a worker process."""
    key = (path, *sorted(kind.items()))
    if key not in _encoders:
        _encoders[key] = Encoder(path, **kind)
    return _encoders[key]


def _inside(enc, left, right):
    """Join within one piece that runs through the cut; None if it doesn't."""
    (a, a_opens), (b, b_opens) = left, right
    piece = np.flatnonzero(a_opens)[-1]
    stop = np.flatnonzero(np.append(b_opens[1:], True))[0] + 1
    t = 16
    while t < len(a) - piece and t < stop:
        p, q = len(a) - t, t
        try:
            text = enc.decode_bytes(np.concatenate([a[p:], b[:q]])).decode()
        except UnicodeDecodeError:  # a token that ends inside a character: take one more
            t += 1
            continue
        if len(enc.split(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.array([0]))) > 1 or text[0].isspace():
            return None
        ids, _ = enc.encode_text(text.encode())
        if ids[0] == a[p] and ids[-1] == b[q - 1]:
            opens = np.concatenate([a_opens[:p], np.zeros(len(ids), dtype=bool), b_opens[q:]])
            return np.concatenate([a[:p], ids, b[q:]]), opens
        t *= 2
    return None


def join(enc, left, right):
    """The encoding of two neighbouring texts together, from their encodings."""
    (a, a_opens), (b, b_opens) = left, right
    if not len(a) or not len(b):
        return right if not len(a) else left
    if (got := _inside(enc, left, right)) is not None:
        return got
    a_at, b_at = np.flatnonzero(a_opens), np.append(np.flatnonzero(b_opens), len(b))
    b_bytes = np.append(0, np.cumsum(enc.byte_sizes[b]))
    grow = 4
    while True:
        p = int(a_at[max(0, len(a_at) - grow)])
        head = enc.decode_bytes(a[p:])
        if p and len(head.decode()) < LOOKAHEAD:
            grow *= 2
            continue
        q = int(b_at[min(grow, len(b_at) - 1)])
        window = head + enc.decode_bytes(b[:q])
        ids, opens = enc.encode_text(window)
        ends = np.append(np.append(0, np.cumsum(enc.byte_sizes[ids]))[:-1][opens], len(window))
        settled = len(window) if q == len(b) else len(head) + len(window[len(head) :].decode()[:-LOOKAHEAD].encode())
        shared = np.intersect1d(ends[(ends >= len(head)) & (ends <= settled)], len(head) + b_bytes[b_at])
        if len(shared):
            w = int(np.searchsorted(np.append(0, np.cumsum(enc.byte_sizes[ids])), shared[0]))
            r = int(np.searchsorted(b_bytes, shared[0] - len(head)))
            return np.concatenate([a[:p], ids[:w], b[r:]]), np.concatenate([a_opens[:p], opens[:w], b_opens[r:]])
        grow *= 2


def join_all(enc, parts):
    """The tree: neighbours first, then the joined ones."""
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _short_rows(path):
    def rows(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            got = enc.encode(*string_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i, _ in got], pa.binary())], names=["id", "ids"])

    return rows


def _leaf_rows(leaf):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()] * len(parts), pa.binary()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())],
                    names=["k", "i", "t"],
                )

    return rows


def _encoded_leaves(path):
    def rows(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            got = enc.encode(*string_column(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*got, strict=True))]
                if got
                else [batch.column(0), batch.column(1), pa.array([], pa.binary()), pa.array([], pa.binary())],
                names=["k", "i", "ids", "opens"],
            )

    return rows


def _joined_rows(path):
    def rows(batches):
        import pyarrow as pa

        enc = encoder(path)
        key, parts = None, []

        def done():
            ids, _ = join_all(enc, parts)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids.tobytes()], pa.binary())], names=["id", "ids"])

        for batch in batches:
            for k, ids, opens in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                k = k.as_py()
                if k != key:
                    if parts:
                        yield done()
                    key, parts = k, []
                parts.append((np.frombuffer(ids.as_py(), dtype=np.int32), np.frombuffer(opens.as_py(), dtype=bool)))
        if parts:
            yield done()

    return rows


def encode(docs, id_col="doc_id", text_col="text", path=None, leaf=LEAF, step=None, schema="ids binary"):
    """(id_col, ids) for each row of docs; ids: little-endian unsigned 32-bit integers. Null text counts as empty.

    Texts above ``leaf`` characters are encoded by their distinct text, so copies cost nothing; ids, null or repeated,
    are carried as they are. Other columns of docs are not read. An empty table gives none. With ``step``, a function for
    mapInArrow over (id, ids), what it makes of them: the id and the columns of ``schema``. It also gets a text's key as the id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or vocabulary_path()
    steps = [step] if step else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    short = rows.filter(F.length("t") <= leaf).mapInArrow(in_one(_short_rows(path), *steps), f"id {id_type}, {schema}")
    long = rows.filter(F.length("t") > leaf).withColumn("k", text_key(F.col("t")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = long.groupBy("k").agg(F.first("t").alias("t")).mapInArrow(_leaf_rows(leaf), "k binary, i long, t string")
    coded = leaves.repartition(n, "k", "i").mapInArrow(_encoded_leaves(path), "k binary, i long, ids binary, opens binary")
    whole = coded.repartition(n, "k").sortWithinPartitions("k", "i").mapInArrow(in_one(_joined_rows(path), *steps), f"id binary, {schema}")
    joined = long.select("id", "k").join(whole.withColumnRenamed("id", "k"), "k").drop("k")
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def _digest_rows(path):
    def rows(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for x in batch.column(1):
                ids = np.frombuffer(x.as_buffer(), dtype=np.int32) if len(x.as_buffer()) else np.zeros(0, np.int32)
                sizes.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text = enc.decode_bytes(ids).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows


def digests(coded, path=None):
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows."""
    id_col = coded.columns[0]
    kind = coded.schema[id_col].dataType.simpleString()
    out = coded.mapInArrow(_digest_rows(path or vocabulary_path()), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _text_rows(path):
    def rows(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode_bytes(np.frombuffer(x or b"", dtype=np.int32)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows


def decode(coded, path=None):
    """(id, text) of encode()'s rows; null ids count as none, bytes that are no character become U+FFFD."""
    id_col = coded.columns[0]
    kind = coded.schema[id_col].dataType.simpleString()
    return coded.mapInArrow(_text_rows(path or vocabulary_path()), f"id {kind}, text string").withColumnRenamed("id", id_col)
