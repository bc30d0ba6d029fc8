"""Passages of a benchmark inside documents, by one Aho-Corasick automaton over its words.

Both sides become words: A-Z in lower case, every ASCII character but digits and letters parts words, all others belong to
them. A window is ten consecutive words of an item, or all of a shorter item. The automaton's symbols are words: each distinct
word of the benchmark has a number, any other word of a document is 0, which no window holds. A document's words run through
the automaton once, slice by slice, in the automaton's running state; what it finds is a word's place in the document, and
characters are counted again only in documents with a find.

The items travel to the tasks as texts, at most ``AUTOMATON_WORDS`` words of them, and every worker builds the automaton once.
A larger benchmark is dealt out, in pieces that overlap by nine words, to as many automata as that needs; each scans all
documents by itself, and only their finds meet, by the text's digest.
"""

import itertools
import uuid

import numpy as np
from pyspark.sql import functions as F

from sentilake.llm.common import small_batches, stage
from sentilake.llm.suffix_dedup import text_key

WINDOW = 10
AUTOMATON_WORDS = 400_000
PIECE_WORDS = 2000
SLICE = 1 << 20

# Bytes of a normalised text: letters in lower case, blanks for what parts words.
_bytes = np.arange(256, dtype=np.uint8)
_upper = (_bytes >= 65) & (_bytes <= 90)
_inside = (_bytes >= 128) | (_bytes >= 48) & (_bytes <= 57) | (_bytes >= 97) & (_bytes <= 122) | _upper
NORMAL = np.where(_inside, np.where(_upper, _bytes + 32, _bytes), 32).astype(np.uint8).tobytes()


def normal_words(raw):
    """Words of a text in UTF-8."""
    return raw.translate(NORMAL).split()


def windows(words, size=WINDOW):
    """Runs of so many consecutive words, or all words of a shorter text."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _slices(raw):
    """Words of a long text, a slice at a time."""
    normal = raw.translate(NORMAL)
    at = 0
    while at < len(normal):
        end = len(normal) if at + SLICE >= len(normal) else normal.find(b" ", at + SLICE)
        end = len(normal) if end < 0 else end
        yield normal[at:end].split()
        at = end


class Automaton:
    """All windows of some items; items are given as (name, text in UTF-8)."""

    def __init__(self, items, size=WINDOW):
        import ahocorasick

        self.symbols, held = {}, {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        for name, raw in items:
            for w in windows(normal_words(raw), size):
                held.setdefault(tuple(self.symbols.setdefault(x, len(self.symbols) + 1) for x in w), set()).add(place[name])
        self.found = [(len(w), np.array(sorted(of), dtype=np.int64)) for w, of in held.items()]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, w in enumerate(held):
            self.machine.add_word(w, i)
        self.machine.make_automaton()

    def scan(self, raw):
        """(words of the text, spans as first and end word, places of items in names); spans that overlap or touch are one."""
        n, ends, which = 0, [], []
        search = None
        for words in _slices(raw):
            n += len(words)
            if not self.found or not words:
                continue
            get = self.symbols.get
            symbols = tuple([get(w, 0) for w in words])
            if search is None:
                search = self.machine.iter(symbols)
            else:
                search.set(symbols)  # goes on in the state, and the count, where the last slice ended
            for end, i in search:
                ends.append(end)
                which.append(i)
        if not ends:
            return n, np.zeros((0, 2), dtype=np.int64), []
        items = np.unique(np.concatenate([self.found[i][1] for i in set(which)]))
        stop = np.array(ends, dtype=np.int64) + 1
        start = stop - np.array([self.found[i][0] for i in which], dtype=np.int64)
        return n, joined(np.stack([start, stop], axis=1)), items.tolist()


def joined(spans):
    """Spans in order, those that overlap or touch as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], axis=1)


def places(raw, spans):
    """Spans of words as (first word, words, first character, end character) of the text as it was."""
    inside = np.frombuffer(raw.translate(NORMAL), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1)[spans[:, 0]], np.flatnonzero(edge == -1)[spans[:, 1] - 1]
    before = np.append(0, np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80))
    return np.stack([spans[:, 0], spans[:, 1] - spans[:, 0], before[first], before[end]], axis=1)


def _piece_rows(size):
    """Items in pieces of bounded length that overlap by a window less one word: name, words, text in UTF-8."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                words = normal_words(text.as_buffer().to_pybytes())
                step = PIECE_WORDS + size - 1
                parts = [words[i : i + step] for i in range(0, max(1, len(words) - size + 1), PIECE_WORDS)] if words else []
                if parts:
                    columns = [pa.array([name.as_py()] * len(parts)), pa.array([len(p) for p in parts], pa.int64()), pa.array([b" ".join(p) for p in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "raw"])

    return rows


SPAN = "struct<word:long,words:long,start:long,end:long>"
_machines = {}


def _automaton(key, items, size):
    """One a worker process."""
    if key not in _machines:
        _machines.clear()
        _machines[key] = Automaton(items, size)
    return _machines[key]


def _scan_rows(key, items, size, all_rows):
    """Rows of (id, digest, text) to (id, digest, n_words, spans, items), or only those of them with a find."""
    names = ("word", "words", "start", "end")

    def rows(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.int64()) for c in names]))
        machine = _automaton(key, items, size)
        for batch in batches:
            counts, spans, found = [], [], []
            for text in batch.column(2):
                raw = text.as_buffer().to_pybytes()
                n, at, which = machine.scan(raw)
                counts.append(n)
                spans.append([dict(zip(names, x, strict=True)) for x in places(raw, at).tolist()] if len(at) else [])
                found.append([machine.names[i] for i in which])
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(columns, names=["id", "k", "n_words", "spans", "items"])
            yield out if all_rows else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return rows


def _merged(spans):
    """Spans of several automata, those that overlap or touch as one."""
    at = {x["word"]: x["start"] for x in spans}
    to = {x["word"] + x["words"]: x["end"] for x in spans}
    whole = joined(np.array([(x["word"], x["word"] + x["words"]) for x in spans], dtype=np.int64).reshape(-1, 2)).tolist()
    return [{"word": a, "words": b - a, "start": at[a], "end": to[b]} for a, b in whole]


def _merge_rows(batches):
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(1).to_pylist()
        spans = pa.array([_merged(list(itertools.chain(*x))) for x in lists], batch.schema.field("spans").type.value_type)
        yield pa.RecordBatch.from_arrays([batch.column(0), spans, batch.column(2)], names=["k", "spans", "items"])


def passages(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", size=WINDOW, automaton_words=AUTOMATON_WORDS):
    """(id_col, n_words, spans, items) of each row of docs.

    spans: the document's words that lie in a window of the benchmark, as runs (first word, words, first character, end
    character, in the text as it was), runs that overlap or touch as one. items: the ids, as sorted text, of all items with a
    window in the document. Null texts have no words, on either side. Rows that repeat an item id are one item of several
    texts; items without an id are one item named by the empty text. Ids of documents, null or repeated, are carried. Other
    columns are not read. No documents give no rows, no items give no spans.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    item = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    texts = benchmark.select(item.alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    pieces = stage(texts.mapInArrow(_piece_rows(size), "item string, n long, raw binary"), "benchmark-pieces")
    weight = F.col("n") + F.octet_length("raw") / 32  # long words count as several
    total = pieces.agg(F.sum(weight)).first()[0] or 0
    shards = 1 if total <= automaton_words else int(2 * total // max(1, automaton_words)) + 1
    shard = F.pmod(F.xxhash64("item", "raw"), F.lit(shards))

    key = text_key(F.col(text_col)) if shards > 1 else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), key.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, k binary, n_words long, spans array<{SPAN}>, items array<string>"

    def scanned(i):
        held = [(r.item, bytes(r.raw)) for r in pieces.filter(shard == i).collect()]
        return rows.mapInArrow(_scan_rows(uuid.uuid4().hex, held, size, shards == 1), schema)

    if shards == 1:
        out = scanned(0).drop("k")
    else:
        # One find a text and automaton, however many copies the text has.
        found = None
        for i in range(shards):
            one = scanned(i).groupBy("k").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
            one = stage(one, "benchmark-finds")
            found = one if found is None else found.unionByName(one)
        lists = found.groupBy("k").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        whole = lists.mapInArrow(_merge_rows, f"k binary, spans array<{SPAN}>, items array<string>")
        counted = rows.mapInArrow(_scan_rows("no items", [], size, True), schema).select("id", "k", "n_words")
        empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
        out = counted.join(whole, "k", "left").select("id", "n_words", empty("spans", SPAN), empty("items", "string"))
    return out.withColumnRenamed("id", id_col)


def report(found):
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of passages()' rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select(
        found.columns[0], "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated")
    )
