"""CSV records with line ends in quotes, read block by block: a large file keeps all tasks busy.

Spark splits a text file into blocks and reads the lines that begin in each. Whether a block begins inside a quoted value
depends on all before it, so a first pass only tells of each block where it ends up if it begins outside quotes, and where if
it begins inside. Run through the blocks of a file in order these tell how each begins. The second pass cuts the lines into
records at true line ends. What a block's edges cut apart, one record at each, is put together by a small third pass over the
blocks that have such an edge.

A value is quoted if its first character is a quote; a quote in it is doubled. Elsewhere a quote is a character like others.
"""

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentilake.session import materialise

BOM = "\ufeff"
MAX_BLOCKS = 200_000  # of all files of one read: what the begin of each block takes in every task is some 30 MB
RECORD, HEAD, TAIL, MIDDLE = range(4)

# From the begin of a value: whole values, then a quoted one that the line doesn't end.
OPENS = re.compile(rb'(?>"(?>[^"]|"")*+"(?!")[^,]*+,|(?!")[^,]*+,)*+"(?>[^"]|"")*+\Z')
# From inside a quoted value: its rest, and what stands between it and the next value or the end of the line.
CLOSES = re.compile(rb'(?>[^"]|"")*+"(?!")[^,]*+(?:,|\Z)')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins outside a quoted value, or inside one, ends inside one."""
    at = 0
    if inside:
        found = CLOSES.match(line)
        if not found:
            return True
        at = found.end()
        if at == len(line) and not line.endswith(b","):
            return False
    return OPENS.match(line, at) is not None


def _runs(batch, held):
    """(file, block, first row, end) of the batch's stretches of one block."""
    files, blocks = batch.column(held).dictionary_encode(), batch.column(held + 1).to_numpy()
    codes = files.indices.to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1]))) if len(codes) else []
    for a, b in zip(new, [*new[1:], len(codes)], strict=True):
        yield files.dictionary[int(codes[a])].as_py(), int(blocks[a]), int(a), int(b)


def _quoted(lines):
    """Places of the lines that hold a quote; all others end as they began."""
    import pyarrow.compute as pc

    return np.flatnonzero(pc.match_substring(lines, b'"').to_numpy(zero_copy_only=False)).tolist()


def _block_rows(batches):
    """(file, block, inside if begun outside, inside if begun inside) of each block."""
    import pyarrow as pa

    now, ends = None, [False, True]

    def done():
        columns = [[now[0]], [now[1]], [ends[0]], [ends[1]]]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "outside", "inside"])

    for batch in batches:
        for file, block, a, b in _runs(batch, 1):
            if now != (file, block):
                if now is not None:
                    yield done()
                now, ends = (file, block), [False, True]
            lines = batch.column(0).slice(a, b - a)
            for i in _quoted(lines):
                line = lines[i].as_py()
                ends = [ends_inside(line, e) for e in ends]
    if now is not None:
        yield done()


def _record_rows(batches):
    """Lines with their file, block and how the block begins, to (file, block, kind, first, record)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    now, inside, begun, kept, fresh = None, False, False, [], False

    def out(file, block, kinds, first, records):
        n = len(kinds)
        arrays = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(first, pa.bool_()), records]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "kind", "first", "record"])

    def left():
        """What the block's end cut off."""
        if kept:
            kind = MIDDLE if begun else TAIL
            yield out(*now, [kind], [fresh and not begun], pa.array([b"\n".join(kept)], pa.binary()))

    for batch in batches:
        for file, block, a, b in _runs(batch, 1):
            if now != (file, block):
                yield from left()
                now, kept, fresh = (file, block), [], block == 0
                inside = begun = bool(batch.column(3)[a].as_py())  # begun: no true line end so far in a block that began inside
            lines = batch.column(0).slice(a, b - a)
            ends = np.ones(b - a, dtype=bool)
            last = 0
            for i in _quoted(lines):
                ends[last:i] = not inside
                inside = ends_inside(lines[i].as_py(), inside)
                ends[i], last = not inside, i + 1
            ends[last:] = not inside
            cuts = np.flatnonzero(ends) + 1
            if not len(cuts):
                kept += lines.to_pylist()
                continue
            offsets = pa.array(np.append(0, cuts), pa.int32())
            records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(0, int(cuts[-1]))), b"\n")
            if kept:
                head = pa.array([b"\n".join([*kept, records[0].as_py()])], pa.binary())
                records = pa.concat_arrays([head, records.slice(1)])
            kinds = np.full(len(records), RECORD, dtype=np.int32)
            kinds[0] = HEAD if begun else RECORD
            first = np.zeros(len(records), dtype=bool)
            first[0] = fresh and not begun
            yield out(file, block, kinds, first, records)
            kept, begun, fresh = lines.slice(int(cuts[-1])).to_pylist(), False, False
    if now is not None:
        yield from left()


def _begins(blocks: DataFrame) -> DataFrame:
    """(file, block, begins, ends): whether each block begins, and ends, inside a quoted value; a file begins outside.

    A block either ends the same way however it begins, or as it began, or the other way round. So the begin follows from the
    last block of the first kind and the number of blocks of the third kind since.
    """
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    fixed = F.col("outside") == F.col("inside")
    marked = blocks.withColumns({"fixed": F.when(fixed, F.col("outside")), "turn": (F.col("outside") & ~F.col("inside")).cast("int")})
    stretch = marked.withColumns(
        {"since": F.coalesce(F.count("fixed").over(before), F.lit(0)), "from": F.coalesce(F.last("fixed", True).over(before), F.lit(False))}
    )
    turns = F.coalesce(F.sum("turn").over(W.partitionBy("file", "since").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = stretch.withColumn("begins", F.col("from") != (turns % 2 == 1))
    return begins.select("file", "block", "begins", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside")).alias("ends"))


def _lines(spark, path) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


RECORDS = "file string, block long, kind int, first boolean, record binary"


def read_records(spark, path) -> DataFrame:
    """(file, first, record) of CSV files: each record's text, which may hold line ends, and whether it is its file's first.

    A last record whose quoted value is never closed is given as it is.
    """
    lines = _lines(spark, path)
    blocks = materialise(lines.mapInArrow(_block_rows, "file string, block long, outside boolean, inside boolean"))
    begins = materialise(_begins(blocks))
    if begins.count() > MAX_BLOCKS:
        raise ValueError(f"the files have more than {MAX_BLOCKS} blocks: read them in parts, or raise spark.sql.files.maxPartitionBytes")
    # Every block is known, or its size has changed since: then records would be cut at wrong places.
    known = lines.join(F.broadcast(begins), ["file", "block"], "left")
    begin = F.coalesce("begins", F.raise_error(F.lit("files or spark.sql.files.maxPartitionBytes changed while CSV was read")).cast("boolean"))
    begun = known.select("line", "file", "block", begin.alias("begins"))
    whole = begun.mapInArrow(_record_rows, RECORDS).where(F.col("kind") == RECORD).select("file", "first", "record")
    cut = begins.where(F.col("begins") | F.col("ends")).select("file", "block")
    if not cut.isEmpty():
        edges = begun.join(F.broadcast(cut), ["file", "block"], "left_semi").select("line", "file", "block", "begins")
        whole = whole.unionByName(_joined(edges.mapInArrow(_record_rows, RECORDS).where(F.col("kind") != RECORD)))
    # A carriage return before the line end belongs to the line end.
    return whole.select("file", "first", F.regexp_replace(F.col("record").cast("string"), r"\r\z", "").alias("record"))


def _joined(parts: DataFrame) -> DataFrame:
    """Records that block edges cut: an end of one block, whole blocks, the begin of a last one."""
    rank = F.when(F.col("kind") == TAIL, 1).otherwise(0)
    order = W.partitionBy("file").orderBy("block", rank)
    numbered = parts.withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    one = numbered.groupBy("file", "nth").agg(
        F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", rank.alias("rank"), F.col("record").cast("string").alias("text")))).alias("parts")
    )
    return one.select("file", "first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").cast("binary").alias("record"))


def parse_records(records: DataFrame, header: list) -> DataFrame:
    """Values of records as text in columns c0, c1 and so on, as many as the header has; an empty value is null.

    The first record of each file has to be the header and goes; lines without a character go, too.
    """
    values = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(header))), {"multiLine": "true", "escape": '"', "mode": "PERMISSIVE"})
    told = records.where(F.col("record") != "").select("first", values.alias("v"))
    same = [F.regexp_replace(F.coalesce(F.col(f"v.c{i}"), F.lit("")), f"^{BOM}", "") == (n or "") for i, n in enumerate(header)]
    wrong = F.raise_error(F.lit(f"a file's header is not {', '.join(n or '' for n in header)}")).cast("boolean")
    kept = F.when(~F.col("first"), F.lit(True)).otherwise(F.when(reduce(lambda a, b: a & b, same), F.lit(False)).otherwise(wrong))
    return told.where(kept).select("v.*")
