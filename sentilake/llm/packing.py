"""Packing token pieces into sequences of fixed length by a configuration linear program.

A configuration says how many pieces of each length one sequence takes. The covering program over all configurations (few
sequences, every length's pieces covered) is solved by multiplicative weights: a length's price falls as it is covered, and
a knapsack over prices, by dynamic programming over the capacity, finds the configuration worth most. The fractional
solution is scaled to what is needed and rounded down; what is left is filled by configurations that take the longest
pieces first and then whatever fits best, each used as often as the stock allows.

Only the histogram of lengths, one row a length, comes to the driver. Pieces take their places by their rank among pieces
of their length, counted by salted slices so that a length which holds most rows is spread.
"""

import math
import zlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentilake.llm import bpe
from sentilake.llm.common import numbers, stage

CAPACITY = 1024
EOS = 2
STEP = 1.0  # how fast a length's price falls with its cover
GOAL = 2.0  # every length is covered so many times before the weights are scaled
SLICE_ROWS = 1_000_000


def best_configuration(prices, stock, capacity):
    """Counts by length of the set worth most; no length above its stock, taken one at a time."""
    worth = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    backward = np.zeros(capacity + 1)  # backward[capacity - c] is worth[c], so that each sum runs over plain slices
    for c in range(1, capacity + 1):
        values = backward[capacity - c + 1 :] + prices[1 : c + 1]
        i = int(values.argmax())
        if values[i] > worth[c - 1]:
            worth[c], choice[c] = values[i], i + 1
        else:
            worth[c] = worth[c - 1]
        backward[capacity - c] = worth[c]
    counts, c = {}, capacity
    while c > 0:
        if choice[c] == 0:
            c -= 1
            continue
        length = int(choice[c])
        if counts.get(length, 0) < stock[length]:
            counts[length] = counts.get(length, 0) + 1
        c -= length
    return counts


def fractional_cover(stock, capacity, step=STEP, goal=GOAL):
    """[(configuration, weight)] that covers the stock, by multiplicative weights."""
    lengths = np.flatnonzero(stock)
    covered = np.zeros(capacity + 1)
    found = {}
    done = np.zeros(capacity + 1, dtype=bool)
    share = min(1.0, max(0.02, len(lengths) / 1024))  # few lengths take finer steps
    while not done[lengths].all():
        prices = np.zeros(capacity + 1)
        open_ = lengths[~done[lengths]]
        prices[open_] = open_ * np.exp(-step * covered[open_])
        config = best_configuration(prices, stock, capacity)
        amount = share * min(stock[x] / k for x, k in config.items())
        key = tuple(sorted(config.items()))
        found[key] = found.get(key, 0.0) + amount
        for x, k in config.items():
            covered[x] += k * amount / stock[x]
            done[x] = covered[x] >= goal
    least = min(covered[x] for x in lengths)
    return [(dict(key), weight / least) for key, weight in found.items()]


def fill(stock, capacity):
    """One configuration: the longest piece in stock, then the largest total that fits, by subset sums over the stock."""
    lengths = [int(x) for x in np.flatnonzero(stock)][::-1]
    config, room = {lengths[0]: 1}, capacity - lengths[0]
    for x in lengths:
        take = min(int(stock[x]) - config.get(x, 0), room // x)
        # Take fewer of this length if a shorter one completes the sequence exactly.
        if take and room - take * x:
            for fewer in range(take, -1, -1):
                rest = room - fewer * x
                if rest == 0 or rest < x and stock[rest] > 0 or fewer == 0:
                    break
            if rest and not (rest < x and stock[rest] > 0):
                fewer = take
            take = fewer
        if take:
            config[x] = config.get(x, 0) + take
            room -= take * x
    return config


def configurations(histogram, capacity=CAPACITY):
    """[(configuration, times)] that hold exactly the pieces of the histogram {length: pieces}."""
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        stock[length] = n
    full, stock[capacity] = int(stock[capacity]), 0
    cover = fractional_cover(stock.astype(float), capacity) if stock.any() else []
    # Rounded twice: taking every configuration, and only those without waste. The better one stays.
    best = min((rounded(cover, stock, capacity, least) for least in (0, capacity)), key=lambda used: sum(n for _, n in used))
    return [({capacity: 1}, full)] * (full > 0) + best


def rounded(cover, stock, capacity, least):
    """Whole numbers of the configurations that hold so much at least; the pieces that remain are filled in."""
    stock, used = stock.copy(), []

    def take(config, times):
        if times > 0:
            used.append((config, int(times)))
            for x, k in config.items():
                stock[x] -= k * int(times)

    for config, weight in sorted(cover, key=lambda x: -sum(a * b for a, b in x[0].items())):
        if sum(x * k for x, k in config.items()) >= least:
            take(config, min(math.floor(weight), *(stock[x] // k for x, k in config.items())))
    while stock.any():
        config = fill(stock, capacity)
        take(config, min(stock[x] // k for x, k in config.items()))
    return used


def slots(used):
    """(length, first rank, end rank, pieces a sequence, first sequence, offset) for each length of each configuration."""
    rows, ranks, sequence = [], {}, 0
    for config, times in used:
        offset = 0
        for x, k in sorted(config.items(), reverse=True):
            first = ranks.get(x, 0)
            rows.append((x, first, first + k * times, k, sequence, offset))
            ranks[x] = first + k * times
            offset += k * x
        sequence += times
    return rows


def _piece_rows(capacity, eos):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            at, out = [], []
            for i, ids in enumerate(batch.column(1)):
                raw = ids.as_buffer().to_pybytes() + int(eos).to_bytes(4, "little")
                n = len(raw) // 4
                start, size = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    out.append((piece, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)])))
                    at.append(i)
                    start, size = start + size, capacity
            numbers = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(numbers, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return rows


def pieces(docs, id_col="doc_id", text_col="text", capacity=CAPACITY, eos=EOS, path=None):
    """(id_col, piece, start, length, ids_crc32): each text's ids and the closing one, cut where longer than the capacity."""
    return bpe.encode(docs, id_col, text_col, path, step=_piece_rows(capacity, eos), schema="piece int, start long, length long, ids_crc32 long")


def place(found, capacity=CAPACITY):
    """Add sequence_id and offset to rows with a length of at most the capacity; rows must come out the same when read again."""
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = numbers(spark, ("length", "first", "stop", "each", "sequence", "shift"), slots(configurations(histogram, capacity)) or [(0, 0, 0, 1, 0, 0)])
    salts = max(16, math.ceil(max(histogram.values(), default=0) / SLICE_ROWS))
    salted = found.withColumn("salt", F.pmod(F.xxhash64(*found.columns), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy(*found.columns)
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    # At most one row a length and configuration: a few thousand whatever the input.
    hit = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["stop"]))
    at = F.col("rank") - F.col("first")
    return hit.select(
        *(ranked[c] for c in found.columns),
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("shift") + (at % F.col("each")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack(docs, id_col="doc_id", text_col="text", capacity=CAPACITY, eos=EOS, path=None):
    """Every piece of every text with its sequence and its place there; offsets of a sequence are gapless from 0.

    Null text counts as empty and takes one place for the closing id. Null and repeated ids are carried as they are; each
    row of docs is packed. Other columns of docs are not read. An empty table gives none.
    """
    return place(stage(pieces(docs, id_col, text_col, capacity, eos, path), "pieces"), capacity)
