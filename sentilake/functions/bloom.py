"""Bloom filters of join keys as native expressions: blocks of bits, each a binary value that a bit-or aggregate builds.

A key belongs to one block, by hash, and sets ``HASHES`` bits in it. A filter of n blocks serves some ``KEYS_PER_BLOCK`` * n
keys; about one key in ten thousand that is not in it passes.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # what the bitmap aggregates hold
KEYS_PER_BLOCK = 1_500
HASHES = 8


def blocks_for(n_keys: int) -> int:
    """Blocks of a filter for so many keys: a power of two, so that filters of like size share a layout."""
    return 1 << (max(1, -(-n_keys // KEYS_PER_BLOCK)) - 1).bit_length()


def block_of(key, blocks) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def positions(key) -> list[Column]:
    """The bits of a key in its block: fifteen bits each of two further hashes."""
    words = [F.xxhash64(key, F.lit(i)) for i in (1, 2)]
    return [F.shiftrightunsigned(words[i // 4], 15 * (i % 4)).bitwiseAND(BLOCK_BITS - 1) for i in range(HASHES)]


def build(keys: DataFrame, key: str, *groups: str) -> DataFrame:
    """(groups, block, bits) of keys, with their groups and the column `blocks` that sizes the group's filter.

    Tasks combine their bits first, so what is shuffled are blocks, not keys.
    """
    placed = keys.select(*groups, "blocks", block_of(key, F.col("blocks")).alias("block"), F.explode(F.array(*positions(key))).alias("_bit"))
    return placed.groupBy(*groups, "blocks", "block").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def may_hold(bits, key) -> Column:
    """Whether a key may be among those that built its block's bits: always for them, rarely for others."""
    bits = F.col(bits) if isinstance(bits, str) else bits

    def is_set(at):
        byte = F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), at.bitwiseAND(7).cast("int")) == 1

    return reduce(lambda a, b: a & b, [is_set(at) for at in positions(key)])
