"""Joins and rankings that hold when one key carries a large part of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

RANK_BUCKETS = 64


def hot_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Every key with `min_rows` rows or more, and how many salts it needs. At most rows / min_rows keys can be."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") >= min_rows) & F.col(key).isNotNull())
    return counts.select(F.col(key).alias("_hot"), (F.ceil(F.col("_n") / min_rows) + 1).cast("int").alias("_salts"))


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str, min_rows: int | None = None) -> DataFrame:
    """Join `rows` to a side with one row per key.

    `how` is any join kind that keeps or drops rows of the left side (inner, left, left_semi, left_anti); of these Spark's
    adaptive execution splits a skewed left partition by itself. With `min_rows` the keys that have so many rows are
    counted first and spread over as many tasks as they fill, for plans in which Spark may not split: hot keys get a salt
    on the left and are repeated once per salt on the right, all others join as they are. The salt follows from the row
    and its input partition, which a retried task finds unchanged.
    """
    if min_rows is None:
        return rows.join(unique, key, how)
    hot = hot_keys(rows, key, min_rows)
    is_hot = F.col("_hot").isNotNull()
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != key]
    spot = F.spark_partition_id() + (F.hash(*plain) if plain else F.lit(0))
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(is_hot, F.pmod(spot, F.col("_salts"))).otherwise(F.lit(0))
    )
    right = unique.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.col("_salts") - 1).otherwise(F.lit(0))))
    )
    return left.drop("_hot", "_salts").join(right.drop("_hot", "_salts"), [key, "_salt"], how).drop("_salt")


def top_per_group(
    df: DataFrame, groups, order, k: int, spread, rank: str = "rank", buckets: int = RANK_BUCKETS
) -> DataFrame:
    """First `k` rows of each group in `order`, with their rank.

    Ranked twice: inside `buckets` slices of each group (by hash of the `spread` columns), then over the at most
    k * buckets rows left, so no task ever holds a whole group. Spark also drops rows past k before each shuffle.
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    spread = [spread] if isinstance(spread, str) else list(spread)
    inner = W.partitionBy(*groups, "_bucket").orderBy(*order)
    outer = W.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("_bucket", F.pmod(F.hash(*spread), F.lit(buckets)))
        .withColumn("_slice_rank", F.row_number().over(inner))
        .where(F.col("_slice_rank") <= k)
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= k)
        .drop("_bucket", "_slice_rank")
    )


def weight(df: DataFrame, column: str = "n_rows") -> Column:
    """Rows a record stands for: the count column of a pre-aggregated table, else 1."""
    return F.col(column) if column in df.columns else F.lit(1).cast(T.LongType())
