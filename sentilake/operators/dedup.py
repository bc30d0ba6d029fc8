"""Set membership on comment texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentilake.functions.text import comment_key
from sentilake.operators.skew import join_unique

KEY = "comment_key"


def with_key(df: DataFrame, comment: str = "comment") -> DataFrame:
    """Add the join key of the comment, unless the table already stores it."""
    return df if KEY in df.columns else df.withColumn(KEY, comment_key(comment))


def keys_of(df: DataFrame, comment: str = "comment") -> DataFrame:
    """Distinct comment keys; copies are combined before they are shuffled."""
    return with_key(df, comment).select(KEY).distinct()


def _found(keyed: DataFrame, known: DataFrame, comment: str) -> DataFrame:
    """Keys of `keyed` that `known` holds. Stored rows are cut to the batch's keys before copies are combined, so a small
    batch is broadcast and nothing stored is shuffled but what was found."""
    return with_key(known, comment).select(KEY).join(keyed.select(KEY).distinct(), KEY, "left_semi").distinct()


def drop_known(new: DataFrame, known: DataFrame, comment: str = "comment", hot_rows: int | None = None, bucketed: bool = False) -> DataFrame:
    """Rows of `new` whose comment does not occur in `known`, whatever their brand or source.

    Copies inside `new` all stay. By default the stored side is first cut to the keys that `new` holds, and only the keys
    found meet the rows. A `bucketed` stored table lies by its keys already: the batch joins it directly and is read once.
    """
    keyed = with_key(new, comment)
    if bucketed:
        return keyed.join(with_key(known, comment).select(KEY), KEY, "left_anti").select(*new.columns)
    return join_unique(keyed, _found(keyed, known, comment), KEY, "left_anti", hot_rows).select(*new.columns)


def mark_known(rows: DataFrame, known: DataFrame, comment: str = "comment", hot_rows: int | None = None) -> DataFrame:
    """All rows of `rows`, with `is_known` telling whether their comment occurs in `known`."""
    keyed = with_key(rows, comment)
    marked = join_unique(keyed, _found(keyed, known, comment).withColumn("_hit", F.lit(True)), KEY, "left", hot_rows)
    return marked.select(*rows.columns, F.col("_hit").isNotNull().alias("is_known"))


def first_per_comment(df: DataFrame, order: list[Column], comment: str = "comment") -> DataFrame:
    """One row per comment text, the first in `order`. Each task passes on one row per text, however many copies."""
    first = W.partitionBy(KEY).orderBy(*order)
    ranked = with_key(df, comment).withColumn("_first", F.row_number().over(first))
    return ranked.where(F.col("_first") == 1).select(*df.columns)
