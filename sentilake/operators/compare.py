"""Brand comparison."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake.functions.text import percent
from sentilake.operators.panels import class_count, keyword_list, row_count

_PCT = {f"{s}_pct": s for s in K.SENTIMENTS}


def select_brands(df: DataFrame, brands=None) -> DataFrame:
    """Comments of the chosen brands; of the first four by name if none are chosen."""
    if brands is None:
        return df.join(F.broadcast(keyword_list(df).limit(K.DEFAULT_BRANDS)), "keyword", "left_semi")
    if len(set(brands)) < 2:
        raise ValueError("a comparison needs at least two brands")
    return df.where(F.col("keyword").isin(*brands))


def brand_summary(df: DataFrame) -> DataFrame:
    """Comments, class shares (one decimal) and mean score (three decimals) of each brand."""
    if "score_sum" in df.columns:
        mean = F.try_divide(F.sum("score_sum"), F.sum("score_rows"))
    elif "score" in df.columns:
        mean = F.avg("score")
    else:
        mean = F.lit(None).cast("double")
    counts = (
        df.where(F.col("keyword").isNotNull())
        .groupBy("keyword")
        .agg(row_count(df).alias("comments"), *[class_count(df, s).alias(s) for s in K.SENTIMENTS], mean.alias("_mean"))
    )
    return counts.select(
        "keyword",
        "comments",
        *[F.bround(percent(s, "comments"), 1).alias(f"{s}_pct") for s in K.SENTIMENTS],
        F.bround("_mean", 3).alias("avg_score"),
    ).orderBy("keyword")


def brand_summary_long(summary: DataFrame) -> DataFrame:
    """The shares of `brand_summary` as one row per brand and class."""
    long = summary.unpivot(["keyword"], list(_PCT), "measure", "pct")
    return long.select("keyword", "measure", F.regexp_replace("measure", "_pct$", "").alias("sentiment"), "pct")
