"""Datasets behind the analysis page, one function a panel.

Count panels take comment rows, or the far smaller `summary_cube` of them; the result is the same. Null
sentiments stay in every total and out of every class.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentilake import constants as K
from sentilake.functions import text as X
from sentilake.operators.skew import top_per_group, weight


def score_bin(score="score", bins: int = K.SCORE_BINS) -> Column:
    """Bin 1..bins of a score in 0..1, 1.0 in the last; null without a score."""
    score = F.col(score) if isinstance(score, str) else score
    bucket = F.width_bucket(score, F.lit(0.0), F.lit(1.0), F.lit(bins))
    inside = F.least(F.greatest(bucket, F.lit(1)), F.lit(bins)).cast("int")
    return F.when(score.isNotNull(), inside)


CUBE_KEYS = ("keyword", "source", "scraped_date", "sentiment", "score_bin")


def summary_cube(df: DataFrame, sign: int = 1) -> DataFrame:
    """Row counts and score sums by brand, source, day, sentiment and score bin: every count panel in one scan.

    Combined before the shuffle; its size depends on the days and brands, not on the comments. With sign -1 the rows are
    taken away: merged with a cube that holds them, they are gone.
    """
    keys = [F.col(c) for c in CUBE_KEYS[:4] if c in df.columns]
    one = F.lit(sign).cast("long")
    measures = [F.sum(one).alias("n_rows")]
    if "score" in df.columns:
        keys.append(score_bin().alias("score_bin"))
        measures += [F.sum(F.col("score") * sign).alias("score_sum"), F.coalesce(F.sum(F.when(F.col("score").isNotNull(), one)), F.lit(0)).cast("long").alias("score_rows")]
    return df.groupBy(*keys).agg(*measures)


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """One cube of several, or of the parts that one table holds: counts and sums added up, cells of which nothing is left gone."""
    whole = reduce(DataFrame.unionByName, cubes)
    measures = [c for c in ("n_rows", "score_sum", "score_rows") if c in whole.columns]
    merged = whole.groupBy(*[c for c in CUBE_KEYS if c in whole.columns]).agg(*[F.sum(c).alias(c) for c in measures])
    return merged.where(F.col("n_rows") != 0)


def class_count(df: DataFrame, label: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("sentiment") == label, weight(df))), F.lit(0)).cast("long")


def row_count(df: DataFrame) -> Column:
    return F.coalesce(F.sum(weight(df)), F.lit(0)).cast("long")


def keyword_filter(df: DataFrame, keyword: str = "All") -> DataFrame:
    """One brand's comments, or everything."""
    if keyword == "All" or "keyword" not in df.columns:
        return df
    return df.where(F.col("keyword") == keyword)


def keyword_list(df: DataFrame) -> DataFrame:
    return df.select("keyword").where(F.col("keyword").isNotNull()).distinct().orderBy("keyword")


def sentiment_summary(df: DataFrame) -> DataFrame:
    """Count, share and text bar of the three classes, in fixed order; zeros where a class is absent."""
    counts = df.agg(row_count(df).alias("total"), *[class_count(df, s).alias(s) for s in K.SENTIMENTS])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(s).alias("sentiment"), F.col(s).alias("n"))
            for i, s in enumerate(K.SENTIMENTS)
        ]
    )
    shares = counts.select("total", F.explode(rows).alias("r")).select("r.*", "total")
    shares = shares.withColumn("pct", X.percent("n", "total"))
    return shares.withColumn("bar", X.percent_bar("pct"))


def kpi_row(df: DataFrame) -> DataFrame:
    """Totals and percentages of the three classes as one row."""
    counts = df.agg(row_count(df).alias("total"), *[class_count(df, s).alias(f"n_{s}") for s in K.SENTIMENTS])
    return counts.select("*", *[X.percent(f"n_{s}", "total").alias(f"pct_{s}") for s in K.SENTIMENTS])


def class_counts(df: DataFrame) -> DataFrame:
    """Comments per sentiment, any class."""
    return df.where(F.col("sentiment").isNotNull()).groupBy("sentiment").agg(row_count(df).alias("n"))


def score_histogram(df: DataFrame, bins: int = K.SCORE_BINS) -> DataFrame:
    """Comments per sentiment and score bin. A cube keeps the default bins only."""
    if "score_bin" not in df.columns:
        df = df.where(F.col("score").isNotNull()).withColumn("score_bin", score_bin(bins=bins))
    elif bins != K.SCORE_BINS:
        raise ValueError(f"the cube holds {K.SCORE_BINS} score bins")
    shown = df.where(F.col("sentiment").isNotNull() & F.col("score_bin").isNotNull())
    counts = shown.groupBy("sentiment", "score_bin").agg(row_count(df).alias("n"))
    start = (F.col("score_bin") - 1).cast("double") / bins
    return counts.select("sentiment", "score_bin", start.alias("bin_start"), "n")


def source_breakdown(df: DataFrame) -> DataFrame:
    """Comments per source and sentiment; empty unless there are several sources."""
    counts = df.where(F.col("source").isNotNull()).groupBy("source", "sentiment").agg(row_count(df).alias("n"))
    everything = W.partitionBy(F.lit(1))  # over the counts: sources times classes
    several = counts.withColumn("_several", F.min("source").over(everything) != F.max("source").over(everything))
    return several.where(F.col("_several") & F.col("sentiment").isNotNull()).drop("_several")


def guards(df: DataFrame) -> DataFrame:
    """How many sources, days and brands there are: which panels apply."""
    names = [c for c in ("source", "scraped_date", "keyword") if c in df.columns]
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in names])


def comment_table(df: DataFrame, sentiments=K.SENTIMENTS) -> DataFrame:
    """Comments of the chosen classes, in the display columns that exist."""
    shown = df.where(F.col("sentiment").isin(*sentiments))
    return shown.select(*[c for c in K.DISPLAY_COLUMNS if c in df.columns])


def filtered_count(df: DataFrame, sentiments=K.SENTIMENTS) -> DataFrame:
    """Comments of the chosen classes, out of how many."""
    chosen = F.sum(F.when(F.col("sentiment").isin(*sentiments), weight(df)))
    return df.agg(F.coalesce(chosen, F.lit(0)).cast("long").alias("shown"), row_count(df).alias("total"))


def _order(df: DataFrame, tie):
    score = [F.col("score").desc_nulls_last()] if "score" in df.columns else []
    return [*score, *[F.col(c) for c in tie]]


def top_comments(df: DataFrame, k: int = K.CARD_TOP, sentiments=K.SENTIMENTS, tie=("id",)) -> DataFrame:
    """Most confident comments per class, or the first ones without scores. Ties go by `tie`, which must be unique."""
    shown = df.where(F.col("sentiment").isin(*sentiments))
    return top_per_group(shown, "sentiment", _order(df, tie), k, spread=list(tie))


def summary_comments(df: DataFrame, k: int = K.SUMMARY_TOP, tie=("id",)) -> DataFrame:
    """Top negative and positive comments of a run, cut for print."""
    top = top_comments(df, k, (K.NEGATIVE, K.POSITIVE), tie)
    return top.select("sentiment", "rank", "score", X.truncate("comment", K.SUMMARY_COMMENT_CHARS).alias("comment"))


def comment_cards(df: DataFrame, k: int = K.CARD_TOP, tie=("id",)) -> DataFrame:
    """Fields of the notable-comment cards."""
    top = top_comments(df, k, tie=tie)
    titles = [c for c in ("article_title", "product_name") if c in df.columns]
    source = F.col("source") if "source" in df.columns else F.lit("")
    title = X.card_title(*titles) if titles else F.lit("")
    score = [F.col("score")] if "score" in df.columns else []
    return top.withColumn("title", title).select(
        "sentiment",
        "rank",
        *score,
        "title",
        X.card_meta(source, F.col("title")).alias("meta"),
        X.truncate("comment", K.CARD_COMMENT_CHARS).alias("comment"),
    )
