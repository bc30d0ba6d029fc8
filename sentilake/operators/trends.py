"""Daily shares, calendars without gaps, rolling means and change alerts.

Each starts from counts by day, so windows run over days and not over comments.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentilake import constants as K
from sentilake.functions.text import percent
from sentilake.operators.panels import class_count, row_count


def daily_shares(df: DataFrame, by=()) -> DataFrame:
    """Comments and share of the day per day and sentiment. The day's total includes null sentiments."""
    by = list(by)
    counts = (
        df.where(F.col("scraped_date").isNotNull())
        .groupBy(*by, "scraped_date", "sentiment")
        .agg(row_count(df).alias("n"))
    )
    day = W.partitionBy(*by, "scraped_date")
    shares = counts.withColumn("total", F.sum("n").over(day)).withColumn("pct", percent("n", "total"))
    return shares.where(F.col("sentiment").isNotNull())


def fill_days(df: DataFrame, series, day: str, values) -> DataFrame:
    """Add the missing days between each series' own first and last one, with null values.

    Every row unfolds into the days up to the next row's, so no calendar is built and nothing is joined.
    """
    series = [series] if isinstance(series, str) else list(series)
    following = F.lead(day).over(W.partitionBy(*series).orderBy(day))
    last = F.coalesce(F.date_sub(following, 1), F.col(day))
    spread = df.withColumn("_last", last).withColumn("_day", F.explode(F.sequence(F.col(day), F.col("_last"))))
    return spread.select(
        *series,
        F.col("_day").alias(day),
        *[F.when(F.col("_day") == F.col(day), F.col(v)).alias(v) for v in values],
    )


def rolling_mean(value: str, series, day: str, days: int = K.ROLLING_DAYS) -> Column:
    """Mean over the last `days` rows of a gapless series, nulls left out."""
    series = [series] if isinstance(series, str) else list(series)
    return F.avg(value).over(W.partitionBy(*series).orderBy(day).rowsBetween(1 - days, 0))


def sentiment_trend(df: DataFrame, by=()) -> DataFrame:
    """Daily share of each class with its 7-day mean. A day without the class counts as missing, not as zero."""
    by = list(by)
    shares = daily_shares(df, by).where(F.col("sentiment").isin(*K.SENTIMENTS))
    dense = fill_days(shares, [*by, "sentiment"], "scraped_date", ["pct"])
    return dense.withColumn("rolling7", rolling_mean("pct", [*by, "sentiment"], "scraped_date"))


def brand_trend(df: DataFrame) -> DataFrame:
    """Daily positive share of each brand with its 7-day mean. A day without a positive comment counts as zero."""
    daily = (
        df.where(F.col("keyword").isNotNull() & F.col("scraped_date").isNotNull())
        .groupBy("keyword", "scraped_date")
        .agg(class_count(df, K.POSITIVE).alias("_positive"), row_count(df).alias("_total"))
        .select("keyword", "scraped_date", percent("_positive", "_total").alias("pct"))
    )
    dense = fill_days(daily, "keyword", "scraped_date", ["pct"])
    return dense.withColumn("rolling7", rolling_mean("pct", "keyword", "scraped_date"))


def change_alert(df: DataFrame, by=("keyword",), threshold: float = K.ALERT_POINTS, days: int = K.ALERT_DAYS) -> DataFrame:
    """Positive share of the last `days` days against everything before, and whether it fell or rose by `threshold`.

    Undated rows count nowhere. A group gets no row unless both periods hold comments.
    """
    by = list(by)
    daily = (
        df.where(F.col("scraped_date").isNotNull())
        .groupBy(*by, "scraped_date")
        .agg(class_count(df, K.POSITIVE).alias("positive"), row_count(df).alias("total"))
    )
    # One row a day, so this window is short.
    newest = F.max("scraped_date").over(W.partitionBy(*(by or [F.lit(1)])))
    recent = F.col("scraped_date") > F.col("cutoff")
    periods = (
        daily.withColumn("cutoff", F.date_sub(newest, days))
        .groupBy(*by, "cutoff")
        .agg(
            *[
                F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(f"{name}_{c}")
                for name, side in (("recent", recent), ("prior", ~recent))
                for c in ("positive", "total")
            ]
        )
        .where((F.col("recent_total") > 0) & (F.col("prior_total") > 0))
    )
    shares = periods.withColumn("recent_pct", percent("recent_positive", "recent_total")).withColumn(
        "prior_pct", percent("prior_positive", "prior_total")
    )
    change = F.col("recent_pct") - F.col("prior_pct")
    alert = F.when(-change >= threshold, "drop").when(change >= threshold, "rise").otherwise("none")
    return shares.select(*by, "cutoff", "recent_pct", "prior_pct", change.alias("change"), alert.alias("alert"))


def overlay(trend: DataFrame, notes: DataFrame, keyword: str | None = None) -> DataFrame:
    """A trend with the notes of its days: of each row's own brand, or of the one named."""
    named = notes.select("keyword", F.col("date").alias("scraped_date"), F.col("text").alias("annotation"))
    if "keyword" in trend.columns:
        return trend.join(named, ["keyword", "scraped_date"], "left")
    return trend.join(named.where(F.col("keyword") == keyword).drop("keyword"), "scraped_date", "left")
