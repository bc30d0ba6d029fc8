"""Comments from a table of tweets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake.operators.skew import join_unique


def select_tweets(tweets: DataFrame, keyword: str, lang: str = "ja") -> DataFrame:
    """Tweets of one language that mention the keyword and are not retweets."""
    return tweets.where(F.col("text").contains(keyword) & (F.col("lang") == lang) & ~F.col("is_retweet"))


def with_author(tweets: DataFrame, users: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Tweets in landing form: link, author name (the author's id where no user is known), text."""
    names = users.where(F.col("author_id").isNotNull()).groupBy("author_id").agg(F.max("username").alias("username"))
    joined = join_unique(tweets, names, "author_id", "left", hot_rows)
    return joined.select(
        F.concat(F.lit(K.TWEET_URL), F.col("tweet_id").cast("string")).alias("tweet_url"),
        F.coalesce("username", F.col("author_id").cast("string")).alias("author"),
        F.col("text").alias("comment"),
    )


def first_tweets(tweets: DataFrame, limit: int) -> DataFrame:
    """The `limit` newest tweets of a search."""
    return tweets.orderBy(F.col("created_at").desc_nulls_last(), F.col("tweet_id").desc()).limit(limit)
