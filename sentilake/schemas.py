"""Column layouts of the tables the jobs read and write."""

from pyspark.sql import types as T


def _strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


NEWS_COMMENT = _strings("article_url", "article_title", "comment")
FORUM_POST = T.StructType(
    _strings("thread_url", "thread_title").fields
    + [T.StructField("post_number", T.IntegerType()), T.StructField("comment", T.StringType())]
)
PRODUCT_REVIEW = _strings("product_url", "product_name", "comment")
RESTAURANT_REVIEW = _strings("restaurant_url", "restaurant_name", "comment")
TWEET_COMMENT = _strings("tweet_url", "author", "comment")

LANDING = {
    "yahoo": NEWS_COMMENT,
    "5ch": FORUM_POST,
    "cosme": PRODUCT_REVIEW,
    "kakaku": PRODUCT_REVIEW,
    "tabelog": RESTAURANT_REVIEW,
    "twitter": TWEET_COMMENT,
}

CANONICAL = _strings("article_url", "article_title", "comment", "source")

FACT = T.StructType(
    CANONICAL.fields
    + [
        T.StructField("keyword", T.StringType()),
        T.StructField("scraped_date", T.DateType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

LABELLED = T.StructType(FACT.fields + [T.StructField("human_label", T.StringType())])

BENCHMARK_SET = _strings("text", "label", "notes")

RAW_TWEET = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("is_retweet", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ANNOTATION = T.StructType(
    [
        T.StructField("keyword", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("text", T.StringType()),
    ]
)

PREDICTION = T.StructType().add("label", T.StringType()).add("score", T.DoubleType())


def require_columns(df, *names):
    """Fail with the names of the columns that are missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
