"""The test tables seen as this library's inputs, in Spark and in SQL.

Each view keeps every row of its table. `SQL[name]` is the same view as a common table expression for DuckDB.
"""

from pyspark.sql import functions as F

from sentilake.sources.tables import spread

START = "2024-01-01"

SQL = {}


def table(spark, d, name, heavy=False):
    """A test table. Each is a single file; `heavy` deals it out to all cores for parsing and regex work."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if heavy else df


def with_views(*names):
    """WITH clause of the named views; one of them may go on from itself."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"


# --- comments over events ---------------------------------------------------------------------
# Two days missing after every five, days without a positive comment, null keys, a class outside the three.

SQL["comments"] = f"""
SELECT event_id AS id,
       CASE WHEN event_id % 101 <> 0 THEN 'brand_' || (user_id % 6) END AS keyword,
       CASE WHEN event_id % 103 <> 0 THEN
         CASE user_id % 5 WHEN 0 THEN 'yahoo' WHEN 1 THEN 'cosme' WHEN 2 THEN 'tabelog' WHEN 3 THEN 'kakaku' ELSE 'twitter' END
       END AS source,
       CASE WHEN event_id % 107 <> 0 THEN
         CAST(ts AS DATE) + CAST(2 * ((CAST(ts AS DATE) - DATE '{START}') // 5) AS INTEGER)
       END AS scraped_date,
       CASE WHEN event_id % 11 = 0 THEN NULL
            WHEN event_id % 97 = 0 THEN 'mixed'
            WHEN event_type IN ('purchase', 'signup') AND day(CAST(ts AS DATE)) % 4 <> 0 THEN 'positive'
            WHEN event_type = 'error' THEN 'negative'
            ELSE 'neutral' END AS sentiment,
       CASE WHEN event_id % 109 <> 0 THEN value / (value + 50.0::DOUBLE) END AS score,
       event_type || ' ' || props AS comment,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE 'item ' || user_id END AS article_title,
       'product ' || (user_id % 10) AS product_name
FROM events"""


def comments(spark, d):
    day = F.to_date("ts")
    eid, user = F.col("event_id"), F.col("user_id")
    names = F.array(*[F.lit(s) for s in ("yahoo", "cosme", "tabelog", "kakaku", "twitter")])
    gap = (2 * F.floor(F.datediff(day, F.lit(START)) / 5)).cast("int")
    sentiment = (
        F.when(eid % 11 == 0, F.lit(None))
        .when(eid % 97 == 0, "mixed")
        .when(F.col("event_type").isin("purchase", "signup") & (F.dayofmonth(day) % 4 != 0), "positive")
        .when(F.col("event_type") == "error", "negative")
        .otherwise("neutral")
    )
    return table(spark, d, "events").select(
        eid.alias("id"),
        F.when(eid % 101 != 0, F.concat(F.lit("brand_"), (user % 6).cast("string"))).alias("keyword"),
        F.when(eid % 103 != 0, F.get(names, (user % 5).cast("int"))).alias("source"),
        F.when(eid % 107 != 0, F.date_add(day, gap)).alias("scraped_date"),
        sentiment.alias("sentiment"),
        F.when(eid % 109 != 0, F.col("value") / (F.col("value") + F.lit(50.0))).alias("score"),
        F.concat("event_type", F.lit(" "), "props").alias("comment"),
        F.when(eid % 7 == 0, F.lit(None))
        .when(eid % 13 == 0, "")
        .otherwise(F.concat(F.lit("item "), user.cast("string")))
        .alias("article_title"),
        F.concat(F.lit("product "), (user % 10).cast("string")).alias("product_name"),
    )


# --- notes over comments: one for every brand and day with the day's signups --------------------

SQL["notes"] = """
SELECT keyword, CAST(row_number() OVER (PARTITION BY keyword ORDER BY scraped_date) - 1 AS INTEGER) AS idx,
       scraped_date AS date, 'launch ' || n AS text
FROM (SELECT keyword, scraped_date, count(*) AS n FROM comments
      WHERE keyword IS NOT NULL AND scraped_date IS NOT NULL GROUP BY 1, 2)"""


def notes(spark, d):
    from pyspark.sql import Window as W

    daily = (
        comments(spark, d)
        .where("keyword IS NOT NULL AND scraped_date IS NOT NULL")
        .groupBy("keyword", "scraped_date")
        .agg(F.count("*").alias("n"))
    )
    idx = F.row_number().over(W.partitionBy("keyword").orderBy("scraped_date")) - 1
    return daily.select(
        "keyword", idx.cast("int").alias("idx"), F.col("scraped_date").alias("date"),
        F.concat(F.lit("launch "), F.col("n").cast("string")).alias("text"),
    )


# --- documents as predicted and as human-labelled comments --------------------------------------

SQL["predicted"] = """
SELECT doc_id, text AS comment,
       CASE WHEN n_chars < 800 THEN 'negative' WHEN n_chars < 1500 THEN 'neutral' ELSE 'positive' END AS sentiment,
       n_chars / (n_chars + 1000.0::DOUBLE) AS score
FROM documents"""


def predicted(spark, d, heavy=False):
    n = F.col("n_chars")
    return table(spark, d, "documents", heavy).select(
        "doc_id",
        F.col("text").alias("comment"),
        F.when(n < 800, "negative").when(n < 1500, "neutral").otherwise("positive").alias("sentiment"),
        (n / (n + F.lit(1000.0))).alias("score"),
    )


SQL["human"] = """
SELECT p.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS human_label
FROM predicted p JOIN labels USING (doc_id)"""


def human(spark, d, heavy=False):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    joined = predicted(spark, d, heavy).join(table(spark, d, "labels"), "doc_id")
    return joined.select("doc_id", "comment", "sentiment", "score", label.alias("human_label"))


# One decision a document; copies of a text have several, the highest doc_id being the latest.
SQL["decisions"] = """
SELECT text AS comment, doc_id AS seq,
       CASE WHEN doc_id % 17 = 0 THEN 'x' WHEN doc_id % 5 = 0 THEN 'p' WHEN doc_id % 5 = 1 THEN ' N' WHEN doc_id % 5 = 2 THEN 'u'
            WHEN doc_id % 5 = 3 THEN '' ELSE 's' END AS decision
FROM documents"""


def decisions(spark, d):
    i = F.col("doc_id")
    key = (
        F.when(i % 17 == 0, "x").when(i % 5 == 0, "p").when(i % 5 == 1, " N").when(i % 5 == 2, "u").when(i % 5 == 3, "")
    )
    return table(spark, d, "documents").select(
        F.col("text").alias("comment"), i.alias("seq"), key.otherwise("s").alias("decision")
    )


SQL["predictions"] = """
SELECT 'len' AS model, human_label AS true_label, sentiment AS pred_label FROM human
UNION ALL
SELECT 'lang', human_label, CASE lang WHEN 'en' THEN 'positive' WHEN 'fr' THEN 'neutral' ELSE 'negative' END
FROM human JOIN documents USING (doc_id)"""


def predictions(spark, d):
    rows = human(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    by_lang = F.when(F.col("lang") == "en", "positive").when(F.col("lang") == "fr", "neutral").otherwise("negative")
    models = F.array(
        F.struct(F.lit("len").alias("model"), F.col("sentiment").alias("pred_label")),
        F.struct(F.lit("lang").alias("model"), by_lang.alias("pred_label")),
    )
    return rows.select(F.col("human_label").alias("true_label"), F.explode(models).alias("m")).select(
        "m.model", "true_label", "m.pred_label"
    )


# --- documents as landed records ----------------------------------------------------------------

SQL["landed"] = """
SELECT CASE doc_id % 6 WHEN 0 THEN 'yahoo' WHEN 1 THEN 'cosme' WHEN 2 THEN 'tabelog' WHEN 3 THEN 'kakaku'
         WHEN 4 THEN 'twitter' ELSE '5ch' END AS source,
       'https://example.com/' || doc_id AS article_url, source || ' title' AS article_title, text AS comment, doc_id
FROM documents"""


def landed(spark, d):
    names = F.array(*[F.lit(s) for s in ("yahoo", "cosme", "tabelog", "kakaku", "twitter", "5ch")])
    return table(spark, d, "documents").select(
        F.get(names, (F.col("doc_id") % 6).cast("int")).alias("source"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("article_url"),
        F.concat("source", F.lit(" title")).alias("article_title"),
        F.col("text").alias("comment"),
        "doc_id",
    )


# --- documents as tweets, customers as users ------------------------------------------------------
# A third of the tweets come from one author.

SQL["tweets"] = """
SELECT doc_id AS tweet_id, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id + 1000 END AS author_id, text,
       CASE WHEN lang = 'fr' THEN 'ja' ELSE lang END AS lang, doc_id % 10 = 0 AS is_retweet
FROM documents"""


def tweets(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("tweet_id"),
        F.when(i % 3 == 0, F.lit(7)).otherwise(i + 1000).cast("long").alias("author_id"),
        "text",
        F.when(F.col("lang") == "fr", "ja").otherwise(F.col("lang")).alias("lang"),
        (i % 10 == 0).alias("is_retweet"),
        F.timestamp_seconds(i).alias("created_at"),
    )


def users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("username"))


# --- a scorer both engines can state ---------------------------------------------------------------

SQL_LABEL = "CASE WHEN length({0}) < 400 THEN 'negative' WHEN length({0}) < 1500 THEN 'neutral' ELSE 'positive' END"
SQL_SCORE = "round(length({0}) / (length({0}) + 1000.0::DOUBLE), 4)"


def length_scorer(df, text):
    """Raw labels 0, 1, 2 by length, as native expressions."""
    n = F.length(text)
    label = F.when(n < 400, "0").when(n < 1500, "1").otherwise("2")
    return df.select(*df.columns, label.alias("label"), (n / (n + F.lit(1000.0))).alias("score"))
