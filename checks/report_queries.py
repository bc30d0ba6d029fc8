"""Analysis page, brand comparison and annotations, over `comments`."""

from functools import reduce

from pyspark.sql import functions as F

from checks import views as V
from checks.catalog import query
from sentilake.operators import annotations as A
from sentilake.operators import compare as C
from sentilake.operators import panels as P
from sentilake.operators import trends as R
from sentilake.plans import reports
from sentilake.session import scratch_path
from sentilake.sources.annotations import read_annotations, write_annotations

# --- trend ------------------------------------------------------------------------------------

_TREND = """,
daily AS (SELECT {by} scraped_date, sentiment, count(*) AS n FROM comments WHERE scraped_date IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {by} scraped_date) * 100 AS pct,
                  sum(n) OVER (PARTITION BY {by} scraped_date) AS total FROM daily),
"""

_ROLL = """
SELECT {by} scraped_date, pct, round(avg(pct) OVER (PARTITION BY {key} ORDER BY scraped_date
         ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling7
FROM (SELECT {cal} c.scraped_date, s.pct FROM calendar c LEFT JOIN series s USING ({using}, scraped_date))"""

TREND_SQL = (
    _TREND.format(by="")
    + """series AS (SELECT scraped_date, sentiment, pct FROM shares WHERE sentiment IN ('positive', 'neutral', 'negative')),
calendar AS (SELECT sentiment, CAST(unnest(generate_series(min(scraped_date), max(scraped_date), INTERVAL 1 DAY)) AS DATE) AS scraped_date
             FROM series GROUP BY sentiment)
"""
    + _ROLL.format(by="sentiment,", key="sentiment", cal="c.sentiment,", using="sentiment")
)


@query("daily_trend_rolling7", "comments", sql=TREND_SQL)
def daily_trend_rolling7(spark, d):
    return R.sentiment_trend(V.comments(spark, d)).withColumn("rolling7", F.round("rolling7", 6))


@query(
    "daily_shares", "comments",
    sql=_TREND.format(by="").rstrip(",\n") + " SELECT scraped_date, sentiment, n, CAST(total AS BIGINT) AS total, pct FROM shares WHERE sentiment IS NOT NULL",
)
def daily_shares(spark, d):
    return R.daily_shares(V.comments(spark, d))


@query(
    "brand_sentiment_trend", "comments",
    sql=_TREND.format(by="keyword,")
    + """series AS (SELECT keyword, scraped_date, sentiment, pct FROM shares WHERE sentiment IN ('positive', 'neutral', 'negative')),
calendar AS (SELECT keyword, sentiment, CAST(unnest(generate_series(min(scraped_date), max(scraped_date), INTERVAL 1 DAY)) AS DATE) AS scraped_date
             FROM series GROUP BY keyword, sentiment)
SELECT keyword, sentiment, scraped_date, pct, round(avg(pct) OVER (PARTITION BY keyword, sentiment ORDER BY scraped_date
         ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling7
FROM (SELECT c.keyword, c.sentiment, c.scraped_date, s.pct FROM calendar c LEFT JOIN series s
      ON s.keyword IS NOT DISTINCT FROM c.keyword AND s.sentiment = c.sentiment AND s.scraped_date = c.scraped_date)""",
)
def brand_sentiment_trend(spark, d):
    return R.sentiment_trend(V.comments(spark, d), by=["keyword"]).withColumn("rolling7", F.round("rolling7", 6))


BRAND_TREND_SQL = """,
series AS (SELECT keyword, scraped_date, CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(*) * 100 AS pct
           FROM comments WHERE keyword IS NOT NULL AND scraped_date IS NOT NULL GROUP BY ALL),
calendar AS (SELECT keyword, CAST(unnest(generate_series(min(scraped_date), max(scraped_date), INTERVAL 1 DAY)) AS DATE) AS scraped_date
             FROM series GROUP BY keyword)
""" + _ROLL.format(by="keyword,", key="keyword", cal="c.keyword,", using="keyword")


@query("brand_positive_trend", "comments", sql=BRAND_TREND_SQL)
def brand_positive_trend(spark, d):
    return R.brand_trend(V.comments(spark, d)).withColumn("rolling7", F.round("rolling7", 6))


_ALERT = """,
marked AS (SELECT *, CAST(max(scraped_date) OVER ({over}) - 7 AS DATE) AS cutoff FROM comments WHERE scraped_date IS NOT NULL),
periods AS (SELECT {by} cutoff,
    count(*) FILTER (scraped_date > cutoff) AS rt, count(*) FILTER (scraped_date > cutoff AND sentiment = 'positive') AS rp,
    count(*) FILTER (scraped_date <= cutoff) AS pt, count(*) FILTER (scraped_date <= cutoff AND sentiment = 'positive') AS pp
  FROM marked GROUP BY ALL),
shares AS (SELECT {by} cutoff, CAST(rp AS DOUBLE) / rt * 100 AS recent_pct, CAST(pp AS DOUBLE) / pt * 100 AS prior_pct
           FROM periods WHERE rt > 0 AND pt > 0)
SELECT {by} cutoff, recent_pct, prior_pct, recent_pct - prior_pct AS change,
       CASE WHEN prior_pct - recent_pct >= {t} THEN 'drop' WHEN recent_pct - prior_pct >= {t} THEN 'rise' ELSE 'none' END AS alert
FROM shares"""


@query("change_alert_by_keyword", "comments", sql=_ALERT.format(by="keyword,", over="PARTITION BY keyword", t=1))
def change_alert_by_keyword(spark, d):
    return R.change_alert(V.comments(spark, d), threshold=1)


@query("change_alert_all", "comments", sql=_ALERT.format(by="", over="", t=10))
def change_alert_all(spark, d):
    return R.change_alert(V.comments(spark, d), by=())


# --- counts -----------------------------------------------------------------------------------

_SHARES = """
SELECT position, sentiment, n, total, CASE WHEN total > 0 THEN CAST(n AS DOUBLE) / total * 100 ELSE 0 END AS pct,
       repeat('█', CAST(floor(CAST(n AS DOUBLE) / total * 100 / 3) AS BIGINT)) AS bar
FROM (SELECT position, k.sentiment, count(*) FILTER (c.sentiment = k.sentiment) AS n, count(*) AS total
      FROM comments c, (VALUES (CAST(0 AS INTEGER), 'positive'), (1, 'neutral'), (2, 'negative')) AS k(position, sentiment) GROUP BY 1, 2)"""


@query("sentiment_summary", "comments", sql=_SHARES)
def sentiment_summary(spark, d):
    return P.sentiment_summary(V.comments(spark, d))


_KPI = """
SELECT {by} count(*) AS total, count(*) FILTER (sentiment = 'positive') AS n_positive,
       count(*) FILTER (sentiment = 'neutral') AS n_neutral, count(*) FILTER (sentiment = 'negative') AS n_negative,
       CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(*) * 100 AS pct_positive,
       CAST(count(*) FILTER (sentiment = 'neutral') AS DOUBLE) / count(*) * 100 AS pct_neutral,
       CAST(count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(*) * 100 AS pct_negative
FROM comments"""


@query("kpi_row", "comments", sql=_KPI.format(by=""))
def kpi_row(spark, d):
    return P.kpi_row(V.comments(spark, d))


@query("kpi_row_from_cube", "comments", sql=_KPI.format(by=""))
def kpi_row_from_cube(spark, d):
    return P.kpi_row(P.summary_cube(V.comments(spark, d)))


@query("kpi_row_one_keyword", "comments", sql=_KPI.format(by="") + " WHERE keyword = 'brand_2'")
def kpi_row_one_keyword(spark, d):
    return P.kpi_row(P.keyword_filter(V.comments(spark, d), "brand_2"))


@query("pie_counts", "comments", sql="SELECT sentiment, count(*) AS n FROM comments WHERE sentiment IS NOT NULL GROUP BY 1")
def pie_counts(spark, d):
    return P.class_counts(V.comments(spark, d))


@query(
    "score_histogram", "comments",
    sql="""SELECT sentiment, bin AS score_bin, CAST(bin - 1 AS DOUBLE) / 20 AS bin_start, count(*) AS n
FROM (SELECT sentiment, CAST(least(floor(score * 20), 19) + 1 AS INTEGER) AS bin FROM comments
      WHERE score IS NOT NULL AND sentiment IS NOT NULL) GROUP BY 1, 2, 3""",
)
def score_histogram(spark, d):
    return P.score_histogram(V.comments(spark, d))


@query(
    "source_breakdown", "comments",
    sql="SELECT source, sentiment, count(*) AS n FROM comments WHERE source IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1, 2",
)
def source_breakdown(spark, d):
    return P.source_breakdown(V.comments(spark, d))


@query(
    "source_breakdown_single", "comments",
    sql="SELECT source, sentiment, count(*) AS n FROM comments WHERE source IS NOT NULL AND source IS NULL GROUP BY 1, 2",
)
def source_breakdown_single(spark, d):
    """A single source: the panel does not apply."""
    return P.source_breakdown(V.comments(spark, d).withColumn("source", F.when(F.col("source").isNotNull(), "yahoo")))


@query(
    "report_guards", "comments",
    sql="SELECT count(DISTINCT source) AS n_source, count(DISTINCT scraped_date) AS n_scraped_date, count(DISTINCT keyword) AS n_keyword FROM comments",
)
def report_guards(spark, d):
    return P.guards(V.comments(spark, d))


@query("keyword_list", "comments", sql="SELECT DISTINCT keyword FROM comments WHERE keyword IS NOT NULL")
def keyword_list(spark, d):
    return P.keyword_list(V.comments(spark, d))


@query(
    "comment_table", "comments",
    sql="SELECT article_title, sentiment, score, comment, source, scraped_date FROM comments WHERE sentiment IN ('negative', 'positive')",
)
def comment_table(spark, d):
    return P.comment_table(V.comments(spark, d), ("negative", "positive"))


@query(
    "filtered_count", "comments",
    sql="SELECT count(*) FILTER (sentiment IN ('negative', 'neutral')) AS shown, count(*) AS total FROM comments",
)
def filtered_count(spark, d):
    return P.filtered_count(V.comments(spark, d), ("negative", "neutral"))


# --- top comments -----------------------------------------------------------------------------

_TOP = """
SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sentiment ORDER BY {order}) AS INTEGER) AS rank
  FROM comments WHERE sentiment IN ({classes})) WHERE rank <= {k}"""
_ALL = "'positive', 'neutral', 'negative'"


@query("top_comments", "comments", sql=_TOP.format(cols="sentiment, rank, id, score, comment", order="score DESC NULLS LAST, id", classes=_ALL, k=5))
def top_comments(spark, d):
    return P.top_comments(V.comments(spark, d)).select("sentiment", "rank", "id", "score", "comment")


@query("first_comments_without_score", "comments", sql=_TOP.format(cols="sentiment, rank, id", order="id", classes=_ALL, k=5))
def first_comments_without_score(spark, d):
    return P.top_comments(V.comments(spark, d).drop("score")).select("sentiment", "rank", "id")


@query(
    "summary_top_comments", "comments",
    sql=_TOP.format(cols="sentiment, rank, score, substring(comment, 1, 80) AS comment", order="score DESC NULLS LAST, id", classes="'negative', 'positive'", k=3),
)
def summary_top_comments(spark, d):
    return P.summary_comments(V.comments(spark, d))


@query(
    "comment_cards", "comments",
    sql="""SELECT sentiment, rank, score, title,
  CASE WHEN title <> '' THEN coalesce(source, '') || '  ·  ' || title ELSE coalesce(source, '') END AS meta, comment
FROM (""" + _TOP.format(
        cols="sentiment, rank, score, source, substring(coalesce(nullif(article_title, ''), nullif(product_name, ''), ''), 1, 70) AS title, substring(comment, 1, 320) AS comment",
        order="score DESC NULLS LAST, id", classes=_ALL, k=5,
    ) + ")",
)
def comment_cards(spark, d):
    return P.comment_cards(V.comments(spark, d))


# --- comparison -------------------------------------------------------------------------------

_BRANDS = """
SELECT keyword, count(*) AS comments,
       round_even(CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(*) * 100, 1) AS positive_pct,
       round_even(CAST(count(*) FILTER (sentiment = 'neutral') AS DOUBLE) / count(*) * 100, 1) AS neutral_pct,
       round_even(CAST(count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(*) * 100, 1) AS negative_pct,
       round_even(avg(score), 3) AS avg_score
FROM comments WHERE keyword IS NOT NULL {where} GROUP BY keyword"""


@query("brand_summary", "comments", sql=_BRANDS.format(where=""))
def brand_summary(spark, d):
    return C.brand_summary(V.comments(spark, d))


@query("brand_summary_from_cube", "comments", sql=_BRANDS.format(where=""))
def brand_summary_from_cube(spark, d):
    return C.brand_summary(P.summary_cube(V.comments(spark, d)))


@query(
    "brand_summary_default_brands", "comments",
    sql=_BRANDS.format(where="AND keyword IN (SELECT DISTINCT keyword FROM comments WHERE keyword IS NOT NULL ORDER BY keyword LIMIT 4)"),
)
def brand_summary_default_brands(spark, d):
    return C.brand_summary(C.select_brands(V.comments(spark, d)))


@query(
    "brand_summary_chosen_brands", "comments", sql=_BRANDS.format(where="AND keyword IN ('brand_1', 'brand_5')")
)
def brand_summary_chosen_brands(spark, d):
    return C.brand_summary(C.select_brands(V.comments(spark, d), ["brand_1", "brand_5"]))


@query(
    "brand_summary_long", "comments",
    sql="SELECT keyword, measure, replace(measure, '_pct', '') AS sentiment, pct FROM (UNPIVOT (" + _BRANDS.format(where="")
    + ") ON positive_pct, neutral_pct, negative_pct INTO NAME measure VALUE pct)",
)
def brand_summary_long(spark, d):
    return C.brand_summary_long(C.brand_summary(V.comments(spark, d)))


# --- annotations ------------------------------------------------------------------------------


@query("annotation_list", "comments", "notes", sql="SELECT keyword, idx, date, text FROM notes")
def annotation_list(spark, d):
    return A.list_annotations(V.notes(spark, d))


@query("annotation_list_one_keyword", "comments", "notes", sql="SELECT keyword, idx, date, text FROM notes WHERE keyword = 'brand_3'")
def annotation_list_one_keyword(spark, d):
    return A.list_annotations(V.notes(spark, d), "brand_3")


@query(
    "annotation_delete", "comments", "notes",
    sql="""SELECT keyword, CAST(row_number() OVER (PARTITION BY keyword ORDER BY idx) - 1 AS INTEGER) AS idx, date, text
FROM notes WHERE idx <> 2""",
)
def annotation_delete(spark, d):
    return A.delete_annotation(V.notes(spark, d), 2)


@query(
    "annotation_add", "comments", "notes",
    sql="""SELECT keyword, idx, date, text FROM notes UNION ALL
SELECT 'brand_1', CAST(max(idx) + 1 AS INTEGER), DATE '2024-02-01', 'campaign' FROM notes WHERE keyword = 'brand_1'""",
)
def annotation_add(spark, d):
    return A.add_annotation(V.notes(spark, d), "brand_1", "2024-02-01", "campaign")


@query(
    "annotation_overlay", "comments", "notes",
    sql=", trend AS (" + "SELECT * FROM (WITH " + BRAND_TREND_SQL.lstrip(",\n") + "))"
    + " SELECT t.*, n.text AS annotation FROM trend t LEFT JOIN notes n ON n.keyword = t.keyword AND n.date = t.scraped_date",
)
def annotation_overlay(spark, d):
    return R.overlay(brand_positive_trend(spark, d), V.notes(spark, d))


@query("annotations_json_roundtrip", "comments", "notes", sql="SELECT keyword, idx, date, text FROM notes")
def annotations_json_roundtrip(spark, d):
    path = scratch_path(spark, "annotations")
    write_annotations(V.notes(spark, d), path)
    return read_annotations(spark, path)


# Every note is added on its day; after every third one the first, second or third of the list goes, if there is one.
_LOG = """, edits AS (SELECT keyword, 2 * idx AS seq, 'add' AS op, date, text, NULL::INTEGER AS position FROM notes
  UNION ALL SELECT keyword, 2 * idx + 1, 'delete', NULL, NULL, CAST(idx // 3 % 4 AS INTEGER) FROM notes WHERE idx % 3 = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY seq) AS nth FROM edits),
folded AS (
  SELECT DISTINCT keyword, 0::BIGINT AS nth, []::STRUCT(date DATE, text VARCHAR)[] AS held FROM edits
  UNION ALL
  SELECT f.keyword, n.nth, CASE WHEN op = 'add' THEN list_append(held, {'date': date, 'text': text})
      ELSE list_concat(held[1:position], held[position + 2:]) END
  FROM folded f JOIN numbered n ON n.keyword = f.keyword AND n.nth = f.nth + 1),
last AS (SELECT keyword, arg_max(held, nth) AS held FROM folded GROUP BY keyword)
SELECT keyword, CAST(i - 1 AS INTEGER) AS idx, held[i].date AS date, held[i].text AS text
FROM (SELECT keyword, held, unnest(range(1, len(held) + 1)) AS i FROM last)"""


@query("annotations_replay", "comments", "notes", sql=_LOG)
def annotations_replay(spark, d):
    """A log of adds and deletes of every brand, folded to its list; positions count anew after each delete."""
    notes = V.notes(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    adds = notes.select("keyword", (2 * F.col("idx")).alias("seq"), F.lit("add").alias("op"), "date", "text", none("int").alias("position"))
    place = (F.floor(F.col("idx") / 3) % 4).cast("int")
    deletes = notes.where(F.col("idx") % 3 == 1).select(
        "keyword", (2 * F.col("idx") + 1).alias("seq"), F.lit("delete").alias("op"), none("date").alias("date"), none("string").alias("text"), place.alias("position")
    )
    return A.replay(adds.unionByName(deletes))


# --- whole pages ------------------------------------------------------------------------------


_LAYOUT = {  # of each panel: the columns that are shown as text, and those that are numbers
    "kpis": ((), ("total", "n_positive", "n_neutral", "n_negative", "pct_positive", "pct_neutral", "pct_negative")),
    "classes": (("sentiment",), ("n",)),
    "scores": (("sentiment", "score_bin"), ("bin_start", "n")),
    "sources": (("source", "sentiment"), ("n",)),
    "shown": ((), ("shown", "total")),
    "alert": (("cutoff", "alert"), ("recent_pct", "prior_pct", "change")),
    "trend": (("sentiment", "scraped_date", "annotation"), ("pct", "rolling7")),
    "cards": (("sentiment", "title", "meta", "comment"), ("rank", "score")),
    "table": (("article_title", "sentiment", "comment", "source", "scraped_date"), ("score",)),
    "summary": (("keyword",), ("comments", "positive_pct", "neutral_pct", "negative_pct", "avg_score")),
    "distribution": (("keyword", "measure", "sentiment"), ("pct",)),
    "brand trend": (("keyword", "scraped_date"), ("pct", "rolling7")),
}


def _page(panels):
    """All rows of all panels in one table: panel, the texts, the numbers."""
    parts = []
    for name, df in panels.items():
        texts, numbers = _LAYOUT[name]
        texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in texts]) if texts else F.array().cast("array<string>")
        values = F.array(*[F.coalesce(F.round(F.col(c).cast("double"), 6).cast("double"), F.lit(-1.0)) for c in numbers])
        parts.append(df.select(F.lit(name).alias("panel"), texts.alias("texts"), values.alias("numbers")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _page_sql(panels):
    """The same of SQL texts, whose first CTE may begin with a comma."""
    parts = []
    for name, sql in panels.items():
        texts, numbers = _LAYOUT[name]
        sql = "WITH " + sql.lstrip(", \n") if sql.lstrip().startswith(",") else sql
        texts = ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in texts)
        values = ", ".join(f"coalesce(round({c}::DOUBLE, 6), -1)" for c in numbers)
        parts.append(f"SELECT '{name}' AS panel, [{texts}]::VARCHAR[] AS texts, [{values}]::DOUBLE[] AS numbers FROM ({sql})")
    return "\nUNION ALL ".join(parts)


def _of(sql, view):
    return sql.replace("FROM comments", f"FROM {view}")


_ANALYSIS = {
    "kpis": _KPI.format(by=""),
    "classes": "SELECT sentiment, count(*) AS n FROM comments WHERE sentiment IS NOT NULL GROUP BY 1",
    "scores": """SELECT sentiment, bin AS score_bin, CAST(bin - 1 AS DOUBLE) / 20 AS bin_start, count(*) AS n
FROM (SELECT sentiment, CAST(least(floor(score * 20), 19) + 1 AS INTEGER) AS bin FROM comments
      WHERE score IS NOT NULL AND sentiment IS NOT NULL) GROUP BY 1, 2, 3""",
    "sources": "SELECT source, sentiment, count(*) AS n FROM comments WHERE source IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1, 2",
    "shown": "SELECT count(*) FILTER (sentiment IN ('positive', 'neutral', 'negative')) AS shown, count(*) AS total FROM comments",
    "alert": _ALERT.format(by="", over="", t=10),
    "trend": ", trend AS (SELECT * FROM (WITH " + TREND_SQL.lstrip(",\n") + ")) SELECT t.*, n.text AS annotation FROM trend t LEFT JOIN notes n ON n.keyword = 'brand_4' AND n.date = t.scraped_date",
    "cards": """SELECT sentiment, rank, score, title,
  CASE WHEN title <> '' THEN coalesce(source, '') || '  ·  ' || title ELSE coalesce(source, '') END AS meta, comment FROM (""" + _TOP.format(
        cols="sentiment, rank, score, source, substring(coalesce(nullif(article_title, ''), nullif(product_name, ''), ''), 1, 70) AS title, substring(comment, 1, 320) AS comment",
        order="score DESC NULLS LAST, id", classes=_ALL, k=5,
    ) + ")",
    "table": "SELECT article_title, sentiment, score, comment, source, scraped_date FROM comments WHERE sentiment IN ('positive', 'neutral', 'negative')",
}


@query(
    "analysis_report", "comments", "notes",
    sql=", b AS (SELECT * FROM comments WHERE keyword = 'brand_4')\n" + _page_sql({k: _of(v, "b") for k, v in _ANALYSIS.items()}),
)
def analysis_report(spark, d):
    """Every panel of a brand's page, every row of each."""
    panels = reports.analysis_report(V.comments(spark, d), "brand_4", V.notes(spark, d))
    assert set(panels) == set(_ANALYSIS)
    return _page(panels)


_FOUR = ", b AS (SELECT * FROM comments SEMI JOIN (SELECT DISTINCT keyword FROM comments WHERE keyword IS NOT NULL ORDER BY 1 LIMIT 4) USING (keyword))\n"
_COMPARED = {
    "summary": _BRANDS.format(where=""),
    "distribution": "SELECT keyword, measure, replace(measure, '_pct', '') AS sentiment, pct FROM (UNPIVOT (" + _BRANDS.format(where="")
    + ") ON positive_pct, neutral_pct, negative_pct INTO NAME measure VALUE pct)",
    "brand trend": BRAND_TREND_SQL,
}


@query("compare_report", "comments", sql=_FOUR + _page_sql({k: _of(v, "b") for k, v in _COMPARED.items()}))
def compare_report(spark, d):
    """Every panel of the comparison of the first four brands."""
    panels = reports.compare_report(V.comments(spark, d))
    panels["brand trend"] = panels.pop("trend")
    assert set(panels) == set(_COMPARED)
    return _page(panels)
