"""Cleaning over `documents` wrapped in site boilerplate; extraction over `pages`, forum threads and tweets."""

from pyspark.sql import functions as F

from checks import views as V
from checks.catalog import query
from checks.views import table
from sentilake import constants as K
from sentilake.functions import labels as L
from sentilake.functions import text as X
from sentilake.functions.markup import Select
from sentilake.operators import extract as E
from sentilake.operators import forum, tweets
from sentilake.plans import landing
from sentilake.session import scratch_path
from sentilake.sources.tables import read_landing

# White space at both ends as Python strips it, in RE2 spelling.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(e):
    return f"regexp_replace({e}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


_LINES = r"regexp_split_to_array({0}, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def sql_lines(e):
    return _LINES.format(e)


def sql_remove(e, *patterns):
    for p in patterns:
        flags, p = ("gs", p[4:]) if p.startswith("(?s)") else ("g", p)
        e = f"regexp_replace({e}, '{p}', '', '{flags}')"
    return e


# --- cleaning ---------------------------------------------------------------------------------

_BEAUTY_SQL = r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '12購入品リピート ' WHEN 1 THEN '7購入品 2024/01/02 03:04:05 ' ELSE '3モニター abc' || chr(10) END
  || text || CASE doc_id % 4 WHEN 0 THEN ' 続きを読む' || chr(10) || 'x' WHEN 1 THEN chr(12288) || '購入場所 店' WHEN 2 THEN chr(10) || '効果 潤い' ELSE '' END AS raw
FROM documents"""


def beauty_raw(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 3 == 0, "12購入品リピート ").when(i % 3 == 1, "7購入品 2024/01/02 03:04:05 ").otherwise("3モニター abc\n")
    tail = F.when(i % 4 == 0, " 続きを読む\nx").when(i % 4 == 1, "　購入場所 店").when(i % 4 == 2, "\n効果 潤い").otherwise("")
    return table(spark, d, "documents", heavy=True).select("doc_id", F.concat(head, "text", tail).alias("raw"))


_BEAUTY_CLEAN = sql_strip(
    sql_remove(
        "raw", r"^[0-9]+購入品リピート\s*", r"^[0-9]+購入品\s*", r"^[0-9]+モニター[^\n]*\n",
        r"[0-9]{4}/[0-9]{2}/[0-9]{2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}\s*", r"(?s)続きを読む.*$", r"(?s)購入場所.*$", r"(?s)効果.*$",
    )
)


@query("clean_beauty", sql=f"SELECT doc_id, {_BEAUTY_CLEAN} AS comment FROM ({_BEAUTY_SQL})")
def clean_beauty(spark, d):
    return beauty_raw(spark, d).select("doc_id", X.clean_beauty("raw").alias("comment"))


_PRICE_SQL = r"""SELECT doc_id, '2026年2月13日 07:51 [2008939-1]' || chr(10) || '満足度' || chr(9) || '5' || chr(10) || '  ' || text || chr(12288)
  || chr(10) || '4.5' || chr(10) || chr(10) || 'コスパ' || chr(9) || '3.5' || chr(10) AS raw FROM documents"""
_PRICE_CLEAN = sql_remove(
    "raw", r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日\s+[0-9]{2}:[0-9]{2}\s*\[[0-9-]+\]\s*",
    r"(満足度|操作性|表現力|携帯性|機能性|デザイン|コストパフォーマンス|食事|サービス|雰囲気|コスパ)\s*[\t\n]+[0-9\.]+\s*",
    r"(?m)^[0-9]+(\.[0-9]+)?\s*$",
)
_PRICE_CLEAN = sql_strip(
    f"array_to_string(list_filter(list_transform({sql_lines(_PRICE_CLEAN)}, lambda x: {sql_strip('x')}), lambda x: x <> ''), chr(10))"
)


@query("clean_price", sql=f"SELECT doc_id, {_PRICE_CLEAN} AS comment FROM ({_PRICE_SQL})")
def clean_price(spark, d):
    raw = F.concat(
        F.lit("2026年2月13日 07:51 [2008939-1]\n満足度\t5\n  "), "text", F.lit("　\n4.5\n\nコスパ\t3.5\n")
    )
    return table(spark, d, "documents", heavy=True).select("doc_id", X.clean_price(raw).alias("comment"))


_RESTAURANT_SQL = r"""SELECT doc_id, 'グルメgirl' || chr(10) || '口コミ12件 ' || 'taro 口コミ3件 フォロワー5人 '
  || '4.0 ～￥999 1人' || chr(10) || ' 詳細 料理・味 4.0' || chr(10) || '2024/10訪問 1 回目 ' || text || chr(10) || 'いいね 3' AS raw FROM documents"""
_RESTAURANT_CLEAN = sql_remove("raw", r"^.{1,30}\n口コミ\S*\s*", r".+?口コミ[0-9]+件\s*フォロワー[0-9]+人\s*")
_RESTAURANT_CLEAN = rf"regexp_replace({_RESTAURANT_CLEAN}, '[0-9.]+\s*[～￥0-9,]+.*?詳細.*?([0-9]{{4}}/[0-9]{{2}}訪問)', '\1', 'gs')"
_RESTAURANT_CLEAN = sql_strip(
    sql_remove(_RESTAURANT_CLEAN, r"[0-9]{4}/[0-9]{2}訪問\s*[0-9]+\s*回目\s*", r"(?s)\n(いいね|お店を保存|口コミを|写真を|もっと見る).*$")
)


@query("clean_restaurant", sql=f"SELECT doc_id, {_RESTAURANT_CLEAN} AS comment FROM ({_RESTAURANT_SQL})")
def clean_restaurant(spark, d):
    raw = F.concat(
        F.lit("グルメgirl\n口コミ12件 taro 口コミ3件 フォロワー5人 4.0 ～￥999 1人\n 詳細 料理・味 4.0\n2024/10訪問 1 回目 "),
        "text",
        F.lit("\nいいね 3"),
    )
    return table(spark, d, "documents", heavy=True).select("doc_id", X.clean_restaurant(raw).alias("comment"))


@query(
    "min_length_gate", "landed",
    sql="""SELECT doc_id, source, count(*) AS kept FROM (SELECT doc_id, source, unnest(string_split(comment, ' ')) AS word FROM landed)
WHERE length(word) >= CASE source WHEN 'yahoo' THEN 6 WHEN '5ch' THEN 5 WHEN 'cosme' THEN 16 WHEN 'kakaku' THEN 21 WHEN 'tabelog' THEN 21 ELSE 0 END
GROUP BY 1, 2""",
)
def min_length_gate(spark, d):
    """Every word of every text as a comment, so that each source's threshold falls among them."""
    words = V.landed(spark, d).select("doc_id", "source", F.explode(F.split("comment", " ", -1)).alias("word"))
    kept = words.where(X.long_enough(F.col("source"), "word"))
    return kept.groupBy("doc_id", "source").agg(F.count("*").alias("kept"))


@query(
    "truncate_names",
    sql="SELECT doc_id, substring(text, 1, 60) AS name60, substring(text, 1, 80) AS name80, substring(text, 1, 320) AS card FROM documents",
)
def truncate_names(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        X.truncate("text", K.BEAUTY_NAME_CHARS).alias("name60"),
        X.truncate("text", K.PRICE_NAME_CHARS).alias("name80"),
        X.truncate("text", K.CARD_COMMENT_CHARS).alias("card"),
    )


@query("unicode_strip", sql=f"SELECT doc_id, {sql_strip('chr(12288) || chr(9) || text || chr(10) || chr(160)')} AS text FROM documents")
def unicode_strip(spark, d):
    return table(spark, d, "documents", heavy=True).select("doc_id", X.strip(F.concat(F.lit("　\t"), "text", F.lit("\n "))).alias("text"))


_RAW_LABEL = "CASE event_id % 9 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN 'POSITIVE' WHEN 4 THEN 'LABEL_0' WHEN 5 THEN 'LABEL_1' WHEN 6 THEN 'LABEL_2' WHEN 7 THEN 'neutral' ELSE 'Mixed' END"


def _raw_labels(spark, d):
    values = F.array(*[F.lit(v) for v in ("0", "1", "2", "POSITIVE", "LABEL_0", "LABEL_1", "LABEL_2", "neutral", "Mixed")])
    raw = F.get(values, (F.col("event_id") % 9).cast("int"))
    return table(spark, d, "events").select("event_id", raw.alias("raw"), (F.col("value") / 491).alias("score"))


@query(
    "label_normalise_a",
    sql=f"""SELECT event_id, CASE raw WHEN '0' THEN 'negative' WHEN '1' THEN 'neutral' WHEN '2' THEN 'positive' ELSE lower(raw) END AS sentiment,
round(value / 491, 4) AS score FROM (SELECT *, {_RAW_LABEL} AS raw FROM events)""",
)
def label_normalise_a(spark, d):
    return _raw_labels(spark, d).select("event_id", L.normalise("raw").alias("sentiment"), L.round_score("score").alias("score"))


@query(
    "label_normalise_b",
    sql=f"""SELECT event_id, CASE raw WHEN '0' THEN 'negative' WHEN '1' THEN 'positive' WHEN 'LABEL_0' THEN 'negative'
WHEN 'LABEL_1' THEN 'neutral' WHEN 'LABEL_2' THEN 'positive' ELSE lower(raw) END AS sentiment FROM (SELECT *, {_RAW_LABEL} AS raw FROM events)""",
)
def label_normalise_b(spark, d):
    return _raw_labels(spark, d).select("event_id", L.normalise("raw", K.BENCHMARK_LABELS).alias("sentiment"))


# --- links and blocks -------------------------------------------------------------------------
# The pages hold none of the sites' classes, so these pass general patterns.

_LINKS = r"""links AS (
SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
       unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
       CAST(generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) - 1 AS INTEGER) AS pos
FROM pages),
resolved AS (SELECT page_id, pos, regexp_extract(page_url, '^(https?://[^/]+)', 1) || href AS href, trim(text) AS text FROM links)
"""


@query(
    "page_links",
    sql="WITH " + _LINKS + """SELECT page_id, pos, href AS url, trim(text) AS title FROM links WHERE trim(text) <> ''
QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""",
)
def page_links(spark, d):
    return E.news_links(table(spark, d, "pages", heavy=True), where=F.lit(True))


@query(
    "thread_links",
    sql="WITH " + _LINKS + """, t AS (SELECT page_id, pos, 'https://a.5ch.net/test/read.cgi/' || substring(href, 2) AS href, trim(text) AS title
  FROM links WHERE page_id % 3 = 1 AND href LIKE '/%' AND trim(text) <> '')
SELECT page_id, pos, href AS url, title FROM t QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""",
)
def thread_links(spark, d):
    """Links of a forum search: a third of the pages have the forum's host and path, another third its host alone."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("/", "https://a.5ch.net/test/read.cgi/", "https://a.5ch.net/list/")]), (F.col("page_id") % 3 + 1).cast("int"))
    pages = table(spark, d, "pages", heavy=True)
    return E.thread_links(pages.withColumn("html", F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), kind))))


@query(
    "page_links_first_three",
    sql="WITH " + _LINKS + """, kept AS (SELECT page_id, pos, href AS url, trim(text) AS title FROM links WHERE trim(text) <> ''
  QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3""",
)
def page_links_first_three(spark, d):
    return E.news_links(table(spark, d, "pages", heavy=True), limit=3, where=F.lit(True))


@query(
    "links_per_search",
    sql="WITH " + _LINKS + """SELECT lang AS keyword, page_id, pos, href FROM links
  JOIN (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages) USING (page_id)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY page_id, pos) <= 25""",
)
def links_per_search(spark, d):
    pages = table(spark, d, "pages", heavy=True)
    lang = pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("keyword"))
    found = E.links(pages).join(lang, "page_id")
    capped = E.cap_per_search(found, 25, search=["keyword"], order=("page_id", "pos"))
    return capped.select("keyword", "page_id", "pos", "href")


_LAST_TEXT = """, firsts AS (
  SELECT page_id, min(pos) OVER (PARTITION BY page_id, href) AS pos, href, last_value(text) OVER (PARTITION BY page_id, href ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text, pos AS own FROM resolved WHERE {where})
"""


@query(
    "product_links",
    sql="WITH " + _LINKS + _LAST_TEXT.format(where=r"regexp_matches(href, '/[^/]{4,}$') AND NOT contains(href, '/review') AND NOT contains(href, '/photo') AND NOT contains(href, '/qa')")
    + "SELECT page_id, pos, href AS url, substring(coalesce(nullif(text, ''), split_part(href, '/', -2)), 1, 60) AS name FROM firsts WHERE own = pos",
)
def product_links(spark, d):
    return E.product_links(table(spark, d, "pages", heavy=True), href_pattern=r"/[^/]{4,}$")


@query(
    "item_links",
    sql="WITH " + _LINKS + _LAST_TEXT.format(where=r"regexp_matches(href, 'example\.(?:com|org|net)/(..)')")
    + r""", items AS (SELECT *, regexp_extract(href, 'example\.(?:com|org|net)/(..)', 1) AS item_id FROM firsts WHERE own = pos)
SELECT page_id, pos, item_id, 'https://shop.example/' || item_id || '/' AS url, coalesce(nullif(substring(text, 1, 80), ''), item_id) AS name
FROM items QUALIFY row_number() OVER (PARTITION BY page_id, item_id ORDER BY pos) = 1""",
)
def item_links(spark, d):
    """Items are known by two letters of the link, so several links of a page share an item."""
    return E.item_links(
        table(spark, d, "pages", heavy=True), id_pattern=r"example\.(?:com|org|net)/(..)", url_form="https://shop.example/{id}/"
    )


@query(
    "restaurant_links",
    sql="WITH " + _LINKS + """SELECT page_id, pos, href AS url FROM resolved JOIN (SELECT page_id, pos, href AS written FROM links) USING (page_id, pos)
WHERE contains(written, 'e') AND contains(written, '/') AND regexp_matches(href, '/[^/]*n[^/]*$')
QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""",
)
def restaurant_links(spark, d):
    return E.restaurant_links(table(spark, d, "pages", heavy=True), parts=("e", "/"), href_pattern=r"/[^/]*n[^/]*$")


@query(
    "brand_fallback",
    sql="WITH " + _LINKS + r"""SELECT page_id, arg_min(href, pos) FILTER (regexp_matches(href, '/[^/]{2}$')) AS url FROM resolved GROUP BY page_id
HAVING count(*) FILTER (regexp_matches(href, '/(de|la|the)$')) = 0 AND count(*) FILTER (regexp_matches(href, '/[^/]{2}$')) > 0""",
)
def brand_fallback(spark, d):
    return E.brand_fallback(table(spark, d, "pages", heavy=True), product_pattern=r"/(de|la|the)$", brand_pattern=r"/[^/]{2}$")


def sql_unescape(e):
    for entity, character in (("quot", '"'), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        e = f"regexp_replace({e}, '&{entity};?', '{character}', 'g')"
    return e


# An unclosed <p> runs on to the end of the article and so holds the later ones as well.
_PARAGRAPHS = (
    r"""WITH parts AS (
SELECT page_id, string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:] AS segs FROM pages),
numbered AS (SELECT page_id, unnest(segs) AS seg, unnest(segs[1:]) AS s, segs, generate_subscripts(segs, 1) AS i FROM parts),
texts AS (SELECT page_id, i, array_to_string(list_transform(
    regexp_split_to_array(CASE WHEN contains(seg, '</p>') THEN seg ELSE array_to_string(segs[i:], '<p>') END, '<[^>]*>'),
    lambda t: """ + sql_strip(sql_unescape("t")) + r"""), '') AS text FROM numbered)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, """ + sql_strip("text") + r""" AS comment FROM texts
WHERE length(""" + sql_strip("text") + """) > 5"""
)


@query("page_blocks", sql=_PARAGRAPHS)
def page_blocks(spark, d):
    found = E.comment_blocks(table(spark, d, "pages", heavy=True), "yahoo", (Select("block", ("p",)),))
    return found.select("page_id", "pos", "comment")


_AD = r"""regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)"""
_AD_RAW = "trim(regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1, 's'))"
_AD_TEXT = sql_strip(rf"regexp_replace({sql_unescape(_AD)}, '[ \t\n\r\f]+', ' ', 'g')")


@query(
    "review_blocks",
    sql=f"SELECT page_id, comment FROM (SELECT page_id, {_AD_TEXT} AS comment FROM pages WHERE contains(html, '<div class=\"ad\">')) WHERE length(comment) > 20",
)
def review_blocks(spark, d):
    spec = (Select("block", ("div",), ("ad",), token=True, rendered=True),)
    return E.comment_blocks(table(spark, d, "pages", heavy=True), "kakaku", spec).select("page_id", "comment")


@query(
    "review_blocks_beauty",
    sql=f"SELECT page_id, comment FROM (SELECT page_id, {_AD_TEXT} AS comment FROM pages WHERE contains(html, '<div class=\"ad\">')) WHERE length(comment) > 15",
)
def review_blocks_beauty(spark, d):
    """Two selects that fit the same element give one block."""
    spec = (Select("block", classes=("ad",), rendered=True), Select("block", ("div",), ("ad",), token=True, rendered=True))
    return E.comment_blocks(table(spark, d, "pages", heavy=True), "cosme", spec).select("page_id", "comment")


_H1 = r"regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
_H1_TEXT = sql_strip(rf"regexp_replace({sql_unescape(_H1)}, '[ \t\n\r\f]+', ' ', 'g')")
_TITLE_TEXT = sql_strip(rf"regexp_replace({sql_unescape(_H1.replace('h1', 'title'))}, '[ \t\n\r\f]+', ' ', 'g')")


@query("product_names", sql=f"SELECT page_id, url, substring(coalesce(nullif({_H1_TEXT}, ''), split_part(url, '/', -2)), 1, 60) AS name FROM pages")
def product_names(spark, d):
    return E.product_names(table(spark, d, "pages", heavy=True))


@query(
    "item_names",
    sql=f"""SELECT page_id, url, coalesce(nullif(substring({sql_strip(f"regexp_replace({_TITLE_TEXT}, ' [^ ]*$', '')")}, 1, 80), ''), split_part(url, '/', -2)) AS name FROM pages""",
)
def item_names(spark, d):
    return E.item_names(table(spark, d, "pages", heavy=True), tail=r" [^ ]*$")


@query("restaurant_names", sql=f"SELECT page_id, url, substring({_H1_TEXT}, 1, 60) AS name FROM pages")
def restaurant_names(spark, d):
    return E.restaurant_names(table(spark, d, "pages", heavy=True), (Select("name", ("h1", "h2"), rendered=True),))


@query(
    "restaurant_reviews",
    sql=f"""SELECT url AS restaurant_url, substring({_H1_TEXT}, 1, 60) AS restaurant_name, {_AD_TEXT} AS comment FROM pages
WHERE contains(html, '<div class="ad">') AND length({_AD_TEXT}) > 20""",
)
def restaurant_reviews(spark, d):
    pages = table(spark, d, "pages", heavy=True)
    blocks = (Select("block", ("div",), ("ad",), token=True, rendered=True),)
    return E.named_reviews(pages, "tabelog", selects=blocks, names=(Select("name", ("h1", "h2"), rendered=True),))


@query(
    "restaurant_reviews_unclosed",
    sql=f"""SELECT url AS restaurant_url, substring({_H1_TEXT}, 1, 60) AS restaurant_name, {_AD_TEXT} AS comment FROM pages, (VALUES (1), (2)) n(i)
WHERE contains(html, '<div class="ad">') AND length({_AD_TEXT}) > 20""",
)
def restaurant_reviews_unclosed(spark, d):
    """The same text as two list items, the first one never closed: each is a review of its own."""
    pages = table(spark, d, "pages", heavy=True)
    item = r'<ul><li class="ad">$1<li class="ad">$1</ul>'
    pages = pages.withColumn("html", F.regexp_replace("html", '(?s)<div class="ad">(.*?)</div>', item))
    blocks = (Select("block", ("li",), ("ad",), token=True, rendered=True),)
    return E.named_reviews(pages, "tabelog", selects=blocks, names=(Select("name", ("h1", "h2"), rendered=True),))


@query(
    "named_news_comments",
    sql=f"""SELECT 'https://news.example/' || page_id AS article_url, CASE WHEN page_id % 3 <> 0 THEN 'item ' || page_id ELSE substring({_H1_TEXT}, 1, 60) END AS article_title,
  {_AD_RAW} AS comment FROM pages WHERE contains(html, '<div class="ad">') AND length({_AD_RAW}) > 5""",
)
def named_news_comments(spark, d):
    """News comments carry the address and title of their article, not of the comment page."""
    pages = table(spark, d, "pages", heavy=True)
    article = F.concat(F.lit("https://news.example/"), F.col("page_id").cast("string"))
    items = pages.select(article.alias("url"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("item "), F.col("page_id").cast("string"))).alias("name"))
    comments = pages.withColumn("url", F.concat(article, F.lit("/comments")))
    return landing.records("yahoo", comments, items, selects=(Select("block", ("div",), ("ad",), token=True),), names=(Select("name", ("h1",)),))


_SITE_BLOCKS = {  # a page's block in each site's own form
    "yahoo": f'<p class="{K.NEWS_COMMENT_CLASS}-10 x">$1</p>',
    "cosme": '<div class="review-sec"><div class="x body">$1</div></div>',
    "kakaku": f'<div class="x {K.PRICE_REVIEW_CLASS}">$1</div>',
    "tabelog": f'<div class="{K.RESTAURANT_REVIEW_CLASS}">$1</div>',
}
_LANDED_PAGES = "\n".join(
    f"UNION ALL SELECT '{source}', url, {text} FROM pages WHERE contains(html, '<div class=\"ad\">') AND length({text}) >= {K.MIN_COMMENT_CHARS[source]}"
    for source, text in (("yahoo", _AD_RAW), ("cosme", _AD_TEXT), ("kakaku", _AD_TEXT), ("tabelog", _AD_TEXT))
)


@query(
    "pages_to_landing", "tweets",
    sql=""", t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
posts AS (SELECT doc_id, unnest(ls) AS l FROM t),
texts AS (SELECT 'twitter' AS source, NULL AS url, text AS comment FROM tweets """ + _LANDED_PAGES + """),
landed AS (SELECT source, url, comment FROM texts UNION ALL SELECT '5ch', 'https://t/' || doc_id, l FROM posts WHERE length(trim(l)) >= 5)
SELECT source, CASE WHEN source <> 'twitter' THEN url END AS url, count(*) AS n,
  CASE WHEN source NOT IN ('twitter', '5ch') THEN string_agg(comment, '|' ORDER BY comment) END AS comments FROM landed GROUP BY 1, 2""",
)
def pages_to_landing(spark, d):
    """All six sources through one plan into the landing folder, the pages' blocks in each site's classes."""
    path = scratch_path(spark, "landing")
    pages = table(spark, d, "pages")
    block = r'(?s)<div class="ad">(.*?)</div>'
    fetched = {s: (pages.withColumn("html", F.regexp_replace("html", block, own)), None) for s, own in _SITE_BLOCKS.items()}
    threads = table(spark, d, "documents").select(
        F.concat(F.lit("https://t/"), F.col("doc_id").cast("string")).alias("thread_url"),
        F.col("source").alias("thread_title"),
        F.regexp_replace("text", r"(?d)(^|\n)([^\n])", "$1name<>sage<>2024<>$2").alias("content"),
    )
    landing.pages_to_landing({**fetched, "5ch": (threads, None), "twitter": (V.tweets(spark, d), V.users(spark, d))}, path)
    found = None
    for source, names in K.CANONICAL_NAMES.items():
        url = next((name for name, common in names.items() if common == "article_url"), "article_url")
        url = F.lit(None).cast("string") if source == "twitter" else F.col(url)
        rows = read_landing(spark, path, source).select(F.lit(source).alias("source"), url.alias("url"), "comment")
        found = rows if found is None else found.unionByName(rows)
    of_page = ~F.col("source").isin("twitter", "5ch")  # a page's comments are few
    counted = found.groupBy("source", "url").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(of_page, F.col("comment")))).alias("all"))
    return counted.select("source", "url", "n", F.when(of_page, F.array_join("all", "|")).alias("comments"))


# --- forum ------------------------------------------------------------------------------------
# Every document is a thread, every line of it a post; blank lines lack the fields.

_THREADS = r"""WITH threads AS (SELECT doc_id, regexp_replace(text, '(^|\n)([^\n])', '\1name<>sage<>2024<>\2', 'g') AS content FROM documents),
posts AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS post_number FROM (SELECT doc_id, """ + sql_lines("content") + """ AS ls FROM threads)),
cut AS (SELECT doc_id, CAST(post_number AS INTEGER) AS post_number, string_split(line, '<>') AS f FROM posts)
"""


@query(
    "forum_posts",
    sql=_THREADS + f"""SELECT * FROM (SELECT doc_id, post_number, {sql_strip("replace(f[4], ',', ' ' || chr(38))")} AS comment FROM cut WHERE len(f) >= 4)
WHERE length(comment) >= 5 AND NOT regexp_full_match(comment, '[>0-9\\s]+')""",
)
def forum_posts(spark, d):
    """Commas are stored as an entity behind a blank, which the text has to get back."""
    threads = table(spark, d, "documents", heavy=True).select(
        "doc_id",
        F.replace(
            F.regexp_replace("text", r"(?d)(^|\n)([^\n])", "$1name<>sage<>2024<>$2"), F.lit(","), F.lit(" &amp;")
        ).alias("content"),
    )
    return forum.parse_posts(threads).select("doc_id", "post_number", "comment")


@query(
    "dat_url",
    sql="""SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'https://' || lang || '.5ch.net/' || source || '/dat/' || doc_id || '.dat' END AS url FROM documents""",
)
def dat_url(spark, d):
    i = F.col("doc_id").cast("string")
    host = F.when(F.col("doc_id") % 4 == 0, ".example.net").otherwise(".5ch.net")
    thread = F.concat(F.lit("https://"), "lang", host, F.lit("/test/read.cgi/"), "source", F.lit("/"), i, F.lit("/l50"))
    return table(spark, d, "documents").select("doc_id", forum.dat_url(thread).alias("url"))


@query(
    "shift_jis_decode",
    sql=r"SELECT conv_id, turn, 'テスト' || regexp_replace(text, '[^\x20-\x7e]', '?', 'g') AS content FROM conversations",
)
def shift_jis_decode(spark, d):
    ascii_only = F.regexp_replace("text", r"[^\x20-\x7e]", "?")
    raw = F.concat(F.lit("テスト".encode("shift_jis")), ascii_only.cast("binary"))
    return forum.decode_threads(table(spark, d, "conversations").select("conv_id", "turn", raw.alias("content")))


# --- tweets and targets -----------------------------------------------------------------------


@query(
    "tweet_select", "tweets",
    sql="SELECT tweet_id, author_id FROM tweets WHERE contains(text, 'que') AND lang = 'ja' AND NOT is_retweet",
)
def tweet_select(spark, d):
    return tweets.select_tweets(V.tweets(spark, d), "que").select("tweet_id", "author_id")


@query(
    "tweet_author_lookup", "tweets",
    sql="""SELECT 'https://twitter.com/i/web/status/' || tweet_id AS tweet_url, coalesce(c_name, CAST(author_id AS VARCHAR)) AS author, text AS comment
FROM tweets LEFT JOIN customer ON c_custkey = author_id""",
)
def tweet_author_lookup(spark, d):
    return tweets.with_author(V.tweets(spark, d), V.users(spark, d))


@query("tweets_newest", "tweets", sql="SELECT tweet_id FROM tweets ORDER BY tweet_id DESC LIMIT 100")
def tweets_newest(spark, d):
    return tweets.first_tweets(V.tweets(spark, d), 100).select("tweet_id")


_ENCODED = "replace(replace(c_name || ' ' || c_mktsegment || ' 任天堂/~*', ' ', '%20'), '#', '%23')"


@query(
    "fetch_targets",
    sql=f"""WITH k AS (SELECT c_name || ' ' || c_mktsegment || ' 任天堂/~*' AS keyword,
  replace({_ENCODED}, '任天堂/~*', '%E4%BB%BB%E5%A4%A9%E5%A0%82/~%2A') AS q FROM customer)
SELECT keyword, source, replace(replace(form, '{{q}}', q), '{{raw}}', keyword) AS url FROM k, (VALUES
 ('yahoo', 'https://news.yahoo.co.jp/search?p={{q}}&ei=UTF-8'), ('5ch', 'https://search.5ch.net/index.php?q={{q}}&type=subject'),
 ('cosme', 'https://www.cosme.net/search/?fw={{q}}'), ('kakaku', 'https://search.kakaku.com/{{q}}/'),
 ('tabelog', 'https://tabelog.com/rstLst/?vs=1&sk={{raw}}&sw={{raw}}')) AS t(source, form)""",
)
def fetch_targets(spark, d):
    keyword = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" 任天堂/~*"))
    return E.search_targets(table(spark, d, "customer").select(keyword.alias("keyword")))


@query(
    "comment_targets", "landed",
    sql="""SELECT doc_id, CASE source WHEN 'yahoo' THEN article_url || '/comments' WHEN 'cosme' THEN article_url || '/review/'
 WHEN 'tabelog' THEN article_url || '/dtlrvwlst/' WHEN 'kakaku' THEN 'https://review.kakaku.com/review/K' || doc_id || '/' ELSE article_url || '//' END AS url FROM landed""",
)
def comment_targets(spark, d):
    item = F.concat(F.lit("https://kakaku.com/item/K"), F.col("doc_id").cast("string"), F.lit("/?x=1"))
    url = F.when(F.col("source") == "kakaku", item).otherwise(F.concat("article_url", F.lit("//")))
    return V.landed(spark, d).select("doc_id", E.comment_target(F.col("source"), url).alias("url"))
