"""Links, names and text blocks from fetched pages.

Input is a table of pages (page_id, url, html). A site's links and blocks are `Select`s plus the native
expressions below; any other page layout passes its own.
"""

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentilake import constants as K
from sentilake.functions import text as X
from sentilake.functions.markup import Select, page_elements
from sentilake.operators.skew import top_per_group

PARSED_LINK = Select("link", ("a",), has_href=True)
RENDERED_LINK = Select("link", ("a",), has_href=True, rendered=True)


# --- links ------------------------------------------------------------------------------------


def links(pages: DataFrame, rendered=False) -> DataFrame:
    """Every link of every page: page_id, pos, href, text, written.

    `href` is the link as written, or as a browser resolves it against the page when `rendered`.
    """
    found = page_elements(pages, [RENDERED_LINK if rendered else PARSED_LINK])
    href = F.col("target" if rendered else "href").alias("href")
    return found.select("page_id", "pos", href, "text", F.col("href").alias("written"))


def first_links(found: DataFrame, limit: int | None = None) -> DataFrame:
    """First occurrence of each target on its page, in page order, `limit` per page.

    A page's links are brought together once; both windows use that placement.
    """
    first = W.partitionBy("page_id", "href").orderBy("pos")
    kept = found.repartition("page_id").withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1)
    return _cap(kept.drop("_first"), limit)


def last_text_links(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Each target once per page, at its first position but with the text of its last occurrence."""
    same = W.partitionBy("page_id", "href").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kept = (
        found.repartition("page_id")
        .withColumn("_first", F.min("pos").over(same))
        .withColumn("text", F.last("text").over(same))
        .where(F.col("pos") == F.col("_first"))
    )
    return _cap(kept.drop("_first"), limit)


def _cap(found: DataFrame, limit):
    if limit is None:
        return found
    order = W.partitionBy("page_id").orderBy("pos")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def news_links(pages: DataFrame, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Titled article links of a news search page."""
    wanted = F.col("href").contains(K.NEWS_LINK) if where is None else where
    found = first_links(links(pages).where(wanted & (F.col("text") != "")), limit)
    return found.select("page_id", "pos", F.col("href").alias("url"), F.col("text").alias("title"))


def thread_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Titled thread links of a forum search page."""
    wanted = F.col("href").contains(K.FORUM_LINK_HOST) & F.col("href").contains(K.FORUM_LINK_PATH)
    return news_links(pages, limit, wanted)


def product_links(
    pages: DataFrame, limit: int | None = None, href_pattern: str = K.BEAUTY_PRODUCT_LINK
) -> DataFrame:
    """Product links of a beauty site's page, named by link text or URL."""
    href = F.col("href")
    wanted = X.matches(href, href_pattern)
    for part in K.BEAUTY_LINK_EXCLUDES:
        wanted = wanted & ~href.contains(part)
    found = last_text_links(links(pages, rendered=True).where(wanted), limit)
    name = X.truncate(X.or_else("text", X.url_segment("href")), K.BEAUTY_NAME_CHARS)
    return found.select("page_id", "pos", href.alias("url"), name.alias("name"))


def brand_fallback(
    pages: DataFrame, product_pattern: str = K.BEAUTY_PRODUCT_LINK, brand_pattern: str = K.BEAUTY_BRAND_LINK
) -> DataFrame:
    """First brand link of each page that lists no product: the page to fetch next."""
    href = F.col("href")
    product = X.matches(href, product_pattern)
    for part in K.BEAUTY_LINK_EXCLUDES:
        product = product & ~href.contains(part)
    brand = X.matches(href, brand_pattern)
    return (
        links(pages, rendered=True)
        .where(product | brand)
        .groupBy("page_id")
        .agg(F.max(product).alias("_listed"), F.min_by(href, F.when(brand, F.col("pos"))).alias("url"))
        .where(~F.col("_listed") & F.col("url").isNotNull())
        .select("page_id", "url")
    )


def item_links(
    pages: DataFrame, limit: int | None = None, id_pattern: str = K.PRICE_ITEM_ID, url_form: str = K.PRICE_ITEM_URL
) -> DataFrame:
    """Item links of a price site's page: the first link of each item id, under its plain URL.

    Repeats of one target share the last text before ids are compared.
    """
    item = X.pattern(id_pattern)
    found = last_text_links(links(pages, rendered=True).where(F.col("href").rlike(item)))
    found = found.withColumn("item_id", F.regexp_extract("href", item, 1))
    first = W.partitionBy("page_id", "item_id").orderBy("pos")
    found = _cap(found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n"), limit)
    return found.select(
        "page_id",
        "pos",
        "item_id",
        F.replace(F.lit(url_form), F.lit("{id}"), F.col("item_id")).alias("url"),
        X.or_else(X.truncate("text", K.PRICE_NAME_CHARS), "item_id").alias("name"),
    )


def restaurant_links(
    pages: DataFrame, limit: int | None = None, parts=(K.RESTAURANT_LINK_HOST, K.RESTAURANT_LINK_AREA),
    href_pattern: str = K.RESTAURANT_LINK,
) -> DataFrame:
    """Restaurant links of a search page, each target once. `parts` must occur in the link as written."""
    href = F.col("href")
    wanted = X.matches(href, href_pattern)
    for part in parts:
        wanted = wanted & F.col("written").contains(part)
    found = first_links(links(pages, rendered=True).where(wanted), limit)
    return found.select("page_id", "pos", href.alias("url"))


def cap_per_search(found: DataFrame, limit: int, search=("keyword", "source"), order=("pos",)) -> DataFrame:
    """First `limit` finds of each search, over all of its pages."""
    return top_per_group(found, search, [F.col(c) for c in order], limit, spread=list(order), rank="_n").drop("_n")


# --- text blocks ------------------------------------------------------------------------------

NEWS_COMMENT = Select("block", ("p",), (K.NEWS_COMMENT_CLASS,), least=K.MIN_COMMENT_CHARS["yahoo"])
# The three layouts of a beauty review; an element that fits several is one block.
BEAUTY_REVIEW = (
    Select("block", classes=("body",), token=True, inside=("review-sec", "post-review"), rendered=True),
    Select("block", classes=("body",), inside=("review",), rendered=True),
)
PRICE_REVIEW = Select("block", classes=(K.PRICE_REVIEW_CLASS,), token=True, rendered=True)
RESTAURANT_REVIEW = Select("block", classes=(K.RESTAURANT_REVIEW_CLASS,), token=True, rendered=True)
# The element a restaurant's or product's name is read from.
RESTAURANT_NAME = (
    Select("name", ("h2",), ("rd-header__title-name",), token=True, rendered=True),
    Select("name", classes=("rdheader-restaurant__name",), token=True, rendered=True),
    Select("name", ("h1", "h2"), ("restaurant",), rendered=True),
)
PRODUCT_NAME = (
    Select("name", ("h1",), rendered=True),
    Select("name", classes=("product-name", "item-name"), rendered=True),
)
PAGE_TITLE = (Select("name", ("title",), rendered=True),)
BLOCK_SELECTS = {
    "yahoo": (NEWS_COMMENT,),
    "cosme": BEAUTY_REVIEW,
    "kakaku": (PRICE_REVIEW,),
    "tabelog": (RESTAURANT_REVIEW,),
}


def comment_blocks(pages: DataFrame, source: str, selects=None) -> DataFrame:
    """Cleaned comments of a source's comment pages that are long enough: page_id, page_url, pos, comment."""
    found = page_elements(pages, selects or BLOCK_SELECTS[source])
    kept = X.keep_where(found, "comment", X.clean_comment(source, "text"), lambda c: X.long_enough(source, c))
    return kept.select("page_id", "page_url", "pos", "comment")


# --- names ------------------------------------------------------------------------------------


def first_name(pages: DataFrame, selects, only_with: str | None = None) -> DataFrame:
    """Every page with the text of its first element among `selects`; null where there is none.

    `only_with` names an element a page must have, or its name is null as well.
    """
    found = page_elements(pages, selects, every_page=True)
    page = W.partitionBy("page_id")
    named = found.select("page_id", F.col("page_url").alias("url"), "pos", "tag", F.col("text").alias("found_name"))
    if only_with:
        has = F.max(F.col("tag") == only_with).over(page)
        named = named.withColumn("found_name", F.when(has, F.col("found_name")))
    first = page.orderBy("pos")
    return (
        named.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).select("page_id", "url", "found_name")
    )


def product_names(pages: DataFrame, selects=PRODUCT_NAME) -> DataFrame:
    """Heading of each product page, else its URL's last part."""
    name = X.truncate(X.or_else("found_name", X.url_segment("url")), K.BEAUTY_NAME_CHARS)
    return first_name(pages, selects, only_with="h1").select("page_id", "url", name.alias("name"))


def item_names(pages: DataFrame, selects=PAGE_TITLE, tail: str = K.PRICE_TITLE_TAIL) -> DataFrame:
    """Title of each item page without the site's tail, else its URL's last part."""
    name = X.truncate(X.strip(X.remove("found_name", tail)), K.PRICE_NAME_CHARS)
    return first_name(pages, selects).select("page_id", "url", X.or_else(name, X.url_segment("url")).alias("name"))


def restaurant_names(pages: DataFrame, selects=RESTAURANT_NAME) -> DataFrame:
    """Heading of each restaurant page, else its URL."""
    name = X.truncate(F.coalesce("found_name", "url"), K.RESTAURANT_NAME_CHARS)
    return first_name(pages, selects).select("page_id", "url", name.alias("name"))


NAME_SELECTS = {"yahoo": PAGE_TITLE, "cosme": PRODUCT_NAME, "kakaku": PAGE_TITLE, "tabelog": RESTAURANT_NAME}


def _page_name(source, text, url) -> Column:
    """A page's name from the element it is read from."""
    if source == "tabelog":
        return X.truncate(F.coalesce(text, url), K.RESTAURANT_NAME_CHARS)
    if source == "kakaku":
        name = X.truncate(X.strip(X.remove(text, K.PRICE_TITLE_TAIL)), K.PRICE_NAME_CHARS)
        return X.or_else(name, X.url_segment(url))
    return X.truncate(X.or_else(text, X.url_segment(url)), K.BEAUTY_NAME_CHARS)


def named_reviews(pages: DataFrame, source: str, items: DataFrame | None = None, selects=None, names=None) -> DataFrame:
    """Reviews with their page's name, in the source's landing columns. A page is parsed once for both.

    `items` (url, name) are the items that a search found: their comment pages' reviews then carry the item's address and
    its name, if it has one. Without them a review carries its own page's.
    """
    blocks, heads = selects or BLOCK_SELECTS[source], names or NAME_SELECTS[source]
    if not all(s.rendered for s in blocks):  # text pieces as parsed, for the name too: one way to read a page
        heads = tuple(replace(s, rendered=False) for s in heads)
    found = page_elements(pages, (*blocks, *heads))
    page = W.partitionBy("page_id").orderBy(F.col("part") != "name", "pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(F.when(F.col("part") == "name", F.col("text"))).over(page)
    read = found.withColumn("_name", first).where(F.col("part") == "block")
    kept = X.keep_where(read, "comment", X.clean_comment(source, "text"), lambda c: X.long_enough(source, c))
    kept = kept.select("page_url", "comment", _page_name(source, F.col("_name"), F.col("page_url")).alias("_name"))
    if items is not None:
        listed = items.select(F.col("url").alias("_url"), F.col("name").alias("_listed"), comment_target(F.lit(source), F.col("url")).alias("page_url"))
        listed = listed.groupBy("page_url").agg(F.min_by(F.struct("_url", "_listed"), "_url").alias("_item"))
        kept = kept.join(listed, "page_url", "left").select(
            F.coalesce("_item._url", "page_url").alias("page_url"), "comment", F.coalesce("_item._listed", "_name").alias("_name")
        )
    own = {common: name for name, common in K.CANONICAL_NAMES[source].items()}
    return kept.select(
        F.col("page_url").alias(own.get("article_url", "article_url")),
        F.col("_name").alias(own.get("article_title", "article_title")),
        "comment",
    )


# --- where to fetch next ----------------------------------------------------------------------


def search_targets(keywords: DataFrame, sources=None, keyword: str = "keyword") -> DataFrame:
    """One search URL per keyword and source."""
    sources = list(sources or K.SEARCH_URLS)
    forms = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(K.SEARCH_URLS[s]).alias("form")) for s in sources])
    q = X.percent_encode(keyword)
    return (
        keywords.select(F.col(keyword).alias("keyword"), F.explode(forms).alias("t"))
        .select("keyword", "t.source", "t.form")
        .withColumn("url", F.replace(F.replace("form", F.lit("{q}"), q), F.lit("{raw}"), F.col("keyword")))
        .select("keyword", "source", "url")
    )


def comment_target(source, url) -> Column:
    """Comment page of an item page, by source; the URL itself where the two are one."""
    plain = F.regexp_replace(url, "/+$", "")
    item = F.regexp_extract(url, X.pattern(K.PRICE_ITEM_ID), 1)
    target = F.when(source == "kakaku", F.replace(F.lit(K.PRICE_REVIEW_URL), F.lit("{id}"), item))
    for name, tail in K.COMMENT_URL_TAILS.items():
        target = target.when(source == name, F.concat(plain, F.lit(tail)))
    return target.otherwise(url)
