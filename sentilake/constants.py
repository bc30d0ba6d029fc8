"""Fixed values that decide results: vocabularies, patterns, thresholds, URL forms.

Everything here is data. Patterns are written for Python's regex rules; `functions.text.pattern`
adds the Java flags that make Spark read them the same way.
"""

# --- fixed values: sentiment vocabulary -------------------------------------------------------
POSITIVE = "positive"
NEUTRAL = "neutral"
NEGATIVE = "negative"
SENTIMENTS = (POSITIVE, NEUTRAL, NEGATIVE)

# Class ids used for training.
LABEL_TO_ID = {"negative": 0, "neutral": 1, "positive": 2}

# Raw model label -> class, for the ingest run. Anything else is lower-cased.
INGEST_LABELS = {"0": "negative", "1": "neutral", "2": "positive"}

# Raw model label -> class, for the model benchmark. "1" means positive here: its model has two classes.
BENCHMARK_LABELS = {
    "0": "negative",
    "1": "positive",
    "LABEL_0": "negative",
    "LABEL_1": "neutral",
    "LABEL_2": "positive",
    "negative": "negative",
    "neutral": "neutral",
    "positive": "positive",
}

# Reviewer keys. An empty decision agrees with the model.
REVIEW_KEYS = {"p": "positive", "n": "negative", "u": "neutral", "s": "skip"}

# --- fixed values: sources --------------------------------------------------------------------
# Sources that a run over "all" covers; the forum has to be asked for by name.
ALL_SOURCES = ("yahoo", "cosme", "tabelog", "kakaku", "twitter")
FORUM_SOURCE = "5ch"

# Landing column -> canonical column, by source.
CANONICAL_NAMES = {
    "yahoo": {},
    "5ch": {"thread_url": "article_url", "thread_title": "article_title"},
    "cosme": {"product_url": "article_url", "product_name": "article_title"},
    "kakaku": {"product_url": "article_url", "product_name": "article_title"},
    "tabelog": {"restaurant_url": "article_url", "restaurant_name": "article_title"},
    "twitter": {"tweet_url": "article_url", "author": "article_title"},
}

# Fewest characters a comment must have to be kept, by source. Tweets are not gated.
MIN_COMMENT_CHARS = {"yahoo": 6, "5ch": 5, "cosme": 16, "kakaku": 21, "tabelog": 21}

# --- fixed values: text patterns --------------------------------------------------------------
# Beauty reviews, applied in this order, each with "".
BEAUTY_RULES = (
    r"^\d+購入品リピート\s*",
    r"^\d+購入品\s*",
    r"^\d+モニター[^\n]*\n",
    r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s*",
    r"(?s)続きを読む.*$",
    r"(?s)購入場所.*$",
    r"(?s)効果.*$",
)

# Price-site reviews, applied in this order, each with "".
PRICE_RULES = (
    r"\d{4}年\d{1,2}月\d{1,2}日\s+\d{2}:\d{2}\s*\[[\d-]+\]\s*",
    r"(満足度|操作性|表現力|携帯性|機能性|デザイン|コストパフォーマンス|食事|サービス|雰囲気|コスパ)\s*[\t\n]+[\d\.]+\s*",
    r"(?m)^\d+(\.\d+)?\s*$",
)

# Restaurant reviews, each with "": the header rules, then the rating block, then the tail rules.
# A user block starts at a line's start or where the last one ended; saying so spares a search from
# every character.
RESTAURANT_HEADER_RULES = (
    r"^.{1,30}\n口コミ\S*\s*",
    r"(?m)(?:^|\G).+?口コミ\d+件\s*フォロワー\d+人\s*",
)
RESTAURANT_DETAIL = "詳細"
RESTAURANT_RATING = r"(?s)[\d.]+\s*[～￥\d,]+.*?詳細.*?(?=\d{4}/\d{2}訪問)"
RESTAURANT_TO_VISIT = r"(?s)\A.*?\d{4}/\d{2}訪問"
RESTAURANT_TAIL_RULES = (
    r"\d{4}/\d{2}訪問\s*\d+\s*回目\s*",
    r"(?s)\n(いいね|お店を保存|口コミを|写真を|もっと見る).*$",
)

# Forum: separator of a DAT line, fields it needs, and posts that only point at other posts.
DAT_SEPARATOR = "<>"
DAT_MIN_FIELDS = 4
ANCHOR_ONLY = r"\A[>0-9\s]+\z"
THREAD_URL = r"^(https://[\w-]+\.5ch\.net)/test/read\.cgi/([\w]+)/(\d+)"

# Price site: item id in a link, and the site's tail on a page title.
PRICE_ITEM_ID = r"kakaku\.com/item/(K\d+)/"
PRICE_ITEM_URL = "https://kakaku.com/item/{id}/"
PRICE_TITLE_TAIL = r"\s*-\s*価格\.com.*$"

TWEET_URL = "https://twitter.com/i/web/status/"

# --- fixed values: links and blocks -----------------------------------------------------------
NEWS_LINK = "news.yahoo.co.jp/articles/"
NEWS_COMMENT_CLASS = r"sc-169yn8p"
FORUM_LINK_HOST = "5ch.net"
FORUM_LINK_PATH = "/test/read.cgi/"
BEAUTY_PRODUCT_LINK = r"/products/\d+/$"
BEAUTY_LINK_EXCLUDES = ("/review", "/photo", "/qa")
BEAUTY_BRAND_LINK = r"/brands/\d+/$"
RESTAURANT_LINK_HOST = "tabelog.com"
RESTAURANT_LINK_AREA = "/A"
RESTAURANT_LINK = r"/\d{8}/$"
PRICE_REVIEW_CLASS = "reviewBoxWtInner"
RESTAURANT_REVIEW_CLASS = "js-rvw-item-clickable-area"

# --- fixed values: display limits -------------------------------------------------------------
BEAUTY_NAME_CHARS = 60
PRICE_NAME_CHARS = 80
RESTAURANT_NAME_CHARS = 60
SUMMARY_COMMENT_CHARS = 80
CARD_COMMENT_CHARS = 320
CARD_TITLE_CHARS = 70
CARD_SEPARATOR = "  ·  "
BAR_POINTS = 3
SUMMARY_TOP = 3
CARD_TOP = 5
SCORE_BINS = 20
DISPLAY_COLUMNS = ("article_title", "sentiment", "score", "comment", "source", "scraped_date")
DEFAULT_BRANDS = 4

# --- fixed values: statistics and training ----------------------------------------------------
ROLLING_DAYS = 7
ALERT_DAYS = 7
ALERT_POINTS = 10.0
VALIDATION_SHARE = 0.15
SPLIT_SEED = 42
SCORING_BATCH = 16
SCORING_CHARS = 200_000  # of a batch, padding included
SCORE_DECIMALS = 4

# --- fixed values: where to fetch -------------------------------------------------------------
# Search page by source; {q} is the percent-encoded keyword, {raw} the keyword as typed.
SEARCH_URLS = {
    "yahoo": "https://news.yahoo.co.jp/search?p={q}&ei=UTF-8",
    "5ch": "https://search.5ch.net/index.php?q={q}&type=subject",
    "cosme": "https://www.cosme.net/search/?fw={q}",
    "kakaku": "https://search.kakaku.com/{q}/",
    "tabelog": "https://tabelog.com/rstLst/?vs=1&sk={raw}&sw={raw}",
}

# What follows an item's URL (without its closing slashes) to reach its comments.
COMMENT_URL_TAILS = {"yahoo": "/comments", "cosme": "/review/", "tabelog": "/dtlrvwlst/"}
PRICE_REVIEW_URL = "https://review.kakaku.com/review/{id}/"
