"""Links, names and blocks on small hand-written pages; forum threads; tweets; fetch targets."""

import pytest
from pyspark.sql import functions as F

from sentilake.functions.markup import Select, page_elements
from sentilake.operators import extract as E
from sentilake.operators import forum, tweets

PAGE = "page_id long, url string, html string"


def collect(df, *columns, sort="pos"):
    return [tuple(r) for r in df.orderBy(sort).select(*columns).collect()]


def page(rows, html, url="https://www.example.jp/search/"):
    return rows([(1, url, html)], PAGE)


def test_news_links(rows):
    html = (
        '<a href="https://news.yahoo.co.jp/articles/1"><img></a><a href="https://news.yahoo.co.jp/articles/1"> 記事 <b>一</b></a>'
        '<a href="https://news.yahoo.co.jp/articles/2">二</a><a href="https://news.yahoo.co.jp/articles/2">again</a>'
        '<a href="/other">x</a><a>no link</a><a href="https://news.yahoo.co.jp/articles/3">三</a>'
    )
    got = collect(E.news_links(page(rows, html), limit=2), "url", "title")
    assert got == [("https://news.yahoo.co.jp/articles/1", "記事一"), ("https://news.yahoo.co.jp/articles/2", "二")]


def test_thread_links(rows):
    html = '<a href="https://a.5ch.net/test/read.cgi/b/1/">スレ</a><a href="https://a.5ch.net/b/">board</a>'
    assert collect(E.thread_links(page(rows, html)), "url") == [("https://a.5ch.net/test/read.cgi/b/1/",)]


def test_news_comments_nest_like_the_parser(rows):
    html = '<p class="sc-169yn8p-10 x">とても良い記事</p><p class="other">違うクラスの文章</p><p class="sc-169yn8p">短い</p>'
    got = collect(E.comment_blocks(page(rows, html), "yahoo"), "comment")
    assert got == [("とても良い記事",)]


def test_product_links_first_place_last_text(rows):
    html = (
        '<a href="/products/1/">古い名</a><a href="/products/2/"></a><a href="/products/1/review/">r</a>'
        '<a href="https://www.example.jp/products/1/">新しい名</a><a href="/products/x/">n</a>'
    )
    got = collect(E.product_links(page(rows, html)), "url", "name")
    assert got == [("https://www.example.jp/products/1/", "新しい名"), ("https://www.example.jp/products/2/", "2")]


def test_brand_fallback_only_without_products(rows):
    both = [
        (1, "https://c/", '<a href="/brands/5/">b</a><a href="/products/1/">p</a>'),
        (2, "https://c/", '<a href="/brands/x/">b</a><a href="/brands/7/">b</a><a href="/brands/8/">b</a>'),
        (3, "https://c/", "<p>none</p>"),
    ]
    assert collect(E.brand_fallback(rows(both, PAGE)), "page_id", "url", sort="page_id") == [(2, "https://c/brands/7/")]


def test_item_links_by_id(rows):
    html = (
        '<a href="https://kakaku.com/item/K0001234567/?x=1"> </a><a href="https://kakaku.com/item/K0001234567/">テレビ</a>'
        '<a href="https://kakaku.com/item/K2/">旧</a><a href="https://kakaku.com/item/K2/">新</a>'
    )
    got = collect(E.item_links(page(rows, html)), "item_id", "url", "name")
    assert got == [
        ("K0001234567", "https://kakaku.com/item/K0001234567/", "K0001234567"),
        ("K2", "https://kakaku.com/item/K2/", "新"),
    ]


def test_restaurant_links_need_the_written_host(rows):
    html = (
        '<a href="https://tabelog.com/tokyo/A1301/A130101/13000001/">a</a><a href="/tokyo/A1301/A130101/13000002/">b</a>'
        '<a href="https://tabelog.com/tokyo/A1301/">c</a><a href="https://tabelog.com/tokyo/A1301/A130101/13000001/">d</a>'
    )
    got = collect(E.restaurant_links(page(rows, html, "https://tabelog.com/rstLst/")), "url")
    assert got == [("https://tabelog.com/tokyo/A1301/A130101/13000001/",)]


def test_beauty_review_selects(rows):
    html = (
        '<div class="review-sec"><div class="body">7購入品 とてもしっとりして良い化粧水でした。続きを読む</div></div>'
        '<div class="body">a body outside of any section, left out</div>'
        '<section class="my-review-list"><div class="text-body">二つ目の口コミもなかなか良いと思います。</div></section>'
    )
    got = collect(E.comment_blocks(page(rows, html), "cosme"), "comment")
    assert got == [("とてもしっとりして良い化粧水でした。",), ("二つ目の口コミもなかなか良いと思います。",)]


def test_price_review_table_cells(rows):
    html = (
        '<div class="reviewBoxWtInner"><p>2026年2月13日 07:51 [2008939-1]</p><table><tr><td>満足度</td><td>5</td></tr></table>'
        "<p>画質がとても良くて大満足です。買ってよかったと思います。</p></div><div class='reviewBoxWtInner2'>x</div>"
    )
    got = collect(E.comment_blocks(page(rows, html), "kakaku"), "comment")
    assert got == [("画質がとても良くて大満足です。買ってよかったと思います。",)]


def test_restaurant_reviews_with_name(rows):
    html = (
        '<h2 class="rd-header__title-name"> モス 新宿店 </h2><div class="a js-rvw-item-clickable-area">グルメ<br>口コミ '
        "2024/10訪問 1 回目 ハンバーガーがとても美味しかったので、また行きたいです。<br>いいね 3</div>"
    )
    pages = page(rows, html, "https://tabelog.com/tokyo/A1/A2/13000001/dtlrvwlst/")
    got = E.named_reviews(pages, "tabelog").collect()
    assert [tuple(r) for r in got] == [
        ("https://tabelog.com/tokyo/A1/A2/13000001/dtlrvwlst/", "モス 新宿店", "ハンバーガーがとても美味しかったので、また行きたいです。")
    ]


def test_unclosed_items_are_separate_reviews(rows):
    long = "ハンバーガーがとても美味しかったので、また行きたいです"
    html = f'<ul><li class="js-rvw-item-clickable-area">{long}一<li class="js-rvw-item-clickable-area">{long}二</ul>'
    got = E.named_reviews(page(rows, html, "https://t/"), "tabelog").collect()
    assert sorted(r.comment for r in got) == sorted([f"{long}一", f"{long}二"])
    html = '<p class="body">' + '<p class="body">0123456789'.join([""] * 2000)
    got = page_elements(page(rows, html), (Select("block", ("p",), rendered=True),)).collect()
    assert sum(len(r.text) for r in got) <= len(html)


def test_noscript_counts_as_text_where_a_page_is_parsed(rows):
    pages = page(rows, "<p>a<noscript>b</noscript><script>c</script></p>")
    parsed, laid_out = (page_elements(pages, (Select("block", ("p",), rendered=r),)).first().text for r in (False, True))
    assert (parsed, laid_out) == ("ab", "a")


def test_news_reviews_carry_their_article(rows):
    pages = rows([(1, "https://n/a/comments", '<title>T</title><p class="sc-169yn8p-10">とても良い記事でした</p>')], "page_id long, url string, html string")
    items = rows([("https://n/a", "記事")], "url string, name string")
    from sentilake.operators.extract import NEWS_COMMENT

    cls = NEWS_COMMENT.classes[0]
    pages = pages.withColumn("html", F.regexp_replace("html", "sc-169yn8p-10", cls))
    assert [tuple(r) for r in E.named_reviews(pages, "yahoo", items).collect()] == [("https://n/a", "記事", "とても良い記事でした")]
    assert [tuple(r) for r in E.named_reviews(pages, "yahoo").collect()] == [("https://n/a/comments", "T", "とても良い記事でした")]


def test_names(rows):
    pages = rows(
        [
            (1, "https://kakaku.com/item/K1/", "<title>ソニー テレビ - 価格.com 比較</title><h1>見出し</h1>"),
            (2, "https://kakaku.com/item/K2/", "<div class='product-name'>no heading</div>"),
        ],
        PAGE,
    )
    assert collect(E.item_names(pages), "name", sort="page_id") == [("ソニー テレビ",), ("K2",)]
    assert collect(E.product_names(pages), "name", sort="page_id") == [("見出し",), ("K2",)]
    assert collect(E.restaurant_names(pages), "name", sort="page_id") == [("https://kakaku.com/item/K1/",), ("https://kakaku.com/item/K2/",)]


def test_deeply_unclosed_page(rows):
    html = "".join(f'<p class="sc-169yn8p"><b>段落その{i}番目' for i in range(3000))
    found = E.comment_blocks(page(rows, html), "yahoo")
    assert found.count() == 3000
    assert found.where("pos = 2999").first().comment == "段落その2999番目"
    assert found.where("pos = 2998").first().comment == "段落その2998番目段落その2999番目"


def test_hidden_text_and_broken_markup(rows):
    html = "<div class=js-rvw-item-clickable-area>これは<script>var x='</div>'</script>壊れた<b>タグ</i>のあるレビューです。まだ続きます。"
    assert collect(E.comment_blocks(page(rows, html), "tabelog"), "comment") == [("これは壊れたタグのあるレビューです。まだ続きます。",)]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://abc.5ch.net/test/read.cgi/news/123/", "https://abc.5ch.net/news/dat/123.dat"),
        ("https://a-b.5ch.net/test/read.cgi/news4vip/99/l50", "https://a-b.5ch.net/news4vip/dat/99.dat"),
        ("https://example.com/x", None),
        ("see https://abc.5ch.net/test/read.cgi/news/123/", None),
    ],
)
def test_dat_url(rows, url, want):
    assert rows([(url,)], "u string").select(forum.dat_url("u")).first()[0] == want


def test_posts_keep_physical_line_numbers(rows):
    dat = "\n".join(
        ["only<>three<>fields", "n<>e<>d<>とても良い<br>商品です<>題", "n<>e<>d<>&gt;&gt;12 <br>", "n<>e<>d<>短い", "n<>e<>d<>&gt;&gt;1 同意します"]
    )
    posts = forum.parse_posts(rows([("u", "t", dat)], "thread_url string, thread_title string, content string"))
    assert collect(posts, "post_number", "comment", sort="post_number") == [(2, "とても良い 商品です"), (5, ">>1 同意します")]


def test_tweets(rows):
    found = rows(
        [(1, 10, "任天堂 すごい", "ja", False, None), (2, 11, "任天堂", "ja", True, None), (3, 12, "任天堂", "en", False, None), (4, 13, "任天堂だ", "ja", False, None)],
        "tweet_id long, author_id long, text string, lang string, is_retweet boolean, created_at timestamp",
    )
    users = rows([(10, "mario")], "author_id long, username string")
    got = tweets.with_author(tweets.select_tweets(found, "任天堂"), users, hot_rows=1)
    assert collect(got, "tweet_url", "author", "comment", sort="tweet_url") == [
        ("https://twitter.com/i/web/status/1", "mario", "任天堂 すごい"), ("https://twitter.com/i/web/status/4", "13", "任天堂だ"),
    ]


def test_targets(rows):
    got = collect(E.search_targets(rows([("資生堂 水",)], "keyword string"), ["cosme", "tabelog"]), "source", "url", sort="source")
    assert got == [
        ("cosme", "https://www.cosme.net/search/?fw=%E8%B3%87%E7%94%9F%E5%A0%82%20%E6%B0%B4"),
        ("tabelog", "https://tabelog.com/rstLst/?vs=1&sk=資生堂 水&sw=資生堂 水"),
    ]
    urls = rows([("yahoo", "https://n/1/"), ("kakaku", "https://kakaku.com/item/K5/"), ("twitter", "t")], "s string, u string")
    assert collect(urls.select("s", E.comment_target(F.col("s"), F.col("u")).alias("t")), "t", sort="s") == [
        ("https://review.kakaku.com/review/K5/",), ("t",), ("https://n/1/comments",),
    ]


def test_a_page_of_unclosed_elements_takes_little_memory():
    """A thousand paragraphs, each holding all that follow: texts are cut from one buffer as their rows leave."""
    import time
    import tracemalloc

    from sentilake.functions import markup as M

    words = [f"{i} " + "word " * 25 for i in range(1000)]
    html = "".join(f"<p class=c>{w}" for w in words)
    start = time.process_time()
    page = M._Page((Select("block", ("p",), ("c",)),), "u")
    page.feed(html)
    page.close()
    stripped = [w.strip() for w in words]
    tracemalloc.start()
    total = 0
    for (_, pos, *_, text), first in zip(page.rows(), range(1000), strict=True):
        assert text == "".join(stripped[first:])
        total += len(text)
    assert total > 60_000_000 and tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()
    assert time.process_time() - start < 10


def test_short_elements_keep_their_place_and_give_no_row():
    from sentilake.functions import markup as M

    page = M._Page((Select("block", ("p",), least=4),), "u")
    page.feed("<p>one</p><p> four </p><p>\n ab <b> c </b></p><p>a<b>bc</b>d")
    page.close()
    assert [(r[1], r[6]) for r in page.rows()] == [(1, "four"), (3, "abcd")]
