"""Cleaning rules and scalar functions on golden cases, and against Python's own regex rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake.functions import labels as L
from sentilake.functions import text as X
from sentilake.functions.markup import decode_shift_jis, fragment_text


def apply(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_beauty(spark):
    raw = ["7購入品 2024/01/02 03:04:05 とても良い 続きを読む…", "12購入品リピート　しっとり\n購入場所 薬局", "3モニター abc\n良い効果がある", "７購入品 全角"]
    assert apply(spark, raw, X.clean_beauty) == ["とても良い", "しっとり", "良い", "全角"]


def test_clean_price(spark):
    raw = ["2026年2月13日 07:51 [2008939-1]\n満足度\t5\n良い", "コスパ\n4.5\n\n 音が良い　\n３\n重い"]
    assert apply(spark, raw, X.clean_price) == ["良い", "音が良い\n重い"]


def test_clean_restaurant(spark):
    raw = [
        "グルメgirl\n口コミ 最高でした\n2024/10訪問 1 回目 美味しい\nいいね 3",
        "太郎 口コミ12件 フォロワー3人 4.0 ～￥999 1人 詳細 料理・味 4.2 2024/10訪問 2 回目 うまい",
    ]
    assert apply(spark, raw, X.clean_restaurant) == ["最高でした\n美味しい", "うまい"]


def python_restaurant(raw):
    """The restaurant rules as plain Python substitutions, one after the other."""
    rules = [
        (r"^.{1,30}\n口コミ\S*\s*", 0), (r".+?口コミ\d+件\s*フォロワー\d+人\s*", 0), (K.RESTAURANT_RATING, 0),
        *[(r, 0) for r in K.RESTAURANT_TAIL_RULES],
    ]
    for rule, flags in rules:
        raw = re.sub(rule, "", raw, flags=flags)
    return raw.strip()


def python_price(raw):
    for rule in K.PRICE_RULES:
        raw = re.sub(rule, "", raw)
    lines = [line.strip() for line in raw.splitlines()]
    return "\n".join(line for line in lines if line).strip()


def python_beauty(raw):
    for rule in K.BEAUTY_RULES:
        raw = re.sub(rule, "", raw)
    return raw.strip()


PIECES = [
    "口コミ", "12件", "フォロワー3人", "詳細", "2024/10訪問", " 1 回目 ", "4.0", "～￥999", "\n", "　", " ", "いいね", "名前",
    "購入品", "リピート", "モニター", "続きを読む", "購入場所", "効果", "2024/01/02 03:04:05", "満足度\t5", "コスパ", "3", "3.5", "\t",
    "2026年2月13日 07:51 [2008939-1]", "良い", "a\rb", "\x0b", "\x85", " ", "７", "もっと見る", ".", ",",
]


@pytest.mark.parametrize(
    "native, plain", [(X.clean_beauty, python_beauty), (X.clean_price, python_price), (X.clean_restaurant, python_restaurant)]
)
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=200, max_size=200))
def test_cleaning_equals_python_rules(spark, native, plain, batch):
    assert apply(spark, batch, native) == [plain(raw) for raw in batch]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=st.lists(st.text(st.sampled_from("a 　\t\n\x0b\x1c\x1f\x85\xa0 ​ ."), max_size=8), min_size=50, max_size=80))
def test_strip_and_lines_equal_python(spark, batch):
    assert apply(spark, batch, X.strip) == [v.strip() for v in batch]
    split = apply(spark, batch, lambda c: F.filter(X.lines(c), lambda line: line != ""))
    assert split == [[line for line in v.splitlines() if line] for v in batch]


def test_min_length_counts_characters(spark):
    assert apply(spark, ["あいうえお", "あいうえおか", "💖💖💖💖💖"], lambda c: X.long_enough("yahoo", c)) == [False, True, False]
    assert apply(spark, ["", "x"], lambda c: X.long_enough("twitter", c)) == [True, True]


def test_percent_bar_and_empty_total(spark):
    row = spark.range(1).select(
        X.percent(F.lit(1), F.lit(3)).alias("a"), X.percent(F.lit(0), F.lit(0)).alias("b"), X.percent_bar(F.lit(33.4)).alias("c")
    ).first()
    assert row.a == pytest.approx(100 / 3) and row.b == 0 and row.c == "█" * 11


def test_card_fields(spark):
    df = spark.createDataFrame([(None, "製品", "cosme"), ("", None, "yahoo"), ("記事", "x", None)], "t string, p string, s string")
    title = X.card_title("t", "p")
    got = [tuple(r) for r in df.select(title, X.card_meta("s", title)).collect()]
    assert got == [("製品", "cosme  ·  製品"), ("", "yahoo"), ("記事", "  ·  記事")]


def test_percent_encode_keeps_path_characters(spark):
    from urllib.parse import quote

    values = ["任天堂", "a b/c~d*e+f%g", "モス&バーガー", ""]
    assert apply(spark, values, X.percent_encode) == [quote(v) for v in values]


@pytest.mark.parametrize(
    "raw, want",
    [("positive", "positive"), ("neutral", "neutral"), ("negative", "negative"), ("0", "negative"), ("1", "neutral"),
     ("2", "positive"), ("POSITIVE", "positive"), ("NEGATIVE", "negative"), ("UNKNOWN", "unknown")],
)
def test_ingest_labels(spark, raw, want):
    assert apply(spark, [raw], L.normalise) == [want]


def test_benchmark_labels_are_their_own(spark):
    got = apply(spark, ["0", "1", "2", "LABEL_0", "LABEL_1", "LABEL_2", "Neutral"], lambda c: L.normalise(c, K.BENCHMARK_LABELS))
    assert got == ["negative", "positive", "2", "negative", "neutral", "positive", "neutral"]


def test_label_ids_round_trip(spark):
    assert apply(spark, list(K.LABEL_TO_ID), lambda c: L.id_label(L.label_id(c))) == list(K.LABEL_TO_ID)


def test_fragment_text(spark):
    got = apply(spark, ["a <br> b", "&gt;&gt;12 ", "x<!-- c -->y", "<script>z</script>ok", "plain", None], fragment_text)
    assert got == ["a   b", ">>12 ", "x y", "ok", "plain", None]


def test_shift_jis(spark):
    raw = ["モスバーガー".encode("shift_jis"), b"\x83", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, b binary").orderBy("i")
    assert [r[0] for r in df.select(decode_shift_jis(F.col("b"))).collect()] == ["モスバーガー", "�", None]
