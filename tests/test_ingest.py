"""Collect, drop known, score, append; review rounds; the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentilake import schemas as S
from sentilake.operators import dedup as D
from sentilake.operators import skew
from sentilake.operators.review import pending
from sentilake.operators.scoring import batch_scorer, classify, classify_one
from sentilake.plans import ingest as I
from sentilake.plans.review_round import review_round
from sentilake.sources import tables as T
from sentilake.streaming import monitor as M

DAY = dt.date(2024, 3, 1)
SAMPLE = [
    ("https://example.com/1", "記事1", "値段のわりに良い作りだと思う", "yahoo"),
    ("https://example.com/2", "記事2", "可もなく不可もない感じ", "yahoo"),
    ("https://example.com/3", "記事3", "届いた品が最悪の状態だった", "yahoo"),
]


def scorer(df, text):
    label = F.when(F.col(text).contains("良い"), "positive").when(F.col(text).contains("最悪"), "negative").otherwise("neutral")
    return df.select(*df.columns, label.alias("label"), F.lit(0.9).alias("score"))


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(SAMPLE, S.CANONICAL)


def test_run_writes_and_reruns_without_growth(spark, sample, tmp_path):
    fact = str(tmp_path / "fact")
    assert I.ingest(sample, fact, "花王", DAY, scorer).count() == 3
    assert I.ingest(sample, fact, "花王", DAY, scorer) is None
    stored = T.read_fact(spark, fact)
    assert stored.count() == 3
    assert {"comment", "sentiment", "score"} <= set(stored.columns)
    assert {r.sentiment for r in stored.collect()} == {"positive", "neutral", "negative"}
    assert {(r.keyword, r.scraped_date) for r in stored.collect()} == {("花王", DAY)}


def test_other_brand_does_not_store_a_known_comment(spark, sample, tmp_path):
    fact = str(tmp_path / "fact")
    I.ingest(sample, fact, "a", DAY, scorer)
    assert I.ingest(sample, fact, "b", DAY, scorer) is None


def test_copies_in_one_batch_stay_unless_asked(spark, sample, tmp_path):
    twice = sample.union(sample)
    assert I.ingest(twice, str(tmp_path / "a"), "k", DAY, scorer).count() == 6
    assert I.ingest(twice, str(tmp_path / "b"), "k", DAY, scorer, once_per_comment=True).count() == 3


@pytest.mark.parametrize("hot_rows", [1, None])
def test_null_comments_match_each_other(rows, hot_rows):
    new, known = rows([("x",), (None,), ("x",)], "comment string"), rows([(None,), ("z",)], "comment string")
    assert [r.comment for r in D.drop_known(new, known, hot_rows=hot_rows).collect()] == ["x", "x"]


def test_drop_known_with_a_hot_text_equals_brute_force(rows, spark):
    texts = ["viral"] * 400 + [f"t{i % 50}" for i in range(300)] + ["fresh"] * 300
    new = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, comment string").repartition(9)
    stored = [f"t{i}" for i in range(0, 50, 2)] + ["viral"] * 100
    known = rows([(t,) for t in stored], "comment string")
    want = sorted(i for i, t in enumerate(texts) if t not in set(stored))
    for hot in (None, 2, 350, 10_000):
        assert sorted(r.id for r in D.drop_known(new, known, hot_rows=hot).collect()) == want
        marked = {r.id: r.is_known for r in D.mark_known(new, known, hot_rows=hot).collect()}
        assert marked == {i: t in set(stored) for i, t in enumerate(texts)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_unique_equals_plain_join(rows, how):
    left = rows([(i, "hot" if i % 3 else f"k{i}") for i in range(90)] + [(99, None)], "i int, k string").repartition(5)
    right = rows([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    got = skew.join_unique(left, right, "k", how, min_rows=10)
    want = left.join(right, "k", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_more_hot_keys_than_a_thousand(spark):
    left = spark.range(5000).select(F.col("id"), (F.col("id") % 1250).alias("k"))
    assert skew.hot_keys(left, "k", 4).count() == 1250
    right = spark.range(0, 1250, 2).select(F.col("id").alias("k"))
    assert skew.join_unique(left, right, "k", "left_anti", min_rows=4).count() == 2500


def test_bucketed_store_is_not_shuffled_and_the_batch_read_once(spark, tmp_path):
    store = T.FactTable("fact_plan_test", 4, str(tmp_path / "fact"))
    batch = spark.createDataFrame([("u", "t", f"c{i}", "yahoo") for i in range(30)], S.CANONICAL)
    I.ingest(batch, store, "k", DAY, scorer)
    batch.write.parquet(str(tmp_path / "batch"))
    again = spark.read.parquet(str(tmp_path / "batch"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = D.drop_known(again, store.read(spark), bucketed=True)
        assert left.count() == 0
        plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE fact_plan_test")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 2


def test_top_per_group_equals_brute_force(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("g"), F.pmod(F.hash("id"), F.lit(17)).alias("v"))
    data = [tuple(r) for r in df.collect()]
    want = sorted(
        (g, rank, i) for g in (0, 1) for rank, (_, i) in enumerate(sorted((v, i) for i, gg, v in data if gg == g)[:7], 1)
    )
    got = skew.top_per_group(df, "g", [F.col("v"), F.col("id")], 7, spread="id")
    assert sorted((r.g, r["rank"], r.id) for r in got.collect()) == want


def test_collect_routes_and_renames(rows):
    frames = {
        "yahoo": rows([("u1", "t1", "c1")], S.NEWS_COMMENT),
        "cosme": rows([("u2", "t2", "c2")], S.PRODUCT_REVIEW),
        "5ch": rows([("u3", "t3", 4, "c3")], S.FORUM_POST),
    }
    everything = I.collect(frames, "all")
    assert everything.columns == S.CANONICAL.names
    assert sorted(r.source for r in everything.collect()) == ["cosme", "yahoo"]
    assert [tuple(r) for r in I.collect(frames, "5ch").collect()] == [("u3", "t3", "c3", "5ch")]
    assert I.collect({}, "all") is None
    with pytest.raises(ValueError):
        I.routed("elsewhere")


def test_nothing_landed_is_an_empty_run(spark, tmp_path):
    assert I.run(spark, str(tmp_path / "none"), str(tmp_path / "fact"), "k", "all", DAY, scorer) is None


def test_csv_with_mark_line_ends_and_quotes(spark, tmp_path):
    file = tmp_path / "f.csv"
    file.write_text('comment,sentiment,score\n"二行\nの ""文"", です",positive,0.5\nNA,neutral,\n', encoding="utf-8-sig")
    got = T.read_fact_csv(spark, str(file))
    assert got.columns == S.FACT.names
    assert [(r.comment, r.sentiment, r.score) for r in got.collect()] == [('二行\nの "文", です', "positive", 0.5), ("NA", "neutral", None)]


def test_csv_over_several_files(spark, tmp_path):
    data = [(f"c{i}", "" if i % 3 == 0 else None if i % 3 == 1 else 'x "y",\nz', float(i)) for i in range(30)]
    df = spark.createDataFrame(data, "comment string, article_title string, score double")
    T.write_csv(df.repartition(4), str(tmp_path / "csv"), bom=True)
    got = T.read_fact_csv(spark, str(tmp_path / "csv")).select("comment", "article_title", "score").collect()
    # An empty field is a missing one, quoted or not.
    assert sorted(map(tuple, got), key=lambda r: r[2]) == [(c, t or None, s) for c, t, s in data]


def test_csv_keeps_white_space_and_refuses_another_header(spark, tmp_path):
    texts = ["  lead and trail  \n", " a,b ", "\tx", "\n\n y"]
    T.write_csv(spark.createDataFrame([(t,) for t in texts], "comment string"), str(tmp_path / "csv"), bom=True)
    assert sorted(r.comment for r in T.read_fact_csv(spark, str(tmp_path / "csv")).collect()) == sorted(texts)
    for name, head in (("a", "comment,label\nc,l\n"), ("b", "label,comment\nl,c\n")):
        (tmp_path / f"{name}.csv").write_text(head)
    with pytest.raises(Exception, match="(?i)header"):
        T.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], spark.createDataFrame([], "comment string, label string").schema).collect()


def test_a_stream_that_goes_on_asks_for_its_date(spark):
    from sentilake.streaming.monitor import monitor

    with pytest.raises(ValueError):
        monitor(None, "fact", "state", "k", DAY, scorer, available_now=False)


def test_benchmark_set(spark, tmp_path):
    file = tmp_path / "set.csv"
    file.write_text('text,label,notes\n良い,positive,"casual, short"\n悪い,negative,\n', encoding="utf-8")
    assert [tuple(r) for r in T.read_benchmark_csv(spark, str(file)).collect()] == [("良い", "positive", "casual, short"), ("悪い", "negative", None)]


def test_thread_files(spark, tmp_path):
    from sentilake.operators.forum import decode_threads, parse_posts

    (tmp_path / "1.dat").write_bytes("名無し<>sage<>2024<>とても美味しい店<>題\r\n名無し<><>2024<>また行きます！<>".encode("shift_jis"))
    posts = parse_posts(decode_threads(T.read_thread_files(spark, str(tmp_path))))
    assert [(r.post_number, r.comment) for r in posts.orderBy("post_number").collect()] == [(1, "とても美味しい店"), (2, "また行きます！")]


def test_bucketed_fact_table(spark, sample, tmp_path):
    store = T.FactTable("bucketed_fact", 4, str(tmp_path / "bucketed"))
    assert I.ingest(sample, store, "a", DAY, scorer).count() == 3
    more = sample.union(spark.createDataFrame([("u", "t", "新しい感想", "cosme")], S.CANONICAL))
    assert [r.comment for r in I.ingest(more, store, "b", DAY, scorer).collect()] == ["新しい感想"]
    assert store.read(spark).count() == 4
    plan = store.read(spark).select(D.KEY).distinct()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_required_columns(rows):
    with pytest.raises(ValueError, match="score"):
        pending(rows([("x", "y")], "comment string, sentiment string"), rows([], "comment string"))


def test_review_rounds(rows, spark, tmp_path):
    path = str(tmp_path / "labelled")
    predicted = rows([("a", "positive", 0.5), ("b", "negative", 0.5), ("c", "neutral", 0.5), ("d", "neutral", 0.5)], "comment string, sentiment string, score double")
    decisions = rows([("a", ""), ("b", " P "), ("c", "s"), ("d", "?")], "comment string, decision string")
    first = review_round(predicted, decisions, path)
    assert sorted((r.comment, r.human_label) for r in first["decided"].collect()) == [("a", "positive"), ("b", "positive")]
    assert first["corrections"].first().error_rate == 50
    assert tuple(first["progress"].first()) == (4, 2, 2)
    second = review_round(predicted, rows([("c", "n"), ("a", "n")], "comment string, decision string"), path)
    assert [(r.comment, r.human_label) for r in second["decided"].collect()] == [("c", "negative")]
    assert [tuple(r) for r in second["distribution"].collect()] == [("positive", 2), ("negative", 1)]


def test_stream_equals_batch_and_replay_adds_nothing(rows, spark, tmp_path):
    landing, fact = str(tmp_path / "landing"), str(tmp_path / "fact")
    news = rows([(f"u{i}", "t", f"comment {i % 7}") for i in range(20)], S.NEWS_COMMENT)
    T.write_landing(news, landing, "yahoo")
    T.write_landing(news.limit(5), landing, "yahoo")

    def run(state):
        stream = M.landing_stream(spark, landing, ["yahoo"], files_per_batch=1)
        M.monitor(stream, fact, str(tmp_path / state), "k", DAY, scorer).awaitTermination()
        return sorted(r.comment for r in T.read_fact(spark, fact).collect())

    batch = I.ingest(I.canonical(news, "yahoo").select(*S.CANONICAL.names), str(tmp_path / "b"), "k", DAY, scorer, once_per_comment=True)
    want = sorted(r.comment for r in batch.collect())
    assert run("state") == want
    assert run("other-state") == want  # everything replayed from the start


def test_batch_scorer(spark, rows):
    def make_model():
        import numpy as np

        def predict(texts):
            return {"label": np.array(["2" if "良" in t else "0" for t in texts]), "score": np.full(len(texts), 0.123456)}

        return predict

    outside = batch_scorer(make_model)
    got = classify(rows([("良い",), ("",), (None,), ("長い" * 5000,)], "comment string"), outside).collect()
    assert [(r.sentiment, r.score) for r in got] == [("positive", 0.1235)] + [("negative", 0.1235)] * 3
    assert classify_one(spark, outside, "良い") == {"label": "2", "score": 0.1235}
