"""Report panels where nulls, gaps and empty tables matter."""

import datetime as dt

import pytest

from sentilake.operators import annotations as A
from sentilake.operators import compare as C
from sentilake.operators import panels as P
from sentilake.operators import trends as R
from sentilake.plans.reports import analysis_report, compare_report
from sentilake.sources.annotations import read_annotations, write_annotations

FACT = "id long, keyword string, source string, scraped_date date, sentiment string, score double, comment string"


def day(n):
    return dt.date(2024, 1, n)


def fact(rows, data):
    return rows([(i, k, s, d and day(d), m, sc, f"c{i}") for i, (k, s, d, m, sc) in enumerate(data)], FACT)


def test_rolling_mean_skips_gaps(rows):
    data = [("a", "x", 1, "positive", 0.5)] + [("a", "x", 1, "neutral", 0.5)] * 9 + [("a", "x", 4, "positive", 0.5)] * 4 + [("a", "x", 4, "neutral", 0.5)] * 6
    trend = R.sentiment_trend(fact(rows, data)).where("sentiment = 'positive'").orderBy("scraped_date").collect()
    assert [(r.scraped_date.day, r.pct, r.rolling7) for r in trend] == [(1, 10, 10), (2, None, 10), (3, None, 10), (4, 40, 25)]


def test_gap_longer_than_the_window_is_null(rows):
    trend = R.brand_trend(fact(rows, [("a", "x", 1, "positive", 1.0), ("a", "x", 12, "negative", 1.0)])).orderBy("scraped_date").collect()
    assert [r.rolling7 for r in trend] == [100.0] * 7 + [None] * 4 + [0.0]


def test_absent_class_is_missing_in_one_trend_and_zero_in_the_other(rows):
    df = fact(rows, [("a", "x", 1, "positive", 1.0), ("a", "x", 2, "negative", 1.0), ("a", "x", 3, "positive", 1.0)])
    assert [r.pct for r in R.sentiment_trend(df).where("sentiment = 'positive'").orderBy("scraped_date").collect()] == [100, None, 100]
    assert [r.pct for r in R.brand_trend(df).orderBy("scraped_date").collect()] == [100, 0, 100]


def test_denominators_keep_null_sentiments(rows):
    df = fact(rows, [("a", "x", 1, None, 1.0), ("a", "x", 1, "positive", 1.0)])
    assert R.daily_shares(df).first().pct == 50
    assert P.kpi_row(df).first().pct_positive == 50


@pytest.mark.parametrize("last, alert", [("negative", "drop"), ("positive", "rise")])
def test_change_alert(rows, last, alert):
    first = "positive" if last == "negative" else "negative"
    df = fact(rows, [("a", "x", 1, first, 1.0), ("a", "x", 2, first, 1.0), ("a", "x", 9, last, 1.0), ("a", "x", None, last, 1.0)])
    row = R.change_alert(df).first()
    assert (row.cutoff, row.alert, abs(row.change)) == (day(2), alert, 100)


def test_change_alert_needs_both_periods(rows):
    assert R.change_alert(fact(rows, [("a", "x", 1, "positive", 1.0), ("a", "x", 5, "positive", 1.0)])).count() == 0


def test_summary_of_an_empty_table(rows):
    got = P.sentiment_summary(fact(rows, [])).orderBy("position").collect()
    assert [(r.sentiment, r.n, r.pct, r.bar) for r in got] == [("positive", 0, 0, ""), ("neutral", 0, 0, ""), ("negative", 0, 0, "")]


def test_top_comments_ties_nulls_and_buckets(rows):
    data = [("a", "x", 1, "positive", s) for s in (0.5, None, 0.9, 0.9, 0.1)] + [("a", "x", 1, "negative", 0.2)]
    got = P.top_comments(fact(rows, data), k=4).orderBy("sentiment", "rank").select("sentiment", "rank", "id").collect()
    assert [tuple(r) for r in got] == [("negative", 1, 5), ("positive", 1, 2), ("positive", 2, 3), ("positive", 3, 0), ("positive", 4, 4)]


def test_cube_gives_the_same_panels(rows, spark):
    from checks import views as V

    df = V.comments(spark, "/root/testdata/sf0.001")
    cube = P.summary_cube(df)
    for panel in (P.kpi_row, P.class_counts, P.score_histogram, P.source_breakdown, P.filtered_count, P.guards, R.sentiment_trend, R.brand_trend, R.change_alert):
        left, right = (sorted(map(str, panel(x).collect())) for x in (df, cube))
        assert left == right, panel.__name__


def test_shares_sum_to_hundred(rows, spark):
    from checks import views as V

    df = V.comments(spark, "/root/testdata/sf0.001").where("sentiment IN ('positive', 'neutral', 'negative')")
    shares = R.daily_shares(df).groupBy("scraped_date").sum("pct").collect()
    assert all(r[1] == pytest.approx(100) for r in shares)


def test_result_does_not_depend_on_partitions(rows, spark):
    from checks import views as V

    df = V.comments(spark, "/root/testdata/sf0.001")
    for panel in (P.top_comments, R.change_alert, C.brand_summary):
        assert sorted(map(str, panel(df.repartition(1)).collect())) == sorted(map(str, panel(df.repartition(7)).collect()))


def test_panels_tolerate_absent_columns(rows):
    df = fact(rows, [("a", "x", 1, "positive", 1.0)]).drop("score", "source", "scraped_date", "keyword")
    report = analysis_report(df)
    assert set(report) == {"kpis", "classes", "cards", "table", "shown"}
    assert report["table"].columns == ["sentiment", "comment"]
    assert [r.meta for r in report["cards"].collect()] == [""]
    assert compare_report(df) == {}


def test_report_wants_sentiment(rows):
    with pytest.raises(ValueError, match="sentiment"):
        analysis_report(rows([("x",)], "comment string"))


def test_comparison_wants_two_brands(rows):
    with pytest.raises(ValueError):
        C.select_brands(fact(rows, []), ["a"])


def test_annotation_edits(rows):
    notes = rows([("a", 0, day(1), "x"), ("a", 1, day(2), "y"), ("b", 0, day(3), "z")], "keyword string, idx int, date date, text string")
    deleted = A.list_annotations(A.delete_annotation(notes, 0, "a"))
    assert [tuple(r) for r in deleted.collect()] == [("a", 0, day(2), "y"), ("b", 0, day(3), "z")]
    added = A.add_annotation(A.add_annotation(notes, "b", "2024-02-01", "n"), "new", "2024-02-02", "first")
    assert [tuple(r)[:2] for r in A.list_annotations(added).collect()] == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("new", 0)]
    assert A.add_annotation(notes, "a", "2024-01-01", "") is notes


def test_annotations_file(rows, spark, tmp_path):
    file = tmp_path / "annotations.json"
    file.write_text('{\n  "任天堂": [{"date": "2024-01-01", "text": "発売"}, {"date": "2024-01-05", "text": "値下げ"}],\n  "b": []\n}', encoding="utf-8")
    notes = read_annotations(spark, str(file))
    assert [tuple(r) for r in A.list_annotations(notes).collect()] == [("任天堂", 0, day(1), "発売"), ("任天堂", 1, day(5), "値下げ")]
    write_annotations(notes, str(tmp_path / "out"))
    assert sorted(map(str, read_annotations(spark, str(tmp_path / "out")).collect())) == sorted(map(str, notes.collect()))
    many = rows([(f"b{i % 7}", i // 7, day(1), f"n{i}\n") for i in range(70)], "keyword string, idx int, date date, text string")
    for single in (False, True):
        write_annotations(many.coalesce(1), str(tmp_path / f"many{single}"), single=single)
        assert sorted(map(str, read_annotations(spark, str(tmp_path / f"many{single}")).collect())) == sorted(map(str, many.collect()))
    file.write_text('{"a": [{"date": ')
    with pytest.raises(Exception, match="no JSON map"):
        read_annotations(spark, str(file)).collect()
    assert read_annotations(spark, str(tmp_path / "none")).count() == 0


def test_notes_after_a_log_of_edits(rows, spark):
    """Against a list that is edited step by step."""
    import random

    from sentilake.operators import annotations as A

    rnd = random.Random(2)
    log, lists = [], {"a": [("2024-01-01", "first")], "b": []}
    notes = rows([("a", 0, "2024-01-01", "first")], "keyword string, idx int, d string, text string").selectExpr("keyword", "idx", "to_date(d) AS date", "text")
    for seq in range(80):
        key = rnd.choice("aab")
        if rnd.random() < 0.6:
            text = rnd.choice(["", None, f"note {seq}", f"note {seq}"])
            log.append((key, seq, "add", "2024-02-01", text, None))
            lists[key] += [("2024-02-01", text)] if text else []
        else:
            at = rnd.randint(-1, 5)
            log.append((key, seq, "delete", None, None, at))
            if 0 <= at < len(lists[key]):
                del lists[key][at]
    rnd.shuffle(log)
    got = A.replay(rows(log, "keyword string, seq int, op string, date string, text string, position int"), notes)
    want = sorted((k, i, d, t) for k, held in lists.items() for i, (d, t) in enumerate(held))
    assert sorted((r.keyword, r.idx, str(r.date), r.text) for r in got.collect()) == want
