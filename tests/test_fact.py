"""The fact table's runs: named when done, with key filters and cubes beside the rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentilake import schemas as S
from sentilake.functions import bloom
from sentilake.operators import dedup as D
from sentilake.operators import panels as P
from sentilake.plans import ingest as I
from sentilake.plans import reports
from sentilake.plans.review_round import review_round
from sentilake.sources import fact as FT
from sentilake.sources import tables as T
from sentilake.streaming import monitor as M

DAY = dt.date(2024, 3, 1)


def scorer(df, text):
    n = F.length(text)
    label = F.when(n % 3 == 0, "positive").when(n % 3 == 1, "negative").otherwise("neutral")
    return df.select(*df.columns, label.alias("label"), F.round((n % 21) / 20, 4).alias("score"))


def batch(spark, texts, source="yahoo"):
    return spark.createDataFrame([(f"u{i}", "t", t, source) for i, t in enumerate(texts)], S.CANONICAL)


def comments(df):
    return sorted((r.comment for r in df.select("comment").collect()), key=str)


def cells(cube):
    return sorted((str((r.keyword, r.source, r.scraped_date, r.sentiment, r.score_bin)), r.n_rows, round(r.score_sum or 0, 6), r.score_rows) for r in cube.collect())


class Stopped(Exception):
    pass


@pytest.fixture(autouse=True)
def filters_of_any_table(monkeypatch):
    """Small tables ask their filters too."""
    monkeypatch.setattr(FT, "FILTER_FROM", 0)


@pytest.fixture
def stopping(monkeypatch):
    """Lets the next run stop once its files are written and before they are named."""
    name = FT.FactFiles._name

    def stop(self, spark, files):
        monkeypatch.setattr(FT.FactFiles, "_name", name)
        raise Stopped

    return lambda: monkeypatch.setattr(FT.FactFiles, "_name", stop)


def test_a_stopped_run_shows_nothing_and_its_replay_adds_each_row_once(spark, tmp_path, stopping):
    store = FT.FactFiles(str(tmp_path / "fact"))
    I.ingest(batch(spark, ["one", "two", "two"]), store, "k", DAY, scorer)
    before = cells(store.cube(spark))
    stopping()
    with pytest.raises(Stopped):
        I.ingest(batch(spark, ["two", "three", "four", "four"]), store, "k", DAY + dt.timedelta(1), scorer, run="second")
    assert len(list((tmp_path / "fact" / "files").iterdir())) == 2  # written, not named
    assert comments(store.read(spark)) == ["one", "two", "two"] and cells(store.cube(spark)) == before
    assert not store.finished(spark, "second")
    assert store.known(spark, D.keys_of(batch(spark, ["three", "two"]))).count() == 1
    for _ in range(2):  # the replay, and a replay of what is finished
        added = I.ingest(batch(spark, ["two", "three", "four", "four"]), store, "k", DAY + dt.timedelta(1), scorer, run="second")
        assert comments(added) == ["four", "four", "three"]
    assert comments(store.read(spark)) == ["four", "four", "one", "three", "two", "two"]
    assert cells(store.cube(spark)) == cells(P.summary_cube(store.read(spark)))


def test_a_stopped_stream_goes_on_where_it_was(spark, rows, tmp_path, stopping):
    landing, fact, state = (str(tmp_path / n) for n in ("landing", "fact", "state"))
    for i in range(3):
        T.write_landing(rows([(f"u{i}{j}", "t", f"c {i * 2 + j}") for j in range(4)], S.NEWS_COMMENT), landing, "yahoo")

    def go():
        stream = M.landing_stream(spark, landing, ["yahoo"], files_per_batch=1)
        M.monitor(stream, fact, state, "k", DAY, scorer).awaitTermination()

    stopping()
    with pytest.raises(Exception, match="Stopped"):
        go()
    assert T.read_fact(spark, fact).isEmpty()
    go()
    assert comments(T.read_fact(spark, fact)) == sorted(f"c {i}" for i in range(8))
    assert {r.run.split(" ")[0] for r in FT.FactFiles(fact).manifest(spark).collect()} == {M.identity(spark, state)}


def test_a_file_that_is_not_named_is_not_read(spark, tmp_path):
    store = FT.FactFiles(str(tmp_path / "fact"))
    store.append(I.new_rows(batch(spark, ["a", "b"]), None, "k", DAY, scorer))
    folder = next((tmp_path / "fact" / "files").iterdir()) / f"scraped_date={DAY}"
    part = next(folder.glob("*.parquet"))
    (folder / "part-of-a-late-task.parquet").write_bytes(part.read_bytes())
    assert comments(store.read(spark)) == ["a", "b"]


def test_a_run_without_rows_is_finished(spark, tmp_path):
    store = FT.FactFiles(str(tmp_path / "fact"))
    run = store.append(I.new_rows(batch(spark, []), None, "k", DAY, scorer), "none")
    assert store.finished(spark, run) and store.read(spark).isEmpty() and store.cube(spark).isEmpty()
    assert store.known(spark, D.keys_of(batch(spark, ["x"]))).isEmpty()


def test_filters_hold_every_key_and_few_others(spark):
    keys = spark.range(9000).select(F.expr("unhex(sha2(cast(id as string), 256))").alias("k"), (F.col("id") % 3).alias("day"))
    sized = keys.withColumn("blocks", F.lit(bloom.blocks_for(3000)))
    filters = bloom.build(sized, "k", "day").collect()
    assert {r.blocks for r in filters} == {2} and len(filters) == 6
    other = spark.range(9000, 40_000).select(F.expr("unhex(sha2(cast(id as string), 256))").alias("k"), F.lit(0).alias("day"))
    table = spark.createDataFrame(filters)

    def passing(probe):
        met = probe.withColumn("block", bloom.block_of("k", F.lit(2))).join(table, ["day", "block"])
        return met.where(bloom.may_hold("bits", F.col("k"))).count()

    assert passing(keys) == 9000
    assert passing(other) < 40


def test_known_keys_against_a_plain_join(spark, tmp_path, monkeypatch):
    store = FT.FactFiles(str(tmp_path / "fact"))
    for day in range(4):
        texts = [f"c{i}" for i in range(day * 500, day * 500 + 2000)] + ["viral"] * 300
        rows = I.new_rows(batch(spark, texts), None, "k", DAY + dt.timedelta(day), scorer)
        store.append(rows.withColumn("scraped_date", F.when(F.col("comment") != "c7", F.col("scraped_date"))))
    new = D.keys_of(batch(spark, [f"c{i}" for i in range(1000, 6000)] + ["viral", "c7", None]))
    want = {bytes(r[0]) for r in new.join(store.read(spark).select(D.KEY), D.KEY, "left_semi").collect()}
    for limit, least in ((FT.FILTER_BLOCKS, 0), (0, 0), (0, 10**6)):
        monkeypatch.setattr(FT, "FILTER_BLOCKS", limit)
        monkeypatch.setattr(FT, "FILTER_FROM", least)
        got = [bytes(r[0]) for r in store.known(spark, new).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) == 2502


def test_a_large_batch_does_not_shuffle_every_stored_key(spark, tmp_path):
    store = FT.FactFiles(str(tmp_path / "fact"))
    store.append(I.new_rows(batch(spark, [f"c{i}" for i in range(20_000)]), None, "k", DAY, scorer))
    new = D.keys_of(batch(spark, [f"c{i}" for i in range(19_900, 50_000)]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.known(spark, new)
        assert found.count() == 100
        plan = found._jdf.queryExecution().executedPlan()
        counted = written_rows(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert counted and max(counted) < 1000  # of 20,000 stored and 30,100 new keys


def written_rows(plan):
    """Records that each exchange of an executed plan wrote."""
    out, seen = [], [plan]
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            seen.append(node.plan())
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
        metrics = node.metrics()
        if name == "ShuffleExchangeExec" and metrics.contains("shuffleRecordsWritten"):
            out.append(metrics.apply("shuffleRecordsWritten").value())
    return out


def test_deltas_of_runs_equal_a_cube_from_scratch(spark, tmp_path):
    store = FT.FactFiles(str(tmp_path / "fact"))
    for i in range(3):
        texts = [f"text {'x' * (j % 17)} {j}" for j in range(i * 20, i * 20 + 40)]
        I.ingest(batch(spark, texts, ("yahoo", "cosme")[i % 2]), store, f"k{i % 2}", DAY + dt.timedelta(i), scorer)
    assert cells(store.cube(spark)) == cells(P.summary_cube(store.read(spark)))


def test_counts_of_a_report_scan_no_comment(spark, tmp_path):
    store = FT.FactFiles(str(tmp_path / "fact"))
    for i in range(2):
        I.ingest(batch(spark, [f"t{'x' * j} {i}" for j in range(30)], ("yahoo", "cosme")[i]), store, f"k{i}", DAY + dt.timedelta(i), scorer)
    fact, cube = store.read(spark), store.cube(spark)
    stored = reports.analysis_report(fact, "All", cube=cube)
    scanned = reports.analysis_report(fact, "All")
    assert set(stored) == set(scanned) and {"trend", "alert", "sources", "scores"} <= set(stored)
    for name in set(stored) - {"cards", "table"}:
        read = stored[name].inputFiles()
        assert read and all("/fact/cube/" in f for f in read), name
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, scanned[name].collect())), name
    both = reports.compare_report(fact, cube=cube)
    assert sorted(both) == ["distribution", "summary", "trend"]
    assert all("/fact/cube/" in f for p in both.values() for f in p.inputFiles())


def test_corrections_are_negative_counts(spark, tmp_path):
    store = FT.FactFiles(str(tmp_path / "fact"))
    added = I.ingest(batch(spark, ["aa", "bbb", "cccc", "dddddd"]), store, "k", DAY, scorer)
    decisions = spark.createDataFrame([("bbb", "n"), ("aa", ""), ("dddddd", "n")], "comment string, decision string")
    review_round(added, decisions, str(tmp_path / "labelled"), fact=store)
    corrected = {r.comment: r.sentiment for r in added.collect()} | {"bbb": "negative", "dddddd": "negative"}
    counts = {s: sum(v == s for v in corrected.values()) for s in ("positive", "neutral", "negative")}
    row = P.kpi_row(store.cube(spark)).first()
    assert {s: row[f"n_{s}"] for s in counts} == counts and row.total == 4
    assert all(r.n_rows > 0 for r in store.cube(spark).collect())
    assert comments(store.read(spark)) == ["aa", "bbb", "cccc", "dddddd"]
