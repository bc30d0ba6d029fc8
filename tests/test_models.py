"""Evaluation against hand-worked numbers, the split, the weights, and the default model."""

import pytest
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake.operators import evaluate as E
from sentilake.operators import scoring as S
from sentilake.operators import training as T
from sentilake.plans.model_benchmark import run_benchmark


@pytest.fixture
def long(rows):
    pairs = [("positive", "positive")] * 3 + [("positive", "negative")] + [("negative", "negative")] * 2 + [("neutral", "other")]
    return rows([("m", t, p) for t, p in pairs], "model string, true_label string, pred_label string")


def test_metrics(long):
    row = E.model_metrics(long).first()
    assert row.accuracy == pytest.approx(5 / 7)
    # negative 4/5, neutral 0, other 0, positive 6/7
    assert row.macro_f1 == pytest.approx((0.8 + 6 / 7) / 4)


def test_report(long):
    report = {r.label: r for r in E.class_report(long).collect()}
    assert (report["other"].precision, report["other"].recall, report["other"].support) == (0, 0, 0)
    assert report["negative"].precision == pytest.approx(2 / 3)
    assert report["accuracy"].f1 == pytest.approx(5 / 7)
    assert report["weighted avg"].recall == pytest.approx(5 / 7)
    assert report["macro avg"].support == 7


def test_confusion_grid_is_complete(long):
    grid = {(r.true_label, r.pred_label): r.n for r in E.confusion_grid(long).collect()}
    assert len(grid) == 16 and sum(grid.values()) == 7
    assert grid["positive", "negative"] == 1 and grid["other", "other"] == 0


def test_benchmark_ranks_models(rows):
    data = [("良い", " Positive"), ("悪い", "negative\n"), ("普通", "NEUTRAL"), (None, "positive"), ("x", None)]

    def perfect(df, text):
        label = F.when(F.col(text) == "良い", "LABEL_2").when(F.col(text) == "悪い", "LABEL_0").otherwise("LABEL_1")
        return df.select(*df.columns, label.alias("label"), F.lit(1.0).alias("score"))

    def constant(df, text):
        return df.select(*df.columns, F.lit("1").alias("label"), F.lit(1.0).alias("score"))

    def broken():
        raise OSError("weights missing")

    registry = {
        "constant": {"load": lambda: constant}, "perfect": {"load": lambda: perfect},
        "broken": {"load": broken}, "skipped": {"load": broken, "skip": True},
    }
    result = run_benchmark(rows(data, "text string, label string"), registry)
    ranking = [tuple(r) for r in result["ranking"].collect()]
    assert ranking == [("perfect", 1.0, 1.0), ("constant", 0.333, 0.167)]


def test_training_rows(rows):
    df = rows([("a", "positive"), ("b", "skip"), (None, "neutral"), ("c", None), ("d", "negative")], "comment string, human_label string")
    assert sorted((r.comment, r.label_id) for r in T.training_rows(df).collect()) == [("a", 2), ("d", 0)]


@pytest.mark.parametrize("n", [1, 3, 7, 100, 5000])
def test_split_takes_exact_shares_in_hash_order(spark, n):
    import hashlib

    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1).otherwise(2).alias("label_id"))
    got = {r.id for r in T.stratified_split(df.repartition(5), "id").where("is_validation").collect()}
    want = set()
    for c in range(3):
        ids = sorted((i for i in range(n) if i % 3 == c), key=lambda i: (hashlib.md5(f"42{i}".encode()).hexdigest(), i))
        want |= set(ids[: int(len(ids) * K.VALIDATION_SHARE + 0.5)])
    assert got == want
    assert T.stratified_split(df, "id").count() == n


def test_class_weights(rows):
    df = rows([(0,)] * 6 + [(1,)] * 3 + [(2,)] * 3, "label_id int")
    assert {r.label_id: r.weight for r in T.class_weights(df).collect()} == pytest.approx({0: 12 / 18, 1: 12 / 9, 2: 12 / 9})


@pytest.fixture(scope="module")
def fitted(spark):
    words = {0: ["がっかりした出来", "すぐ壊れて損をした", "もう買わない"], 1: ["可もなく不可もない", "ふつうの味", "まあまあかな"], 2: ["期待以上で嬉しい", "毎日使いたい", "とても気に入った"]}
    data = [(i * 3 + c, w + "。" * (i % 4), c) for i in range(12) for c, ws in words.items() for w in [ws[i % 3]]]
    df = spark.createDataFrame(data, "id long, comment string, label_id int")
    split = T.stratified_split(df, "id")
    return T.train(split, grid=[{"reg": 0.001}, {"reg": 10.0}], features=1 << 12, max_iter=20), split


def test_default_model(spark, fitted, tmp_path):
    (model, score, setting), split = fitted
    assert setting == {"reg": 0.001} and score > 0.9
    T.save_model(model, str(tmp_path / "model"))
    scorer = S.fitted_scorer(T.load_model(str(tmp_path / "model")))
    texts = ["期待以上で嬉しいし気に入った", "がっかりした、すぐ壊れて損をした", "気に入った。" * 1000, "", None]
    got = S.classify(spark.createDataFrame([(t,) for t in texts], "comment string"), scorer).collect()
    assert [r.sentiment for r in got[:2]] == ["positive", "negative"]
    assert len(got) == 5 and all(r.sentiment in K.SENTIMENTS and 0 <= r.score <= 1 for r in got)
    report = {r.label for r in T.validation_report(model, split).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= report


def test_batches_are_bounded_and_carry_their_rows(spark, tmp_path):
    """Sixteen very long texts and many short ones: batches stay within the bound, and each row has its own result."""
    lengths = [5000 + i for i in range(16)] + [i % 40 for i in range(300)]
    for rows, chars in ((16, 20_000), (7, None), (1, 10), (16, 1)):
        batches = list(S.length_batches(lengths, rows, chars))
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
        assert all(len(b) <= rows and (chars is None or len(b) == 1 or len(b) * max(lengths[i] for i in b) <= chars) for b in batches)
    seen = str(tmp_path / "seen")

    def make_model():
        import numpy as np

        def predict(texts):
            with open(seen, "a") as f:
                f.write(f"{len(texts)} {max(map(len, texts))}\n")
            return {"label": np.array([t[:3] or "none" for t in texts]), "score": np.array([len(t) / 10_000 for t in texts])}

        return predict

    data = [(i, f"{i:03d}" + "x" * (n - 3) if n > 3 else "") for i, n in enumerate(lengths)]
    got = S.classify(spark.createDataFrame(data, "id int, comment string").coalesce(1), S.batch_scorer(make_model, batch_chars=20_000)).collect()
    assert {r.id: (r.sentiment, r.score) for r in got} == {i: (t[:3] or "none", round(len(t) / 10_000, 4)) for i, t in data}
    sizes = [tuple(map(int, x.split())) for x in open(seen)]
    assert all(n <= 16 and (n == 1 or n * longest <= 20_000) for n, longest in sizes)
    assert sum(n for n, longest in sizes if longest >= 5000) == 16 and any(n == 16 for n, _ in sizes)


def test_models_that_fail_on_a_worker_are_left_out(rows):
    def good():
        import numpy as np

        return lambda texts: {"label": np.array(["2"] * len(texts)), "score": np.ones(len(texts))}

    def bad():
        raise OSError("no weights here")

    df = rows([(1, "a", "positive"), (2, None, "neutral")], "id int, text string, true_label string")
    registry = {"good": {"load": lambda: S.batch_scorer(good), "labels": K.INGEST_LABELS}, "bad": {"load": lambda: S.batch_scorer(bad)}}
    got = S.score_with_models(df, registry).collect()
    assert sorted((r.id, r.model, r.pred_label, r.score) for r in got) == [(1, "good", "positive", 1.0), (2, "good", "positive", 1.0)]
    with pytest.raises(ValueError, match="every model"):
        S.score_with_models(df, {"bad": registry["bad"]})
    with pytest.raises(Exception, match="no weights here"):
        S.classify(df.select("id", F.col("text").alias("comment")), S.batch_scorer(bad)).collect()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_grams_are_counted_as_by_hashing_tf(rows, monkeypatch, n):
    """The same vectors as from the arrays of grams that HashingTF takes, for characters of one to four bytes."""
    from pyspark.ml.feature import HashingTF

    monkeypatch.setattr(T, "PART", 40)
    texts = ["", "a", "ab", "Abab ABAB", "期待以上で嬉しい", "É𝄞x𝄞é\n𝄞", "\x00\x00b", "¤¤¤§ " * 50, "İI", None]
    df = rows([(i, t) for i, t in enumerate(texts)], "id int, _text string").coalesce(1)
    grams = F.expr(f"CASE WHEN length(t) >= {n} THEN transform(sequence(1, length(t) - {n - 1}), i -> substring(t, i, {n})) ELSE array() END")
    terms = df.select("id", F.lower(F.coalesce("_text", F.lit(""))).alias("t")).select("id", grams.alias("g"))
    want = {r.id: r.v for r in HashingTF(numFeatures=1 << 10, inputCol="g", outputCol="v").transform(terms).collect()}
    (stage,) = T.gram_stages(n, 1 << 10)
    assert {r.id: r._tf for r in stage.transform(df).collect()} == want
