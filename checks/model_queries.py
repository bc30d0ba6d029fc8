"""Scoring, evaluation and training, over `documents` and `labels`."""

import numpy as np
from pyspark.sql import functions as F

from checks import views as V
from checks.catalog import query
from checks.views import SQL_LABEL, SQL_SCORE, table
from sentilake import constants as K
from sentilake.operators import evaluate as E
from sentilake.operators import scoring as S
from sentilake.operators import training as T
from sentilake.plans.model_benchmark import run_benchmark
from sentilake.session import scratch_path
from sentilake.sources import tables as IO

# --- scoring ----------------------------------------------------------------------------------


def length_model():
    """Loader of an outside model: texts in, arrays of labels and scores out. Nested, so that it goes with the task."""

    def load():
        def predict(texts):
            n = np.array([len(t) for t in texts])
            return {"label": np.select([n < 400, n < 1500], ["0", "1"], "2"), "score": n / (n + 1000.0)}

        return predict

    return load


@query(
    "batch_scoring",
    sql=f"SELECT doc_id, {SQL_LABEL.format('text')} AS sentiment, {SQL_SCORE.format('text')} AS score FROM documents",
)
def batch_scoring(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("comment"))
    return S.classify(docs, S.batch_scorer(length_model())).select("doc_id", "sentiment", "score")


@query(
    "batch_scoring_by_length",
    sql=f"SELECT doc_id, {SQL_LABEL.format('text')} AS sentiment, {SQL_SCORE.format('text')} AS score FROM documents",
)
def batch_scoring_by_length(spark, d):
    """The same through small batches: a text of more than 3000 characters is a batch of its own, ids are carried."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("comment"))
    return S.classify(docs, S.batch_scorer(length_model(), batch_size=5, batch_chars=3000)).select("doc_id", "sentiment", "score")


@query("classify_single_texts", sql=f"SELECT item_id, {SQL_LABEL.format('text')} AS sentiment, {SQL_SCORE.format('text')} AS score FROM benchmark")
def classify_single_texts(spark, d):
    """Each benchmark text classified by itself; the outside model sees one text at a time."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("comment"))
    return S.classify(items, S.batch_scorer(length_model(), batch_size=1)).select("item_id", "sentiment", "score")


def _shout_scorer(df, text):
    mark = F.when(F.col(text).contains("!"), "LABEL_2").when(F.col(text).contains("?"), "LABEL_0").otherwise("LABEL_1")
    return df.select(*df.columns, mark.alias("label"), F.lit(0.5).alias("score"))


def _broken():
    raise RuntimeError("no weights")


def _broken_on_workers():
    raise RuntimeError("no weights on this worker")


def _broken_on_a_text():
    """Loader of a model that cannot take texts of more than 2000 characters."""

    def load():
        def predict(texts):
            if any(len(t) > 2000 for t in texts):
                raise ValueError("a long text")
            return {"label": np.full(len(texts), "1"), "score": np.full(len(texts), 0.5)}

        return predict

    return load


REGISTRY = {
    "length": {"load": lambda: V.length_scorer, "labels": K.INGEST_LABELS},
    "batched": {"load": lambda: S.batch_scorer(length_model()), "labels": K.INGEST_LABELS},
    "marks": {"load": lambda: _shout_scorer, "labels": K.BENCHMARK_LABELS},
    "broken": {"load": _broken, "labels": K.BENCHMARK_LABELS},
    "skipped": {"load": _broken, "labels": None, "skip": True},
    "broken on workers": {"load": lambda: S.batch_scorer(_broken_on_workers), "labels": K.BENCHMARK_LABELS},
    "broken on a text": {"load": lambda: S.batch_scorer(_broken_on_a_text()), "labels": K.BENCHMARK_LABELS},
}

_MARKS = "CASE WHEN contains(comment, '!') THEN 'positive' WHEN contains(comment, '?') THEN 'negative' ELSE 'neutral' END"


@query(
    "score_with_models", "predicted", "human",
    sql=f"""SELECT doc_id, model, human_label AS true_label, pred_label, score FROM (
SELECT doc_id, human_label, unnest(['length', 'batched', 'marks']) AS model,
       unnest([{SQL_LABEL.format('comment')}, {SQL_LABEL.format('comment')}, {_MARKS}]) AS pred_label,
       unnest([{SQL_SCORE.format('comment')}, {SQL_SCORE.format('comment')}, 0.5::DOUBLE]) AS score FROM human)""",
)
def score_with_models(spark, d):
    rows = V.human(spark, d).select("doc_id", F.col("comment").alias("text"), F.col("human_label").alias("true_label"))
    return S.score_with_models(rows, REGISTRY)


# --- evaluation -------------------------------------------------------------------------------

_CONFUSION = """, counts AS (SELECT model, true_label, pred_label, count(*) AS n FROM predictions GROUP BY ALL),
classes AS (SELECT DISTINCT model, unnest([true_label, pred_label]) AS label FROM counts),
scored AS (SELECT model, label, coalesce(sum(n) FILTER (true_label = label), 0) AS support,
    coalesce(sum(n) FILTER (pred_label = label), 0) AS predicted, coalesce(sum(n) FILTER (true_label = label AND pred_label = label), 0) AS tp
  FROM classes JOIN counts USING (model) GROUP BY ALL),
rated AS (SELECT model, label, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN CAST(tp AS DOUBLE) * 2 / (support + predicted) ELSE 0 END AS f1, CAST(support AS BIGINT) AS support, tp FROM scored)
"""
_METRICS = "SELECT model, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM rated GROUP BY model"


@query(
    "model_metrics", "predicted", "human", "predictions",
    sql=_CONFUSION + f"SELECT model, accuracy, round(macro_f1, 9) AS macro_f1 FROM ({_METRICS})",
)
def model_metrics(spark, d):
    return E.model_metrics(V.predictions(spark, d)).withColumn("macro_f1", F.round("macro_f1", 9))


@query(
    "model_ranking", "predicted", "human", "predictions",
    sql=_CONFUSION + f"SELECT model, round_even(accuracy, 3) AS accuracy, round_even(macro_f1, 3) AS macro_f1 FROM ({_METRICS})",
)
def model_ranking(spark, d):
    return E.model_ranking(V.predictions(spark, d))


@query(
    "class_report", "predicted", "human", "predictions",
    sql=_CONFUSION + """SELECT model, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
SELECT model, label, precision, recall, f1, support FROM rated
UNION ALL SELECT model, 'accuracy', NULL, NULL, CAST(sum(tp) AS DOUBLE) / sum(support), CAST(sum(support) AS BIGINT) FROM rated GROUP BY model
UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM rated GROUP BY model
UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM rated GROUP BY model)""",
)
def class_report(spark, d):
    report = E.class_report(V.predictions(spark, d))
    return report.select("model", "label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "class_counts", "predicted", "human", "predictions",
    sql=_CONFUSION + """SELECT model, label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
CAST(predicted - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn FROM scored""",
)
def class_counts(spark, d):
    return E.class_counts(E.confusion_counts(V.predictions(spark, d)))


@query(
    "confusion", "predicted", "human", "predictions",
    sql=_CONFUSION + """SELECT a.model, a.label AS true_label, b.label AS pred_label, coalesce(n, 0) AS n
FROM classes a JOIN classes b USING (model) LEFT JOIN counts c ON c.model = a.model AND c.true_label = a.label AND c.pred_label = b.label""",
)
def confusion(spark, d):
    return E.confusion_grid(V.predictions(spark, d))


@query(
    "confusion_matrix", "predicted", "human", "predictions",
    sql="""SELECT model, true_label, count(*) FILTER (pred_label = 'negative') AS negative,
count(*) FILTER (pred_label = 'neutral') AS neutral, count(*) FILTER (pred_label = 'positive') AS positive FROM predictions GROUP BY 1, 2""",
)
def confusion_matrix(spark, d):
    return E.confusion_matrix(V.predictions(spark, d), list(K.LABEL_TO_ID))


@query(
    "model_benchmark", "predicted", "human",
    sql=", predictions AS (SELECT unnest(['length', 'batched', 'marks']) AS model, human_label AS true_label, unnest(["
    + f"{SQL_LABEL.format('comment')}, {SQL_LABEL.format('comment')}, {_MARKS}]) AS pred_label FROM human)"
    + _CONFUSION
    + f"""SELECT 'ranking' AS part, model, NULL AS item, [round_even(accuracy, 3), round_even(macro_f1, 3)] AS numbers FROM ({_METRICS})
UNION ALL SELECT 'report', model, label, [round(precision, 9), round(recall, 9), round(f1, 9), support] FROM rated
UNION ALL SELECT 'report', model, 'accuracy', [NULL, NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 9), sum(support)] FROM rated GROUP BY model
UNION ALL SELECT 'report', model, 'macro avg', [round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)] FROM rated GROUP BY model
UNION ALL SELECT 'report', model, 'weighted avg', [round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1 * support) / sum(support), 9), sum(support)] FROM rated GROUP BY model
UNION ALL SELECT 'confusion', a.model, a.label || ' ' || b.label, [coalesce(n, 0)::DOUBLE]
  FROM classes a JOIN classes b USING (model) LEFT JOIN counts c ON c.model = a.model AND c.true_label = a.label AND c.pred_label = b.label""",
)
def model_benchmark(spark, d):
    """Ranking of all models, written as CSV and read back, the report of each class, and the confusion grid."""
    gold = V.human(spark, d).select(
        F.col("comment").alias("text"), F.concat(F.lit(" "), F.initcap("human_label"), F.lit("\n")).alias("label")
    )
    path = scratch_path(spark, "ranking")
    result = run_benchmark(gold, REGISTRY)
    IO.write_csv(result["ranking"], path)
    ranking = IO.read_csv(spark, path, spark.createDataFrame([], "model string, accuracy double, macro_f1 double").schema)
    numbers = lambda *c: F.array(*[F.round(F.col(x).cast("double"), 9) for x in c]).alias("numbers")
    none = F.lit(None).cast("string").alias("item")
    grid = result["confusion"].select(F.lit("confusion").alias("part"), "model", F.concat_ws(" ", "true_label", "pred_label").alias("item"), numbers("n"))
    report = result["report"].select(F.lit("report").alias("part"), "model", F.col("label").alias("item"), numbers("precision", "recall", "f1", "support"))
    return ranking.select(F.lit("ranking").alias("part"), "model", none, numbers("accuracy", "macro_f1")).unionByName(report).unionByName(grid)


# --- training data ----------------------------------------------------------------------------


def _training(spark, d):
    return T.training_rows(V.human(spark, d, heavy=True))


_IDS = "CASE human_label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END"
_SPLIT = f""", split AS (SELECT doc_id, CAST({_IDS} AS INTEGER) AS label_id,
  row_number() OVER (PARTITION BY human_label ORDER BY md5('42' || doc_id), doc_id)
    <= round(count(*) OVER (PARTITION BY human_label) * 0.15::DOUBLE) AS is_validation FROM human)
"""


@query("training_rows", "predicted", "human", sql=f"SELECT doc_id, CAST({_IDS} AS INTEGER) AS label_id FROM human")
def training_rows(spark, d):
    return _training(spark, d).select("doc_id", "label_id")


@query("stratified_split", "predicted", "human", sql=_SPLIT + "SELECT doc_id, label_id, is_validation FROM split")
def stratified_split(spark, d):
    return T.stratified_split(_training(spark, d), "doc_id").select("doc_id", "label_id", "is_validation")


@query(
    "stratified_split_documents",
    sql="""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id), doc_id)
  <= round(count(*) OVER (PARTITION BY lang) * 0.15::DOUBLE) AS is_validation FROM documents""",
)
def stratified_split_documents(spark, d):
    split = T.stratified_split(table(spark, d, "documents"), "doc_id", "lang", classes=("en", "fr", "de", "es"))
    return split.select("doc_id", "lang", "is_validation")


@query(
    "class_weights", "predicted", "human",
    sql=_SPLIT + """SELECT label_id, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
FROM split WHERE NOT is_validation GROUP BY label_id""",
)
def class_weights(spark, d):
    split = T.stratified_split(_training(spark, d), "doc_id")
    return T.class_weights(split.where(~F.col("is_validation")))


@query(
    "dataset_profile", "predicted", "human",
    sql="""SELECT human_label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS BIGINT) AS share FROM human GROUP BY human_label""",
)
def dataset_profile(spark, d):
    return T.dataset_profile(_training(spark, d))


@query("training_csv_roundtrip", "predicted", "human", sql="SELECT comment, human_label FROM human")
def training_csv_roundtrip(spark, d):
    path = scratch_path(spark, "training")
    IO.write_csv(V.human(spark, d).drop("doc_id"), path, bom=True)
    return IO.read_training_csv(spark, path).select("comment", "human_label")


# Texts that a mark separates, so that SQL can say what a model trained on them must answer.
_CLASS_MARKS = ("¤¤", "§§", "¶¶")


def _marked(spark, d):
    """Every document behind its class's mark, with the class as label."""
    docs = table(spark, d, "documents", heavy=True)
    at = (F.col("doc_id") % 3 + 1).cast("int")
    mark = F.element_at(F.array(*[F.lit(m * 60) for m in _CLASS_MARKS]), at)
    label = F.element_at(F.array(*[F.lit(x) for x in K.SENTIMENTS]), at)
    return docs.select("doc_id", F.concat(mark, F.lit(" "), "text").alias("comment"), label.alias("human_label"))


_RULE = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(K.SENTIMENTS)) + " END"


@query(
    "train_and_score",
    sql=f"""SELECT {_RULE} AS human_label, count(*) AS n, count(*) AS n_share, count(*) AS n_as_saved, true AS learned FROM documents GROUP BY 1""",
)
def train_and_score(spark, d):
    """Train on the labelled documents, save, load, and classify every document: nearly all as the mark says, and all in the
    loaded model as in the first."""
    docs = _marked(spark, d)
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    split = T.stratified_split(T.training_rows(labelled), "doc_id")
    model, _, _ = T.train(split, grid=[{"reg": 0.001}], features=1 << 14, max_iter=20)
    path = scratch_path(spark, "model")
    T.save_model(model, path)
    scored = S.classify(docs, S.fitted_scorer(T.load_model(path)))
    first = S.classify(scored.select("human_label", "comment", F.col("sentiment").alias("_s"), F.col("score").alias("_p")), S.fitted_scorer(model))
    same = (F.col("_s") == F.col("sentiment")) & (F.col("_p") == F.col("score"))
    right = F.count_if(F.col("sentiment") == F.col("human_label")) >= 0.9 * F.count("*")
    return first.groupBy("human_label").agg(
        F.count("*").alias("n"), F.count_if(F.col("score").between(0.3333, 1)).alias("n_share"), F.count_if(same).alias("n_as_saved"), right.alias("learned")
    )


@query(
    "validation_report",
    sql=f"""WITH n AS (SELECT {_RULE} AS label, CAST(round(count(*) * 0.15) AS BIGINT) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1)
SELECT label, n AS support, true AS good FROM n
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), CAST(sum(n) AS BIGINT), true FROM n""",
)
def validation_report(spark, d):
    labelled = _marked(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    split = T.stratified_split(T.training_rows(labelled), "doc_id")
    model, _, _ = T.train(split, grid=[{"reg": 0.001}, {"reg": 0.01}], features=1 << 14, max_iter=20)
    good = F.col("f1").between(0.6, 1) & F.coalesce(F.col("precision").between(0.6, 1), F.lit(True)) & F.coalesce(F.col("recall").between(0.6, 1), F.lit(True))
    return T.validation_report(model, split).select("label", "support", good.alias("good"))


_ODD = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN repeat(text, 20) ELSE text END"


@query(
    "empty_and_long_text",
    sql=f"""SELECT doc_id, {SQL_LABEL.format("t")} AS sentiment, {SQL_SCORE.format("t")} AS score, {SQL_LABEL.format("c")} AS limited_sentiment
FROM (SELECT doc_id, coalesce({_ODD}, '') AS t, substring(coalesce({_ODD}, ''), 1, 512) AS c FROM documents)""",
)
def empty_and_long_text(spark, d):
    """Empty, missing and very long texts, whole and for a model with an input limit."""
    odd = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 2, F.repeat("text", F.lit(20))).when(F.col("doc_id") % 5 != 1, F.col("text"))
    docs = table(spark, d, "documents", heavy=True).select("doc_id", odd.alias("comment"))
    whole = S.classify(docs, S.batch_scorer(length_model())).withColumnsRenamed({"sentiment": "whole", "score": "whole_score"})
    limited = S.classify(whole, S.batch_scorer(length_model(), max_chars=512))
    return limited.select("doc_id", F.col("whole").alias("sentiment"), F.col("whole_score").alias("score"), F.col("sentiment").alias("limited_sentiment"))
