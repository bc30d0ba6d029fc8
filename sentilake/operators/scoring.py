"""Sentiment scoring with a pluggable model.

A scorer is a function (DataFrame, text column) -> DataFrame that adds `label` and `score`.
"""

import logging
from typing import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentilake import constants as K
from sentilake.functions.labels import id_label, normalise, round_score
from sentilake.schemas import PREDICTION
from sentilake.session import materialise

Scorer = Callable[[DataFrame, str], DataFrame]
GUARDED_PREDICTION = T.StructType([*PREDICTION.fields, T.StructField("error", T.StringType())])
WINDOW_BATCHES = 64  # batches' worth of texts that are put in order of length together
log = logging.getLogger(__name__)

__all__ = ["Scorer", "batch_scorer", "fitted_scorer", "classify", "classify_one", "score_with_models"]


def length_batches(lengths, rows: int, chars: int | None):
    """Rows, shortest texts first, in batches of so many at most and of so many characters, counted as an outside model pads
    them: each text as long as its batch's longest. A longer text is a batch of its own."""
    order = np.argsort(lengths, kind="stable")
    batch = []
    for i in order.tolist():
        if batch and (len(batch) == rows or chars is not None and (len(batch) + 1) * lengths[i] > chars):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def _guarded(make_predict_fn, rows: int, chars: int | None):
    """A loader whose function never raises: of a model that fails, at loading or on a text, rows carry the error instead."""

    def load():
        try:
            predict, broken = make_predict_fn(), None
        except Exception as error:
            predict, broken = None, f"{type(error).__name__}: {error}"

        def predictions(texts):
            label, error = np.full(len(texts), None, dtype=object), np.full(len(texts), broken, dtype=object)
            score = np.full(len(texts), np.nan)
            for at in length_batches(np.array([len(t) for t in texts], dtype=np.int64), rows, chars) if predict else ():
                try:
                    got = predict(texts[at])
                    label[at], score[at] = np.asarray(got["label"], dtype=object), np.asarray(got["score"], dtype=np.float64)
                except Exception as failed:
                    error[at] = f"{type(failed).__name__}: {failed}"
            return {"label": label, "score": score, "error": error}

        return predictions

    return load


def batch_scorer(make_predict_fn, batch_size: int = K.SCORING_BATCH, max_chars: int | None = None, batch_chars: int | None = K.SCORING_CHARS) -> Scorer:
    """Scorer from an outside model.

    `make_predict_fn()` loads the model, once per Python worker, and returns a function from an array of texts to
    {"label": array, "score": array}. Texts go over in Arrow batches and to the model in batches of texts of like length: of
    `batch_size` at most, and of `batch_chars` characters with the padding to the longest. `max_chars` is for models with an
    input limit of their own; by default the whole text is passed. A model that fails fails the job; `scorer.guarded` is the
    same scorer with a further column `error` instead.
    """
    load = _guarded(make_predict_fn, batch_size, batch_chars)
    predict = predict_batch_udf(load, return_type=GUARDED_PREDICTION, batch_size=batch_size * WINDOW_BATCHES)

    def guarded(df: DataFrame, text: str) -> DataFrame:
        given = F.coalesce(F.col(text), F.lit(""))
        given = given if max_chars is None else F.substring(given, 1, max_chars)
        scored = df.withColumn("_prediction", predict(given))
        return scored.select(*df.columns, *[F.col(f"_prediction.{c}").alias(c) for c in ("label", "score", "error")])

    def score(df: DataFrame, text: str) -> DataFrame:
        scored = guarded(df, text)
        failed = F.raise_error(F.concat(F.lit("the model failed: "), "error")).cast("string")
        label = F.when(F.col("error").isNull(), F.col("label")).otherwise(failed)
        return scored.select(*df.columns, label.alias("label"), "score")

    score.guarded = guarded
    return score


def fitted_scorer(model) -> Scorer:
    """Scorer from a fitted `training` pipeline: runs in the JVM, no Python worker."""

    def score(df: DataFrame, text: str) -> DataFrame:
        taken = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        scored = model.transform(taken)
        confidence = F.array_max(vector_to_array("probability"))
        return scored.select(*df.columns, id_label(F.col("prediction").cast("int")).alias("label"), confidence.alias("score"))

    return score


def classify(df: DataFrame, scorer: Scorer, text: str = "comment", labels: dict = K.INGEST_LABELS) -> DataFrame:
    """Add `sentiment` and `score`, the label normalised by the model's own map."""
    kept = [c for c in df.columns if c not in ("sentiment", "score", "label")]
    scored = scorer(df.select(*kept), text)
    return scored.select(*kept, normalise("label", labels).alias("sentiment"), round_score("score").alias("score"))


def classify_one(spark, scorer: Scorer, text: str) -> dict:
    """Label and score of a single text."""
    row = scorer(spark.createDataFrame([(text,)], "comment string"), "comment").first()
    return {"label": row["label"], "score": round(row["score"], K.SCORE_DECIMALS)}


def score_with_models(df: DataFrame, registry: dict, text: str = "text", true_label: str = "true_label") -> DataFrame:
    """Predictions of every model in one pass over the rows: id columns, model, true_label, pred_label, score.

    `registry` maps a model's name to {"load": () -> Scorer, "labels": map, "skip": bool}. Models that are marked, cannot be
    loaded, or fail on a worker, when loaded there or on any text, are left out with all their rows. What each model said is
    kept in reliable storage, without the texts, so that its errors are counted before its rows are given.
    """
    scored, names = df, []
    for i, (name, entry) in enumerate(registry.items()):
        if entry.get("skip"):
            continue
        try:
            scorer = entry["load"]()
        except Exception as error:
            log.warning("model %s left out: %s", name, error)
            continue
        guarded = getattr(scorer, "guarded", None)
        pred = F.struct(
            F.lit(name).alias("model"),
            normalise("label", entry.get("labels") or K.BENCHMARK_LABELS).alias("pred_label"),
            round_score("score").alias("score"),
            (F.col("error") if guarded else F.lit(None).cast("string")).alias("error"),
        )
        column = f"_model_{i}"
        scored = (guarded or scorer)(scored, text).withColumn(column, pred).drop("label", "score", "error")
        names.append(column)
    if not names:
        raise ValueError("no model could be loaded")
    long = scored.withColumn("_p", F.explode(F.array(*names)))
    kept = [c for c in df.columns if c not in (text, true_label)]
    told = materialise(long.select(*kept, "_p.model", F.col(true_label).alias("true_label"), "_p.pred_label", "_p.score", "_p.error"))
    failed = told.where(F.col("error").isNotNull()).groupBy("model").agg(F.count("*").alias("n"), F.min("error").alias("error")).collect()
    for row in failed:
        log.warning("model %s left out: %d rows failed, first %s", row.model, row.n, row.error)
    if len(failed) == len(names):
        raise ValueError("every model failed")
    return told.where(~F.col("model").isin([row.model for row in failed])).drop("error")
