"""Benchmark of several models on one labelled set."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake.operators import evaluate as E
from sentilake.operators.scoring import score_with_models
from sentilake.operators.training import benchmark_rows


def run_benchmark(rows: DataFrame, registry: dict) -> dict[str, DataFrame]:
    """Ranking, per-class reports and confusion grids. Each model scores each row once; only labels are kept."""
    gold = benchmark_rows(rows).select("text", F.col("label").alias("true_label"))
    counted = score_with_models(gold, registry).select("model", "true_label", "pred_label")
    return {
        "ranking": E.model_ranking(counted),
        "report": E.class_report(counted),
        "confusion": E.confusion_grid(counted),
    }
