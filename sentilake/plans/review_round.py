"""One round of human review: apply decisions to what is pending, store, report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake import schemas as S
from sentilake.operators import review as R
from sentilake.schemas import require_columns
from sentilake.session import materialise
from sentilake.sources.fact import FactFiles
from sentilake.sources.tables import append_labelled, read_labelled


def review_round(
    predicted: DataFrame, decisions: DataFrame, labelled_path: str, order: str | None = None, fact: FactFiles | None = None
) -> dict[str, DataFrame]:
    """Append the round's labels; returns the round's rows and the state of the labelled table.

    With a `fact` store whose comments were predicted, its counts follow the corrections.
    """
    spark = predicted.sparkSession
    require_columns(predicted, "comment", "sentiment", "score")
    decided = materialise(R.apply_decisions(predicted, decisions, order, read_labelled(spark, labelled_path)))
    if not decided.isEmpty():
        append_labelled(decided, labelled_path)
        if fact is not None:
            wrong = decided.where(F.col("human_label") != F.col("sentiment")).select(*S.FACT.names, "human_label")
            fact.correct(wrong, wrong.withColumn("sentiment", F.col("human_label")))
    labelled = read_labelled(spark, labelled_path)
    return {
        "decided": decided,
        "distribution": R.label_distribution(labelled),
        "corrections": R.corrections(labelled),
        "progress": R.progress(predicted, labelled),
    }
