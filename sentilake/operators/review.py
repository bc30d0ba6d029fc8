"""Human review of predictions: what is pending, what was decided, how far it is."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake.functions.labels import lookup
from sentilake.functions.text import strip
from sentilake.operators.dedup import KEY, drop_known, keys_of, mark_known, with_key
from sentilake.operators.skew import join_unique
from sentilake.schemas import require_columns


def pending(predicted: DataFrame, labelled: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Predicted comments that nobody has labelled."""
    require_columns(predicted, "comment", "sentiment", "score")
    return drop_known(predicted, labelled, hot_rows=hot_rows)


def latest_decisions(decisions: DataFrame, order: str | None = None) -> DataFrame:
    """One decision per comment: the last by `order`, or the greatest key where there is no order."""
    key = F.lower(strip("decision"))
    keyed = with_key(decisions).withColumn("_decision", F.coalesce(key, F.lit("")))
    last = F.max(F.struct(*([order] if order else []), "_decision"))
    return keyed.groupBy(KEY).agg(last.alias("_last")).select(KEY, F.col("_last._decision").alias("_decision"))


def apply_decisions(
    predicted: DataFrame, decisions: DataFrame, order: str | None = None, labelled: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Comments with their human label. Empty agrees with the model; skips and unknown keys stay pending.

    Give the `pending` comments, or all predicted ones with the `labelled` table: decisions on comments that have a
    label are then dropped first, key against key, and the comments are joined only once.
    """
    latest = latest_decisions(decisions, order)
    if labelled is not None:
        latest = latest.join(keys_of(labelled), KEY, "left_anti")
    joined = join_unique(with_key(predicted), latest, KEY, "inner", hot_rows)
    label = F.when(F.col("_decision") == "", F.col("sentiment")).otherwise(lookup("_decision", K.REVIEW_KEYS))
    decided = joined.withColumn("human_label", label)
    kept = decided.where((F.col("_decision") == "") | (F.col("human_label") != "skip"))
    return kept.select(*predicted.columns, "human_label")


def label_distribution(labelled: DataFrame, label: str = "human_label") -> DataFrame:
    """Rows per label, most frequent first."""
    counts = labelled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), label)


def corrections(labelled: DataFrame) -> DataFrame:
    """How often the reviewer differed from the model."""
    differs = ~F.col("human_label").eqNullSafe(F.col("sentiment"))
    counts = labelled.agg(F.count("*").alias("labelled"), F.count_if(differs).alias("corrections"))
    share = F.when(F.col("labelled") > 0, F.col("corrections").cast("double") / F.col("labelled") * 100)
    return counts.withColumn("error_rate", share)


def agreement(labelled: DataFrame) -> DataFrame:
    """How often model and reviewer gave the same label."""
    same = F.col("human_label").eqNullSafe(F.col("sentiment"))
    counts = labelled.agg(F.count("*").alias("labelled"), F.count_if(same).alias("agreed"))
    share = F.when(F.col("labelled") > 0, F.col("agreed").cast("double") / F.col("labelled") * 100)
    return counts.withColumn("agreement", share)


def progress(predicted: DataFrame, labelled: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Predicted comments: in all, done, and left."""
    marked = mark_known(predicted, labelled, hot_rows=hot_rows)
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if("is_known").alias("done"),
        F.count_if(~F.col("is_known")).alias("remaining"),
    )
