"""Model evaluation on a long table of predictions: model, true_label, pred_label.

All metrics come from the confusion counts, which are small: one scan of the predictions, no joins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """Rows per model, true and predicted label, where there are any."""
    return predictions.groupBy("model", "true_label", "pred_label").agg(F.count("*").alias("n"))


def class_counts(confusion: DataFrame) -> DataFrame:
    """True and false positives and negatives of every class that occurs as true or predicted label."""
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("s.support")).otherwise(F.lit(0))
    return (
        confusion.withColumn("s", F.explode(sides))
        .groupBy("model", F.col("s.label").alias("label"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(hit).alias("tp"))
        .withColumn("fp", F.col("predicted") - F.col("tp"))
        .withColumn("fn", F.col("support") - F.col("tp"))
    )


def _share(part, whole) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(F.lit(0.0))


def class_scores(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    scored = class_counts(confusion)
    f1 = F.when(F.col("tp") > 0, F.col("tp").cast("double") * 2 / (F.col("support") + F.col("predicted")))
    return scored.select(
        "model",
        "label",
        _share("tp", "predicted").alias("precision"),
        _share("tp", "support").alias("recall"),
        F.coalesce(f1, F.lit(0.0)).alias("f1"),
        "support",
        "tp",
    )


def model_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and macro F1 of each model."""
    scored = class_scores(confusion_counts(predictions))
    return scored.groupBy("model").agg(
        (F.sum("tp").cast("double") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def class_report(predictions: DataFrame) -> DataFrame:
    """Scores per class, with accuracy, macro and weighted averages as further rows."""
    scored = class_scores(confusion_counts(predictions))
    names = ("precision", "recall", "f1")

    def line(label, p, r, f):
        fields = zip((*names, "support"), (p, r, f, F.sum("support")))
        return F.struct(F.lit(label).alias("label"), *[c.cast("long" if n == "support" else "double").alias(n) for n, c in fields])

    accuracy = F.sum("tp").cast("double") / F.sum("support")
    weighted = [F.sum(F.col(n) * F.col("support")) / F.sum("support") for n in names]
    averages = scored.groupBy("model").agg(
        F.array(
            line("accuracy", F.lit(None), F.lit(None), accuracy),
            line("macro avg", *[F.avg(n) for n in names]),
            line("weighted avg", *weighted),
        ).alias("lines")
    )
    summary = averages.select("model", F.explode("lines").alias("l")).select("model", "l.*")
    return scored.select("model", "label", *names, "support").unionByName(summary)


def confusion_grid(predictions: DataFrame) -> DataFrame:
    """Confusion counts over the full grid of each model's classes, zeros included."""
    cell = F.struct("true_label", "pred_label")
    # Gathers counts, at most classes squared entries a model.
    models = confusion_counts(predictions).groupBy("model").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("true_label", "pred_label"))))).alias("_classes"),
        F.map_from_entries(F.collect_list(F.struct(cell.alias("cell"), "n"))).alias("_cells"),
    )
    rows = models.withColumn("true_label", F.explode("_classes"))
    grid = rows.withColumn("pred_label", F.explode("_classes"))
    n = F.coalesce(F.try_element_at("_cells", cell), F.lit(0).cast("long"))
    return grid.select("model", "true_label", "pred_label", n.alias("n"))


def confusion_matrix(predictions: DataFrame, classes) -> DataFrame:
    """Confusion counts of one model set, one column per predicted class."""
    counts = confusion_counts(predictions)
    return counts.groupBy("model", "true_label").pivot("pred_label", list(classes)).sum("n").na.fill(0)


def model_ranking(predictions: DataFrame) -> DataFrame:
    """Models by macro F1, best first, rounded to three decimals."""
    metrics = model_metrics(predictions)
    return metrics.select(
        "model", F.bround("accuracy", 3).alias("accuracy"), F.bround("macro_f1", 3).alias("macro_f1")
    ).orderBy(F.col("macro_f1").desc(), "model")
