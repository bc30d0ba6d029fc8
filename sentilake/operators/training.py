"""Training data and a weighted three-class text model on spark.ml."""

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentilake import constants as K
from sentilake.functions.labels import clean_gold, id_label, label_id
from sentilake.operators.evaluate import class_report, model_metrics

CLASS_IDS = tuple(K.LABEL_TO_ID.values())


def training_rows(labelled: DataFrame, text: str = "comment", label: str = "human_label") -> DataFrame:
    """Rows with a text and one of the three classes, plus the class id."""
    known = labelled.na.drop(subset=[text, label]).where(F.col(label).isin(*K.LABEL_TO_ID))
    return known.withColumn("label_id", label_id(label))


def benchmark_rows(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows with a text and a label, the label cleaned."""
    return rows.na.drop(subset=[text, label]).withColumn(label, clean_gold(label))


def dataset_profile(rows: DataFrame, label: str = "human_label") -> DataFrame:
    """Rows and share of each class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # over the classes
    return counts.withColumn("total", total).withColumn("share", F.col("n").cast("double") / F.col("total"))


# --- split ------------------------------------------------------------------------------------

_SLICES = 4  # hex digits of the order hash that make a slice


def split_hash(row_id, seed: int = K.SPLIT_SEED) -> Column:
    """Order in which a class is dealt out: the same on every run and any partitioning."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(row_id).cast("string")))


def stratified_split(
    rows: DataFrame, row_id: str, label: str = "label_id", share: float = K.VALIDATION_SHARE, seed: int = K.SPLIT_SEED,
    classes=CLASS_IDS,
) -> DataFrame:
    """Add `is_validation`, true for exactly round(share * n) rows of each class: the first by `split_hash`, then id.

    A class is not sorted. Counting rows per hash slice finds the slice where its quota ends; only that slice, about
    1/65536 of the class, is ranked to find the last row inside. The rows themselves are then passed over once, and
    compared with it. `row_id` must be unique. Rows of no listed class stay on the training side.
    """
    slim = rows.where(F.col(label).isin(*classes)).select(F.col(label).alias("_class"), F.col(row_id).alias("_id"))
    slim = slim.withColumn("_h", split_hash("_id", seed)).withColumn("_slice", F.substring("_h", 1, _SLICES))
    counts = slim.groupBy("_class", "_slice").agg(F.count("*").alias("n"))
    quota = F.round(F.sum("n").over(W.partitionBy("_class")) * share).cast("long")
    before = F.sum("n").over(W.partitionBy("_class").orderBy("_slice")) - F.col("n")
    ends = counts.withColumn("_quota", quota).withColumn("_before", before)
    ends = ends.where((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("n") >= F.col("_quota")))
    ends = ends.select("_class", "_slice", (F.col("_quota") - F.col("_before")).alias("_left"))
    # Both broadcast sides have at most one row per listed class.
    edge = slim.join(F.broadcast(ends), ["_class", "_slice"])
    rank = F.row_number().over(W.partitionBy("_class").orderBy("_h", "_id"))
    last = edge.withColumn("_rank", rank).where(F.col("_rank") == F.col("_left"))
    last = last.select("_class", F.col("_h").alias("_last_h"), F.col("_id").alias("_last_id"))
    placed = rows.withColumn("_h", split_hash(row_id, seed)).join(F.broadcast(last), F.col(label) == F.col("_class"), "left")
    inside = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col(row_id) <= F.col("_last_id")))
    return placed.select(*rows.columns, F.coalesce(inside, F.lit(False)).alias("is_validation"))


def class_weights(rows: DataFrame, label: str = "label_id", classes=CLASS_IDS) -> DataFrame:
    """Balanced weight n / (classes * n_class) of each listed class that occurs: one row per class."""
    counts = rows.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count("*").alias("n"))
    all_classes = W.partitionBy(F.lit(1))
    weight = F.sum("n").over(all_classes).cast("double") / (F.count("*").over(all_classes) * F.col("n"))
    return counts.withColumn("weight", weight)


def with_weight(rows: DataFrame, label: str = "label_id") -> DataFrame:
    """Rows with their class's weight. The weights are one row for each of the three classes."""
    return rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label)


# --- model ------------------------------------------------------------------------------------


PART = 1 << 20  # bytes of text that are counted at a time


def _rotated(x, bits: int):
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def _mixed(k):
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def gram_hashes(data, begin, end):
    """Murmur3 of the byte ranges, as `HashingTF` hashes its terms. Ranges are as short as a gram."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    h = np.full(len(begin), 42, dtype=np.uint32)
    for at in range(0, int(size.max(initial=0)), 4):
        some = np.flatnonzero(size > at)
        left = np.minimum(size[some] - at, 4)
        k = np.zeros(len(some), dtype=np.uint32)
        for i in range(4):
            byte = padded[np.minimum(begin[some] + at + i, len(data))].astype(np.uint32)
            k |= np.where(i < left, byte, np.uint32(0)) << np.uint32(8 * i)
        mixed = h[some] ^ _mixed(k)
        h[some] = np.where(left == 4, _rotated(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64), mixed)
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def gram_counts(data, offsets, n: int, features: int):
    """(row, feature, count) of the texts' n-grams, by row and feature."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero((data & 0xC0) != 0x80)
    stop = np.append(start, len(data))
    whole = max(0, len(start) - n + 1)
    inside = np.flatnonzero(row[start[:whole]] == row[start[n - 1 :][:whole]])
    feature = gram_hashes(data, start[inside], stop[inside + n]).astype(np.int64) % features
    key, count = np.unique(row[start[inside]] * features + feature, return_counts=True)
    return key // features, key % features, count


def _gram_vectors(n: int, features: int):
    """Arrow function from texts to sparse vectors of counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def vectors(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        found, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, side="right")) - 1)
            row, feature, count = gram_counts(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], n, features)
            found.append((row + at, feature, count))
            at = stop
        row, feature, count = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 3
        ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
        fields = {
            "type": pa.array(np.zeros(len(texts)), pa.int8()),
            "size": pa.array(np.full(len(texts), features), pa.int32()),
            "indices": pa.ListArray.from_arrays(ends, pa.array(feature, pa.int32())),
            "values": pa.ListArray.from_arrays(ends, pa.array(count, pa.float64())),
        }
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    return vectors


class CharGrams(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Overlapping character n-grams of the lower-cased `_text`, counted by hash into the vector `_tf`: features are numbered as
    by `HashingTF`, but whole Arrow columns are counted at a time and no string is made of a gram."""

    n = Param(Params._dummy(), "n", "characters of a gram", typeConverter=TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "number of features", typeConverter=TypeConverters.toInt)

    def __init__(self, n: int = 2, features: int = 1 << 18):
        super().__init__()
        self._set(n=n, features=features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        count = F.arrow_udf(_gram_vectors(self.getOrDefault(self.n), self.getOrDefault(self.features)), VectorUDT())
        return dataset.withColumn("_tf", count(F.lower("_text")))


def gram_stages(n: int = 2, features: int = 1 << 18) -> list:
    """Overlapping character n-grams of the lower-cased text, counted by hash. Needs no word breaking and no fitting."""
    return [CharGrams(n, features)]


def classifier(reg: float = 0.01, max_iter: int = 50) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_features", labelCol="label_id", weightCol="weight", family="multinomial",
        regParam=reg, maxIter=max_iter,
    )


def _predicted(scored: DataFrame, name: str = "fitted") -> DataFrame:
    return scored.select(
        F.lit(name).alias("model"),
        id_label("label_id").alias("true_label"),
        id_label(F.col("prediction").cast("int")).alias("pred_label"),
    )


def predictions(model: PipelineModel, rows: DataFrame, text: str = "comment", name: str = "fitted") -> DataFrame:
    """Long predictions of a fitted model on rows with `label_id`."""
    return _predicted(model.transform(rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))), name)


def train(split: DataFrame, text: str = "comment", grid=None, n: int = 2, features: int = 1 << 18, **settings):
    """Fit every setting of the grid on the training side and keep the best macro F1 on the validation side.

    Returns (model, macro F1, setting). `split` comes from `stratified_split`. Texts are broken up once for all
    settings; the hashed counts are what is kept in between.
    """
    grid = grid or [{"reg": 0.001}, {"reg": 0.01}]
    count = PipelineModel(stages=gram_stages(n, features))
    texts = split.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), "label_id", "is_validation")
    counted = count.transform(texts).select("_tf", "label_id", "is_validation").persist()
    try:
        fit_on, held_out = with_weight(counted.where(~F.col("is_validation"))), counted.where("is_validation")
        rarity = IDF(inputCol="_tf", outputCol="_features").fit(fit_on)
        best = None
        for setting in grid:
            fitted = classifier(**{**settings, **setting}).fit(rarity.transform(fit_on))
            row = model_metrics(_predicted(fitted.transform(rarity.transform(held_out)))).first()
            score = row["macro_f1"] if row else 0.0
            if best is None or score > best[1]:
                best = (PipelineModel(stages=[*count.stages, rarity, fitted]), score, setting)
        return best
    finally:
        counted.unpersist()


def validation_report(model: PipelineModel, split: DataFrame, text: str = "comment") -> DataFrame:
    return class_report(predictions(model, split.where("is_validation"), text))


def save_model(model: PipelineModel, path: str):
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
