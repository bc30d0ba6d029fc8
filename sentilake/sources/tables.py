"""Readers and writers of the stored tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentilake import constants as K
from sentilake import schemas as S
from sentilake.operators.dedup import KEY, with_key
from sentilake.sources.csv_blocks import BOM, parse_records, read_records
from sentilake.sources.fact import FactFiles, FactTable, append_fact, fact_store, read_fact  # noqa: F401
from sentilake.sources.paths import path_exists



def spread(df: DataFrame) -> DataFrame:
    """Repartition a plain scan that arrives in fewer splits than there are cores, ahead of a CPU-heavy step.

    A table with enough splits, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- CSV --------------------------------------------------------------------------------------


def read_csv(spark, path, schema) -> DataFrame:
    """CSV with header, quoted line ends, doubled quotes and an optional byte order mark; large files are read in blocks.

    Columns are matched to `schema` by header name; absent ones come back null, additional ones are left out. The files
    of one read share a header: another one is an error, as values are taken by position.
    """
    header = spark.read.options(multiLine=True, escape='"', encoding="UTF-8").csv(path).head()
    if header is None:
        return spark.createDataFrame([], schema)
    names = [(c or "").lstrip(BOM) for c in header]
    raw = parse_records(read_records(spark, path), names)
    place = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}
    return raw.select(*[(F.col(place[f.name]) if f.name in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path, bom=False, mode="error"):
    """CSV files with header, white space around values kept. `bom` marks every file as UTF-8 for spreadsheet programs, in the first header name."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode(mode).options(
        header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_fact_csv(spark, path) -> DataFrame:
    return read_csv(spark, path, S.FACT)


def read_source_csv(spark, path, source: str) -> DataFrame:
    """One source's records from CSV, in its own columns."""
    return read_csv(spark, path, S.LANDING[source])


def read_benchmark_csv(spark, path) -> DataFrame:
    return read_csv(spark, path, S.BENCHMARK_SET)


def read_training_csv(spark, path) -> DataFrame:
    return S.require_columns(read_csv(spark, path, S.LABELLED), "comment", "human_label")


# --- landing ----------------------------------------------------------------------------------


def write_landing(records: DataFrame, path, source: str, mode="append"):
    """One source's records in its own columns, under a `source=` folder."""
    fields = S.LANDING[source].names
    S.require_columns(records, *fields).select(*fields).write.mode(mode).parquet(f"{path}/source={source}")


def read_landing(spark, path, source: str) -> DataFrame:
    """One source's records; an empty table if nothing has landed."""
    folder = f"{path}/source={source}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], S.LANDING[source])
    return spark.read.schema(S.LANDING[source]).parquet(folder)


def read_thread_files(spark, path) -> DataFrame:
    """Raw forum threads, one file each: path and bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


# --- labelled table ---------------------------------------------------------------------------

STORED_LABELLED = T.StructType(S.LABELLED.fields + [T.StructField(KEY, T.BinaryType())])


def _read(spark, path, schema):
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_labelled(spark, path) -> DataFrame:
    return _read(spark, path, STORED_LABELLED)


def append_labelled(rows: DataFrame, path):
    present = with_key(rows)
    columns = [F.col(f.name) if f.name in present.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STORED_LABELLED.fields]
    present.select(*columns).write.mode("append").parquet(path)


def union_by_name(frames) -> DataFrame:
    """All frames under one another, columns matched by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def export_comments(df: DataFrame, path, sentiments=K.SENTIMENTS):
    """The filtered comments as CSV."""
    write_csv(df.where(F.col("sentiment").isin(*sentiments)).drop(KEY), path, bom=True)
