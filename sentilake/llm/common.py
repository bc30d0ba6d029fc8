"""Tables, stages and settings that the operators share."""

import gc
import re

from sentilake.session import scratch_path


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df, name, **options):
    """Compute once into the shared folder; a lost executor then costs no recomputation of what led here."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark, *frames):
    """Delete staged tables that nothing needs any more. Spark then also drops the shuffles and broadcasts that led to them,
    once its driver has collected its garbage."""
    for folder in {f.rsplit("/", 1)[0] for frame in frames for f in frame.inputFiles()}:
        if re.search("-[0-9a-f]{32}$", folder):
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_one(*steps):
    """Functions for mapInArrow, one after the other, as one. A step that reads another's rows directly takes a second Python
    worker of every core, and the session keeps as many as there ever were."""

    def rows(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return rows


def numbers(spark, names, rows):
    """A small table of whole numbers, sent as Arrow. Tuples would go through Python workers of another kind, which stay beside
    the others in every executor."""
    import pyarrow as pa

    columns = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns, strict=True)}))


def small_batches(spark, rows=64):
    """Whole texts go to Python: keep an Arrow batch at a few dozen rows, as many can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
