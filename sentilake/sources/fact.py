"""The fact table: scored comments by day, as files that a run names when it is done, or in the catalog, bucketed by key."""

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentilake import schemas as S
from sentilake.functions import bloom
from sentilake.operators.dedup import KEY, with_key
from sentilake.operators.panels import merge_cubes, summary_cube
from sentilake.operators.skew import join_unique
from sentilake.session import materialise
from sentilake.sources.paths import path_exists

STORED_FACT = T.StructType(S.FACT.fields + [T.StructField(KEY, T.BinaryType())])
MANIFEST = "run string, batch string, file string, scraped_date date, n_rows long"
FILTERS = "scraped_date date, blocks int, block int, bits binary"
FILTER_FROM = 1_000_000  # stored rows
FILTER_BLOCKS = 16_384  # of 4 KB: the largest filter of found keys that goes to every task


def _as_fact(rows: DataFrame) -> DataFrame:
    return with_key(rows).select(*STORED_FACT.names)


def _filter_sizes(files) -> dict:
    """Blocks of each day's filter in each batch."""
    rows = {}
    for r in files:
        rows[r.batch, r.scraped_date] = rows.get((r.batch, r.scraped_date), 0) + r.n_rows
    return {k: bloom.blocks_for(n) for k, n in rows.items()}


@dataclass(frozen=True)
class FactFiles:
    """The fact table as Parquet files with a folder per `scraped_date`.

    A run writes its files, its counts and its key filters into folders of its own and then names them in the manifest, by
    one file that Spark's committer renames into place. Readers open named files only: a run that stops before leaves
    nothing to see, and its replay writes anew. Runs may append side by side.

        files/batch=<id>/scraped_date=<day>/   the rows
        cube/batch=<id>/                       their summary cube
        filters/batch=<id>/                    a Bloom filter of the comment keys for each day
        manifest/                              for each run its files, and one row without a file
    """

    path: str
    filter_from: int | None = None  # stored rows from which the filters are asked; FILTER_FROM by default

    # --- manifest ------------------------------------------------------------------------------

    def manifest(self, spark) -> DataFrame:
        """The files of all finished runs; each run also has one row without a file."""
        if not path_exists(spark, f"{self.path}/manifest"):
            return spark.createDataFrame([], MANIFEST)
        return spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def finished(self, spark, run: str) -> bool:
        return not self.manifest(spark).where(F.col("run") == run).isEmpty()

    def _live(self, spark, run=None) -> list:
        """Rows of the manifest for all finished runs, or for one: names and counts of files are all that comes to the driver.
        A run has been named once; of two names that it has by accident, the first counts."""
        named = self.manifest(spark)
        rows = (named if run is None else named.where(F.col("run") == run)).collect()
        first = {}
        for r in rows:
            first[r.run] = min(first.get(r.run, r.batch), r.batch)
        return [r for r in rows if first[r.run] == r.batch]

    def _rows(self, spark, live) -> DataFrame:
        """Rows of the files that parts of the manifest name."""
        names = [f"{self.path}/files/{r.file}" for r in live if r.file]
        if not names:
            return spark.createDataFrame([], STORED_FACT)
        read = spark.read.schema(STORED_FACT).option("basePath", f"{self.path}/files").parquet(*names)
        return read.select(*STORED_FACT.names)

    def _beside(self, spark, kind, batches, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/batch={b}" for b in sorted(batches)])

    # --- reading -------------------------------------------------------------------------------

    def read(self, spark) -> DataFrame:
        """The stored rows with their comment keys; an empty table before the first run."""
        return self._rows(spark, self._live(spark))

    def added(self, spark, run: str) -> DataFrame:
        """The rows that a run added."""
        return self._rows(spark, self._live(spark, run))

    def cube(self, spark) -> DataFrame:
        """The summary cube of all stored rows, from the runs' own cubes; no comment is read."""
        empty = summary_cube(spark.createDataFrame([], S.FACT))
        batches = {r.batch for r in self._live(spark)}
        return merge_cubes(self._beside(spark, "cube", batches, empty.schema)) if batches else empty

    def known(self, spark, keys: DataFrame) -> DataFrame:
        """Those of some distinct keys that are stored.

        The days' filters tell which keys a day may hold, by a join that moves the keys and the filters' blocks. The rows
        of those days are then cut, before they move, by a filter of the keys that passed, and meet these in an exact join.
        With more keys passed than such a filter may hold the days' rows are joined as they are, and so is a table of fewer
        than `FILTER_FROM` rows, which asking the filters would not save from anything.
        """
        files = [r for r in self._live(spark) if r.file]
        if not files:
            return keys.select(KEY).limit(0)
        if sum(r.n_rows for r in files) < (FILTER_FROM if self.filter_from is None else self.filter_from):
            stored = self._rows(spark, files).select(KEY).join(keys.select(KEY), KEY, "left_semi").distinct()
            return keys.select(KEY).join(stored, KEY, "left_semi")
        stored = self._beside(spark, "filters", {r.batch for r in files}, FILTERS)
        # Filters have a power of two of blocks: a few dozen sizes at most.
        probes = F.array(*[F.struct(F.lit(n).alias("blocks"), bloom.block_of(KEY, F.lit(n)).alias("block")) for n in sorted(set(_filter_sizes(files).values()))])
        probed = keys.select(KEY, F.explode(probes).alias("p")).select(KEY, "p.blocks", "p.block")
        met = probed.join(stored, (probed["blocks"] == stored["blocks"]) & (probed["block"] == stored["block"]) & bloom.may_hold(stored["bits"], probed[KEY]))
        passed = materialise(met.select(probed[KEY], "scraped_date").distinct())
        found = passed.groupBy("scraped_date").agg(F.count("*").alias("n")).collect()
        if not found:
            return keys.select(KEY).limit(0)
        days = {r.scraped_date for r in found}
        rows = self._rows(spark, [r for r in files if r.scraped_date in days]).select(KEY)
        maybe = passed.select(KEY).distinct()
        blocks = bloom.blocks_for(sum(r.n for r in found))
        if blocks <= FILTER_BLOCKS:
            few = bloom.build(maybe.withColumn("blocks", F.lit(blocks)), KEY)
            rows = rows.join(F.broadcast(few), (bloom.block_of(KEY, F.lit(blocks)) == few["block"]) & bloom.may_hold(few["bits"], F.col(KEY)), "left_semi")
        return maybe.join(rows.distinct(), KEY, "left_semi")

    # --- writing -------------------------------------------------------------------------------

    def append(self, rows: DataFrame, run: str | None = None) -> str:
        """Add rows under their day, and name them in the manifest when all is written. Rebalancing gives files of an even
        size. A run that is finished already adds nothing. Returns the run's name, by default a new one."""
        if run is None:
            run = uuid.uuid4().hex
        elif self.finished(rows.sparkSession, run):
            return run
        self._name(rows.sparkSession, self._stage(rows, run))
        return run

    def _stage(self, rows: DataFrame, run: str) -> list:
        """Write a run's files, filters and cube; returns its part of the manifest."""
        spark, batch = rows.sparkSession, uuid.uuid4().hex
        folder = f"{self.path}/files/batch={batch}"
        _as_fact(rows).hint("rebalance").write.partitionBy("scraped_date").parquet(folder)
        written = spark.read.schema(STORED_FACT).option("basePath", folder).parquet(folder)
        with ThreadPoolExecutor(1) as beside:
            cube = beside.submit(summary_cube(written).write.parquet, f"{self.path}/cube/batch={batch}")
            by_file = written.groupBy(F.regexp_extract("_metadata.file_path", "/files/(batch=.*)$", 1).alias("file"), "scraped_date").agg(F.count("*").alias("n"))
            files = [Row(run=run, batch=batch, file=r.file, scraped_date=r.scraped_date, n_rows=r.n) for r in by_file.collect()]
            if files:
                sizes = _filter_sizes(files)
                dated = [F.lit(x) for (_, day), n in sizes.items() if day is not None for x in (day, n)]
                blocks = F.try_element_at(F.create_map(*dated), F.col("scraped_date")) if dated else F.lit(None).cast("int")
                keys = written.select("scraped_date", KEY, F.coalesce(blocks, F.lit(sizes.get((batch, None)))).alias("blocks"))
                bloom.build(keys, KEY, "scraped_date").write.parquet(f"{self.path}/filters/batch={batch}")
            cube.result()
        return [*files, Row(run=run, batch=batch, file=None, scraped_date=None, n_rows=sum(r.n_rows for r in files))]

    def _name(self, spark, files: list) -> None:
        """Make a run's files visible: one file, so one rename."""
        spark.createDataFrame(files, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def correct(self, before: DataFrame, after: DataFrame, run: str | None = None) -> str:
        """Take rows out of the table's counts and put their corrected form in, as a run without rows: the cube follows the
        correction, the stored comments stay as they were scored."""
        spark, batch = before.sparkSession, uuid.uuid4().hex
        if run is None or not self.finished(spark, run):
            run = run or uuid.uuid4().hex
            merge_cubes(summary_cube(before, -1), summary_cube(after)).write.parquet(f"{self.path}/cube/batch={batch}")
            self._name(spark, [Row(run=run, batch=batch, file=None, scraped_date=None, n_rows=0)])
        return run


@dataclass(frozen=True)
class FactTable:
    """The fact table in the catalog, by day and bucketed by comment key.

    Finding known comments then reads the stored keys bucket by bucket and shuffles only the new batch.
    """

    name: str
    buckets: int
    path: str | None = None

    def read(self, spark) -> DataFrame:
        if not spark.catalog.tableExists(self.name):
            return spark.createDataFrame([], STORED_FACT)
        return spark.table(self.name).select(*STORED_FACT.names)

    def finished(self, spark, run: str) -> bool:
        return False

    def known(self, spark, keys: DataFrame) -> DataFrame:
        """Those of some distinct keys that are stored; stored keys stay where they are."""
        return keys.join(self.read(spark).select(KEY), KEY, "left_semi")

    def append(self, rows: DataFrame, run: str | None = None) -> None:
        """Add rows. Rebalancing by key keeps a bucket's rows together, and splits the bucket of a hot text."""
        even = _as_fact(rows).hint("rebalance", KEY)
        writer = even.write.mode("append").partitionBy("scraped_date").bucketBy(self.buckets, KEY).sortBy(KEY)
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)


def fact_store(store):
    """A store, or FactFiles for a path."""
    return FactFiles(store) if isinstance(store, str) else store


def read_fact(spark, path) -> DataFrame:
    return FactFiles(path).read(spark)


def append_fact(rows: DataFrame, path):
    FactFiles(path).append(rows)


def added_rows(store, spark, run: str | None, run_date, keys: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """What a run added: its own files, or in a catalog table the rows of its day with its keys, which no earlier run stored."""
    if run is not None:
        return store.added(spark, run)
    day = store.read(spark).where(F.col("scraped_date") == F.lit(run_date).cast("date"))
    return join_unique(day, keys, KEY, "left_semi", hot_rows)
