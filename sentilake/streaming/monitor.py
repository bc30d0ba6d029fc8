"""The recurring run as a stream: files that land are ingested in micro-batches."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sentilake import schemas as S
from sentilake.operators.scoring import Scorer
from sentilake.plans.ingest import canonical, ingest
from sentilake.sources.tables import union_by_name


def landing_stream(spark, landing: str, sources, files_per_batch: int | None = None) -> DataFrame:
    """Arriving records of several sources under the common names."""

    def stream(source):
        reader = spark.readStream.schema(S.LANDING[source])
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return canonical(reader.parquet(f"{landing}/source={source}"), source).select(*S.CANONICAL.names)

    return union_by_name([stream(s) for s in sources])


def identity(spark, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint began."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()[0]


def monitor(
    arriving: DataFrame, fact, checkpoint: str, keyword: str, run_date: date | Callable[[], date], scorer: Scorer,
    available_now: bool = True,
) -> StreamingQuery:
    """Ingest every micro-batch into the fact table (a path or a store).

    A batch is a run named by the stream's identity, which lies in its checkpoint, and the batch's number: replayed after it
    was finished it does nothing, and stopped before it has left nothing to see. A stream begun anew finds its stored comments
    again: membership in the fact table is the only state, so no watermark bounds it. A stream that goes on over days needs
    its date as a function, asked for each batch.
    """
    if not available_now and not callable(run_date):
        raise ValueError("a stream that goes on needs run_date as a function")

    def store(batch: DataFrame, batch_id: int):
        day = run_date() if callable(run_date) else run_date
        ingest(batch, fact, keyword, day, scorer, once_per_comment=True, run=f"{identity(batch.sparkSession, checkpoint)} {batch_id}")

    writer = arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
