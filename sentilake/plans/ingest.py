"""The recurring run: collect landed records, drop known comments, score, append."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake import schemas as S
from sentilake.operators.dedup import KEY, drop_known, first_per_comment, with_key
from sentilake.operators.panels import sentiment_summary, summary_comments
from sentilake.operators.scoring import Scorer, classify
from sentilake.operators.skew import join_unique
from sentilake.session import materialise
from sentilake.sources.fact import added_rows, fact_store
from sentilake.sources.tables import read_landing, union_by_name


def routed(source: str) -> tuple:
    """Sources a run covers."""
    if source == "all":
        return K.ALL_SOURCES
    if source not in K.CANONICAL_NAMES:
        raise ValueError(f"unknown source {source!r}")
    return (source,)


def canonical(records: DataFrame, source: str) -> DataFrame:
    """A source's records under the common names, stamped with the source."""
    renamed = records.withColumnsRenamed(K.CANONICAL_NAMES[source])
    return renamed.withColumn("source", F.lit(source))


def collect(frames: dict[str, DataFrame], source: str = "all") -> DataFrame | None:
    """Union of the routed sources' records; None if there is none of them."""
    chosen = [canonical(frames[s], s) for s in routed(source) if s in frames]
    return union_by_name(chosen).select(*S.CANONICAL.names) if chosen else None


def collect_landing(spark, landing: str, source: str = "all") -> DataFrame:
    return collect({s: read_landing(spark, landing, s) for s in routed(source)}, source)


def stamp(df: DataFrame, keyword: str | None, run_date: date) -> DataFrame:
    """Brand and run date of new rows. Rows that bring their own brand keep it when `keyword` is None."""
    if keyword is not None:
        df = df.withColumn("keyword", F.lit(keyword))
    return df.withColumn("scraped_date", F.lit(run_date).cast("date"))


def new_rows(
    collected: DataFrame, fact: DataFrame | None, keyword, run_date, scorer: Scorer, hot_rows: int | None = None
) -> DataFrame:
    """Fact rows of the comments not stored yet. Without a stored table nothing is dropped."""
    keyed = with_key(collected)
    fresh = keyed if fact is None else drop_known(keyed, fact, hot_rows=hot_rows)
    return classify(stamp(fresh, keyword, run_date), scorer)


def ingest(
    collected: DataFrame | None, fact, keyword, run_date, scorer: Scorer,
    once_per_comment: bool = False, hot_rows: int | None = None, run: str | None = None,
) -> DataFrame | None:
    """Append what is new to the fact table (a path or a store) and return it; None if nothing was.

    Only the keys of the new comments are kept aside, in reliable storage. The rows are scored on their way into the
    store, and what was added is read back from there. `once_per_comment` also drops copies within the batch, which makes
    a repeated run append nothing twice. A named `run` that is finished already is not done again: what it added is returned.
    """
    if collected is None:
        return None
    spark, store = collected.sparkSession, fact_store(fact)
    if run is not None and store.finished(spark, run):
        return store.added(spark, run)
    keyed = with_key(collected)
    if once_per_comment:
        keyed = first_per_comment(keyed, [F.col(c) for c in ("source", "article_url", "article_title") if c in keyed.columns])
    keys = keyed.select(KEY).distinct()
    fresh = materialise(keys.join(store.known(spark, keys), KEY, "left_anti"))
    if fresh.isEmpty():
        return None
    rows = join_unique(keyed, fresh, KEY, "left_semi", hot_rows)
    run = store.append(classify(stamp(rows, keyword, run_date), scorer), run)
    return added_rows(store, spark, run, run_date, fresh, hot_rows)


def run(spark, landing: str, fact, keyword: str, source: str, run_date, scorer: Scorer):
    """One monitoring run over the landed records. Returns (new rows, summary, top comments), or None."""
    added = ingest(collect_landing(spark, landing, source), fact, keyword, run_date, scorer)
    if added is None:
        return None
    return added, sentiment_summary(added), summary_comments(added, tie=("article_url", "comment"))
