"""Collecting, dropping known comments, storing, reviewing and streaming, over `documents`."""

import datetime
from functools import reduce

from pyspark.sql import functions as F

from checks import views as V
from checks.catalog import query
from checks.views import SQL_LABEL, SQL_SCORE, table
from sentilake import constants as K
from sentilake import schemas as S
from sentilake.operators import dedup as D
from sentilake.operators import review as R
from sentilake.plans import ingest as I
from sentilake.plans.review_round import review_round
from sentilake.session import scratch_path
from sentilake.sources import tables as T
from sentilake.sources.fact import STORED_FACT, FactFiles
from sentilake.streaming import monitor as M

RUN_DATE = datetime.date(2024, 3, 1)


def _land(rows, path, source):
    """Write one source's part of the records in the source's own columns."""
    own = {common: name for name, common in K.CANONICAL_NAMES[source].items()}
    records = rows.where(F.col("source") == source).withColumnsRenamed(own)
    if source == K.FORUM_SOURCE:
        records = records.withColumn("post_number", F.col("doc_id").cast("int"))
    T.write_landing(records, path, source)


def _landing(spark, d):
    path = scratch_path(spark, "landing")
    rows = V.landed(spark, d)
    for source in K.CANONICAL_NAMES:
        _land(rows, path, source)
    return path


# --- collect ----------------------------------------------------------------------------------


@query("collect_all_sources", "landed", sql="SELECT article_url, article_title, comment, source FROM landed WHERE source <> '5ch'")
def collect_all_sources(spark, d):
    return I.collect_landing(spark, _landing(spark, d), "all")


@query("collect_forum", "landed", sql="SELECT article_url, article_title, comment, source FROM landed WHERE source = '5ch'")
def collect_forum(spark, d):
    return I.collect_landing(spark, _landing(spark, d), "5ch")


@query(
    "union_missing_columns", "landed",
    sql="SELECT article_url, comment, CAST(NULL AS INTEGER) AS post_number FROM landed UNION ALL SELECT 'c' || conv_id, text, CAST(turn AS INTEGER) FROM conversations",
)
def union_missing_columns(spark, d):
    turns = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("article_url"),
        F.col("text").alias("comment"),
        F.col("turn").cast("int").alias("post_number"),
    )
    return T.union_by_name([V.landed(spark, d).select("article_url", "comment"), turns])


# --- drop known, store ------------------------------------------------------------------------

_NEW = "landed_new AS (SELECT * FROM landed WHERE comment NOT IN (SELECT text FROM documents SEMI JOIN labels USING (doc_id)))"


def _stored(spark, d):
    """Comments of the labelled documents."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").select(F.col("text").alias("comment"))


@query("drop_known_comments", "landed", sql=", " + _NEW + " SELECT doc_id, source FROM landed_new")
def drop_known_comments(spark, d):
    return D.drop_known(V.landed(spark, d), _stored(spark, d)).select("doc_id", "source")


@query("drop_known_comments_salted", "landed", sql=", " + _NEW + " SELECT doc_id, source FROM landed_new")
def drop_known_comments_salted(spark, d):
    """The same with every repeated text treated as a hot key."""
    return D.drop_known(V.landed(spark, d), _stored(spark, d), hot_rows=2).select("doc_id", "source")


_SCORED = f"{SQL_LABEL.format('comment')} AS sentiment, {SQL_SCORE.format('comment')} AS score"


@query(
    "ingest_new_comments", "landed",
    sql=f""", {_NEW} SELECT article_url, article_title, comment, source, 'acme' AS keyword, DATE '2024-03-01' AS scraped_date, {_SCORED}
FROM landed_new WHERE source <> '5ch'""",
)
def ingest_new_comments(spark, d):
    collected = V.landed(spark, d).where(F.col("source").isin(*K.ALL_SOURCES)).select(*S.CANONICAL.names)
    added = I.new_rows(collected, _stored(spark, d), "acme", RUN_DATE, V.length_scorer)
    return added.select(*S.FACT.names)


_RERUN = f"""SELECT keyword, scraped_date, count(*) AS n_rows, round(sum(score), 4) AS score_sum FROM (
SELECT 'acme' AS keyword, DATE '2024-03-01' AS scraped_date, {_SCORED} FROM landed WHERE source <> '5ch' UNION ALL
SELECT 'other', DATE '2024-03-02', {_SCORED} FROM landed WHERE source = '5ch'
  AND comment NOT IN (SELECT comment FROM landed WHERE source <> '5ch')) GROUP BY 1, 2"""


def _rerun(spark, d, store):
    """A run, the same run again, then another brand and day: what the fact table holds."""
    landing = _landing(spark, d)
    I.run(spark, landing, store, "acme", "all", RUN_DATE, V.length_scorer)
    I.run(spark, landing, store, "acme", "all", RUN_DATE, V.length_scorer)
    I.run(spark, landing, store, "other", "5ch", datetime.date(2024, 3, 2), V.length_scorer)
    stored = store.read(spark).groupBy("keyword", "scraped_date")
    return stored.agg(F.count("*").alias("n_rows"), F.round(F.sum("score"), 4).alias("score_sum"))


@query("ingest_rerun", "landed", sql=_RERUN)
def ingest_rerun(spark, d):
    return _rerun(spark, d, FactFiles(scratch_path(spark, "fact")))


class Stopped(Exception):
    """A run that ends between writing its files and naming them."""


class _Stopping(FactFiles):
    def _name(self, spark, files):
        raise Stopped


@query("ingest_after_a_stop", "landed", sql=_RERUN)
def ingest_after_a_stop(spark, d):
    """Two runs stop when their files are written: nothing of them shows, and their replay adds each row once."""
    path, landing = scratch_path(spark, "fact"), _landing(spark, d)
    runs = [("acme", "all", RUN_DATE), ("other", "5ch", datetime.date(2024, 3, 2))]
    for keyword, source, day in runs:
        for store in (_Stopping(path), FactFiles(path), FactFiles(path)):
            try:
                I.ingest(I.collect_landing(spark, landing, source), store, keyword, day, V.length_scorer, run=f"{keyword} {day}")
            except Stopped:
                pass
    stored = FactFiles(path).read(spark).groupBy("keyword", "scraped_date")
    return stored.agg(F.count("*").alias("n_rows"), F.round(F.sum("score"), 4).alias("score_sum"))


@query("known_by_filters", sql="SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents SEMI JOIN labels USING (doc_id))")
def known_by_filters(spark, d):
    """Documents whose text a fact table of seven days holds, found through the days' key filters whatever their number."""
    store = FactFiles(scratch_path(spark, "fact"), filter_from=0)
    scored = I.new_rows(_stored(spark, d), None, "acme", RUN_DATE, V.length_scorer)
    rows = scored.withColumns({c: F.lit("") for c in ("article_url", "article_title", "source")})
    store.append(rows.withColumn("scraped_date", F.date_add("scraped_date", F.pmod(F.hash("comment"), F.lit(7)))))
    documents = D.with_key(table(spark, d, "documents").withColumnRenamed("text", "comment"))
    known = store.known(spark, documents.select(D.KEY).distinct())
    return documents.join(known, D.KEY, "left_semi").select("doc_id")


@query(
    "cube_of_runs", "comments",
    sql="""SELECT keyword, source, scraped_date, sentiment, count(*) AS n_rows, count(score) AS score_rows, round(sum(score), 6) AS score_sum
FROM (SELECT * REPLACE (CASE WHEN id % 50 = 0 AND sentiment IS NOT NULL THEN 'neutral' ELSE sentiment END AS sentiment) FROM comments) GROUP BY 1, 2, 3, 4""",
)
def cube_of_runs(spark, d):
    """Counts of three runs and a round of corrections, from the runs' own cubes: no stored comment is read."""
    store = FactFiles(scratch_path(spark, "fact"))
    rows = V.comments(spark, d).withColumn("article_url", F.col("id").cast("string"))
    for i in range(3):
        store.append(rows.where(F.col("id") % 3 == i))
    wrong = rows.where((F.col("id") % 50 == 0) & F.col("sentiment").isNotNull() & (F.col("sentiment") != "neutral"))
    store.correct(wrong, wrong.withColumn("sentiment", F.lit("neutral")))
    cells = store.cube(spark).groupBy("keyword", "source", "scraped_date", "sentiment")
    return cells.agg(F.sum("n_rows").alias("n_rows"), F.sum("score_rows").alias("score_rows"), F.round(F.sum("score_sum"), 6).alias("score_sum"))


@query("ingest_rerun_bucketed", "landed", sql=_RERUN)
def ingest_rerun_bucketed(spark, d):
    """The same with the fact table in the catalog, bucketed by comment key."""
    path = scratch_path(spark, "fact")
    name = "fact_" + path.rsplit("-", 1)[1]
    _rerun(spark, d, T.FactTable(name, 8, path))
    spark.sql(f"DROP TABLE {name}")
    stored = spark.read.schema(STORED_FACT).parquet(path).groupBy("keyword", "scraped_date")
    return stored.agg(F.count("*").alias("n_rows"), F.round(F.sum("score"), 4).alias("score_sum"))


@query(
    "ingest_summary", "landed",
    sql=f"""SELECT s.sentiment, (SELECT count(*) FROM (SELECT {_SCORED} FROM landed WHERE source <> '5ch') x WHERE x.sentiment = s.sentiment) AS n
FROM (VALUES ('positive'), ('neutral'), ('negative')) s(sentiment)""",
)
def ingest_summary(spark, d):
    """The run's own summary, classes without a comment included."""
    result = I.run(spark, _landing(spark, d), scratch_path(spark, "fact"), "acme", "all", RUN_DATE, V.length_scorer)
    return result[1].select("sentiment", "n")


@query(
    "fact_partition_read", "comments",
    sql="SELECT id, keyword, scraped_date, score FROM (SELECT id, keyword, scraped_date, score, max(scraped_date) OVER () AS newest FROM comments) WHERE scraped_date = newest",
)
def fact_partition_read(spark, d):
    """Append by day, then read the newest day's folder."""
    path = scratch_path(spark, "fact")
    rows = V.comments(spark, d).withColumn("article_url", F.col("id").cast("string"))
    T.append_fact(rows, path)
    newest = rows.agg(F.max("scraped_date")).first()[0]
    day = T.read_fact(spark, path).where(F.col("scraped_date") == F.lit(newest))
    return day.select(F.col("article_url").cast("long").alias("id"), "keyword", "scraped_date", "score")


@query(
    "fact_csv_roundtrip", "landed",
    sql=f"""SELECT article_url, article_title, comment, source, 'acme "x", y' AS keyword, DATE '2024-03-01' AS scraped_date, {_SCORED}
FROM (SELECT article_url, article_title, '  ' || chr(9) || comment || ' ' || chr(10) || ' ' AS comment, source FROM landed)""",
)
def fact_csv_roundtrip(spark, d):
    """Texts with line ends, quotes, commas and white space around them through CSV with a byte order mark."""
    path = scratch_path(spark, "csv")
    padded = V.landed(spark, d).withColumn("comment", F.concat(F.lit("  \t"), "comment", F.lit(" \n ")))
    rows = I.new_rows(padded.select(*S.CANONICAL.names), None, 'acme "x", y', RUN_DATE, V.length_scorer)
    T.write_csv(rows.select(*S.FACT.names), path, bom=True)
    return T.read_fact_csv(spark, path)


@query(
    "source_csv_union", "landed",
    sql="SELECT article_url, article_title, comment, source FROM landed WHERE source <> '5ch'",
)
def source_csv_union(spark, d):
    """Every routed source's own CSV files, read back, renamed, stamped and united."""
    frames = {}
    for source in K.ALL_SOURCES:
        own = {common: name for name, common in K.CANONICAL_NAMES[source].items()}
        path = scratch_path(spark, source)
        rows = V.landed(spark, d).where(F.col("source") == source).withColumnsRenamed(own)
        T.write_csv(rows.select(*S.LANDING[source].names), path, bom=True)
        frames[source] = T.read_source_csv(spark, path, source)
    return I.collect(frames, "all")


@query(
    "ingest_from_csv", "landed",
    sql=f"""SELECT source, count(*) AS n_rows, round(sum(score), 4) AS score_sum FROM (SELECT source, {_SCORED}
FROM (SELECT source, ' ' || comment || ' ' AS comment FROM landed WHERE source <> '5ch')) GROUP BY 1""",
)
def ingest_from_csv(spark, d):
    """A fact table exported as CSV, read again as a new batch: the same texts, so nothing is stored twice."""
    fact, csv = scratch_path(spark, "fact"), scratch_path(spark, "csv")
    padded = V.landed(spark, d).where(F.col("source").isin(*K.ALL_SOURCES)).withColumn("comment", F.concat(F.lit(" "), "comment", F.lit(" ")))
    I.ingest(padded.select(*S.CANONICAL.names), fact, "acme", RUN_DATE, V.length_scorer)
    T.write_csv(T.read_fact(spark, fact).select(*S.FACT.names), csv, bom=True)
    I.ingest(T.read_fact_csv(spark, csv).select(*S.CANONICAL.names), fact, "acme", datetime.date(2024, 3, 2), V.length_scorer)
    stored = T.read_fact(spark, fact).groupBy("source")
    return stored.agg(F.count("*").alias("n_rows"), F.round(F.sum("score"), 4).alias("score_sum"))


@query(
    "benchmark_csv",
    sql="""SELECT text, CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS label,
CASE WHEN doc_id % 4 <> 0 THEN 'source ' || source || ', "' || lang || '"' END AS notes FROM documents""",
)
def benchmark_csv(spark, d):
    """A benchmark set with quoted commas, quotes and missing notes; a file without its columns is refused."""
    path = scratch_path(spark, "benchmark")
    label = F.element_at(F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative")), (F.col("doc_id") % 3 + 1).cast("int"))
    notes = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("source "), "source", F.lit(', "'), "lang", F.lit('"')))
    T.write_csv(table(spark, d, "documents").select("text", label.alias("label"), notes.alias("notes")), path)
    read = T.read_benchmark_csv(spark, path)
    try:
        S.require_columns(read, "text", "label", "human_label")
    except ValueError:
        return S.require_columns(read, "text", "label", "notes")
    raise AssertionError("a missing column was not noticed")


@query(
    "export_filtered_comments", "comments",
    sql="SELECT CAST(id AS BIGINT) AS id, sentiment, comment, scraped_date FROM comments WHERE sentiment IN ('positive', 'negative')",
)
def export_filtered_comments(spark, d):
    path = scratch_path(spark, "export")
    T.export_comments(V.comments(spark, d), path, ("positive", "negative"))
    schema = "id long, sentiment string, comment string, scraped_date date"
    return T.read_csv(spark, path, spark.createDataFrame([], schema).schema)


# --- review -----------------------------------------------------------------------------------


def _labelled(spark, d):
    return V.human(spark, d)


@query("review_pending", "predicted", "human", sql="SELECT doc_id, sentiment FROM predicted WHERE comment NOT IN (SELECT comment FROM human)")
def review_pending(spark, d):
    return R.pending(V.predicted(spark, d), _labelled(spark, d)).select("doc_id", "sentiment")


_APPLIED = """, latest AS (SELECT comment, trim(lower(arg_max(decision, seq))) AS k FROM decisions GROUP BY comment),
applied AS (SELECT p.*, CASE k WHEN '' THEN sentiment WHEN 'p' THEN 'positive' WHEN 'n' THEN 'negative' WHEN 'u' THEN 'neutral' END AS human_label
  FROM predicted p JOIN latest USING (comment) WHERE comment NOT IN (SELECT comment FROM human) AND k IN ('', 'p', 'n', 'u'))
"""


@query("review_apply", "predicted", "human", "decisions", sql=_APPLIED + "SELECT doc_id, sentiment, human_label FROM applied")
def review_apply(spark, d):
    decided = R.apply_decisions(V.predicted(spark, d), V.decisions(spark, d), "seq", _labelled(spark, d))
    return decided.select("doc_id", "sentiment", "human_label")


@query("review_apply_salted", "predicted", "human", "decisions", sql=_APPLIED + "SELECT doc_id, sentiment, human_label FROM applied")
def review_apply_salted(spark, d):
    """In two steps, with every repeated text treated as a hot key."""
    waiting = R.pending(V.predicted(spark, d), _labelled(spark, d), hot_rows=2)
    return R.apply_decisions(waiting, V.decisions(spark, d), "seq", hot_rows=2).select("doc_id", "sentiment", "human_label")


@query("label_distribution", "predicted", "human", sql="SELECT human_label, count(*) AS n FROM human GROUP BY 1")
def label_distribution(spark, d):
    return R.label_distribution(_labelled(spark, d))


@query(
    "review_corrections", "predicted", "human",
    sql="""SELECT count(*) AS labelled, count(*) FILTER (human_label <> sentiment) AS corrections,
CAST(count(*) FILTER (human_label <> sentiment) AS DOUBLE) / count(*) * 100 AS error_rate FROM human""",
)
def review_corrections(spark, d):
    return R.corrections(_labelled(spark, d))


@query(
    "agreement", "predicted", "human",
    sql="""SELECT count(*) AS labelled, count(*) FILTER (human_label = sentiment) AS agreed,
CAST(count(*) FILTER (human_label = sentiment) AS DOUBLE) / count(*) * 100 AS agreement FROM human""",
)
def agreement(spark, d):
    return R.agreement(_labelled(spark, d))


@query(
    "review_progress", "predicted", "human",
    sql="""SELECT count(*) AS total, count(*) FILTER (comment IN (SELECT comment FROM human)) AS done,
count(*) FILTER (comment NOT IN (SELECT comment FROM human)) AS remaining FROM predicted""",
)
def review_progress(spark, d):
    return R.progress(V.predicted(spark, d), _labelled(spark, d))


@query(
    "review_round", "predicted", "human", "decisions",
    sql=_APPLIED.replace("comment NOT IN (SELECT comment FROM human) AND", "")
    + """SELECT 'label ' || human_label AS item, count(*) AS n FROM applied GROUP BY 1
UNION ALL SELECT 'corrections', count(*) FILTER (human_label <> sentiment) FROM applied
UNION ALL SELECT 'remaining', count(*) FROM predicted WHERE comment NOT IN (SELECT comment FROM applied)""",
)
def review_round_report(spark, d):
    """A first round on everything, stored, and its report; a second one has nothing to decide but the skipped."""
    path = scratch_path(spark, "labelled")
    review_round(V.predicted(spark, d), V.decisions(spark, d), path, "seq")
    state = review_round(V.predicted(spark, d), V.decisions(spark, d), path, "seq")
    parts = [
        state["distribution"].select(F.concat(F.lit("label "), "human_label").alias("item"), "n"),
        state["corrections"].select(F.lit("corrections").alias("item"), F.col("corrections").alias("n")),
        state["progress"].select(F.lit("remaining").alias("item"), F.col("remaining").alias("n")),
    ]
    return reduce(lambda a, b: a.union(b), parts)


# --- stream -----------------------------------------------------------------------------------


@query(
    "stream_ingest", "landed",
    sql=f"SELECT comment, {_SCORED} FROM (SELECT DISTINCT comment FROM landed)",
)
def stream_ingest(spark, d):
    """Every source's records land file by file, the labelled documents twice; the fact table ends with each text once."""
    sources = tuple(K.CANONICAL_NAMES)
    landing, fact = scratch_path(spark, "landing"), scratch_path(spark, "fact")
    rows = V.landed(spark, d)
    again = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    for source in sources:
        _land(again, landing, source)
        _land(rows, landing, source)
    arriving = M.landing_stream(spark, landing, sources, files_per_batch=1)
    M.monitor(arriving, fact, scratch_path(spark, "state"), "acme", RUN_DATE, V.length_scorer).awaitTermination()
    return T.read_fact(spark, fact).select("comment", "sentiment", "score")
