"""Event annotations as a JSON map: brand -> list of {date, text}."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake import schemas as S
from sentilake.sources.paths import path_exists

_MAP = "map<string,array<struct<date:string,text:string>>>"


def _maps(value):
    """The JSON maps of a file: one on every line, or else one over the whole file. Anything else is an error."""
    lines = F.filter(F.split(value, "\n"), lambda line: F.trim(line) != "")
    each = F.transform(lines, lambda line: F.from_json(line, _MAP))
    whole = F.from_json(value, _MAP)
    broken = F.raise_error(F.concat(F.lit("annotations are no JSON map: "), F.substring(value, 1, 200))).cast(f"array<{_MAP}>")
    return F.when(F.forall(each, lambda m: m.isNotNull()), each).when(whole.isNotNull(), F.array(whole)).otherwise(broken)


def read_annotations(spark, path) -> DataFrame:
    """One row per note: keyword, idx (position in the brand's list), date, text. Empty if there is no file.

    A file is one JSON map, on any number of lines, or has one map on every line. Notes are written by hand and few.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.ANNOTATION)
    notes = (
        spark.read.text(path, wholetext=True)
        .select(F.explode(_maps(F.col("value"))).alias("map"))
        .select(F.explode("map").alias("keyword", "notes"))
        .select("keyword", F.posexplode("notes").alias("pos", "note"))
    )
    return notes.select(
        "keyword",
        F.col("pos").alias("idx"),
        F.to_date("note.date").alias("date"),
        F.col("note.text").alias("text"),
    )


def write_annotations(notes: DataFrame, path, mode="error", single=False):
    """JSON maps, one line per brand, its notes in order; `single` writes one map of all brands, as the page stores it."""
    note = F.struct("idx", F.date_format("date", "yyyy-MM-dd").alias("date"), "text")
    lists = notes.groupBy("keyword").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    lists = lists.withColumn("notes", F.transform("notes", lambda n: F.struct(n["date"].alias("date"), n["text"].alias("text"))))
    entry = F.struct("keyword", "notes")
    maps = lists.agg(F.collect_list(entry).alias("all")) if single else lists.select(F.array(entry).alias("all"))
    maps.select(F.to_json(F.map_from_entries("all")).alias("value")).write.mode(mode).text(path)
