"""Edits on event annotations: rows (keyword, idx, date, text), idx the place in the brand's list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_annotation(notes: DataFrame, keyword: str, date, text: str) -> DataFrame:
    """Append a note to a brand's list. An empty text adds nothing."""
    if not text:
        return notes
    place = F.coalesce(F.max("idx") + 1, F.lit(0)).cast(notes.schema["idx"].dataType)
    added = notes.where(F.col("keyword") == keyword).agg(place.alias("idx"))
    added = added.select(
        F.lit(keyword).alias("keyword"), "idx", F.to_date(F.lit(str(date))).alias("date"), F.lit(text).alias("text")
    )
    return notes.select("keyword", "idx", "date", "text").union(added)


def delete_annotation(notes: DataFrame, position: int, keyword: str | None = None) -> DataFrame:
    """Remove the note at a position of a brand's list (of every brand's without `keyword`); later ones move up."""
    meant = F.lit(True) if keyword is None else F.col("keyword") == keyword
    kept = notes.where(~(meant & (F.col("idx") == position)))
    moved = F.when(meant & (F.col("idx") > position), F.col("idx") - 1).otherwise(F.col("idx"))
    return kept.withColumn("idx", moved.cast(notes.schema["idx"].dataType))


def list_annotations(notes: DataFrame, keyword: str | None = None) -> DataFrame:
    """Notes in list order, of one brand or of all."""
    chosen = notes if keyword is None else notes.where(F.col("keyword") == keyword)
    return chosen.select("keyword", "idx", "date", "text").orderBy("keyword", "idx")


def replay(log: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Lists after an ordered log of edits: rows (keyword, seq, op, date, text, position), op `add` or `delete`.

    The edits of a brand are applied in the order of `seq`: an add puts its note at the list's end unless its text is empty,
    a delete takes out the note that stands at its position by then, and nothing where none stands there. `notes` are the
    lists before the log. A brand's edits meet in one row, as its list does wherever it is stored.
    """
    edit = ["keyword", "seq", "op", "date", "text", "position"]
    edits = log.select("keyword", F.col("seq").cast("long").alias("seq"), "op", F.col("date").cast("date").alias("date"), "text", F.col("position").cast("int").alias("position"))
    if notes is not None:
        least = F.lit(-(2**62)) + F.col("idx")
        before = notes.select("keyword", least.alias("seq"), F.lit("add").alias("op"), "date", "text", F.lit(None).cast("int").alias("position"))
        edits = before.unionByName(edits)
    ordered = F.array_sort(F.collect_list(F.struct(*edit[1:])))
    note = lambda e: F.struct(e["date"].alias("date"), e["text"].alias("text"))
    start = F.array().cast("array<struct<date:date,text:string>>")

    def step(held, e):
        at = e["position"]
        out = F.concat(F.slice(held, F.lit(1), at), F.slice(held, at + 2, F.size(held)))
        added = F.when(F.coalesce(e["text"], F.lit("")) != "", F.concat(held, F.array(note(e)))).otherwise(held)
        return F.when(e["op"] == "add", added).when((e["op"] == "delete") & (at >= 0) & (at < F.size(held)), out).otherwise(held)

    lists = edits.groupBy("keyword").agg(F.aggregate(ordered, start, step).alias("held"))
    return lists.select("keyword", F.posexplode("held").alias("idx", "note")).select("keyword", "idx", "note.date", "note.text")
