"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import functions as F

from sentilake.llm.common import discard, stage


def _star(edges, small):
    """Every node's neighbours on one side hang on its least neighbour; least values are pre-aggregated, nothing is gathered."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    side = both.filter(F.col("v") < F.col("u")) if small else both.filter(F.col("v") > F.col("u"))
    out = side.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges, a="a", b="b"):
    """(node, component) for every node with an edge; a component is its least node. Loops and repeats don't matter."""
    spark = edges.sparkSession
    current = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "components")
    seen = None
    while True:
        before, current = current, stage(_star(_star(current, False), True), "components")
        discard(spark, before)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
