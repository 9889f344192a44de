"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.shared import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours its smallest neighbour (or itself): its larger ones, or else its smaller ones."""
    if large:
        near = links.union(links.select("b", "a")).toDF("u", "v")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        near = links.toDF("v", "u")  # v < u
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"), F.col("m").alias("a"))
    return moved.where("a < b").select("a", "b").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) of every node of links (a, b), root being the smallest node that links reach. Loops (a = b) and
    nulls are left out; directions and repeats do not matter. Each round is a table in the shared folder."""
    now = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state, before = written(now, name), None
    while True:
        sign = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        state = written(_star(_star(state, True), False), name)
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(state.select("a", "a").distinct())
