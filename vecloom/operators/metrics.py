"""Aggregations over predictions and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_class_recall(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("recall"))


def mean_per_class_recall(predicted: DataFrame) -> DataFrame:
    return per_class_recall(predicted).agg(F.avg("recall").alias("mean_per_class_recall"))


def macro_scores(predicted: DataFrame) -> DataFrame:
    """f1_macro and recall_macro over all classes that occur as label or prediction; one pass over the rows."""
    counts = predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("label").alias("c"), (F.col("label") == F.col("predicted")).cast("long").alias("hit"), F.lit(1).alias("truth"), F.lit(0).alias("guess")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("hit"), F.lit(0).alias("truth"), F.lit(1).alias("guess")))).alias("s"), "n")
    per = sides.groupBy(F.col("s.c").alias("c")).agg(F.sum(F.col("s.hit") * F.col("n")).alias("hit"), F.sum(F.col("s.truth") * F.col("n")).alias("truth"), F.sum(F.col("s.guess") * F.col("n")).alias("guess"))
    return per.agg(F.avg(F.try_divide(2.0 * F.col("hit"), F.col("truth") + F.col("guess"))).alias("f1_macro"), F.avg(F.try_divide(1.0 * F.col("hit"), F.col("truth"))).alias("recall_macro"))


def by_group(rows: DataFrame, group: list[str], value: Column, domain: DataFrame | None = None) -> DataFrame:
    """acc and count of each group; groups of the domain without rows have NaN and 0."""
    out = rows.groupBy(*group).agg(F.avg(value.cast("double")).alias("acc"), F.count("*").alias("count"))
    if domain is None:
        return out
    return domain.join(out, group, "left").select(*group, F.coalesce("acc", F.lit(float("nan"))).alias("acc"), F.coalesce("count", F.lit(0)).alias("count"))


def worst(groups: DataFrame, value: str = "acc") -> DataFrame:
    """The least value of groups that have one. It is the least for harmful rates too, as published results have it."""
    return groups.agg(F.min(F.when(~F.isnan(value), F.col(value))).alias("worst"), F.try_divide(F.sum(F.when(~F.isnan(value), F.col(value) * F.col("count"))), F.sum("count")).alias("average"))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def pairwise_test(rows: DataFrame) -> DataFrame:
    """image_acc, text_acc and acc of rows with the scores own (image and its caption), text_wrong, image_wrong."""
    image, text = F.col("own") > F.col("image_wrong"), F.col("own") > F.col("text_wrong")
    return rows.agg(F.avg(image.cast("double")).alias("image_acc"), F.avg(text.cast("double")).alias("text_acc"), F.avg((image & text).cast("double")).alias("acc"))


def parameter_change(rows: DataFrame) -> DataFrame:
    """Sums of before and after, their difference and its percentage."""
    out = rows.agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("percent", F.try_divide(100.0 * F.col("delta"), F.col("before")))
