"""Losses over pair tables.

A pair table has batch, i, j and a student logit s; teachers add t. Pairs are made by an equi-join on batch, so their
number grows with the batch size and not with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V

ROW, COLUMN = ["batch", "i"], ["batch", "j"]


def pairs(rows: DataFrame, image: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """batch, i, j, a, b (and carried columns of the image side) of all pairs inside each batch of rows (batch, pos)."""
    left = rows.select("batch", F.col("pos").alias("i"), F.col(image).alias("a"), *carry)
    right = rows.select("batch", F.col("pos").alias("j"), F.col(text).alias("b"))
    return left.join(right, "batch")


def log_softmax(x: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    top = F.max(x).over(w)
    return x - top - F.log(F.sum(F.exp(x - top)).over(w))


def softmax(x: Column, by: list[str]) -> Column:
    return F.exp(log_softmax(x, by))


def teachers(table: DataFrame, widths: list[int], scales: list[float], biases: list[float] | None = None, kind: str = "softmax") -> DataFrame:
    """The pair table with teacher targets from ensemble vectors a, b: t_row and t_col (mean of the teachers' softmaxes
    along rows and columns), or t (mean of sigmoids, mapped to -1..1)."""
    n, biases = len(scales), biases or [0.0] * len(scales)
    logits = [scales[t] * V.dot(V.part(F.col("a"), widths, t), V.part(F.col("b"), widths, t)) + biases[t] for t in range(n)]
    x = table.withColumns({f"_l{t}": logits[t] for t in range(n)})
    mean = lambda cols: sum(cols[1:], cols[0]) / n
    if kind == "sigmoid":
        return x.withColumn("t", mean([2 * V.sigmoid(F.col(f"_l{t}")) - 1 for t in range(n)])).drop(*(f"_l{t}" for t in range(n)))
    x = x.withColumns({f"_r{t}": softmax(F.col(f"_l{t}"), ROW) for t in range(n)}).withColumns({f"_c{t}": softmax(F.col(f"_l{t}"), COLUMN) for t in range(n)})
    return x.withColumns({"t_row": mean([F.col(f"_r{t}") for t in range(n)]), "t_col": mean([F.col(f"_c{t}") for t in range(n)])}).drop(*(f"_{p}{t}" for t in range(n) for p in "lrc"))


def contrastive(table: DataFrame, weight: float = 1.0) -> DataFrame:
    """(batch, loss): cross entropy of the matching pair, by rows and by columns, halved."""
    x = table.withColumns({"_r": log_softmax(F.col("s"), ROW), "_c": log_softmax(F.col("s"), COLUMN)})
    return x.where("i = j").groupBy("batch").agg((F.avg(-F.col("_r") - F.col("_c")) / 2 * weight).alias("loss"))


def distillation(table: DataFrame, weight: float = 1.0, average_after_softmax: bool = False) -> DataFrame:
    """(batch, loss): cross entropy of the student with teacher targets, both ways, halved. Targets are t_row and t_col
    if they are probabilities already, else the softmaxes of a teacher logit t."""
    x = table.withColumns({"_r": log_softmax(F.col("s"), ROW), "_c": log_softmax(F.col("s"), COLUMN)})
    if not average_after_softmax:
        x = x.withColumns({"t_row": softmax(F.col("t"), ROW), "t_col": softmax(F.col("t"), COLUMN)})
    out = x.groupBy("batch").agg(F.sum(-F.col("t_row") * F.col("_r") - F.col("t_col") * F.col("_c")).alias("total"), F.countDistinct("i").alias("n"))
    return out.select("batch", (F.col("total") / F.col("n") / 2 * weight).alias("loss"))


def sigmoid_loss(table: DataFrame, weight: float = 1.0, label: Column | None = None) -> DataFrame:
    """(batch, loss): -log sigmoid(label * s), summed over a row and averaged over rows. label is +1 on the diagonal and
    -1 elsewhere, or a teacher's target."""
    sign = F.when(F.col("i") == F.col("j"), 1.0).otherwise(-1.0) if label is None else label
    out = table.groupBy("batch").agg(F.sum(-V.log_sigmoid(sign * F.col("s"))).alias("total"), F.countDistinct("i").alias("n"))
    return out.select("batch", (F.col("total") / F.col("n") * weight).alias("loss"))


def negative_only(table: DataFrame) -> DataFrame:
    """The sigmoid loss of blocks that hold no matching pairs, as summed parts: (batch, total)."""
    return table.groupBy("batch").agg(F.sum(-V.log_sigmoid(-F.col("s"))).alias("total"))


def reinforced(gt: DataFrame, syn: DataFrame | None, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(batch, contrastive, distillation, loss): both losses on the true captions, plus on synthetic ones if given."""
    kinds = [gt] + ([syn] if syn is not None else [])
    parts = [f.withColumn("part", F.lit(name)) for t in kinds for f, name in ((contrastive(t, weights[0]), "c"), (distillation(t, weights[1], True), "d"))]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    out = x.groupBy("batch").agg(F.sum(F.when(F.col("part") == "c", F.col("loss"))).alias("contrastive"), F.sum(F.when(F.col("part") == "d", F.col("loss"))).alias("distillation"))
    return out.withColumn("loss", F.col("contrastive") + F.col("distillation"))


def choose(distill: bool = False, reinforcement: bool = False, sigmoid: bool = False, caption: bool = False) -> str:
    """Which loss a run uses, in this order: distillation without stored targets, captions, sigmoid, stored targets,
    plain."""
    if distill and not reinforcement:
        return "distill_sigmoid" if sigmoid else "distill"
    if caption:
        return "caption"
    return "sigmoid" if sigmoid else "reinforced" if reinforcement else "contrastive"
