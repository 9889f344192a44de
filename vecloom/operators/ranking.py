"""Class prototypes, scores, ranks and recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.session import size_in_bytes

#: Bytes of the class side that are broadcast at once.
BLOCK = 64 << 20


def prototypes(rows: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(class, prototype): the unit mean of the unit vectors of each label. Sums run per component, with partial
    aggregation, so a label may hold any share of the rows."""
    units = rows.select(F.col(label).alias("class"), V.unit(V.double(vector)).alias("u")).where("u IS NOT NULL")
    means = units.select("class", F.posexplode("u").alias("i", "x")).groupBy("class", "i").agg(F.avg("x").alias("x"))
    whole = means.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return whole.select("class", V.unit(F.col("mean")).alias("prototype"))


def class_scores(queries: DataFrame, classes: DataFrame, keep: list[str], vector: str = "embedding") -> DataFrame:
    """keep, class and score (cosine) of every query and class. The class side is a table of classes: a block of them is
    broadcast at a time, as many blocks as its bytes take."""
    q = queries.select(*keep, V.unit(V.double(vector)).alias("_u"))
    blocks = max(1, -(-size_in_bytes(classes) // BLOCK))
    out = None
    for b in range(blocks):
        some = classes if blocks == 1 else classes.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == b)
        one = q.crossJoin(F.broadcast(some)).select(*keep, "class", V.dot(F.col("_u"), F.col("prototype")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def ranked(scores: DataFrame, by: list[str], score: str = "score", name: str = "class") -> DataFrame:
    """rank from 1; equal scores by name."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), name)))


def topk_accuracy(ranks: DataFrame, label: str = "label", ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """acc1, acc5, ...: the share of queries whose label is among the first k; NULL where there are fewer than k classes."""
    hit = ranks.where(F.col("class") == F.col(label))
    per = ranks.agg(F.max("rank").alias("n"), F.count_if(F.col("rank") == 1).alias("queries"))
    out = hit.agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks)).crossJoin(F.broadcast(per))
    return out.select(*(F.when(F.col("n") >= k, F.try_divide(F.col(f"h{k}"), F.col("queries"))).alias(f"acc{k}") for k in ks))


def first_place(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The best class of each query, by one aggregation."""
    return scores.groupBy(*by).agg(F.min_by("class", F.struct(-F.col(score), "class")).alias("predicted"))


def highlighted(scores: DataFrame, by: list[str], least: float = 0.22, within: float = 0.05) -> DataFrame:
    """Whether a score is good in itself and close to its query's best."""
    best = F.max("score").over(Window.partitionBy(*by))
    return scores.withColumn("highlight", (F.col("score") >= least) & (F.col("score") >= F.coalesce(best, F.lit(0.0)) * (1 - within)))


def recall_among_all(pairs: DataFrame, key: str, image: str, text: str, ks: tuple[int, ...] = (1, 5, 10), block: int = 4096, digits: int = 9) -> DataFrame:
    """(direction, k, recall) both ways: every image ranked against the texts of all pairs, and every text against all
    images, by their products rounded to `digits`; equal ones by key. Blocks of queries meet blocks of candidates as
    matrix products, and a query keeps only the number of candidates before its match."""
    x = pairs.select(F.col(key).cast("long").alias("key"), V.double(image).alias("a"), V.double(text).alias("b"))
    blocks = max(1, -(-x.count() // block))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    asked = x.withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = x.withColumn("y", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).toDF("other", "a_", "b_", "y_", "x_")

    def count(asked: pa.Table, held: pa.Table) -> pa.Table:
        name = asked.column("key").to_numpy()
        other = held.column("other").to_numpy()
        q = {s: np.array(asked.column(s).to_pylist(), float).reshape(len(name), -1) for s in "ab"}
        c = {s: np.array(held.column(f"{s}_").to_pylist(), float).reshape(len(other), -1) for s in "ab"}
        match = np.round((q["a"] * q["b"]).sum(axis=1), digits)[:, None]
        out = []
        for mine, theirs in ("ab", "ba"):
            s = np.round(q[mine] @ c[theirs].T, digits) if len(name) and len(other) else np.zeros((len(name), len(other)))
            before = (s > match) | (s == match) & (other < name[:, None])
            out.append((before & (other != name[:, None])).sum(axis=1))
        return pa.table({"key": name, "texts": out[0].astype(np.int64), "images": out[1].astype(np.int64)})

    counted = asked.groupBy("x", "y").cogroup(held.groupBy("x_", "y_")).applyInArrow(count, "key long, texts long, images long")
    places = counted.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("images").alias("images"))
    told = places.select(F.explode(F.array(F.struct(F.lit("image_to_text").alias("direction"), F.col("texts").alias("n")), F.struct(F.lit("text_to_image").alias("direction"), F.col("images").alias("n")))).alias("s"))
    told = told.select("s.direction", F.explode(F.array(*map(F.lit, ks))).alias("k"), "s.n")
    return told.groupBy("direction", "k").agg(F.avg((F.col("n") < F.col("k")).cast("double")).alias("recall"))


def recall_at(pairs: DataFrame, image: str, text: str, match: Column, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(direction, k, recall) both ways, of scored pairs."""
    out = None
    for direction, query, other in (("image_to_text", image, text), ("text_to_image", text, image)):
        place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), other))
        hits = pairs.withColumn("place", place).where(match)
        one = hits.agg(*(F.avg((F.col("place") <= k).cast("double")).alias(str(k)) for k in ks))
        one = one.select(F.lit(direction).alias("direction"), F.explode(F.create_map(*(x for k in ks for x in (F.lit(k), F.col(str(k)))))).alias("k", "recall"))
        out = one if out is None else out.unionByName(one)
    return out
