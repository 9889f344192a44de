"""Samples of many parts: grouping, joining, filtering, drawing and batching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import range_of

IMAGES = ["jpg", "png", "jpeg", "webp"]
#: Fixed constants of the minimal-standard generator, which other SQL engines repeat exactly.
MODULUS, FACTOR = 2147483647, 48271


def grouped(members: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """(shard, key, parts) of members (shard, key, ext, data): extensions in lower case, the last of equal ones by
    order (if there is such a column) stands."""
    x = members.withColumn("ext", F.lower("ext"))
    if suffixes:
        x = x.where(F.col("ext").isin(suffixes))
    order = F.col("order") if "order" in members.columns else F.lit(0)
    last = x.groupBy("shard", "key", "ext").agg(F.max_by("data", F.struct(order, "data")).alias("data"))
    return last.groupBy("shard", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "data")))).alias("parts"))


def overlaid(a: DataFrame, b: DataFrame) -> DataFrame:
    """All samples of both sides; of equal parts b's stands. (shard, key) is unique on each side."""
    none = F.expr("cast(map() as map<string,string>)").cast(dict(a.dtypes)["parts"])
    x = a.withColumnRenamed("parts", "p").join(b.withColumnRenamed("parts", "q"), ["shard", "key"], "full_outer")
    p, q = F.coalesce("p", none), F.coalesce("q", none)
    own = F.map_filter(p, lambda k, _: ~F.map_contains_key(q, k))
    return x.select("shard", "key", F.map_concat(own, q).alias("parts"))


def complete(parts: str = "parts") -> Column:
    """Whether a caption and an image are there."""
    has = lambda k: F.coalesce(F.map_contains_key(parts, F.lit(k)), F.lit(False))
    image = has(IMAGES[0])
    for k in IMAGES[1:]:
        image = image | has(k)
    return has("txt") & image


def large_enough(least: int | None) -> Column:
    return F.lit(True) if least is None else F.least("width", "height") >= least


def first_part(names: str, parts: str = "parts") -> Column:
    """The first of the parts in "a;b;c" that is there."""
    return F.coalesce(*(F.try_element_at(F.col(parts), F.lit(k)) for k in names.split(";")))


def embedding_payload(parts: str = "parts") -> Column:
    return first_part("npz;pth.gz", parts)


def batched(rows: DataFrame, size: int, order: list[str], partial: bool) -> DataFrame:
    """batch_id and pos. The order is total, so the numbering is one sequence: it goes by counts per range of the first
    order column, and no task sees all rows. A partial last batch stays or goes."""
    x = rows.withColumn("_p", range_of(rows, order[0], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    x = x.withColumn("_n", own)
    counts = x.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select(F.col("_p"), (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # one row a partition
    x = x.join(F.broadcast(before), "_p").withColumn("_at", F.col("_b") + F.col("_n") - 1)
    x = x.withColumn("batch_id", F.floor(F.col("_at") / size).cast("long")).withColumn("pos", (F.col("_at") % size).cast("int"))
    if not partial:
        total = counts.agg(F.sum("_c")).first()[0] or 0
        x = x.where(F.col("batch_id") < total // size)
    return x.drop("_p", "_n", "_b", "_at")


def batch_count(rows: int, size: int) -> int:
    return math.ceil(rows / size)


def draw(*keys: Column | int, seed: int = 0) -> Column:
    """A number below MODULUS that depends on the keys alone."""
    out = F.lit(seed % MODULUS).cast("long")
    for k in keys:
        k = F.lit(k) if isinstance(k, int) else k
        out = ((out + F.pmod(k.cast("long"), F.lit(MODULUS)) + 1) * FACTOR) % MODULUS
    return (out * FACTOR) % MODULUS


def chosen(array: Column, index: Column) -> Column:
    """Element index modulo the size; NULL of an empty array."""
    return F.get(array, F.when(F.size(array) > 0, F.pmod(index, F.size(array))).cast("int"))


def index_of(array: Column, epoch: int, sequential: bool, *keys: Column, seed: int = 0) -> Column:
    """epoch modulo the size, or a draw; NULL of an empty array."""
    at = F.lit(epoch).cast("long") if sequential else draw(*keys, epoch, seed=seed)
    return F.when(F.size(array) > 0, F.pmod(at, F.size(array))).cast("int")


def keys_like(m: Column, pattern: str) -> Column:
    """Entries whose key matches from its start on."""
    return F.map_filter(m, lambda k, _: k.rlike(f"^(?:{pattern})"))


def drawn_synthetic(syn: Column, epoch: int, sequential: bool, *keys: Column, seed: int = 1) -> Column:
    """struct(key, index, text): the key is always drawn; the caption goes by the epoch in sequential mode."""
    names = F.array_sort(F.map_keys(syn))
    key = chosen(names, draw(*keys, epoch, seed=seed))
    texts = F.try_element_at(syn, key)
    at = index_of(texts, epoch, sequential, *keys, seed=seed + 1)
    return F.struct(key.alias("key"), at.alias("index"), F.get(texts, at).alias("text"))


def synthetic_embedding(text_emb: Column, n_texts: Column, syn_emb: Column, key: Column, index: Column) -> Column:
    """Behind the true captions' vectors if there are more of them than captions, else under the key's own name."""
    return F.when(F.size(text_emb) > n_texts, F.get(text_emb, n_texts + index)).otherwise(F.get(F.try_element_at(syn_emb, F.concat(key, F.lit("_emb"))), index))


def mixed(gt: Column, syn: Column, ratio: float, *keys: Column, seed: int = 3) -> Column:
    """syn in a share `ratio` of rows, else gt."""
    return F.when(draw(*keys, seed=seed) < F.lit(int(ratio * MODULUS)), syn).otherwise(gt)


def resampled(shards: DataFrame, slots: int, epoch: int, seed: int = 0, weight: str | None = None) -> DataFrame:
    """(slot, and the columns of shards): shards drawn with replacement. shards has shard_id from 0 without gaps; weight
    names a column of whole numbers that repeat a shard."""
    spark = shards.sparkSession
    if weight:
        shards = shards.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(weight))))
        at = F.row_number().over(Window.orderBy("shard_id", "_copy")) - 1  # a list of shards is short
        shards = shards.withColumn("_at", at.cast("long")).drop("_copy")
    else:
        shards = shards.withColumn("_at", F.col("shard_id").cast("long"))
    n = shards.count()
    picks = spark.range(slots).select(F.col("id").alias("slot"), (draw(F.col("id"), epoch, seed=seed) % max(n, 1)).alias("_at"))
    return picks.join(shards, "_at").drop("_at")


def train_rows(samples: DataFrame, epoch: int = 0, sequential: bool = False, distill: bool = False, ratio: float = 0.0, key_pattern: str = "syn_text.*", seed: int = 0, by: Column | None = None) -> DataFrame:
    """One training row a sample (key, paug, texts, syn_texts, image_emb, text_emb, syn_emb): a drawn augmentation and
    caption with the vectors of the same places, and a synthetic caption. With distill no stored vectors are used. Draws
    go by the number `by`, the key's hash if not given."""
    key = F.xxhash64("key") if by is None else by
    syn = drawn_synthetic(keys_like(F.col("syn_texts"), key_pattern), epoch, sequential, key, seed=seed + 2)
    x = samples.withColumns({"_aug": index_of(F.col("paug"), epoch, sequential, key, seed=seed), "_cap": index_of(F.col("texts"), epoch, sequential, key, seed=seed + 1), "_syn": syn})
    none = F.array().cast("array<float>")
    vector = lambda v: none if distill else F.coalesce(v, none)
    syn_vector = synthetic_embedding(F.col("text_emb"), F.size("texts"), F.col("syn_emb"), F.col("_syn.key"), F.col("_syn.index"))
    swap = draw(key, epoch, seed=seed + 7) < F.lit(int(ratio * MODULUS))
    text, emb = F.get("texts", F.col("_cap")), vector(F.get("text_emb", F.col("_cap")))
    out = {"text": F.when(swap, F.col("_syn.text")).otherwise(text), "text_emb": F.when(swap, vector(syn_vector)).otherwise(emb)}
    syn_out = (F.col("_syn.text"), vector(syn_vector)) if not ratio else (F.lit(None).cast("string"), none)
    return x.select("key", F.lit(epoch).alias("epoch"), F.get("paug", F.col("_aug")).alias("paug"), vector(F.get("image_emb", F.col("_aug"))).alias("image_emb"), out["text"].alias("text"), out["text_emb"].alias("text_emb"), syn_out[0].alias("syn_text"), syn_out[1].alias("syn_text_emb"))


def stacked(gt: DataFrame, syn: DataFrame) -> DataFrame:
    """Both sets of rows with their kind; split them again by it."""
    return gt.withColumn("kind", F.lit("gt")).unionByName(syn.withColumn("kind", F.lit("syn")))


def budget(iterations: int, global_batch: int, checkpoints: int, nodes: int, per_node: int) -> dict[str, int]:
    seen = iterations * global_batch
    return {"num_seen": seen, "per_epoch": seen // checkpoints, "per_worker_batch": global_batch // nodes // per_node}


def merged_config(stored: dict, runtime: dict) -> dict:
    """Stored transforms without normalisation, and with the run's mean, std, crop size and interpolation."""
    out = {k: dict(v) for k, v in stored.items() if k != "normalize"}
    if {"mean", "std"} <= runtime.keys():
        out["normalize"] = {"mean": runtime["mean"], "std": runtime["std"]}
    for k in ("size", "interpolation"):
        if k in runtime and "random_resized_crop" in out:
            out["random_resized_crop"][k] = runtime[k]
    return out
