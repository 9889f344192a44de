"""Queries of shards, sample parts, training rows, pixels and numeric columns, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vecloom.functions import bpe as B
from vecloom.functions import vectors as V
from vecloom.operators import augment as A
from vecloom.operators import losses as L
from vecloom.operators import samples as S
from vecloom.plans import corpus_queries, embedding_queries
from vecloom.session import table
from vecloom.sources import configs as C
from vecloom.sources import shards, web
from vecloom.streaming import frames as P


def r6(c):
    return F.round(c, 6)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _parts(spark, sf_dir):
    """A sample a document: language and source as text parts, an image part of changing kind, and vectors in one of two
    kinds of file or none."""
    d = F.col("doc_id")
    entry = lambda name, value: F.struct(F.lit(name).alias("k") if isinstance(name, str) else name.alias("k"), value.alias("v"))
    image = F.element_at(F.array(*map(F.lit, S.IMAGES)), (d % 4 + 1).cast("int"))
    entries = F.array(entry("txt", F.col("lang")), entry("url.txt", F.col("source")), entry(image, F.col("n_chars").cast("string")))
    vectors = F.when(d % 3 == 0, F.array(entry("npz", d.cast("string")))).when(d % 3 == 1, F.array(entry("pth.gz", (-d).cast("string")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    return documents(spark, sf_dir).select((d % 16).cast("string").alias("shard"), F.lpad(d.cast("string"), 9, "0").alias("key"), "doc_id", F.map_from_entries(F.concat(entries, vectors)).alias("parts"))


def tar_members(spark, sf_dir):
    """Shards written as tars and read back, without their vectors."""
    read = shards.tar_members(shards.tars(_parts(spark, sf_dir).select("shard", "key", "parts")), ["txt", "url.txt", *S.IMAGES])
    return read.select("shard", "key", "ext", F.decode("data", "utf-8").alias("data"))


def coalesced_parts(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", S.first_part("webp;png;jpg").alias("image"), S.first_part("cls").alias("label"))


def embedding_payload(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", S.embedding_payload().alias("vectors"))


def mapped_columns(spark, sf_dir):
    """Parts under new names, each by its own column expression, and in a fixed order."""
    x = _parts(spark, sf_dir).withColumns({"image": F.try_element_at("parts", F.lit("jpg")), "text": F.upper(F.try_element_at("parts", F.lit("txt")))})
    return x.select("doc_id", F.struct("image", "text").alias("pair")).select("doc_id", "pair.*")


def error_tolerant_parse(spark, sf_dir):
    """A JSON column whose every seventh value is broken off: told, not dropped."""
    broken = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    x = shards.parsed(table(spark, sf_dir, "events").select("event_id", broken.alias("props")), "props", "k int")
    return x.select("event_id", F.col("props.k").alias("k"), F.col("_corrupt").alias("corrupt"))


def untyped_json(spark, sf_dir):
    """The same field by a path, without a schema."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"), F.try_variant_get(F.parse_json("props"), "$.none", "int").alias("none"))


def fetched_urls(spark, sf_dir):
    """Pages' URLs by a getter that fails for every third length."""

    def get(url: str, timeout: float) -> bytes:
        if len(url) % 3 == 0:
            raise OSError("gone")
        return url.upper().encode()

    x = web.fetched(table(spark, sf_dir, "pages").select("url"), tries=1, get=get)
    return x.select("url", F.decode("content", "utf-8").alias("body"), "error")


def result_lines(spark, sf_dir):
    """JSON records of evaluations, some with NaN or broken, parsed and reduced to their main metric."""
    size = F.col("p_size")
    key = F.when(size % 4 == 0, "retrieval/a").when(size % 4 == 1, "wilds/fmow").when(size % 4 == 2, "fairness/utkface").otherwise("imagenet1k")
    value = F.when(size % 5 == 0, "NaN").otherwise((size / 100).cast("string"))
    line = F.concat(F.lit('{"key": "'), key, F.lit('", "dataset": "d", "metrics": {"acc1": '), value, F.lit(', "mean_recall@1": 0.25, "acc_worst_region": null}}'))
    lines = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.when(size % 11 == 0, "{broken").otherwise(line).alias("value"))
    x = C.main_metrics(C.parsed_results(lines))
    return x.groupBy("key").agg(F.count("*").alias("records"), F.count("main_metric").alias("n"), r6(F.avg("main_metric")).alias("main_metric"))


def metric_rows(spark, sf_dir):
    x = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), r6(F.max("o_totalprice")).alias("top"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    return C.as_metrics(x)


def evaluation_paths(spark, sf_dir):
    tasks = [f"wds/task{i}" for i in range(12)]
    rows = [(t, i, p) for t in tasks for i, p in enumerate(shards.evaluation_source(t, "root", shards=2))]
    return spark.createDataFrame(rows, "task string, shard long, path string")


def merge_ranks(spark, sf_dir):
    """A merge list by rule: every pair of neighbours in the alphabet, behind a header line."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    ranks = B.read_merges(["#version", *(f"{a} {b}" for a, b in zip(letters, letters[1:], strict=False)), ""])
    return spark.createDataFrame([(a, b, r) for (a, b), r in ranks.items()], "left string, right string, rank long")


def byte_alphabet(spark, sf_dir):
    return spark.createDataFrame([*B.byte_symbols().items()], "byte long, symbol string")


def preset_prompts(spark, sf_dir):
    from vecloom.functions import text as X

    x = X.presets(spark)
    every = x.select("title", "prefix", "suffix", F.posexplode("class_names").alias("place", "name"))
    return every.select("title", F.col("place").cast("long").alias("place"), X.prompt(F.col("prefix"), F.col("name"), F.col("suffix")).alias("prompt"))


def _training(spark, sf_dir):
    d = F.col("doc_id")
    vector = lambda *v: F.array(*v).cast("array<float>")
    syn = F.create_map(F.lit("syn_text"), F.array(F.reverse("lang"), F.reverse("source")), F.lit("syn_text_b"), F.array(F.upper("lang")), F.lit("other"), F.array(F.lit("x")))
    syn_emb = F.create_map(F.lit("syn_text_emb"), F.array(vector(d + 0.5), vector(d + 1.5)), F.lit("syn_text_b_emb"), F.array(vector(d + 2.5)))
    return documents(spark, sf_dir).select(d.cast("string").alias("key"), F.array(d, d + 1, d + 2).alias("paug"), F.array("lang", "source").alias("texts"), syn.alias("syn_texts"), F.array(vector(d), vector(d * 2), vector(d * 3)).alias("image_emb"), F.array(vector(-d), vector(-d * 2)).alias("text_emb"), syn_emb.alias("syn_emb"))


def _told(x):
    one = lambda c: F.get(c, 0).cast("long")
    return x.select(F.col("key").cast("long").alias("doc_id"), "epoch", "paug", one("image_emb").alias("image"), "text", one("text_emb").alias("text_vector"), "syn_text", F.get("syn_text_emb", 0).cast("double").alias("syn_vector"))


def training_rows(spark, sf_dir):
    return _told(S.train_rows(_training(spark, sf_dir), epoch=3, sequential=True, by=F.col("key").cast("long"), seed=4))


def training_rows_drawn(spark, sf_dir):
    return _told(S.train_rows(_training(spark, sf_dir), epoch=1, by=F.col("key").cast("long"), seed=4))


def training_rows_mixed(spark, sf_dir):
    """Half of the captions are synthetic ones, with their vectors."""
    return _told(S.train_rows(_training(spark, sf_dir), epoch=2, sequential=True, ratio=0.5, key_pattern="syn_text$", by=F.col("key").cast("long"))).drop("syn_text", "syn_vector")


def training_rows_online(spark, sf_dir):
    """Teachers run online: no stored vectors."""
    return _told(S.train_rows(_training(spark, sf_dir), epoch=5, sequential=True, distill=True, by=F.col("key").cast("long"))).drop("syn_text")


def synthetic_keys(spark, sf_dir):
    syn = S.drawn_synthetic(S.keys_like(F.col("syn_texts"), "syn_text.*"), 7, False, F.col("key").cast("long"), seed=6)
    return _training(spark, sf_dir).select(F.col("key").cast("long").alias("doc_id"), syn.alias("s")).select("doc_id", F.col("s.key").alias("syn_key"), F.col("s.text").alias("syn_text"))


def config_override(spark, sf_dir):
    stored = {"normalize": {"mean": [0.0]}, "random_resized_crop": {"size": 256, "scale": [0.1, 1.0]}, "rand_augment": {"p": 0.9}}
    runtime = {"mean": [0.5], "std": [0.25], "size": 224, "interpolation": "bicubic"}
    rows = [(k, a, json.dumps(b)) for k, v in S.merged_config(stored, runtime).items() for a, b in v.items()]
    return spark.createDataFrame(rows, "transform string, setting string, value string")


def config_split(spark, sf_dir):
    before, after = A.split_config({k: {} for k in ["to_tensor", "mixup", "resize", "cutmix"]})
    return spark.createDataFrame([(k, False) for k in before] + [(k, True) for k in after], "transform string, after_collate boolean")


def magnitudes(spark, sf_dir):
    """The strength of every operation in bin 10 of 31, for images of 224 x 160."""
    rows = [(op, *A.magnitude(op, 10, 31, 224, 160)) for op in A.OPERATIONS]
    return spark.createDataFrame(rows, "op string, magnitude double, signed boolean").withColumn("magnitude", r6("magnitude"))


def loss_precedence(spark, sf_dir):
    rows = [(d, r, s, c, L.choose(d, r, s, c)) for d in (False, True) for r in (False, True) for s in (False, True) for c in (False, True)]
    return spark.createDataFrame(rows, "distill boolean, reinforcement boolean, sigmoid boolean, caption boolean, loss string")


def weighted_losses(spark, sf_dir):
    """Contrastive loss at a quarter, distillation at three quarters."""
    x = embedding_queries.embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).alias("batch"), (F.col("vec_id") % 32).alias("pos"), V.double("embedding").alias("v"))
    t = L.pairs(x, "v", "v").withColumns({"s": 8 * V.dot(F.col("a"), F.col("b")), "t": 4 * V.dot(F.col("a"), F.reverse("b"))})
    parts = L.contrastive(t, 0.25).withColumnRenamed("loss", "contrastive").join(L.distillation(t, 0.75).withColumnRenamed("loss", "distillation"), "batch")
    return parts.select(F.col("batch").cast("long").alias("batch"), r6("contrastive").alias("contrastive"), r6("distillation").alias("distillation"))


def weighted_shards(spark, sf_dir):
    """Slots drawn with replacement from nations' shards, each repeated by its weight."""
    x = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("shard_id"), (F.col("n_nationkey") % 4 + 1).cast("long").alias("weight"))
    return S.resampled(x, 500, 2, seed=8, weight="weight").select("slot", "shard_id")


def member_features(spark, sf_dir):
    """Two encoders' vectors, each of unit length, one after the other."""
    v = V.double("embedding")
    x = table(spark, sf_dir, "embeddings").select("vec_id", V.joined(V.unit(F.slice(v, 1, 48)), V.unit(F.slice(v, 49, 16))).alias("f"))
    return x.select("vec_id", F.size("f").alias("n"), r6(F.get("f", 0)).alias("first"), r6(F.get("f", 63)).alias("last"))


def _tokens():
    """An embedding as eight tokens of eight numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(V.double("embedding"), i * 8 + 1, F.lit(8)))


def attention(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", _tokens().alias("m"))
    x = x.select("vec_id", V.attention(F.col("m"), F.col("m"), F.col("m")).alias("a"), V.attention(F.col("m"), F.col("m"), F.col("m"), causal=True).alias("c"))
    return x.select("vec_id", r6(F.get(F.get("a", 5), 2)).alias("whole"), r6(F.get(F.get("c", 5), 2)).alias("causal"), r6(F.get(F.get("c", 0), 7)).alias("first"))


def position_resize(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", V.resized_rows(_tokens(), 12).alias("w"), V.resized_rows(_tokens(), 4).alias("n"), V.resized_rows(_tokens(), 8).alias("s"))
    at = lambda c, i, j: r6(F.get(F.get(c, i), j))
    return x.select("vec_id", at("w", 0, 0).alias("edge"), at("w", 5, 3).alias("wide"), at("n", 2, 1).alias("narrow"), at("s", 7, 7).alias("same"))


def half_precision(spark, sf_dir):
    x = (F.col("value") - 250) * F.when(F.col("event_id") % 3 == 0, 1e-7).when(F.col("event_id") % 3 == 1, 1.0).otherwise(500.0)
    return table(spark, sf_dir, "events").select("event_id", V.half(x).alias("half"))


def byte_range(spark, sf_dir):
    """Values of -1 to 1 as bytes and back."""
    share = F.transform(V.double("embedding"), lambda v: (v + 1) / 2)
    x = table(spark, sf_dir, "embeddings").select("vec_id", V.to_bytes_range(share).alias("b"))
    back = V.to_unit_range(F.col("b"))
    return x.select("vec_id", F.aggregate("b", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), r6(F.get(back, 0)).alias("first"), r6(V.total(back)).alias("mean"))


#: Parameters of each transform of pixel_transforms, over images of 8 x 8 pixels.
PIXELS = {
    "center_crop": ({"center_crop": {"size": 4}}, {"center_crop": ()}),
    "resize": ({"resize": {"size": 4}}, {"resize": ()}),
    "random_crop": ({"random_crop": {"size": 3}}, {"random_crop": (1, 4)}),
    "random_resized_crop": ({"random_resized_crop": {"size": 2}}, {"random_resized_crop": (2, 1, 4, 4)}),
    "flip": ({"random_horizontal_flip": {}}, {"random_horizontal_flip": True}),
    "erasing": ({"random_erasing": {}}, {"random_erasing": (2, 5, 3, 2)}),
    "no_erasing": ({"random_erasing": {}}, {"random_erasing": (-1, 0, 0, 0)}),
    "preprocess": ({"resize": {"size": 8}, "center_crop": {"size": 6}, "to_tensor": {}}, {"resize": (), "center_crop": (), "to_tensor": ()}),
    **{op: ({"rand_augment": {}}, {"rand_augment": [(op, m)]}) for op, m in [("Identity", 0.0), ("ShearX", 1.0), ("ShearY", -1.0), ("TranslateX", 2.0), ("TranslateY", -3.0), ("Rotate", 90.0), ("Brightness", 0.5), ("Color", 0.5), ("Contrast", -0.5), ("Sharpness", -1.0), ("Posterize", 3.0), ("Solarize", 128.0), ("AutoContrast", 0.0)]},
}


def pixel_transforms(spark, sf_dir):
    """Stored parameters applied to grey images made of embeddings: a checksum of each result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, sums = [], [], []
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                image = np.floor((np.array(v) + 1) * 127.5).astype(np.uint8).reshape(8, 8, 1)
                for name, (config, params) in PIXELS.items():
                    out = A.applied(image, params, config).astype(float).ravel()
                    ids.append(vec_id), names.append(name), sums.append(float((out * np.arange(1, len(out) + 1)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(sums, pa.float64())], names=["vec_id", "transform", "checksum"])

    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), V.double("embedding").alias("v"))
    return x.mapInArrow(run, "vec_id long, transform string, checksum double").withColumn("checksum", F.round("checksum", 3))


def mixed_batches(spark, sf_dir):
    """MixUp or CutMix for each batch of 16 images, with their labels."""
    x = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), (F.col("vec_id") % 16).cast("long").alias("pos"), "vec_id", V.double("embedding").alias("v"), "label")
    y = A.mixed_batch(x, 16, 10, {"mixup": 0.7, "cutmix": 0.6})
    weighed = lambda c: V.total(F.transform(c, lambda a, i: a * (i + 1)))
    return y.select("vec_id", "kind", r6(weighed(F.col("v"))).alias("pixels"), r6(weighed(F.col("target"))).alias("target"))


def frame_scores(spark, sf_dir):
    """The newest odd vectors as frames, against class vectors; none of the classes gives no rows."""
    x = embedding_queries.embeddings(spark, sf_dir)
    from vecloom.operators import ranking as R

    classes = R.prototypes(x.where("vec_id % 2 = 0"))
    frames = P.newest(x.where("vec_id % 2 = 1").withColumn("camera", F.col("vec_id") % 14), ["camera"], ["vec_id"])
    some, none = (P.scored(frames, c, ["camera"]) for c in (classes, classes.where("false")))
    return some.unionByName(none).select("camera", "class", r6("score").alias("score"))


_FUNCTIONS = (tar_members, coalesced_parts, embedding_payload, mapped_columns, error_tolerant_parse, untyped_json, fetched_urls, result_lines, metric_rows, evaluation_paths, merge_ranks, byte_alphabet, preset_prompts, training_rows, training_rows_drawn, training_rows_mixed, training_rows_online, synthetic_keys, config_override, config_split, magnitudes, loss_precedence, weighted_losses, weighted_shards, member_features, attention, position_resize, half_precision, byte_range, pixel_transforms, mixed_batches, frame_scores)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _draw(seed: int, *keys: str) -> str:
    return corpus_queries._draw(seed, *keys)


_IMAGE = "['jpg', 'png', 'jpeg', 'webp'][doc_id % 4 + 1]"
_SIZE = "CASE WHEN {0} % 4 = 0 THEN 'retrieval/a' WHEN {0} % 4 = 1 THEN 'wilds/fmow' WHEN {0} % 4 = 2 THEN 'fairness/utkface' ELSE 'imagenet1k' END"


def _train(epoch: int, paug: str, cap: str, key: str, at: str) -> str:
    syn_text = f"CASE WHEN {key} = 0 THEN reverse([lang, source][{at} + 1]) ELSE upper(lang) END"
    syn_vector = f"CASE WHEN {key} = 0 THEN doc_id + 0.5 + {at} ELSE doc_id + 2.5 END"
    return f"SELECT doc_id, CAST({epoch} AS INTEGER) AS epoch, doc_id + {paug} AS paug, doc_id * ({paug} + 1) AS image, [lang, source][{cap} + 1] AS text, -doc_id * ({cap} + 1) AS text_vector, {syn_text} AS syn_text, CAST({syn_vector} AS FLOAT)::DOUBLE AS syn_vector FROM documents"


_KEY4 = f"({_draw(6, 'doc_id', '3')} % 2)"
_HALF = "CASE WHEN x = 0 THEN x WHEN abs(x) >= 65520 THEN sign(x) * 'inf'::DOUBLE ELSE round_even(x / s, 0) * s END"
_TOK = "t AS (SELECT vec_id, list_transform(range(8), lambda i: (embedding::DOUBLE[])[i * 8 + 1:i * 8 + 8]) AS m FROM embeddings)"
_ATT = "list_sum(list_transform(range(1, {n} + 1), lambda j: exp(list_dot_product(m[{r}], m[j]) / sqrt(8)) * m[j][{c}])) / list_sum(list_transform(range(1, {n} + 1), lambda j: exp(list_dot_product(m[{r}], m[j]) / sqrt(8))))"
_P = "p AS (SELECT vec_id, k // 8 AS i, k % 8 AS j, floor((embedding[k + 1]::DOUBLE + 1) * 127.5) AS x FROM embeddings, range(64) r(k))"


def _moved(name: str, i: str, j: str) -> str:
    """A transform that takes pixel (i, j) to a place given by two expressions, if that lies in the image."""
    return f"SELECT vec_id, '{name}' AS transform, sum(CASE WHEN {i} BETWEEN 0 AND 7 AND {j} BETWEEN 0 AND 7 THEN x * (({i}) * 8 + {j} + 1) ELSE 0 END) AS c FROM p GROUP BY vec_id"


def _valued(name: str, v: str, where: str = "true", w: int = 8, i: str = "i", j: str = "j", frm: str = "p") -> str:
    return f"SELECT vec_id, '{name}' AS transform, sum({v} * (({i}) * {w} + {j} + 1)) AS c FROM {frm} WHERE {where} GROUP BY vec_id"


_AROUND = "(SELECT a.vec_id, a.i, a.j, CASE WHEN a.i BETWEEN 1 AND 6 AND a.j BETWEEN 1 AND 6 THEN (sum(b.x) + 4 * any_value(a.x)) / 13 ELSE any_value(a.x) END AS x FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.vec_id, a.i, a.j)"
_STATS = "(SELECT *, avg(x) OVER w AS mean, min(x) OVER w AS lo, max(x) OVER w AS hi FROM p WINDOW w AS (PARTITION BY vec_id))"
_PIXELS = [
    _valued("center_crop", "x", "i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5", 4, "i - 2", "j - 2"),
    _valued("resize", "x / 4", "true", 4, "i // 2", "j // 2"),
    _valued("random_crop", "x", "i BETWEEN 1 AND 3 AND j BETWEEN 4 AND 6", 3, "i - 1", "j - 4"),
    _valued("random_resized_crop", "x / 4", "i BETWEEN 2 AND 5 AND j BETWEEN 1 AND 4", 2, "(i - 2) // 2", "(j - 1) // 2"),
    _moved("flip", "i", "7 - j"),
    _valued("erasing", "x", "NOT (i BETWEEN 2 AND 4 AND j BETWEEN 5 AND 6)"),
    _valued("no_erasing", "x"),
    _valued("preprocess", "x / 255", "i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6", 6, "i - 1", "j - 1"),
    _valued("Identity", "x"),
    _valued("Color", "x"),
    # the middle of row i moves by i + 1/2 columns
    "SELECT vec_id, 'ShearX' AS transform, sum(x * (i * 8 + (j - i - 1) + 1)) AS c FROM p WHERE j - i - 1 >= 0 GROUP BY vec_id",
    "SELECT vec_id, 'ShearY' AS transform, sum(x * ((i + j) * 8 + j + 1)) AS c FROM p WHERE i + j <= 7 GROUP BY vec_id",
    _moved("TranslateX", "i", "j + 2"),
    _moved("TranslateY", "i - 3", "j"),
    _moved("Rotate", "7 - j", "i"),
    _valued("Brightness", "least(x * 1.5, 255)"),
    _valued("Contrast", "least(greatest((x - mean) * 0.5 + mean, 0), 255)", frm=_STATS),
    _valued("AutoContrast", "CASE WHEN hi > lo THEN (x - lo) * 255 / (hi - lo) ELSE x END", frm=_STATS),
    _valued("Sharpness", "x", frm=_AROUND),
    _valued("Posterize", "floor(x / 32) * 32"),
    _valued("Solarize", "CASE WHEN x >= 128 THEN 255 - x ELSE x END"),
]
_BATCH = f"b AS (SELECT vec_id, vec_id // 16 AS batch, vec_id % 16 AS pos, embedding::DOUBLE[] AS v, label FROM embeddings), m AS (SELECT a.*, o.v AS ov, o.label AS ol, CASE WHEN o.v IS NULL THEN 'none' ELSE ['mixup', 'cutmix'][{_draw(5, 'a.batch')} % 2 + 1] END AS kind FROM b a LEFT JOIN b o ON o.batch = a.batch AND o.pos = 15 - a.pos)"
#: The box of lambda 0.6 in 8 x 8 pixels: sides floor(8 * sqrt(0.4)) = 5, two to either side of the middle.
_INSIDE = "(k // 8 BETWEEN 2 AND 5 AND k % 8 BETWEEN 2 AND 5)"
SQL = {
    "tar_members": f"SELECT (doc_id % 16) || '.tar' AS shard, lpad(doc_id::VARCHAR, 9, '0') AS key, unnest(['txt', 'url.txt', {_IMAGE}]) AS ext, unnest([lang, source, n_chars::VARCHAR]) AS data FROM documents",
    "coalesced_parts": f"SELECT doc_id, CASE WHEN {_IMAGE} <> 'jpeg' THEN n_chars::VARCHAR END AS image, NULL::VARCHAR AS label FROM documents",
    "embedding_payload": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN (-doc_id)::VARCHAR END AS vectors FROM documents",
    "mapped_columns": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars::VARCHAR END AS image, upper(lang) AS text FROM documents",
    "error_tolerant_parse": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS INTEGER) END AS k, event_id % 7 = 0 AS corrupt FROM events",
    "untyped_json": "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS INTEGER) AS k, NULL::INTEGER AS \"none\" FROM events",
    "fetched_urls": "SELECT url, CASE WHEN length(url) % 3 <> 0 THEN upper(url) END AS body, CASE WHEN length(url) % 3 = 0 THEN 'gone' END AS error FROM pages",
    "result_lines": f"WITH x AS (SELECT {_SIZE.format('p_size')} AS key, p_size FROM part WHERE p_size % 11 <> 0), m AS (SELECT key, CASE key WHEN 'retrieval/a' THEN 0.25 WHEN 'imagenet1k' THEN CASE WHEN p_size % 5 <> 0 THEN p_size / 100 END END AS m FROM x) SELECT key, count(*) AS records, count(m) AS n, round(avg(m), 6) AS main_metric FROM m GROUP BY key",
    "metric_rows": "WITH x AS (SELECT count(*) AS n, round(max(o_totalprice), 6) AS top, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders) SELECT unnest(['orders', 'top', 'filled']) AS metric, unnest([n::DOUBLE, top, filled::DOUBLE]) AS value FROM x",
    "evaluation_paths": "SELECT 'wds/task' || i AS task, s AS shard, 'root/wds_wds-task' || i || '_test/test/' || s || '.tar' AS path FROM range(12) t(i), range(2) r(s)",
    "merge_ranks": 'SELECT chr(CAST(97 + i AS INTEGER)) AS "left", chr(CAST(98 + i AS INTEGER)) AS "right", i AS rank FROM range(25) t(i)',
    "byte_alphabet": "WITH b AS (SELECT i AS byte, i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i BETWEEN 174 AND 255 AS own FROM range(256) t(i)) SELECT byte, chr(CAST(CASE WHEN own THEN byte ELSE 255 + sum((NOT own)::INT) OVER (ORDER BY byte) END AS INTEGER)) AS symbol FROM b",
    "preset_prompts": "WITH p(title, prefix, names) AS (VALUES ('Desk items', 'A photo of', ['pen', 'pencil', 'paper', 'mouse', 'keyboard', 'computer', 'phone', 'stapler', 'cup']), ('Expressions', 'A person', ['smiling', 'waving', 'giving a thumbs up', 'sticking out their tongue', 'looking angry'])) SELECT title, i - 1 AS place, prefix || ' ' || names[i] || ' ' AS prompt FROM p, range(1, 10) t(i) WHERE i <= len(names)",
    "training_rows": _train(3, "0", "1", _KEY4, f"(3 % CASE WHEN {_KEY4} = 0 THEN 2 ELSE 1 END)"),
    "training_rows_drawn": _train(1, f"({_draw(4, 'doc_id', '1')} % 3)", f"({_draw(5, 'doc_id', '1')} % 2)", f"({_draw(6, 'doc_id', '1')} % 2)", f"({_draw(7, 'doc_id', '1')} % 2)"),
    "training_rows_mixed": f"SELECT doc_id, CAST(2 AS INTEGER) AS epoch, doc_id + 2 AS paug, doc_id * 3 AS image, CASE WHEN {_draw(7, 'doc_id', '2')} < {int(0.5 * S.MODULUS)} THEN reverse(lang) ELSE lang END AS text, CASE WHEN {_draw(7, 'doc_id', '2')} < {int(0.5 * S.MODULUS)} THEN CAST(trunc(CAST(doc_id + 0.5 AS FLOAT)) AS BIGINT) ELSE -doc_id END AS text_vector FROM documents",
    "training_rows_online": "SELECT doc_id, CAST(5 AS INTEGER) AS epoch, doc_id + 2 AS paug, NULL::BIGINT AS image, source AS text, NULL::BIGINT AS text_vector, NULL::DOUBLE AS syn_vector FROM documents",
    "synthetic_keys": f"SELECT doc_id, ['syn_text', 'syn_text_b'][{_draw(6, 'doc_id', '7')} % 2 + 1] AS syn_key, CASE WHEN {_draw(6, 'doc_id', '7')} % 2 = 0 THEN reverse([lang, source][{_draw(7, 'doc_id', '7')} % 2 + 1]) ELSE upper(lang) END AS syn_text FROM documents",
    "config_override": "SELECT * FROM (VALUES ('random_resized_crop', 'size', '224'), ('random_resized_crop', 'scale', '[0.1, 1.0]'), ('random_resized_crop', 'interpolation', '\"bicubic\"'), ('rand_augment', 'p', '0.9'), ('normalize', 'mean', '[0.5]'), ('normalize', 'std', '[0.25]')) t(transform, setting, value)",
    "config_split": "SELECT * FROM (VALUES ('to_tensor', false), ('resize', false), ('mixup', true), ('cutmix', true)) t(transform, after_collate)",
    "magnitudes": "SELECT op, round(m, 6) AS magnitude, signed FROM (VALUES ('Identity', 0::DOUBLE, false), ('ShearX', 0.3 / 3, true), ('ShearY', 0.3 / 3, true), ('TranslateX', 150 / 331 * 160 / 3, true), ('TranslateY', 150 / 331 * 224 / 3, true), ('Rotate', 10, true), ('Brightness', 0.3, true), ('Color', 0.3, true), ('Contrast', 0.3, true), ('Sharpness', 0.3, true), ('Posterize', 7, false), ('Solarize', 170, false), ('AutoContrast', 0, false), ('Equalize', 0, false)) t(op, m, signed)",
    "loss_precedence": "SELECT d AS distill, r AS reinforcement, s AS sigmoid, c AS caption, CASE WHEN d AND NOT r AND s THEN 'distill_sigmoid' WHEN d AND NOT r THEN 'distill' WHEN c THEN 'caption' WHEN s THEN 'sigmoid' WHEN r THEN 'reinforced' ELSE 'contrastive' END AS loss FROM (VALUES (false), (true)) t1(d), (VALUES (false), (true)) t2(r), (VALUES (false), (true)) t3(s), (VALUES (false), (true)) t4(c)",
    "weighted_losses": """WITH b AS (SELECT vec_id // 32 AS batch, vec_id % 32 AS pos, embedding::DOUBLE[] AS v FROM embeddings),
t AS (SELECT x.batch, x.pos AS i, y.pos AS j, 8 * list_dot_product(x.v, y.v) AS s, 4 * list_dot_product(x.v, list_reverse(y.v)) AS t FROM b x JOIN b y ON x.batch = y.batch),
l AS (SELECT *, s - ln(sum(exp(s)) OVER (PARTITION BY batch, i)) AS sr, s - ln(sum(exp(s)) OVER (PARTITION BY batch, j)) AS sc, exp(t) / sum(exp(t)) OVER (PARTITION BY batch, i) AS tr, exp(t) / sum(exp(t)) OVER (PARTITION BY batch, j) AS tc FROM t)
SELECT batch, round(0.25 * avg(-sr - sc) FILTER (i = j) / 2, 6) AS contrastive, round(0.75 * sum(-tr * sr - tc * sc) / count(DISTINCT i) / 2, 6) AS distillation FROM l GROUP BY batch""",
    "weighted_shards": f"WITH c AS (SELECT n_nationkey::BIGINT AS shard_id, row_number() OVER (ORDER BY n_nationkey, w) - 1 AS place FROM nation, range(4) t(w) WHERE w < n_nationkey % 4 + 1), s AS (SELECT i AS slot, {_draw(8, 'i', '2')} % (SELECT count(*) FROM c) AS place FROM range(500) t(i)) SELECT slot, shard_id FROM s JOIN c USING (place)",
    "member_features": "WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:48] AS a, (embedding::DOUBLE[])[49:64] AS b FROM embeddings) SELECT vec_id, CAST(64 AS INTEGER) AS n, round(a[1] / sqrt(list_dot_product(a, a)), 6) AS first, round(b[16] / sqrt(list_dot_product(b, b)), 6) AS last FROM e",
    "attention": f"WITH {_TOK} SELECT vec_id, round({_ATT.format(n=8, r=6, c=3)}, 6) AS whole, round({_ATT.format(n=6, r=6, c=3)}, 6) AS causal, round(m[1][8], 6) AS first FROM t",
    # places of rows 0 and 5 of 12 among 8: 0 (held) and 5.5 * 8 / 12 - 0.5 = 3 + 1/6; of row 2 of 4: 4.5
    "position_resize": f"WITH {_TOK} SELECT vec_id, round(m[1][1], 6) AS edge, round(m[4][4] * 5 / 6 + m[5][4] / 6, 6) AS wide, round((m[5][2] + m[6][2]) / 2, 6) AS narrow, round(m[8][8], 6) AS same FROM t",
    "half_precision": f"WITH x AS (SELECT event_id, (value - 250) * CASE event_id % 3 WHEN 0 THEN 1e-7 WHEN 1 THEN 1.0 ELSE 500.0 END::DOUBLE AS x FROM events), s AS (SELECT *, pow(2.0::DOUBLE, greatest(floor(log2(CASE WHEN x = 0 THEN 1 ELSE abs(x) END)), -14) - 10) AS s FROM x) SELECT event_id, {_HALF} AS half FROM s",
    "byte_range": "WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor((v::DOUBLE + 1) / 2 * 255) AS BIGINT)) AS b FROM embeddings) SELECT vec_id, CAST(list_sum(b) AS BIGINT) AS total, round(b[1] / 255, 6) AS first, round(list_sum(list_transform(b, lambda x: x / 255)), 6) AS mean FROM b",
    "pixel_transforms": f"WITH {_P}, c AS ({' UNION ALL '.join(_PIXELS)}) SELECT vec_id, transform, round(c, 3) AS checksum FROM c",
    "mixed_batches": f"""WITH {_BATCH} SELECT vec_id, kind, round(list_sum(list_transform(range(64), lambda k: (k + 1) * CASE WHEN kind = 'mixup' THEN 0.7 * v[k + 1] + 0.3 * ov[k + 1] WHEN kind = 'cutmix' AND {_INSIDE} THEN ov[k + 1] ELSE v[k + 1] END)), 6) AS pixels,
round(CASE kind WHEN 'mixup' THEN 0.7 * (label + 1) + 0.3 * (ol + 1) WHEN 'cutmix' THEN 0.75 * (label + 1) + 0.25 * (ol + 1) ELSE label + 1 END, 6) AS target FROM m""",
    "frame_scores": f"WITH {embedding_queries._P}, f AS (SELECT vec_id % 14 AS camera, max(vec_id) AS vec_id FROM u WHERE vec_id % 2 = 1 GROUP BY 1) SELECT camera, class, round(list_dot_product(u, prototype), 6) AS score FROM f JOIN u USING (vec_id), p",
}
