"""Queries over embeddings: vectors, ranking, metrics, losses, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import geometry as G
from vecloom.functions import vectors as V
from vecloom.operators import losses as L
from vecloom.operators import metrics as M
from vecloom.operators import ranking as R
from vecloom.session import table

BATCH = 32
WIDTHS, SCALES = [32, 32], [70.0, 60.0]


def r6(c):
    return V.rounded(F.col(c) if isinstance(c, str) else c)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def l2_normalize(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", r6(V.norm(V.double("embedding"))).alias("norm"), F.transform(V.unit(V.double("embedding")), r6).alias("unit"))


def _pairs(spark, sf_dir):
    """vec 2k with vec 2k + 1: an equi-join."""
    x = embeddings(spark, sf_dir)
    a = x.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("pair"), V.double("embedding").alias("a"))
    b = x.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).cast("long").alias("pair"), V.double("embedding").alias("b"))
    return a.join(b, "pair")


def cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair", r6(V.dot(F.col("a"), F.col("b"))).alias("dot"), r6(V.cosine(F.col("a"), F.col("b"))).alias("cosine"))


def _scores(spark, sf_dir, keep=("vec_id", "label")):
    """Odd vectors against the prototypes of the even ones."""
    x = embeddings(spark, sf_dir)
    classes = R.prototypes(x.where("vec_id % 2 = 0"))
    return R.class_scores(x.where("vec_id % 2 = 1"), classes, [*keep])


def scaled_logits_softmax(spark, sf_dir):
    x = _scores(spark, sf_dir).withColumn("logit", 100.0 * F.col("score"))
    return x.select("vec_id", "class", r6("logit").alias("logit"), r6(L.softmax(F.col("logit"), ["vec_id"])).alias("p"), r6(L.log_softmax(F.col("logit"), ["vec_id"])).alias("log_p"), r6(V.sigmoid(F.col("logit"))).alias("sigmoid"))


def class_prototypes(spark, sf_dir):
    x = R.prototypes(embeddings(spark, sf_dir).where("vec_id % 2 = 0"))
    return x.select("class", F.transform("prototype", r6).alias("prototype"))


def zero_shot_topk_acc(spark, sf_dir):
    out = R.topk_accuracy(R.ranked(_scores(spark, sf_dir), ["vec_id"]))
    return out.select(r6("acc1").alias("acc1"), r6("acc5").alias("acc5"))


def argmax_class(spark, sf_dir):
    return R.first_place(_scores(spark, sf_dir), ["vec_id", "label"])


def mean_per_class_recall(spark, sf_dir):
    return M.mean_per_class_recall(argmax_class(spark, sf_dir)).select(r6("mean_per_class_recall").alias("mean_per_class_recall"))


def confusion_f1_macro(spark, sf_dir):
    return M.macro_scores(argmax_class(spark, sf_dir)).select(r6("f1_macro").alias("f1_macro"), r6("recall_macro").alias("recall_macro"))


def predictions_ranked(spark, sf_dir):
    return R.ranked(_scores(spark, sf_dir, ("vec_id",)), ["vec_id"]).select("vec_id", "class", r6("score").alias("score"), "rank")


def predictions_highlight(spark, sf_dir):
    return R.highlighted(_scores(spark, sf_dir, ("vec_id",)), ["vec_id"]).select("vec_id", "class", "highlight")


def score_bucket(spark, sf_dir):
    return _scores(spark, sf_dir, ("vec_id",)).select("vec_id", "class", G.score_bucket(F.col("score")).alias("bucket"))


def retrieval_recall_at_k(spark, sf_dir):
    """Images are even vectors, texts the odd ones behind them; each is ranked against all of the other kind."""
    x = _pairs(spark, sf_dir)
    return R.recall_among_all(x, "pair", "a", "b").select("direction", "k", r6("recall").alias("recall"))


def _grouped(spark, sf_dir):
    return argmax_class(spark, sf_dir).withColumn("grp", (F.col("vec_id") % 8 / 2).cast("int")).withColumn("hit", F.col("predicted") == F.col("label"))


def group_accuracy(spark, sf_dir):
    """Groups 0 to 3, and 4, which is always empty: NaN and 0."""
    domain = spark.range(5).select(F.col("id").cast("int").alias("grp"))
    return M.by_group(_grouped(spark, sf_dir), ["grp"], F.col("hit"), domain).select("grp", F.when(F.isnan("acc"), None).otherwise(r6("acc")).alias("acc"), F.isnan("acc").alias("empty"), F.col("count").alias("n"))


def worst_group(spark, sf_dir):
    domain = spark.range(5).select(F.col("id").cast("int").alias("grp"))
    out = M.worst(M.by_group(_grouped(spark, sf_dir), ["grp"], F.col("hit"), domain))
    return out.select(r6("worst").alias("worst"), r6("average").alias("average"))


def crossed_groups(spark, sf_dir):
    x = _grouped(spark, sf_dir).withColumn("parity", (F.col("label") % 2).cast("int"))
    return M.by_group(x, ["grp", "parity"], F.col("hit")).select("grp", "parity", r6("acc").alias("acc"), F.col("count").alias("n"))


def binary_regroup(spark, sf_dir):
    x = _grouped(spark, sf_dir).withColumn("binary", F.when(F.col("grp") == 0, 0).otherwise(1))
    return M.by_group(x, ["binary"], F.col("hit")).select("binary", r6("acc").alias("acc"), F.col("count").alias("n"))


def pairwise_caption_test(spark, sf_dir):
    """Own pair against a text and an image of the next pair."""
    x = _pairs(spark, sf_dir)
    y = x.select((F.col("pair") - 1).alias("pair"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    z = x.join(y, "pair").select(V.dot(F.col("a"), F.col("b")).alias("own"), V.dot(F.col("a"), F.col("b2")).alias("text_wrong"), V.dot(F.col("a2"), F.col("b")).alias("image_wrong"))
    out = M.pairwise_test(z.select("own", "text_wrong", "image_wrong"))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def _batches(spark, sf_dir):
    """Batches of 32 neighbours; a row's text is its vector backwards."""
    return embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / BATCH).alias("batch"), (F.col("vec_id") % BATCH).alias("pos"), V.double("embedding").alias("image"), F.reverse(V.double("embedding")).alias("text"))


def _pair_table(spark, sf_dir):
    return L.pairs(_batches(spark, sf_dir), "image", "text").withColumn("s", 10.0 * V.dot(F.col("a"), F.col("b")))


def _loss(df):
    return df.select("batch", r6("loss").alias("loss"))


def clip_loss(spark, sf_dir):
    return _loss(L.contrastive(_pair_table(spark, sf_dir)))


def distill_loss(spark, sf_dir):
    x = _pair_table(spark, sf_dir).withColumn("t", 70.0 * V.dot(F.slice("a", 1, 32), F.slice("b", 1, 32)))
    return _loss(L.distillation(x))


def distill_loss_ensemble(spark, sf_dir):
    return _loss(L.distillation(L.teachers(_pair_table(spark, sf_dir), WIDTHS, SCALES), average_after_softmax=True))


def siglip_loss(spark, sf_dir):
    return _loss(L.sigmoid_loss(_pair_table(spark, sf_dir)))


def siglip_distill_loss(spark, sf_dir):
    x = L.teachers(_pair_table(spark, sf_dir), WIDTHS, SCALES, [-10.0, -10.0], "sigmoid")
    return _loss(L.sigmoid_loss(x, label=F.col("t")))


def reinforced_loss(spark, sf_dir):
    """Synthetic captions: the pair table with the logit halved."""
    gt = L.teachers(_pair_table(spark, sf_dir), WIDTHS, SCALES)
    out = L.reinforced(gt, gt.withColumn("s", F.col("s") / 2), (0.25, 0.75))
    return out.select("batch", *(r6(c).alias(c) for c in ("contrastive", "distillation", "loss")))


def layer_norm(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.transform(V.layer_norm(V.double("embedding")), r6).alias("x"))


def global_pool(spark, sf_dir):
    v = V.double("embedding")
    return embeddings(spark, sf_dir).select("vec_id", *(r6(V.pool(v, how)).alias(how) for how in ("mean", "abs", "rms")))


def normalize_channels(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.transform(V.affine(V.double("embedding"), [0.5, 0.25, 0.0], [0.5, 0.25, 1.0]), r6).alias("x"))


def mixup(spark, sf_dir):
    """Each even vector with its odd partner, at a weight by the pair; labels as mixed one-hot vectors."""
    x = embeddings(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2))
    a, b = x.where("vec_id % 2 = 0").select("pair", V.double("embedding").alias("a"), F.col("label").alias("la")), x.where("vec_id % 2 = 1").select("pair", V.double("embedding").alias("b"), F.col("label").alias("lb"))
    lam = (F.col("pair") % 10) / 10.0
    y = a.join(b, "pair")
    return y.select("pair", F.transform(V.blend(F.col("a"), F.col("b"), lam), r6).alias("x"), F.transform(V.blend(V.one_hot(F.col("la"), 10), V.one_hot(F.col("lb"), 10), lam), r6).alias("target"))


def conv_bn_fold(spark, sf_dir):
    """The first 9 components as a kernel, the next ones as the norm's figures."""
    v = V.double("embedding")
    out = G.fold_norm(F.slice(v, 1, 9), F.get(v, 9), F.get(v, 10), F.get(v, 11), F.abs(F.get(v, 12)), F.get(v, 13))
    x = embeddings(spark, sf_dir).select("vec_id", out.alias("f"))
    return x.select("vec_id", F.transform("f.kernel", r6).alias("kernel"), r6("f.bias").alias("bias"))


def causal_mask(spark, sf_dir):
    x = spark.range(1, 9).select(F.col("id").cast("int").alias("n"), V.causal_mask(F.col("id").cast("int")).alias("m"))
    return x.select("n", F.transform("m", lambda r: F.size(F.filter(r, lambda v: v == 0))).alias("open"))


def projection(spark, sf_dir):
    w = [[(i + j) % 3 - 1.0 for i in range(64)] for j in range(4)]
    return embeddings(spark, sf_dir).select("vec_id", F.transform(V.project(V.double("embedding"), w), r6).alias("x"))


QUERIES = {f.__name__: f for f in (l2_normalize, cosine_pairs, scaled_logits_softmax, class_prototypes, zero_shot_topk_acc, argmax_class, mean_per_class_recall, confusion_f1_macro, predictions_ranked, predictions_highlight, score_bucket, retrieval_recall_at_k, group_accuracy, worst_group, crossed_groups, binary_regroup, pairwise_caption_test, clip_loss, distill_loss, distill_loss_ensemble, siglip_loss, siglip_distill_loss, reinforced_loss, layer_norm, global_pool, normalize_channels, mixup, conv_bn_fold, causal_mask, projection)}

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"
_P = f"{_E}, m AS (SELECT label AS class, i, avg(u[i]) AS x FROM u, range(1, 65) t(i) WHERE vec_id % 2 = 0 GROUP BY ALL), g AS (SELECT class, list(x ORDER BY i) AS g FROM m GROUP BY class), p AS (SELECT class, list_transform(g, lambda x: x / sqrt(list_dot_product(g, g))) AS prototype FROM g)"
_S = f"{_P}, s AS (SELECT vec_id, label, class, list_dot_product(u, prototype) AS score FROM u, p WHERE vec_id % 2 = 1)"
_A = f"{_S}, a AS (SELECT vec_id, label, class AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS r FROM s) WHERE r = 1)"
_Q = f"{_E}, q AS (SELECT x.vec_id // 2 AS pair, x.v AS a, y.v AS b, x.label AS la, y.label AS lb FROM e x JOIN e y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0)"
_D = f"{_A}, d AS (SELECT CAST(floor(vec_id % 8 / 2) AS INTEGER) AS grp, predicted = label AS hit, label FROM a)"
_G = "SELECT CAST(i AS INTEGER) AS grp, round(avg(hit::INT), 6) AS acc, count(hit) = 0 AS empty, count(hit) AS n FROM range(5) t(i) LEFT JOIN d ON grp = i GROUP BY i"
_T = f"{_E}, b AS (SELECT vec_id // 32 AS batch, vec_id % 32 AS pos, v AS a, list_reverse(v) AS b FROM e), t AS (SELECT x.batch, x.pos AS i, y.pos AS j, x.a, y.b, 10 * list_dot_product(x.a, y.b) AS s FROM b x JOIN b y ON x.batch = y.batch)"


def _lsm(x: str, src: str, out: str, carry: str = "*") -> str:
    """A step that adds {out}r and {out}c, the log softmaxes of x along rows and columns."""
    return f"""(SELECT {carry}, {x} - mr_ - ln(sum(exp({x} - mr_)) OVER (PARTITION BY batch, i)) AS {out}r, {x} - mc_ - ln(sum(exp({x} - mc_)) OVER (PARTITION BY batch, j)) AS {out}c
  FROM (SELECT *, max({x}) OVER (PARTITION BY batch, i) AS mr_, max({x}) OVER (PARTITION BY batch, j) AS mc_ FROM {src}))"""


_KEEP = "* EXCLUDE (mr_, mc_)"
_ST = _lsm("s", "t", "s", _KEEP)
_ENS0 = f"(SELECT *, 70 * list_dot_product(a[1:32], b[1:32]) AS t1, 60 * list_dot_product(a[33:64], b[33:64]) AS t2 FROM {_ST})"
_ENS = f"(SELECT *, (exp(ar) + exp(br)) / 2 AS tr, (exp(ac) + exp(bc)) / 2 AS tc FROM {_lsm('t2', _lsm('t1', _ENS0, 'a', _KEEP), 'b', _KEEP)})"
_LS = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"
_SIG = "exp(" + _LS + ")"
SQL = {
    "l2_normalize": f"WITH {_E} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, list_transform(u, lambda x: round(x, 6)) AS unit FROM u JOIN e USING (vec_id)",
    "cosine_pairs": f"WITH {_Q} SELECT pair, round(list_dot_product(a, b), 6) AS dot, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS cosine FROM q",
    "scaled_logits_softmax": f"WITH {_S}, l AS (SELECT vec_id, class, 100 * score AS l, max(100 * score) OVER (PARTITION BY vec_id) AS m FROM s), z AS (SELECT *, sum(exp(l - m)) OVER (PARTITION BY vec_id) AS z FROM l) SELECT vec_id, class, round(l, 6) AS logit, round(exp(l - m) / z, 6) AS p, round(l - m - ln(z), 6) AS log_p, round({_SIG.format('l')}, 6) AS sigmoid FROM z",
    "class_prototypes": f"WITH {_P} SELECT class, list_transform(prototype, lambda x: round(x, 6)) AS prototype FROM p",
    "zero_shot_topk_acc": f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS r FROM s) SELECT round(avg((r <= 1)::INT), 6) AS acc1, round(avg((r <= 5)::INT), 6) AS acc5 FROM r WHERE class = label",
    "argmax_class": f"WITH {_A} SELECT * FROM a",
    "mean_per_class_recall": f"WITH {_A} SELECT round(avg(r), 6) AS mean_per_class_recall FROM (SELECT avg((predicted = label)::INT) AS r FROM a GROUP BY label)",
    "confusion_f1_macro": f"WITH {_A}, c AS (SELECT DISTINCT label AS c FROM a UNION SELECT predicted FROM a), k AS (SELECT c, (SELECT count(*) FROM a WHERE label = c AND predicted = c) AS hit, (SELECT count(*) FROM a WHERE label = c) AS truth, (SELECT count(*) FROM a WHERE predicted = c) AS guess FROM c) SELECT round(avg(2.0 * hit / (truth + guess)), 6) AS f1_macro, round(avg(CASE WHEN truth > 0 THEN 1.0 * hit / truth END), 6) AS recall_macro FROM k",
    "predictions_ranked": f"WITH {_S} SELECT vec_id, class, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS INTEGER) AS rank FROM s",
    "predictions_highlight": f"WITH {_S} SELECT vec_id, class, score >= 0.22 AND score >= max(score) OVER (PARTITION BY vec_id) * 0.95 AS highlight FROM s",
    "score_bucket": f"WITH {_S} SELECT vec_id, class, least(CAST(round(20 * least(greatest(score - 0.15, 0), 0.22) / (0.22 - 0.15)) AS INTEGER), 20) AS bucket FROM s",
    "retrieval_recall_at_k": f"WITH {_Q}, c AS (SELECT x.pair AS i, y.pair AS j, round(list_dot_product(x.a, y.b), 9) AS s FROM q x, q y), r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS it, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS ti FROM c) SELECT direction, k, round(avg((CASE WHEN direction = 'image_to_text' THEN it ELSE ti END <= k)::INT), 6) AS recall FROM r, (VALUES (1), (5), (10)) t(k), (VALUES ('image_to_text'), ('text_to_image')) d(direction) WHERE i = j GROUP BY direction, k",
    "group_accuracy": f"WITH {_D} {_G}",
    "worst_group": f"WITH {_D}, w AS ({_G}) SELECT min(acc) AS worst, (SELECT round(avg(hit::INT), 6) FROM d) AS average FROM w",
    "crossed_groups": f"WITH {_D} SELECT grp, CAST(label % 2 AS INTEGER) AS parity, round(avg(hit::INT), 6) AS acc, count(*) AS n FROM d GROUP BY ALL",
    "binary_regroup": f"WITH {_D} SELECT CASE WHEN grp = 0 THEN 0 ELSE 1 END AS binary, round(avg(hit::INT), 6) AS acc, count(*) AS n FROM d GROUP BY ALL",
    "pairwise_caption_test": f"WITH {_Q}, z AS (SELECT list_dot_product(x.a, x.b) AS own, list_dot_product(x.a, y.b) AS tw, list_dot_product(y.a, x.b) AS iw FROM q x JOIN q y ON y.pair = x.pair + 1) SELECT round(avg((own > iw)::INT), 6) AS image_acc, round(avg((own > tw)::INT), 6) AS text_acc, round(avg((own > iw AND own > tw)::INT), 6) AS acc FROM z",
    "clip_loss": f"WITH {_T} SELECT batch, round(avg(-sr - sc) / 2, 6) AS loss FROM {_ST} WHERE i = j GROUP BY batch",
    "distill_loss": f"WITH {_T} SELECT batch, round(sum(-exp(tr) * sr - exp(tc) * sc) / count(DISTINCT i) / 2, 6) AS loss FROM {_lsm('t1', _ENS0, 't', _KEEP)} GROUP BY batch",
    "distill_loss_ensemble": f"WITH {_T} SELECT batch, round(sum(-tr * sr - tc * sc) / count(DISTINCT i) / 2, 6) AS loss FROM {_ENS} GROUP BY batch",
    "siglip_loss": f"WITH {_T}, l AS (SELECT batch, i, CASE WHEN i = j THEN s ELSE -s END AS x FROM t) SELECT batch, round(sum(-{_LS.format('x')}) / count(DISTINCT i), 6) AS loss FROM l GROUP BY batch",
    "siglip_distill_loss": f"WITH {_T}, l AS (SELECT batch, i, s, 70 * list_dot_product(a[1:32], b[1:32]) - 10 AS t1, 60 * list_dot_product(a[33:64], b[33:64]) - 10 AS t2 FROM t), k AS (SELECT batch, i, s * (2 * {_SIG.format('t1')} - 1 + 2 * {_SIG.format('t2')} - 1) / 2 AS x FROM l) SELECT batch, round(sum(-{_LS.format('x')}) / count(DISTINCT i), 6) AS loss FROM k GROUP BY batch",
    "reinforced_loss": f"WITH {_T}, h AS (SELECT * REPLACE (s / 2 AS s) FROM t), p AS (SELECT batch, i, j, sr, sc, tr, tc FROM {_ENS} UNION ALL SELECT batch, i, j, sr, sc, tr, tc FROM {_ENS.replace('FROM t)', 'FROM h)')}), c AS (SELECT batch, sum(-sr - sc) / 2 / count(DISTINCT i) * 0.25 AS c FROM p WHERE i = j GROUP BY batch), k AS (SELECT batch, sum(-tr * sr - tc * sc) / 2 / count(DISTINCT i) * 0.75 AS k FROM p GROUP BY batch) SELECT batch, round(c, 6) AS contrastive, round(k, 6) AS distillation, round(c + k, 6) AS loss FROM c JOIN k USING (batch)",
    "layer_norm": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, list_avg(v) AS m, list_var_pop(v) AS s FROM e) SELECT vec_id, list_transform(v, lambda x: round((x - m) / sqrt(s + 1e-5), 6)) AS x FROM m",
    "global_pool": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(list_avg(v), 6) AS mean, round(list_avg(list_transform(v, lambda x: abs(x))), 6) AS abs, round(sqrt(list_avg(list_transform(v, lambda x: x * x))), 6) AS rms FROM e",
    "normalize_channels": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, list_transform(v, lambda x, i: round((x - list_extract([0.5, 0.25, 0.0], (i - 1) % 3 + 1)) / list_extract([0.5, 0.25, 1.0], (i - 1) % 3 + 1), 6)) AS x FROM e",
    "mixup": f"WITH {_Q} SELECT pair, list_transform(list_zip(a, b), lambda z: round(pair % 10 / 10 * z[1] + (1 - pair % 10 / 10) * z[2], 6)) AS x, list_transform(range(10), lambda k: round(pair % 10 / 10 * (k = la)::INT + (1 - pair % 10 / 10) * (k = lb)::INT, 6)) AS target FROM q",
    "conv_bn_fold": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT vec_id, v, v[11] / sqrt(abs(v[13]) + 1e-5) AS t FROM e) SELECT vec_id, list_transform(v[1:9], lambda x: round(x * t, 6)) AS kernel, round(v[14] + (v[10] - v[12]) * t, 6) AS bias FROM f",
    "causal_mask": "SELECT CAST(n AS INTEGER) AS n, list_transform(range(1, n + 1), lambda i: CAST(i AS INTEGER)) AS open FROM range(1, 9) t(n)",
    "projection": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, list_transform(range(4), lambda j: round(list_dot_product(v, list_transform(range(64), lambda i: ((i + j) % 3 - 1)::DOUBLE)), 6)) AS x FROM e",
}
