"""Queries of result files, shard lists, byte-pair codes, and smaller columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions import bpe as B
from vecloom.functions import geometry as G
from vecloom.functions import vectors as V
from vecloom.operators import losses as L
from vecloom.operators import samples as S
from vecloom.session import table
from vecloom.sources import configs as C
from vecloom.sources import shards
from vecloom.streaming import frames as P

PATTERN = "data/{train,val}-{000..019}.tar"
#: A small vocabulary made by rule: every letter, alone and at a word's end, and one merged pair.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
MERGE = ("a", "n")
VOCAB = {p: i for i, p in enumerate([*LETTERS, *(c + "</w>" for c in LETTERS), "".join(MERGE)])}


def r6(c):
    return F.round(c, 6)


def _records(spark, sf_dir):
    """Result records made of parts: three kinds of task, each with its own main metric."""
    third = F.col("p_size") % 3
    key = F.when(third == 0, "retrieval/a").when(third == 1, "comp/sugarcrepe").otherwise("vtab/b")
    metrics = F.create_map(F.lit("acc1"), F.col("p_retailprice") / 10000, F.lit("mean_recall@1"), F.col("p_size") / 100, F.lit("acc"), F.lit(0.5))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), key.alias("key"), F.lit("x").alias("dataset"), metrics.alias("metrics"))


def results_leaderboard(spark, sf_dir):
    return C.leaderboard(_records(spark, sf_dir))


def results_main_metric(spark, sf_dir):
    x = C.main_metrics(_records(spark, sf_dir))
    return x.groupBy("key").agg(r6(F.avg("main_metric")).alias("main_metric"), F.count("*").alias("n"))


def _grouped_records(spark, sf_dir):
    """A record of two regions for each supplier; every fourth has no rows in the second."""
    k = F.col("s_suppkey")
    first, second = (k % 10) / 10, F.when(k % 4 == 0, float("nan")).otherwise((k % 7) / 7)
    metrics = F.create_map(F.lit("acc_region:0"), first, F.lit("count_region:0"), (k % 5 + 1).cast("double"), F.lit("acc_region:1"), second, F.lit("count_region:1"), (k % 4).cast("double"))
    return table(spark, sf_dir, "supplier").select(F.lit("m").alias("model"), k.cast("string").alias("key"), F.lit("x").alias("dataset"), metrics.alias("metrics"))


def results_group_metrics(spark, sf_dir):
    x = C.group_metrics(_grouped_records(spark, sf_dir))
    return x.select("key", "grouping", "group", F.when(~F.isnan("acc"), r6("acc")).alias("acc"), F.col("count").cast("long").alias("n"))


def results_worst_groups(spark, sf_dir):
    return C.worst_groups(_grouped_records(spark, sf_dir)).select("key", "grouping", r6("worst").alias("worst"), r6("average").alias("average"))


def shard_list(spark, sf_dir):
    return spark.createDataFrame([(i, name) for i, name in enumerate(shards.expand(PATTERN))], "place long, path string")


def byte_pair_codes(spark, sf_dir):
    """Encoded and decoded again: names, with letters for digits, as the vocabulary has letters only."""
    bpe = B.Bpe({MERGE: 0}, VOCAB)
    spelled = F.translate("n_name", "_0123456789", " abcdefghij")
    x = table(spark, sf_dir, "nation").select("n_nationkey", B.encode_column(bpe, spelled).alias("ids"))
    return x.select("n_nationkey", F.size("ids").cast("long").alias("n"), B.decode_column(bpe, F.col("ids")).alias("name"))


def array_softmax(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", V.softmax(F.transform(V.double("embedding"), lambda v: v * 10)).alias("p"))
    return x.select("vec_id", r6(F.get("p", 0)).alias("first"), r6(F.array_max("p")).alias("top"), r6(V.total(F.col("p"))).alias("all"))


def log_sigmoid(spark, sf_dir):
    """Far from 0 as well, where the plain form overflows."""
    x = (F.col("value") - 250) * 8
    return table(spark, sf_dir, "events").select("event_id", r6(V.log_sigmoid(x)).alias("log_p"), r6(V.sigmoid(x)).alias("p"), r6(V.logit_scale(x / 100)).alias("scale"))


def one_hot_labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.one_hot(F.col("label"), 10).alias("target"))


def negative_blocks(spark, sf_dir):
    """The images of each block of 32 pairs against the texts of the next block."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("batch"), F.floor(F.col("vec_id") / 2).alias("i"), V.double("embedding").alias("v"))
    images = x.where("vec_id % 2 = 0").select("batch", "i", F.col("v").alias("a"))
    texts = x.where("vec_id % 2 = 1").select((F.col("batch") - 1).alias("batch"), F.col("i").alias("j"), F.col("v").alias("b"))
    scored = images.join(texts, "batch").select("batch", "i", "j", (10 * V.dot(F.col("a"), F.col("b")) - 10).alias("s"))
    return L.negative_only(scored).select(F.col("batch").cast("long").alias("batch"), r6("total").alias("total"))


def sigmoid_targets(spark, sf_dir):
    """The ensemble's soft labels of the pairs of each block of 32."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("batch"), F.floor(F.col("vec_id") / 2).alias("pos"), V.double("embedding").alias("v"))
    rows = x.where("vec_id % 2 = 0").withColumnRenamed("v", "a").join(x.where("vec_id % 2 = 1").select("pos", F.col("v").alias("b")), "pos")
    t = L.teachers(L.pairs(rows, "a", "b"), [32, 32], [7.0, 6.0], [-1.0, 0.5], kind="sigmoid")
    return t.groupBy(F.col("i").cast("long").alias("i")).agg(r6(F.avg("t")).alias("mean"), r6(F.max("t")).alias("top"))


def micro_utilities(spark, sf_dir):
    n = F.col("n_nationkey")
    turned = G.inverted(F.create_map(n, F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", G.clamp(n, 5, 20).alias("held"), G.part_of(F.col("n_name"), n % 4, n % 4 + 4).alias("part"), F.element_at(turned, F.col("n_name")).alias("back"))


def kernel_fusion(spark, sf_dir):
    size = F.col("p_size")
    kernel = lambda k: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: ((size * k + i) % 7).cast("double"))
    text = lambda v: F.array_join(F.transform(v, lambda x: F.round(x * 4).cast("long").cast("string")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", text(G.fused_branches(kernel(1), size.cast("double"))).alias("branches"), text(G.fused_mixer(kernel(2), kernel(3), F.lit(0.5))).alias("mixer"))


def batch_plan(spark, sf_dir):
    """Batches of orders, and the samples of a run of that many steps."""
    n = S.batch_count(table(spark, sf_dir, "orders").count(), 256)
    plan = S.budget(n * 20, 8192, 20, 4, 8)
    return spark.createDataFrame([(n, plan["num_seen"], plan["per_epoch"], plan["per_worker_batch"])], "batches long, num_seen long, per_epoch long, per_worker_batch long")


def stream_outliers(spark, sf_dir):
    """Durations under the bound, in thousandths."""
    return table(spark, sf_dir, "events").where(P.plausible(F.col("value") / 1000, 250)).groupBy("event_type").agg(F.count("*").alias("n"), r6(F.max("value")).alias("top"))


QUERIES = {f.__name__: f for f in (results_leaderboard, results_main_metric, results_group_metrics, results_worst_groups, shard_list, byte_pair_codes, array_softmax, log_sigmoid, one_hot_labels, negative_blocks, sigmoid_targets, micro_utilities, kernel_fusion, batch_plan, stream_outliers)}

_RECORDS = "r AS (SELECT p_brand AS model, CASE p_size % 3 WHEN 0 THEN 'retrieval/a' WHEN 1 THEN 'comp/sugarcrepe' ELSE 'vtab/b' END AS key, CASE p_size % 3 WHEN 0 THEN p_size / 100 WHEN 1 THEN 0.5 ELSE p_retailprice / 10000 END AS m FROM part)"
_GROUPS = "g AS (SELECT s_suppkey::VARCHAR AS key, 0 AS grp, s_suppkey % 10 / 10 AS acc, s_suppkey % 5 + 1 AS n FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 1, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 / 7 END, s_suppkey % 4 FROM supplier)"
_LOG_P = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"
_HALVES = "x AS (SELECT vec_id, vec_id // 64 AS batch, vec_id // 2 AS i, embedding::DOUBLE[] AS v FROM embeddings)"
_SOFT = "(2 / (1 + exp(-({0} * list_dot_product(a.v[{1}:{2}], b.v[{1}:{2}]) + {3}))) - 1)"
_KERNEL = "list_transform(range(9), lambda i: {0})"
SQL = {
    "results_leaderboard": f"WITH {_RECORDS} SELECT model, round(100 * avg(m), 1) AS average, count(m) AS tasks FROM r WHERE key NOT LIKE 'comp/%' GROUP BY model",
    "results_main_metric": f"WITH {_RECORDS} SELECT key, round(avg(m), 6) AS main_metric, count(*) AS n FROM r GROUP BY key",
    "results_group_metrics": f"WITH {_GROUPS} SELECT key, 'region' AS grouping, CAST(grp AS INTEGER) AS \"group\", round(acc, 6) AS acc, CAST(n AS BIGINT) AS n FROM g",
    "results_worst_groups": f"WITH {_GROUPS} SELECT key, 'region' AS grouping, round(min(acc), 6) AS worst, round(sum(acc * n) / sum(n), 6) AS average FROM g WHERE n > 0 GROUP BY key",
    "shard_list": "SELECT s * 20 + i AS place, 'data/' || kind || '-' || lpad(i::VARCHAR, 3, '0') || '.tar' AS path FROM (VALUES (0, 'train'), (1, 'val')) t(s, kind), range(20) r(i)",
    "byte_pair_codes": "WITH w AS (SELECT n_nationkey, lower(translate(n_name, '_0123456789', ' abcdefghij')) AS name FROM nation) SELECT n_nationkey, length(replace(name, ' ', '')) - len(regexp_extract_all(name, 'an[a-z]')) AS n, name FROM w",
    "array_softmax": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE * 10)) AS e FROM embeddings) SELECT vec_id, round(e[1] / list_sum(e), 6) AS first, round(list_max(e) / list_sum(e), 6) AS top, 1.0::DOUBLE AS \"all\" FROM e",
    "log_sigmoid": f"WITH x AS (SELECT event_id, (value - 250) * 8 AS x FROM events) SELECT event_id, round({_LOG_P.format('x')}, 6) AS log_p, round(exp({_LOG_P.format('x')}), 6) AS p, round(least(exp(x / 100), 100), 6) AS scale FROM x",
    "one_hot_labels": "SELECT vec_id, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS target FROM embeddings",
    "negative_blocks": f"WITH {_HALVES}, s AS (SELECT a.batch, -(10 * list_dot_product(a.v, b.v) - 10) AS s FROM x a JOIN x b ON b.batch = a.batch + 1 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) SELECT batch, round(sum(-{_LOG_P.format('s')}), 6) AS total FROM s GROUP BY batch",
    "sigmoid_targets": f"WITH {_HALVES}, t AS (SELECT a.i, ({_SOFT.format(7.0, 1, 32, -1.0)} + {_SOFT.format(6.0, 33, 64, 0.5)}) / 2 AS t FROM x a JOIN x b ON b.batch = a.batch AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) SELECT i, round(avg(t), 6) AS mean, round(max(t), 6) AS top FROM t GROUP BY i",
    "micro_utilities": "SELECT n_nationkey, least(greatest(n_nationkey, 5), 20) AS held, CASE WHEN n_nationkey % 4 + 4 <= length(n_name) THEN substr(n_name, n_nationkey % 4 + 1, 4) END AS part, n_nationkey AS back FROM nation",
    "kernel_fusion": f"SELECT p_partkey, array_to_string({_KERNEL.format('4 * ((p_size + i) % 7 + CASE WHEN i = 4 THEN p_size + 1 ELSE 0 END)')}, ' ') AS branches, array_to_string({_KERNEL.format('2 * ((p_size * 2 + i) % 7 - (p_size * 3 + i) % 7) + CASE WHEN i = 4 THEN 4 ELSE 0 END')}, ' ') AS mixer FROM part",
    "batch_plan": "WITH b AS (SELECT CAST(ceil(count(*) / 256) AS BIGINT) AS n FROM orders) SELECT n AS batches, n * 20 * 8192 AS num_seen, n * 8192 AS per_epoch, CAST(256 AS BIGINT) AS per_worker_batch FROM b",
    "stream_outliers": "SELECT event_type, count(*) AS n, round(max(value), 6) AS top FROM events WHERE value / 1000 * 1000 < 250 GROUP BY event_type",
}
