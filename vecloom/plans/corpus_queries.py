"""Queries over documents, conversations, parts and events: samples, text, augmentation, streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions import geometry as G
from vecloom.functions import text as X
from vecloom.operators import augment as A
from vecloom.operators import metrics as M
from vecloom.operators import samples as S
from vecloom.session import table
from vecloom.streaming import frames as P


def r6(c):
    return F.round(c, 6)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _members(spark, sf_dir):
    """Three members a document, in 16 shards; extensions in mixed case."""
    parts = F.array(F.struct(F.lit("TXT").alias("ext"), F.col("lang").alias("data")), F.struct(F.lit("src").alias("ext"), F.col("source").alias("data")), F.struct(F.when(F.col("doc_id") % 5 == 0, "png").otherwise("jpg").alias("ext"), F.col("n_chars").cast("string").alias("data")))
    x = documents(spark, sf_dir).select((F.col("doc_id") % 16).alias("shard"), F.col("doc_id").alias("key"), F.explode(parts).alias("m"))
    return x.select("shard", "key", "m.ext", "m.data")


def _listed(parts):
    return F.array_join(F.transform(F.array_sort(F.map_entries(parts)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def shard_members_grouped(spark, sf_dir):
    return S.grouped(_members(spark, sf_dir)).select("shard", "key", _listed(F.col("parts")).alias("parts"))


def _extra(spark, sf_dir):
    """A second archive from labels; its src overrides the first one's."""
    x = table(spark, sf_dir, "labels").select((F.col("doc_id") % 16).alias("shard"), F.col("doc_id").alias("key"), F.explode(F.array(F.struct(F.lit("src").alias("ext"), F.lit("labels").alias("data")), F.struct(F.lit("q").alias("ext"), F.col("quality").cast("string").alias("data")))).alias("m"))
    return x.select("shard", "key", "m.ext", "m.data")


def shard_union_by_key(spark, sf_dir):
    x = S.overlaid(S.grouped(_members(spark, sf_dir)), S.grouped(_extra(spark, sf_dir)))
    return x.select("shard", "key", _listed(F.col("parts")).alias("parts"))


def filter_has_fields(spark, sf_dir):
    x = S.grouped(_members(spark, sf_dir).where("key % 7 <> 0 OR lower(ext) <> 'txt'"))
    return x.where(S.complete()).select("shard", "key", S.first_part("jpg;png;jpeg;webp").alias("image"))


def filter_min_side(spark, sf_dir):
    x = documents(spark, sf_dir).select("doc_id", (F.col("n_chars") % 640 + 1).alias("width"), (F.col("doc_id") % 480 + 1).alias("height"))
    return x.where(S.large_enough(200))


def batching_drop_last(spark, sf_dir):
    x = S.batched(table(spark, sf_dir, "orders").select("o_orderkey"), 256, ["o_orderkey"], False)
    return x.select("o_orderkey", "batch_id", "pos")


def batching_keep_last(spark, sf_dir):
    x = S.batched(table(spark, sf_dir, "orders").select("o_orderkey"), 256, ["o_orderkey"], True)
    return x.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def _captions(spark, sf_dir):
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).select("doc_id", lines.alias("texts"), F.create_map(F.lit("syn_text"), F.reverse(lines), F.lit("syn_text_b"), F.slice(lines, 1, 1), F.lit("other"), lines).alias("syn"))


def sequential_sample(spark, sf_dir):
    x = _captions(spark, sf_dir)
    at = S.index_of(F.col("texts"), 5, True)
    return x.select("doc_id", at.alias("i"), F.get("texts", at).alias("caption"))


def random_sample(spark, sf_dir):
    x = _captions(spark, sf_dir)
    at = S.index_of(F.col("texts"), 2, False, F.col("doc_id"), seed=11)
    return x.select("doc_id", at.alias("i"), F.get("texts", at).alias("caption"))


def regex_key_select(spark, sf_dir):
    x = _captions(spark, sf_dir).withColumn("kept", S.keys_like(F.col("syn"), "syn_text.*$"))
    drawn = S.drawn_synthetic(F.col("kept"), 3, True, F.col("doc_id"))
    return x.select("doc_id", F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("keys"), drawn.alias("d")).select("doc_id", "keys", "d.key", "d.index", "d.text")


def positional_embedding_lookup(spark, sf_dir):
    """Vectors are (lines, place): behind the true captions' ones where doc_id is even, under the key's name elsewhere."""
    x = _captions(spark, sf_dir).withColumn("n", F.size("texts"))
    true = F.transform("texts", lambda t, i: F.array(F.lit(0), i))
    syn = F.transform("texts", lambda t, i: F.array(F.lit(1), i))
    emb = F.when(F.col("doc_id") % 2 == 0, F.concat(true, syn)).otherwise(true)
    named = F.create_map(F.lit("syn_text_emb"), F.transform("texts", lambda t, i: F.array(F.lit(2), i)))
    got = S.synthetic_embedding(emb, F.col("n"), named, F.lit("syn_text"), F.lit(0))
    return x.select("doc_id", F.get(got, 0).alias("kind"), F.get(got, 1).alias("place"))


def caption_mix(spark, sf_dir):
    x = documents(spark, sf_dir)
    return x.select("doc_id", S.mixed(F.lit("gt"), F.lit("syn"), 0.25, F.col("doc_id"), seed=3).alias("side"))


def resampled_shards(spark, sf_dir):
    shards = spark.range(16).select(F.col("id").alias("shard_id"), (F.col("id") % 3 + 1).cast("int").alias("copies"))
    return S.resampled(shards, 64, 2, 5, "copies").select("slot", "shard_id")


def stacked_kinds(spark, sf_dir):
    x = documents(spark, sf_dir).select("doc_id", "n_chars")
    y = S.stacked(x, x.withColumn("n_chars", -F.col("n_chars")))
    return y.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def prompt_templates(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_brand").distinct().crossJoin(F.broadcast(X.presets(spark).select("title", "prefix", "suffix")))
    return x.select("title", X.prompt(F.col("prefix"), F.col("p_brand"), F.col("suffix")).alias("prompt"))


def class_name_admit(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_type", F.lit("  ")).alias("name"), "p_partkey")
    return X.admit(x, "name", "p_partkey").select("name", F.lower("name").alias("folded"), F.col("p_partkey").alias("first"))


def pretokenize(spark, sf_dir):
    t = X.pretokenize(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


def adjacent_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.adjacent_pairs(F.split("p_type", "")), ",").alias("pairs"))


def _vocabulary(spark, sf_dir):
    """Distinct words of p_name, numbered."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("piece")).where("piece < 'm'")
    return words.groupBy("piece").agg(F.min(F.length("piece")).alias("len")).select("piece", (F.pmod(F.ascii("piece") * 131 + F.col("len"), F.lit(9973))).cast("int").alias("id"))


def vocab_lookup(spark, sf_dir):
    """Words that the vocabulary lacks are dropped."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "piece"))
    y = x.join(_vocabulary(spark, sf_dir), "piece")
    return y.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda s: s["id"].cast("string")), " ").alias("ids"))


def _tokens(spark, sf_dir):
    """Numbers from 1 to 100 in place of ids, up to 90 of them."""
    ids = F.transform(F.sequence(F.lit(1), (F.col("n_chars") % 90 + 1).cast("int")), lambda i: (i * 7 % 100 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", X.frame(ids).alias("t"))


def frame_context(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.array_join(F.transform("t", lambda x: x.cast("string")), " ").alias("tokens"))


def eot_position(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", X.end_place(F.col("t")).alias("place"), X.end_place_by_count(F.col("t")).alias("by_count"))


def caption_cleanup(spark, sf_dir):
    x = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("junk<start_of_text>"), "text", F.lit("<end_of_text>more"))
    return x.select("conv_id", "turn", X.clean_caption(raw).alias("caption"))


def name_prefixes(spark, sf_dir):
    x = table(spark, sf_dir, "nation")
    key = X.add_prefix(F.col("n_name"), "image_encoder.")
    return x.select("n_nationkey", key.alias("key"), X.strip_prefix(key, "image_encoder.").alias("name"), X.task_slug(F.concat(F.lit("wds/"), "n_name")).alias("slug"))


def _entries(spark, sf_dir):
    """Crops and operations by doc_id; each fifth entry has no operations (skipped), each seventh an empty list."""
    names = F.array(*map(F.lit, A.OPERATIONS))
    d = F.col("doc_id")
    crop = F.struct(*((d * k % 97).cast("int").alias(c) for k, c in ((3, "i"), (5, "j"), (7, "h"), (11, "w"))))
    op = lambda k: F.struct(F.get(names, (d * k % 14).cast("int")).alias("op"), ((d * k % 19) - 9).cast("double").alias("mag"))
    ra = F.when(d % 5 == 0, None).when(d % 7 == 0, F.slice(F.array(op(1)), 1, 0)).otherwise(F.array(op(1), op(3)))
    return documents(spark, sf_dir).select("doc_id", F.struct(crop.alias("rrc"), ra.alias("ra")).alias("e"))


def _told(e):
    ops = F.array_join(F.transform(e["ra"], lambda o: F.concat_ws(":", o["op"].cast("string"), o["mag"].cast("int").cast("string"))), ",")
    return F.concat_ws(" ", e["rrc"]["i"], e["rrc"]["j"], e["rrc"]["h"], e["rrc"]["w"]), ops


def augment_compress(spark, sf_dir):
    x = _entries(spark, sf_dir).withColumn("e", A.compressed(F.col("e")))
    crop, ops = _told(F.col("e"))
    return x.select("doc_id", crop.alias("crop"), ops.alias("ops"))


def augment_decompress(spark, sf_dir):
    x = _entries(spark, sf_dir).withColumn("e", A.decompressed(A.compressed(F.col("e"))))
    crop, ops = _told(F.col("e"))
    return x.select("doc_id", crop.alias("crop"), ops.alias("ops"))


def config_compose(spark, sf_dir):
    config = {"normalize": {}, "random_resized_crop": {"enable": True}, "to_rgb": {"enable": True}, "to_tensor": {"enable": True}, "rand_augment": {}, "mixup": {"enable": False}}
    return spark.createDataFrame([(i, k) for i, (k, _) in enumerate(A.composed(config))], "place int, name string")


def multi_sample_expand(spark, sf_dir):
    x = A.expanded(documents(spark, sf_dir).select("doc_id"), 10)
    return x.select("doc_id", "aug", (S.draw(F.col("doc_id"), F.col("aug"), seed=9) % 14).cast("int").alias("op"))


def cutmix_bbox(spark, sf_dir):
    d = F.col("doc_id")
    box = G.cutmix_box(F.lit(224), F.lit(224), (d % 10) / 10.0, (d * 13 % 224).cast("int"), (d * 29 % 224).cast("int"))
    x = documents(spark, sf_dir).select("doc_id", box.alias("b"))
    return x.select("doc_id", "b.x1", "b.y1", "b.x2", "b.y2", r6("b.lam").alias("lam"))


def crop_geometry(spark, sf_dir):
    d = F.col("doc_id")
    box = G.centre_box((d % 300 + 224).cast("int"), (d % 200 + 225).cast("int"), F.lit(224))
    x = documents(spark, sf_dir).select("doc_id", box.alias("b"), G.teacher_resize(F.lit(224), F.lit(0.875)).alias("resize"))
    return x.select("doc_id", "b.left", "b.top", "resize")


def bottleneck_rank(spark, sf_dir):
    k, c = F.lit(3), F.col("p_size") * 8
    x = table(spark, sf_dir, "part")
    return x.select("p_partkey", G.bottleneck_rank(k, k, c, c * 2).alias("rank"), G.ffn_width(c, F.lit(2.7)).alias("width"), r6(G.drop_path(F.col("p_size"), F.lit(51), 0.1)).alias("drop"))


def group_rates_by_lang(spark, sf_dir):
    x = documents(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.by_group(x, ["lang"], F.col("toxic") == 1).select("lang", r6("acc").alias("rate"), F.col("count").alias("n"))


def jaccard_by_size(spark, sf_dir):
    """Words of neighbouring turns, by the size of the first set (10 or more as one)."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    y = x.join(x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    z = y.select(F.least(F.size("w"), F.lit(10)).alias("size"), M.jaccard(F.col("w"), F.col("v")).alias("j"))
    return z.groupBy("size").agg(r6(F.avg("j")).alias("jaccard"), F.count("*").alias("n"))


def parameter_change(spark, sf_dir):
    x = table(spark, sf_dir, "part").select((F.col("p_size") * 9).alias("before"), (F.col("p_size") * 7 + 3).alias("after"))
    return M.parameter_change(x).select("before", "after", "delta", r6("percent").alias("percent"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_keep_latest(spark, sf_dir):
    return P.newest(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", r6("value").alias("value"))


def stream_decimate(spark, sf_dir):
    return P.every(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 2).select("user_id", "event_id")


def stream_ema(spark, sf_dir):
    x = P.moving_average(_events(spark, sf_dir), "user_id", "value", ["ts", "event_id"])
    return x.select("user_id", r6("average").alias("average"), "n")


def stream_rate(spark, sf_dir):
    """Values as milliseconds; those of 300 or more are dropped."""
    x = _events(spark, sf_dir).withColumn("seconds", F.col("value") / 1000).where(P.plausible(F.col("seconds"), 300))
    y = P.moving_average(x, "user_id", "seconds", ["ts", "event_id"])
    return y.select("user_id", G.rate_text(F.col("average")).alias("r")).select("user_id", "r.fps", r6("r.ms").alias("ms"))


QUERIES = {f.__name__: f for f in (shard_members_grouped, shard_union_by_key, filter_has_fields, filter_min_side, batching_drop_last, batching_keep_last, sequential_sample, random_sample, regex_key_select, positional_embedding_lookup, caption_mix, resampled_shards, stacked_kinds, prompt_templates, class_name_admit, pretokenize, adjacent_pairs, vocab_lookup, frame_context, eot_position, caption_cleanup, name_prefixes, augment_compress, augment_decompress, config_compose, multi_sample_expand, cutmix_bbox, crop_geometry, bottleneck_rank, group_rates_by_lang, jaccard_by_size, parameter_change, stream_keep_latest, stream_decimate, stream_ema, stream_rate)}


def _draw(seed: int, *keys: str) -> str:
    out = f"{seed}::BIGINT"
    for k in keys:
        out = f"(({out} + ({k}) % {S.MODULUS} + 1) * {S.FACTOR} % {S.MODULUS})"
    return f"({out} * {S.FACTOR} % {S.MODULUS})"


_OPS = "[" + ", ".join(f"'{o}'" for o in A.OPERATIONS) + "]"
_ENTRY = f"CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN {{0}} ELSE {{1}} END"
_CROP = "concat_ws(' ', doc_id * 3 % 97, doc_id * 5 % 97, doc_id * 7 % 97, doc_id * 11 % 97) AS crop"
_MAG = [f"(doc_id * {k} % 19 - 9)" for k in (1, 3)]
_NONE = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '' END"
_MEMBERS = "m AS (SELECT doc_id % 16 AS shard, doc_id AS key, unnest(['txt', 'src', CASE WHEN doc_id % 5 = 0 THEN 'png' ELSE 'jpg' END]) AS ext, unnest([lang, source, n_chars::VARCHAR]) AS data FROM documents)"
_LIST = "string_agg(ext || '=' || data, ';' ORDER BY ext)"
_LINES = "c AS (SELECT doc_id, string_split(text, chr(10)) AS texts FROM documents)"
_FRAME = "f AS (SELECT doc_id, list_transform(range(1, n_chars % 90 + 2), lambda i: i * 7 % 100 + 1)[1:75] AS ids FROM documents), t AS (SELECT doc_id, [49406] || ids || [49407] || list_transform(range(75 - len(ids)), lambda x: 0) AS t, len(ids) AS n FROM f)"
_EMA = "list_reduce(list({0} ORDER BY ts, event_id), lambda a, x: a - a / 10 + x / 10)"
SQL = {
    "shard_members_grouped": f"WITH {_MEMBERS} SELECT shard, key, {_LIST} AS parts FROM m GROUP BY shard, key",
    "shard_union_by_key": f"WITH {_MEMBERS}, b AS (SELECT doc_id % 16 AS shard, doc_id AS key, unnest(['src', 'q']) AS ext, unnest(['labels', quality::VARCHAR]) AS data FROM labels), a AS (SELECT * FROM b UNION ALL SELECT * FROM m ANTI JOIN b USING (shard, key, ext)) SELECT shard, key, {_LIST} AS parts FROM a GROUP BY shard, key",
    "filter_has_fields": "SELECT doc_id % 16 AS shard, doc_id AS key, n_chars::VARCHAR AS image FROM documents WHERE doc_id % 7 <> 0",
    "filter_min_side": "SELECT doc_id, n_chars % 640 + 1 AS width, doc_id % 480 + 1 AS height FROM documents WHERE least(n_chars % 640 + 1, doc_id % 480 + 1) >= 200",
    "batching_drop_last": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders) SELECT o_orderkey, n // 256 AS batch_id, CAST(n % 256 AS INTEGER) AS pos FROM r WHERE n // 256 < c // 256",
    "batching_keep_last": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) SELECT n // 256 AS batch_id, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY 1",
    "sequential_sample": f"WITH {_LINES} SELECT doc_id, CAST(5 % len(texts) AS INTEGER) AS i, texts[5 % len(texts) + 1] AS caption FROM c",
    "random_sample": f"WITH {_LINES}, d AS (SELECT *, CAST({_draw(11, 'doc_id', '2')} % len(texts) AS INTEGER) AS i FROM c) SELECT doc_id, i, texts[i + 1] AS caption FROM d",
    "regex_key_select": f"WITH {_LINES}, d AS (SELECT *, {_draw(1, 'doc_id', '3')} % 2 AS k FROM c), e AS (SELECT doc_id, CASE WHEN k = 0 THEN 'syn_text' ELSE 'syn_text_b' END AS key, CASE WHEN k = 0 THEN list_reverse(texts) ELSE texts[1:1] END AS own FROM d) SELECT doc_id, 'syn_text,syn_text_b' AS keys, key, CAST(3 % len(own) AS INTEGER) AS index, own[3 % len(own) + 1] AS text FROM e",
    "positional_embedding_lookup": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS kind, 0 AS place FROM documents",
    "caption_mix": f"SELECT doc_id, CASE WHEN {_draw(3, 'doc_id')} < {int(0.25 * S.MODULUS)} THEN 'syn' ELSE 'gt' END AS side FROM documents",
    "resampled_shards": f"WITH s AS (SELECT row_number() OVER (ORDER BY id, c) - 1 AS place, id AS shard_id FROM range(16) t(id), range(1, 4) u(c) WHERE c <= id % 3 + 1) SELECT slot, shard_id FROM (SELECT slot, {_draw(5, 'slot', '2')} % (SELECT count(*) FROM s) AS place FROM range(64) r(slot)) JOIN s USING (place)",
    "stacked_kinds": "SELECT 'gt' AS kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'syn', count(*), CAST(-sum(n_chars) AS BIGINT) FROM documents",
    "prompt_templates": "SELECT title, prefix || ' ' || p_brand || ' ' AS prompt FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('Desk items', 'A photo of'), ('Expressions', 'A person'), ('Custom', 'A photo of')) t(title, prefix)",
    "class_name_admit": "SELECT trim(p_type) AS name, lower(trim(p_type)) AS folded, min(p_partkey) AS first FROM part WHERE trim(p_type) <> '' GROUP BY 1, 2",
    "pretokenize": "WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '" + X.PRETOKEN.replace("'", "''") + "') AS t FROM conversations) SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS n, coalesce(array_to_string(t, ' '), '') AS tokens FROM t",
    "adjacent_pairs": "WITH l AS (SELECT p_partkey, unnest(range(1, length(p_type))) AS i, p_type FROM part), g AS (SELECT p_partkey, p_type[i] || ' ' || p_type[i + 1] AS pair, min(i) AS i FROM l GROUP BY ALL) SELECT p_partkey, string_agg(pair, ',' ORDER BY i) AS pairs FROM g GROUP BY p_partkey",
    "vocab_lookup": "WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS piece, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part) SELECT p_partkey, string_agg(((ascii(piece) * 131 + length(piece)) % 9973)::VARCHAR, ' ' ORDER BY i) AS ids FROM w WHERE piece < 'm' GROUP BY p_partkey",
    "frame_context": f"WITH {_FRAME} SELECT doc_id, array_to_string(t, ' ') AS tokens FROM t",
    "eot_position": f"WITH {_FRAME} SELECT doc_id, CAST(n + 1 AS INTEGER) AS place, CAST(n + 1 AS INTEGER) AS by_count FROM t",
    "caption_cleanup": "SELECT conv_id, turn, rtrim(string_split(text, '.')[1], ' ') AS caption FROM conversations",
    "name_prefixes": "SELECT n_nationkey, 'image_encoder.' || n_name AS key, n_name AS name, replace('wds/' || n_name, '/', '-') AS slug FROM nation",
    "augment_compress": f"SELECT doc_id, {_CROP}, {_ENTRY.format(_NONE, f'(doc_id % 14) || chr(58) || {_MAG[0]} || chr(44) || (doc_id * 3 % 14) || chr(58) || {_MAG[1]}')} AS ops FROM documents",
    "augment_decompress": f"SELECT doc_id, {_CROP}, {_ENTRY.format(_NONE, f'{_OPS}[doc_id % 14 + 1] || chr(58) || {_MAG[0]} || chr(44) || {_OPS}[doc_id * 3 % 14 + 1] || chr(58) || {_MAG[1]}')} AS ops FROM documents",
    "config_compose": "SELECT * FROM (VALUES (0, 'random_resized_crop'), (1, 'rand_augment'), (2, 'to_tensor'), (3, 'normalize')) t(place, name)",
    "multi_sample_expand": f"SELECT doc_id, CAST(aug AS INTEGER) AS aug, CAST({_draw(9, 'doc_id', 'aug')} % 14 AS INTEGER) AS op FROM documents, range(10) t(aug)",
    "cutmix_bbox": "WITH b AS (SELECT doc_id, CAST(floor(224 * sqrt(1 - doc_id % 10 / 10)) AS INTEGER) // 2 AS h, CAST(doc_id * 13 % 224 AS INTEGER) AS x, CAST(doc_id * 29 % 224 AS INTEGER) AS y FROM documents), c AS (SELECT doc_id, greatest(0, least(x - h, 224)) AS x1, greatest(0, least(y - h, 224)) AS y1, greatest(0, least(x + h, 224)) AS x2, greatest(0, least(y + h, 224)) AS y2 FROM b) SELECT *, round(1 - (x2 - x1) * (y2 - y1) / (224 * 224), 6) AS lam FROM c",
    "crop_geometry": 'SELECT doc_id, CAST(round_even((doc_id % 300) / 2, 0) AS INTEGER) AS "left", CAST(round_even((doc_id % 200 + 1) / 2, 0) AS INTEGER) AS top, 256 AS resize FROM documents',
    "bottleneck_rank": "WITH c AS (SELECT p_partkey, p_size, p_size * 8 AS c FROM part) SELECT p_partkey, greatest(1, CAST(round_even((-3 * c + sqrt(9 * c * c + 4 * 9 * 2 * c * 9)) / 18, 0) AS INTEGER)) AS rank, CAST(ceil(c * 2.7::DOUBLE / 16) * 16 AS INTEGER) AS width, round(0.1 * p_size / 50, 6) AS drop FROM c",
    "group_rates_by_lang": "SELECT lang, round(avg(toxic), 6) AS rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "jaccard_by_size": "WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations), j AS (SELECT least(len(x.w), 10) AS size, len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) AS j FROM w x JOIN w y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) SELECT CAST(size AS INTEGER) AS size, round(avg(j), 6) AS jaccard, count(*) AS n FROM j GROUP BY 1",
    "parameter_change": "WITH s AS (SELECT CAST(sum(p_size * 9) AS BIGINT) AS before, CAST(sum(p_size * 7 + 3) AS BIGINT) AS after FROM part) SELECT before, after, after - before AS delta, round(100.0::DOUBLE * (after - before) / before, 6) AS percent FROM s",
    "stream_keep_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id",
    "stream_decimate": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 3 = 0",
    "stream_ema": f"SELECT user_id, round({_EMA.format('value')}, 6) AS average, count(*) AS n FROM events GROUP BY user_id",
    "stream_rate": f"WITH a AS (SELECT user_id, {_EMA.format('value / 1000')} AS a FROM events WHERE value / 1000 * 1000 < 300 GROUP BY user_id) SELECT user_id, CAST(round(1 / a) AS INTEGER) AS fps, round(round(a * 10000) / 10, 6) AS ms FROM a",
}
