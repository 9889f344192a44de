"""Operator 7: n-gram Jaccard join by token-combination prefixes.

Tokens are word n-grams, rare ones first by a frequency sketch of the whole corpus. With a share t to reach, a set of
size s may lack e = s - ceil(t s) tokens of a partner's. Tokens are dealt into classes by hash; small sets index single
tokens, others pairs of tokens of one class. A prefix is extended until its classes hold e + 1 tokens beyond the first
of each (beyond none, for single tokens): lacking at most e, a partner then shares two tokens of some class (or one
token), and as the prefix that ends first lies wholly inside what the other one covers, both index that combination.

Combinations meet in buckets. Up to `small` sets with one combination give their pairs; more give a star, so nothing
grows with the square of a group. Pairs pass an exact bound first (the parity bitmaps of two sets differ in no more
bits than the sets in tokens). What is left falls into components, whose members' whole sets are compared in blocks; a
pair inside one component of links already needs no comparison, as only connections are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.components import components
from vecloom.llm.shared import lean, shares, table, written
from vecloom.llm.tokens_file import as_bytes
from vecloom.llm.wordkit import mix, pieces, run_starts, runs, window_hashes, word_hashes

SKETCH_BITS, CHUNKS = 20, 64
SMALL = 64
BLOCK = 1024
SPREAD = 16


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of every text, one after another, and their number for each. A text of fewer than
    n words has its whole sequence as its one shingle; a text without words has none."""
    flat, sizes = [], []
    for lo, hi in pieces([len(t) for t in texts]):
        words, counts = word_hashes(texts[lo:hi], lower=True)
        found = [window_hashes(words, counts, n)[:2]]
        for m in sorted(set(counts[(counts > 0) & (counts < n)].tolist())):
            h, text, _ = window_hashes(words, counts, m)
            found.append((mix(h[counts[text] == m] + np.uint64(m)), text[counts[text] == m]))
        h, text = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        flat.append(h[new])
        sizes.append(np.bincount(text[new], minlength=hi - lo))
    return np.concatenate([np.empty(0, np.uint64), *flat]), np.concatenate([np.empty(0, np.int64), *sizes])


def node_of(tokens: np.ndarray) -> int:
    """A set's number: equal sets have equal ones."""
    return int(mix(np.array([np.sum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64) + np.uint64(len(tokens)))[0].astype(np.int64))


def bitmap_of(tokens: np.ndarray) -> bytes:
    bits = max(256, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many tokens two sets differ in at least, by their bitmaps; of the larger bitmap, parts fold together."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
        at = np.flatnonzero((la == x) & (lb == y))
        m = min(x, y)
        p, q = (np.bitwise_xor.reduce(np.frombuffer(b"".join([v[i] for i in at]), np.uint8).reshape(len(at), -1, m), axis=1) for v in (a, b))
        out[at] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return out


def spare(size: int, percent: int) -> int:
    """How many of its tokens a set's partner may lack."""
    return size - -(-size * percent // 100)


def classes_of(level: int, percent: int) -> int:
    """How many classes sets of about 1.5 * 2**level tokens have: about 1.5 tokens of a prefix fall into each. 0: single
    tokens, for small sets and where a level's smallest sets could not fill a prefix of pairs."""
    m = -(-4 * (spare(3 << level >> 1, percent) + 1) // 3)
    least = (1 << level) * percent // 100
    return 0 if level < 5 or least - m <= spare(least, percent) else m


def signatures(tokens: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The combinations that a set indexes. order: its tokens' places, rare ones first. Sets that may be partners share
    the level of the larger one."""
    out, size = [], len(tokens)
    for level in {size.bit_length() - 1, (size * 100 // percent).bit_length() - 1}:
        m, salt = classes_of(level, percent), np.uint64(level * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        need = spare(size, percent) + 1
        if not m:
            out.append(mix(tokens[order[:need]] ^ salt))
            continue
        ranked = tokens[order]
        kind = (mix(ranked + salt) % np.uint64(m)).astype(np.int64)
        again = np.ones(size, np.int64)
        again[np.unique(kind, return_index=True)[1]] = 0
        upto = np.cumsum(again)
        end = int(np.searchsorted(upto, need)) + 1
        kind, some = kind[:end], ranked[:end]
        by = np.lexsort((some, kind))
        kind, some = kind[by], some[by]
        for step in range(1, int(np.bincount(kind).max())):
            same = np.flatnonzero(kind[step:] == kind[:-step])
            out.append(mix(some[same] * np.uint64(0xD1342543DE82EF95) + mix(some[same + step]) + salt))
    return np.unique(np.concatenate(out))


def join_groups(docs: DataFrame, n: int = 4, percent: int = 85, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, n_shingles and component_id, the
    smallest doc_id that links reach. Two rows link when 100 * |intersection| >= percent * |union| of their n-word
    shingles, with A-Z taken as a-z.

    Rows without words (null, empty or white-space text) have no shingles and link with nothing: their component is
    their own doc_id. Rows with equal sets are one node, so copies cost nothing more. A null doc_id joins a component
    but cannot name it unless it is alone. No rows give no rows. Nodes and shingles are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        from pyspark import TaskContext

        counts, names = np.zeros(1 << SKETCH_BITS, np.int32), ["chunk", "doc_id", "n_shingles", "node", "body"]
        for b in shares(batches, "text"):
            flat, sizes = shingle_sets(as_bytes(b.column(1)), n)
            counts += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
            ends = np.cumsum(sizes)
            sets = [flat[x:y] for x, y in zip(ends - sizes, ends, strict=True)]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            maps = pa.array([bitmap_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(sets), pa.int32()), b.column(0), pa.array(sizes, pa.int64()), nodes, maps], names=names)
        part = TaskContext.get().partitionId()
        body = [zstandard.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int64()), pa.array([0] * CHUNKS, pa.int64()), pa.array([None] * CHUNKS, pa.int64()), pa.array(body, pa.binary())], names=names)

    seen = written(picked.mapInArrow(look, "chunk int, doc_id long, n_shingles long, node long, body binary"), "shingles")

    def add(t: pa.Table) -> pa.Table:
        lean()
        total = sum(np.frombuffer(zstandard.decompress(x), np.int32).astype(np.int64) for x in t.column("body").to_pylist())
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"chunk": t.column("chunk")[:1].cast(pa.int32()), "body": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    chunks = seen.where("chunk IS NOT NULL").select("chunk", F.expr("doc_id div 256").alias("some"), "body")
    summed = chunks.groupBy("chunk", "some").applyInArrow(add, "chunk int, body binary").groupBy("chunk").applyInArrow(add, "chunk int, body binary")
    parts = {r["chunk"]: zstandard.decompress(r["body"]) for r in summed.collect()}  # 4 MB whatever the input
    sketch = spark.sparkContext.broadcast(b"".join(parts.get(i, bytes(4 << SKETCH_BITS >> 6)) for i in range(CHUNKS)))
    info = seen.where("chunk IS NULL AND node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("body").alias("map"), F.count("*").alias("rows"))
    tokens = seen.where("chunk IS NULL").agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(16, -(-tokens // 4_000_000))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        often = np.frombuffer(sketch.value, np.int32)
        for b in shares(batches, "text"):
            flat, sizes = shingle_sets(as_bytes(b.column(0)), n)
            rank, ends = often[(flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], np.cumsum(sizes)
            done, sig, node = set(), [], []
            for x, y in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                if x == y or (name := node_of(flat[x:y])) in done:
                    continue
                done.add(name)
                sig.append(signatures(flat[x:y], np.argsort(rank[x:y], kind="stable"), percent))
                node.append(np.full(len(sig[-1]), name, np.int64))
            if not sig:
                continue
            sig, node = np.concatenate(sig), np.concatenate(node)
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            first = run_starts(sig)
            many = np.diff(np.append(first, len(sig)))
            crowd = np.repeat(many > small, many)
            lead = np.repeat(first, many)
            star = crowd & (lead != np.arange(len(sig)))
            crowd, keep = crowd[~star], ~star
            links = [(int(a) % buckets, None, x) for a, x in _packed(node[lead[star]], node[star])]
            sig, node = sig[keep], node[keep]
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, sig, node, crowd = bucket[by], sig[by], node[by], crowd[by]
            rows = links + [(int(bucket[lo]), sig[lo:hi].tobytes() + node[lo:hi].tobytes() + crowd[lo:hi].tobytes(), None) for lo, hi in runs(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "entries", "links"])

    def meet(t: pa.Table) -> pa.Table:
        """Pairs (a < b) of the sets that share a combination of this bucket; star: one side stands for a crowd."""
        lean()
        a, b, star = [], [], []
        for x in filter(None, t.column("links").to_pylist()):
            pair = np.frombuffer(x, np.int64).reshape(2, -1)
            a.append(pair[0]), b.append(pair[1]), star.append(np.ones(pair.shape[1], bool))
        sig, node, crowd = [], [], []
        for x in filter(None, t.column("entries").to_pylist()):
            k = len(x) // 17
            sig.append(np.frombuffer(x, np.uint64, k)), node.append(np.frombuffer(x, np.int64, k, 8 * k)), crowd.append(np.frombuffer(x, bool, k, 16 * k))
        if sig:
            sig, node, crowd = (np.concatenate(x) for x in (sig, node, crowd))
            order = np.lexsort((node, sig))
            sig, node, crowd = sig[order], node[order], crowd[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            crowded = np.logical_or.reduceat(crowd, run_starts(sig))
            sig, node = sig[new], node[new]
            first = run_starts(sig)
            many = np.diff(np.append(first, len(sig)))
            crowded |= many > small
            wide = np.repeat(crowded, many)
            lead = np.repeat(first, many)
            out = wide & (lead != np.arange(len(sig)))
            a.append(node[lead[out]]), b.append(node[out]), star.append(np.ones(int(out.sum()), bool))
            for step in range(1, int(many[~crowded].max(initial=1))):
                same = np.flatnonzero((lead[step:] == lead[:-step]) & ~wide[step:])
                a.append(node[same]), b.append(node[same + step]), star.append(np.zeros(len(same), bool))
        a, b, star = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((a, np.int64), (b, np.int64), (star, bool)))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((~star, hi, lo))
        lo, hi, star = lo[order], hi[order], star[order]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        new &= lo != hi
        return pa.table({"a": lo[new], "b": hi[new], "star": star[new]})

    met = picked.select("text").mapInArrow(index, "bucket int, entries binary, links binary").groupBy("bucket").applyInArrow(meet, "a long, b long, star boolean")
    pairs = written(met.groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    sides = [info.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("map").alias(f"map_{x}")) for x in "ab"]
    fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            total = b.column("size_a").to_numpy() + b.column("size_b").to_numpy()
            differ = least_differences(b.column("map_a").to_pylist(), b.column("map_b").to_pylist())
            keep = pa.array(differ * (100 + percent) <= total * (100 - percent))
            yield b.select(["a", "b"]).filter(keep)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in shares(batches, "text"):
            flat, sizes = shingle_sets(as_bytes(b.column(0)), n)
            ends = np.cumsum(sizes)
            nodes = [node_of(flat[x:y]) if y > x else None for x, y in zip(ends - sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), b.column(0)], names=["node", "text"])

    close = pairs.where("NOT star").join(sides[0], "a").join(sides[1], "b").where(fits).select("a", "b", "size_a", "size_b", "map_a", "map_b").mapInArrow(bounded, "a long, b long")
    groups = written(components(close.union(pairs.where("star").select("a", "b")), "candidates"), "groups")
    # Only components of several blocks are listed, so their table is small and a large component is not dealt by its root.
    wide = written(groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "wide")
    members = groups.join(wide, "root", "left").fillna({"blocks": 1}).join(info.select("node", "doc_id"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("node", "doc_id", "root", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    lots = max(16, groups.count() // 1500)
    nameless = picked.where("doc_id IS NULL").select("text").mapInArrow(named, "node long, text string").dropDuplicates(["node"])
    texts = members.join(picked, "doc_id").unionByName(members.where("doc_id IS NULL").join(nameless, "node"), allowMissingColumns=True)
    held = texts.select(F.pmod(F.xxhash64("root", "x", "y"), F.lit(lots)).alias("lot"), "root", "x", "y", "node", "text")

    def verify(t: pa.Table) -> pa.Table:
        """The links of one lot of blocks, as a spanning forest."""
        lean()
        t = t.sort_by([("root", "ascending"), ("x", "ascending"), ("y", "ascending"), ("node", "ascending")])
        texts, nodes = as_bytes(t.column("text")), t.column("node").to_numpy()
        key = mix(t.column("root").to_numpy().astype(np.uint64) + mix(t.column("x").to_numpy().astype(np.uint64) * np.uint64(1 << 32) + t.column("y").to_numpy().astype(np.uint64)))
        a, b = [], []
        for lo, hi in runs(key):
            flat, sizes = shingle_sets(texts[lo:hi], n)
            ends = np.cumsum(sizes)
            sets = {}
            for i, (p, q) in enumerate(zip(ends - sizes, ends, strict=True)):
                if q > p and node_of(flat[p:q]) == nodes[lo + i]:  # another row of that doc_id may have another text
                    sets[int(nodes[lo + i])] = flat[p:q]
            for p, q in links_among([*sets.values()], percent):
                a.append([*sets][p]), b.append([*sets][q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    linked = components(held.groupBy("lot").applyInArrow(verify, "a long, b long"), "linked")
    # A component's sets and a set's rows may be any share of the table, so both joins are dealt by salt as well; the sides
    # that are copied hold only components of links and sets of several rows.
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SPREAD))
    copied = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    sets = info.select("node", "doc_id", "rows").join(linked, "node", "left").where("root IS NOT NULL OR rows > 1")
    least = sets.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    names = sets.withColumn("salt", salt("node")).join(copied(least), ["root", "salt"], "left").select("node", F.coalesce("least", "doc_id").alias("name"))
    rows = seen.where("chunk IS NULL").select("doc_id", "n_shingles", "node", salt("doc_id").alias("salt"))
    return rows.join(copied(names), ["node", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def _packed(a: np.ndarray, b: np.ndarray, most: int = 100_000) -> Iterator[tuple[int, bytes]]:
    for i in range(0, len(a), most):
        yield int(a[i] & 0x7FFFFFFF), a[i : i + most].tobytes() + b[i : i + most].tobytes()


def links_among(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: a set is held against all that are not yet connected with it."""
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    ends, group, out = np.cumsum(size), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        open_ = np.flatnonzero((group != group[i]) & (np.arange(len(sets)) > i) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent))
        if not len(open_):
            continue
        mine = np.zeros(len(vocabulary), bool)
        mine[flat[ends[i] - size[i] : ends[i]]] = True
        both = np.bincount(owner[mine[flat]], minlength=len(sets))[open_]
        for j in open_[100 * both >= percent * (size[open_] + size[i] - both)].tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard_join": jaccard_join}
#: Links are found here by a self-join on shingles; only small tables can be given to it.
SQL = {
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reached) AS component_id
FROM w LEFT JOIN c USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id"""
}
