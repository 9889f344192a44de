"""Operator 1: approximate nearest neighbours by multiprobe p-stable hashing.

Vectors get one more component so that all have the norm of the longest one; the nearest by inner product are then the
nearest by distance. A table hashes a vector by K Gaussian (2-stable) projections cut into cells. A query does not only
visit its own bucket: for every perturbation of its cells by -1, 0 or 1 it estimates the chance that a neighbour's
projections fall there (the cells' Gaussian mass around the query's projections, with the spread of a neighbour's
distance), and visits buckets in that order until the tables' estimated misses multiply to no more than 1 - target.

Distinct vectors are searched, each with its smallest ids, so copies cost nothing more. Buckets are gathered in blocks
of bounded size (a large bucket is split, as are many queries), and a block scores its own rows against the queries
that visit it, exactly and in double precision; what queries keep of each block is merged.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.shared import table, written
from vecloom.llm.wordkit import mix

_FOUND = "array<struct<loss:double,vec_id:bigint>>"


class Index:
    """Tables of projections, fitted on a sample of at most `sample` distinct vectors.

    spread: how far neighbours' projections lie apart, from the distances of the sample's queries to their neighbours
    (which are farther in a sample than among all rows, so the estimate errs towards more probes)."""

    def __init__(self, sample: np.ndarray, norm: float, k: int, target: float, tables: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.norm, self.bits, self.tables, self.miss = norm, bits, tables, 1 - target
        x = self.lift(sample)
        self.axes = rng.standard_normal((tables, x.shape[1], bits))
        q = self.query(sample[rng.permutation(len(sample))[:256]])
        far = np.maximum(2 - 2 * (q @ x.T), 0)
        far.sort(axis=1)
        near = far[:, 1 : 1 + k] if len(sample) > 1 else far
        self.spread = math.sqrt(max(float(np.quantile(near, 0.9)), 1e-6))
        self.width = 2.4 * self.spread  # cells to either side then hold nearly all neighbours
        self.shift = rng.random((tables, bits))
        self.steps = np.array([*itertools.product((-1, 0, 1), repeat=bits)], np.int64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows scaled into the unit ball and raised onto the sphere."""
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))])

    def query(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([x, np.zeros((len(x), 1))])

    def cells(self, x: np.ndarray, table_: int) -> tuple[np.ndarray, np.ndarray]:
        at = x @ self.axes[table_] / self.width + self.shift[table_]
        return np.floor(at).astype(np.int64), at

    def code(self, cells: np.ndarray, table_: int) -> np.ndarray:
        """The bucket's number, 63 bits."""
        out = np.full(cells.shape[:-1], table_ + 1, np.uint64)
        for i in range(self.bits):
            out = mix(out * np.uint64(31) + cells[..., i].astype(np.uint64))
        return (out >> np.uint64(1)).astype(np.int64)

    def probes(self, x: np.ndarray, table_: int) -> list[np.ndarray]:
        """For each query the buckets to visit, in order of their chance of holding a neighbour."""
        cells, at = self.cells(self.query(x), table_)
        erf = np.vectorize(math.erf)
        inside = at - cells
        edge = np.stack([inside + 1, inside, inside - 1, inside - 2])  # distance to the edges of the cells -1, 0 and 1
        upto = 0.5 * (1 + erf(edge * self.width / (self.spread * math.sqrt(2))))
        chance = np.log(np.maximum(upto[:-1] - upto[1:], 1e-12))  # [step, query, axis]
        total = sum(chance[self.steps[:, i] + 1, :, i] for i in range(self.bits)).T
        order = np.argsort(-total, axis=1, kind="stable")
        mass = np.cumsum(np.exp(np.take_along_axis(total, order, axis=1)), axis=1)
        need = 1 - self.miss ** (1 / self.tables)
        many = np.minimum((mass < need).sum(axis=1) + 1, len(self.steps))
        return [self.code(c + self.steps[o[:m]], table_) for c, o, m in zip(cells, order, many, strict=True)]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, target: float = 0.92, tables: int = 2, bits: int = 7, sample: int = 4096, block: int = 4096, seed: int = 7) -> DataFrame:
    """The k rows of largest inner product that are found for each query: query_id, rank (from 1), vec_id, score.

    rows and queries have vec_id and embedding (numbers); other columns are not read, and queries' ids are looked up
    among rows, so each must be a row there. A query's own row is no candidate. Ties go to the smaller vec_id. Vectors
    that are null, zero, of another length than the most common one, or hold null or non-finite components take no
    part, nor do rows of null vec_id; a vec_id that repeats counts once for each distinct vector. An empty side gives no
    rows. `sample` bounds the vectors on which spread is fitted; all rows are indexed.
    """
    spark = rows.sparkSession
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0)
    x = x.where(fine).withColumn("v", F.transform("v", lambda a: a + F.lit(0.0)))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().withColumn("asked", F.lit(True))
    width = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    found = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], found)
    x = x.where(F.size("v") == width["d"]).join(asked, "vec_id", "left")
    # The k + 1 smallest ids of a distinct vector are all that a result can name. Groups of copies are cut into parts
    # first, so no task gathers one whole.
    some = x.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
    distinct = written(some.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.max("asked").alias("asked")).withColumn("class", F.get("ids", 0)), "vectors")
    facts = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a)).alias("square")).first()
    picked = distinct.orderBy(F.xxhash64("class")).limit(sample).select("v").toPandas()["v"]
    index = Index(np.array(picked.tolist(), np.float64), math.sqrt(facts["square"]), k, target, tables, bits, seed)
    blocks = max(1, -(-facts["n"] // block))

    def place(batches):
        for b in batches:
            v = index.lift(matrix(b.column("v")))
            for t in range(index.tables):
                code = index.code(index.cells(v, t)[0], t)
                yield pa.RecordBatch.from_arrays([pa.array(t * blocks + (code % blocks).astype(np.int32), pa.int32()), pa.array(code), *(b.column(c) for c in ("class", "ids", "v"))], names=["block", "code", "class", "ids", "v"])

    def visit(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                v = matrix(part.column("v"))
                for t in range(index.tables):
                    block_, codes, row = [], [], []
                    for i, c in enumerate(index.probes(v, t)):
                        at = t * blocks + c % blocks
                        order = np.argsort(at, kind="stable")
                        for j in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                            block_.append(int(at[j[0]])), codes.append(c[j]), row.append(i)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(block_, pa.int32()), part.column("class").take(take), part.column("v").take(take), pa.array(codes, pa.list_(pa.int64()))], names=["block", "class", "v", "codes"])

    placed = distinct.select("class", "ids", "v").mapInArrow(place, "block int, code long, class long, ids array<long>, v array<double>")
    visits = distinct.where("asked").select("class", "v").mapInArrow(visit, "block int, class long, v array<double>, codes array<long>")
    # Sides of a block are split by the numbers of their rows, each part of one meeting each part of the other.
    have = placed.groupBy("block").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("xs"))
    want = visits.groupBy("block").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("ys"))
    cuts = written(have.join(want, "block"), "cuts")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("class"), F.col(own)).cast("int")
        out = side.join(cuts, "block").withColumn(own[0], mine).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return out.drop("xs", "ys")

    left, right = dealt(placed, "xs", "ys"), dealt(visits, "ys", "xs")

    def score(held: pa.Table, visiting: pa.Table) -> pa.Table:
        if not held.num_rows or not visiting.num_rows:
            return pa.table({"class": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("loss", pa.float64()), ("vec_id", pa.int64())])))})
        code, v, ids = held.column("code").to_numpy(), matrix(held.column("v")), held.column("ids").to_pylist()
        name, q, codes = visiting.column("class").to_pylist(), matrix(visiting.column("v")), visiting.column("codes").to_pylist()
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        known, at = np.unique(code, return_inverse=True)
        out = []
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256] @ v.T
            for i, s in enumerate(part, lo):
                seen = np.zeros(len(known), bool)
                c = np.asarray(codes[i], np.int64)
                p = np.searchsorted(known, c).clip(max=len(known) - 1)
                seen[p[known[p] == c]] = True
                rows_ = np.flatnonzero(seen[at])
                if len(rows_) > k + 1:  # enough vectors, with all that tie with the last of them
                    last = np.partition(s[rows_], len(rows_) - k - 1)[len(rows_) - k - 1]
                    rows_ = rows_[s[rows_] >= last]
                best = sorted((-float(s[r]), d) for r in rows_.tolist() for d in (ids[r] if many[r] > 1 else (ids[r][0],)))[: k + 1]
                out.append([{"loss": a, "vec_id": d} for a, d in best])
        return pa.table({"class": pa.array(name, pa.int64()), "found": pa.array(out, pa.list_(pa.struct([("loss", pa.float64()), ("vec_id", pa.int64())])))})

    keys = ["block", "x", "y"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"class long, found {_FOUND}")
    # Tables may score one pair in blocks of other shapes, a last bit apart; the sum is taken anew for what is returned.
    merged = scored.groupBy("class").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, tables * (k + 1)).alias("found"))
    members = x.where("asked").select("vec_id", "v").distinct().join(distinct.select("v", "class"), "v").select(F.col("vec_id").alias("query_id"), "class", F.col("v").alias("q"))
    pairs = members.join(merged, "class").withColumn("ids", F.array_distinct(F.transform(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), lambda f: f["vec_id"])))
    pairs = pairs.select("query_id", "q", F.explode(F.slice("ids", 1, k + 2)).alias("vec_id"))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    exact = pairs.join(x.select("vec_id", "v").distinct(), "vec_id").select("query_id", "vec_id", dot.alias("score"))
    best = exact.groupBy("query_id").agg(F.slice(F.array_sort(F.array_agg(F.struct((-F.col("score")).alias("loss"), "vec_id"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.loss")).alias("score"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {"op1_nearest_vectors": nearest_vectors}
SQL: dict[str, str] = {}
