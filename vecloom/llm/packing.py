"""Operator 9: packing under control of a mixture, by deficit round-robin over source queues.

The tokens of a source form a queue. Every window of `length` tokens is filled from all queues by their target rates.
Token j of a queue of rate r falls due at (2j+1)/(2r): serving tokens in the order of those times is deficit
round-robin with a quantum of one token, since at any time each queue has had its rate's share to within a token, and
what a window owes to a queue is paid by the next one. The place of a token in that order is a sum over queues of a
quotient of integers, so every task works out its own documents' places from the queue totals, and a deficit crosses
windows and partitions without any task having to wait for another. A queue that runs dry leaves its share to the
others, in their proportions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.shared import lean, table, written
from vecloom.llm.tokens_file import as_bytes
from vecloom.llm.wordbpe import WordBpe
from vecloom.llm.wordkit import pieces

_ENCODED = "doc_id long, source string, part int, start_in_part long, doc_tokens long, ids binary"
_PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Rates are whole numbers up to this, so targets hold to about one part in a million.
RATE_UNIT = 1 << 20


#: Queues that one group of a larger schedule holds.
GROUP = 16


class Schedule:
    """Where the tokens of each queue go. totals: tokens in each queue; weights: the target proportions.

    Up to `most` queues are served side by side. More are dealt into groups of GROUP, groups into groups, until `most`
    are left: a group is served as one queue, at the summed weight of its members, and serves them in the same way. So
    each queue has its rate's share to within a token for every level. A queue that runs dry leaves its share to its
    group first; groups are made of queues that run dry one after the other, those of weight 0 by themselves."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, length: int, most: int = 256) -> None:
        total, weight = np.asarray(totals, np.int64), np.maximum(np.asarray(weights, float), 0)
        self.length = length
        self.parent, self.place, self.rate, self.total = [], [], [], []  # by level, from the queues up
        while True:
            n = len(total)
            group, place = np.zeros(n, np.int64), np.arange(n)
            if top := n <= max(most, GROUP):
                many = 1
            else:
                idle = weight <= 0
                order = np.lexsort((place, np.where(idle, 0, total / np.where(idle, 1, weight)), idle))
                at = np.arange(n) - np.where(idle[order], n - idle.sum(), 0)
                first = -(-int(n - idle.sum()) // GROUP)
                group[order], place[order] = at // GROUP + np.where(idle[order], first, 0), at % GROUP
                many = int(group.max()) + 1
            sums = np.bincount(group, weight, many)
            rate, held = np.ones((many, place.max(initial=0) + 1), np.int64), np.zeros((many, place.max(initial=0) + 1), np.int64)
            rate[group, place] = np.maximum(1, np.round(weight / np.maximum(sums[group], 1e-300) * RATE_UNIT)).astype(np.int64)
            held[group, place] = total
            self.parent.append(group), self.place.append(place), self.rate.append(rate), self.total.append(held)
            if top:
                return
            total, weight = held.sum(axis=1), sums

    def among(self, level: int, group: np.ndarray, own: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many tokens of a group come before token j of its member `own`.

        Of a member of rate q against one of rate r these are (due * q / r + 1) / 2, with due = 2j + 1, and not more than
        it has. due is split into whole * r + rest and whole held to what uses the member up, so no product exceeds
        four times a queue's tokens or RATE_UNIT squared: 64 bits suffice for 2**60 tokens."""
        rates, totals = self.rate[level], self.total[level]
        out, mine = j.copy(), rates[group, own]
        whole, rest = np.divmod(2 * j + 1, mine)
        for s in range(rates.shape[1]):
            rate, total = (rates[0, s], totals[0, s]) if len(rates) == 1 else (rates[group, s], totals[group, s])
            due = np.minimum(whole, (2 * total + 2) // rate + 1) * rate + (rest * rate - (s > own)) // mine
            ahead = np.minimum(total, (due + 1) // 2)
            out += np.where(s == own, 0, ahead)
        return out

    def rank(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many tokens of all queues come before token j of a queue."""
        for level, (parent, place) in enumerate(zip(self.parent, self.place, strict=True)):
            j = self.among(level, parent[queue], place[queue], j)
            queue = parent[queue]
        return j

    def served(self, level: int, group: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """[row, member]: the tokens that the members of a group have given before its token number `goal`."""
        n = self.rate[level].shape[1]
        of, own, want = np.repeat(group, n), np.tile(np.arange(n), len(group)), np.repeat(goal, n)
        lo, hi = np.zeros(len(want), np.int64), self.total[level][of, own]
        while (live := lo < hi).any():
            mid = (lo + hi) // 2
            late = self.among(level, of, own, mid) >= want
            hi, lo = np.where(live & late, mid, hi), np.where(live & ~late, mid + 1, lo)
        return lo.reshape(len(group), n)

    def cut(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of runs of queue tokens (size 1 or more): run, start in the run, length, window, offset there."""
        first, last = (self.rank(queue, x) // self.length for x in (start, start + size - 1))
        many = last - first + 1
        run = np.repeat(np.arange(len(queue)), many)
        window = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        n, edge, path = len(run), np.concatenate([window, window + 1]), [np.tile(queue[run], 2)]
        for parent in self.parent:
            path.append(parent[path[-1]])
        goal, before = edge * self.length, np.zeros(n, np.int64)
        for level in reversed(range(len(self.parent))):  # from the windows' edges down to what each queue has given
            group, own = path[level + 1], self.place[level][path[level]]
            _, some, back = np.unique(group * (int(edge.max(initial=0)) + 1) + edge, return_index=True, return_inverse=True)
            served = self.served(level, group[some], goal[some])
            ahead = np.cumsum(served, axis=1) - served
            before += ahead[back[n:], own[n:]] - ahead[back[:n], own[:n]]
            goal = served[back, own]
        lo, hi = np.maximum(start[run], goal[:n]), np.minimum(start[run] + size[run], goal[n:])
        keep = hi > lo
        return tuple(x[keep] for x in (run, lo - start[run], hi - lo, window, before + lo - goal[:n]))


def as_blobs(ids: np.ndarray, counts: np.ndarray, wide: bool) -> pa.Array:
    """The ids of each row as little-endian numbers of 16 bits, or 32 if wide: what the JVM moves as one block."""
    kind = np.dtype("<u4" if wide else "<u2")
    ends = np.concatenate([[0], np.cumsum(counts) * kind.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, kind))])


def of_blobs(blobs: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What as_blobs made of rows that have ids: all ids, and where each row's begin."""
    ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    width = int(ends[-1] - ends[0]) // int(counts.sum())
    return np.frombuffer(blobs.buffers()[2], f"<u{width}", int(counts.sum()), int(ends[0])), (ends[:-1] - ends[0]) // width


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of every row with its place in its partition's part of its source's queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        from pyspark import TaskContext

        part, bpe, seen = TaskContext.get().partitionId(), WordBpe(tokenizer, end_id), {}
        for batch in batches:
            texts, sources = as_bytes(batch.column(2)), batch.column(1).to_pylist()
            for lo, hi in pieces([len(t) for t in texts], 1 << 21):
                ids, counts = bpe.encode(texts[lo:hi])
                start = np.empty(hi - lo, np.int64)
                for i, (s, n) in enumerate(zip(sources[lo:hi], counts.tolist(), strict=True)):
                    start[i] = seen.get(s, 0)
                    seen[s] = int(start[i]) + n
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(np.full(hi - lo, part, np.int32)), pa.array(start), pa.array(counts), as_blobs(ids, counts, bpe.wide)], names=["doc_id", "source", "part", "start_in_part", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ENCODED)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, targets: dict[str, float] | None = None, max_queues: int = 256) -> DataFrame:
    """One row per piece of every document: where its ids lie in which sequence.

    docs has doc_id, text and source; other columns are not read. targets gives the weight of each source (others: 0,
    served at the least rate); by default a source's weight is its number of tokens, so each sequence mirrors the
    corpus. Every source has a queue of its own; more than max_queues of them are served in groups (see Schedule), and
    tasks hold some 50 bytes a source. Null text is empty (a document of its end id alone); a
    null source is the source "". Equal rows are packed each for itself. No rows give no pieces. All sequences but the
    last are full.
    """
    spark = docs.sparkSession
    rows = written(encode(docs, tokenizer, end_id), "pack", **{"parquet.enable.dictionary#ids": "false"})
    totals = rows.groupBy("part", "source").agg(F.sum("doc_tokens").alias("size"))
    sizes = totals.groupBy("source").agg(F.sum("size").alias("size"))
    # Sources are numbered by size: a range each, in order, and the rows before it.
    wanted = spark.createDataFrame([(s, float(w)) for s, w in (targets or {}).items()] or [("", 0.0)], "source string, weight double")
    ranked = sizes.join(F.broadcast(wanted), "source", "left").fillna({"weight": 0.0}).orderBy(F.desc("size"), "source").withColumn("at", F.monotonically_increasing_id())
    ranked = written(ranked, "sources")
    known = ranked.select("at", "size", "weight").toPandas().sort_values("at")
    at, total = known["at"].to_numpy(np.int64), known["size"].to_numpy(np.int64)
    schedule = Schedule(total, known["weight"].to_numpy(float) if targets else total, length, max_queues)
    parts, begin = np.unique(at >> 33, return_index=True)
    begins = spark.createDataFrame([*zip(parts.tolist(), begin.tolist(), strict=True)] or [(0, 0)], "range long, begin long")
    numbered = ranked.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(begins), "range").select("source", (F.col("begin") + F.col("at") - F.shiftleft("range", 33)).alias("queue"))
    places = totals.join(F.broadcast(numbered) if len(at) <= 200_000 else numbered, "source")
    places = places.withColumn("before", F.sum("size").over(Window.partitionBy("queue").orderBy("part")) - F.col("size"))
    places = written(places.select("part", "source", "queue", "before"), "places")
    if places.count() <= 200_000:  # parts times sources: small, or else joined by shuffling
        places = F.broadcast(places)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if not b.num_rows:
                continue
            start, size = (b.column(c).to_numpy() for c in ("queue_start", "doc_tokens"))
            flat, at = of_blobs(b.column("ids"), size)
            run, begin, n, window, offset = schedule.cut(b.column("queue").to_numpy().astype(np.int64), start, size)
            lo = at[run] + begin
            crc = [zlib.crc32(flat[x:y].astype("<u4")) for x, y in zip(lo.tolist(), (lo + n).tolist(), strict=True)]
            take = pa.array(run)
            out = [b.column("doc_id").take(take), b.column("source").take(take), pa.array(begin), pa.array(n), pa.array(crc, pa.int64()), pa.array(size[run]), pa.array(window), pa.array(offset)]
            for x in range(0, len(run), 50_000):
                yield pa.RecordBatch.from_arrays([c[x : x + 50_000] for c in out], names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    laid = rows.join(places, ["part", "source"]).select("doc_id", "source", "queue", (F.col("before") + F.col("start_in_part")).alias("queue_start"), "doc_tokens", "ids")
    return laid.mapInArrow(lay, _PIECES)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


QUERIES = {"op9_packing": packing}
SQL: dict[str, str] = {}
