"""Operator 8: SentencePiece encoding and decoding.

A text is a sequence of units: a run of spaces (one more stands before the text) with the word behind it. Pieces hold
spaces only in front, so units are encoded one by one, and every distinct unit of a task once. A unit's ids are a path
of its lattice: substrings of bounded length, joined with the piece table, grouped by unit and folded by a Viterbi pass.

lattice() is that in DataFrame operations, for unigram models, whose paths have scores that add up. encode() is for BPE
models, the kind of the piece file here: it works the same steps on Arrow batches, admitting only neighbours that BPE
leaves apart (see piecelattice), which gives the library's ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.piecelattice import PieceLattice
from vecloom.llm.shared import lean, table
from vecloom.llm.tokens_file import as_bytes
from vecloom.llm.wordkit import pieces

SPACE = "▁"
_SPACE = SPACE.encode()
_UNIT = re.compile(rb" +[^ ]*")


def lattice(units: DataFrame, table_: DataFrame, longest: int = 16, unknown: float = -100.0) -> DataFrame:
    """(unit, ids, score): the path of largest total score through each distinct unit.

    units has unit (text, with SPACE for spaces); table_ has piece, id and score. A character that no piece covers is
    an edge of its own, with id -1 and score `unknown`. Of paths of equal score the one with the longer last piece
    stands, so results are the same on every run. Null and empty units are left out; repeats count once; other columns
    are not read. The piece table is broadcast if it has at most 200,000 rows, a vocabulary's usual bound, else joined
    by shuffling.
    """
    words = units.select("unit").where("unit <> ''").distinct()
    spans = words.withColumn("n", F.length("unit")).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spans = spans.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start")))))
    parts = spans.select("unit", "start", "size", F.expr("substring(unit, start + 1, size)").alias("piece"))
    known = table_.select("piece", F.col("id").cast("int").alias("id"), F.col("score").cast("double").alias("score"))
    if known.count() <= 200_000:
        known = F.broadcast(known)
    edges = parts.join(known, "piece", "left").where((F.col("size") == 1) | F.col("id").isNotNull())
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
    grouped = edges.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # best[i]: the best path to place i. Edges come by their end, so every path to an edge's start is settled.
    kind = "array<struct<score:double,ids:array<int>>>"
    none = F.expr("named_struct('score', cast('-Infinity' as double), 'ids', cast(array() as array<int>))")
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.expr("cast(array() as array<int>)").alias("ids"))).cast(kind)

    def step(best, e):
        before = F.get(best, e["start"])
        path = F.struct((before["score"] + e["score"]).alias("score"), F.concat(before["ids"], F.array(e["id"])).alias("ids"))
        last = F.get(best, e["end"])
        grown = F.concat(best, F.array_repeat(none, F.greatest(e["end"] + 1 - F.size(best), F.lit(0))))
        better = last.isNull() | (path["score"] > last["score"])
        return F.when(better, F.concat(F.slice(grown, F.lit(1), e["end"]), F.array(path))).otherwise(best).cast(kind)

    folded = grouped.select("unit", F.aggregate("edges", first, step, lambda best: F.get(best, F.size(best) - 1)).alias("path"))
    return folded.select("unit", F.col("path.ids").alias("ids"), F.col("path.score").alias("score"))


class Pieces:
    """The pieces of a BPE model with byte fallback, read from its file with the library: their lattice, and the bytes
    that they stand for. Made once on the driver; some 400 bytes a piece go to each executor."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        every = [(i, library.id_to_piece(i)) for i in range(library.get_piece_size())]
        byte_ids = [i for i, _ in every if library.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("a model with byte pieces is needed")
        self.byte_id = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.lattice = PieceLattice({i: (p, library.get_score(i)) for i, p in every if not (library.is_unknown(i) or library.is_control(i) or library.is_byte(i) or library.is_unused(i))})
        surface = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else p.replace(SPACE, " ").encode() for i, p in every]
        self.sizes = np.fromiter(map(len, surface), np.int64, len(every))
        self.bytes, self.starts = np.frombuffer(b"".join(surface), np.uint8), np.cumsum(self.sizes) - self.sizes

    def spelt(self, character: str) -> list[int]:
        return [self.byte_id[b] for b in character.encode()]


class Units:
    """Ids of distinct units, kept from run to run of texts. limit bounds the units kept; it changes no result."""

    def __init__(self, known: Pieces, limit: int = 400_000) -> None:
        self.known, self.limit = known, limit
        self.forget()

    def forget(self) -> None:
        self.number, self.ids, self.counts = {}, np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their number for each."""
        if len(self.number) > self.limit:
            self.forget()
        number = self.number
        units = [_UNIT.findall(b" " + t.replace(_SPACE, b" ")) if t else [] for t in texts]  # models take both alike
        new = [*{u for x in units for u in x if u not in number}]
        ids, counts = self.known.lattice.encode([u.decode().replace(" ", SPACE) for u in new], self.known.spelt)
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        at = np.fromiter((number[u] for x in units for u in x), np.int64, int(sizes.sum()))
        many = self.counts[at]
        ends = np.cumsum(many)
        begins = np.cumsum(self.counts) - self.counts
        flat = self.ids[np.repeat(begins[at] - ends + many, many) + np.arange(int(many.sum()))]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return flat, np.diff(upto)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of id sequences, without the space that was put in front."""
        sizes = self.known.sizes[ids]
        upto = np.cumsum(sizes)
        flat = self.known.bytes[np.repeat(self.known.starts[ids] - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)].tobytes()
        at = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a:b][1:] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (if asked for), n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and restored
    (whether decoding the ids gives the text back) of every row of docs (doc_id, text; other columns are not read).
    Null text is empty and has no ids; a "▁" of the text itself is a space to such models and comes back as one. Rows
    are encoded whole and one by one; repeated rows repeat. No rows give no rows. model: the file of a BPE model that
    keeps white space, puts a space in front and has byte pieces."""
    sent = docs.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        units = Units(sent.value)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in pieces([len(t) for t in texts], 1 << 22):
                ids, counts = units.encode(texts[lo:hi])
                at = np.concatenate([[0], np.cumsum(counts)])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                same = [a == b for a, b in zip(units.decode(ids, counts), texts[lo:hi], strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))] if with_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *lists, pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", *["ids"] * with_ids, "n_ids", "ids_crc32", "restored"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, {'ids array<int>, ' * with_ids}n_ids long, ids_crc32 long, restored boolean")


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


QUERIES = {"op8_sentence_pieces": sentence_pieces}
SQL: dict[str, str] = {}
