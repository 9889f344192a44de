"""Operator 10: token ids in Parquet list columns, for whole reads and for selective ones."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.shared import shared_dir, table
from vecloom.llm.wordbpe import WordBpe
from vecloom.llm.wordkit import pieces

#: The file format. Ids are dictionary-coded (a dictionary of at most 49,408 ids, so 16 bits an id before compression);
#: lengths and starts rise slowly and are delta-coded; pages are small and indexed, so a reader of a few documents or
#: of the metadata columns touches few pages.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#doc_id": "false",
}
#: Bytes of stored input that one range takes.
RANGE = 128 << 20
_ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def list_of(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def ranges(rows: DataFrame) -> int:
    """The session's number of shuffle partitions, or more for inputs that the planner knows to be large."""
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-known // RANGE)) if known < 1 << 60 else least  # beyond that the planner does not know it


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Writes the ids of every row of docs (doc_id, text; other columns are not read) under path, in ascending doc_id.

    Rows are dealt by ranges of doc_id and then of the text's hash, so the order needs no single task and many rows of
    one doc_id none either. There are `partitions` ranges; by default the session's number, or more where the input's
    estimated size needs them (RANGE bytes each). Null text is empty and has the end id alone; rows with equal doc_id
    stand together, ordered by their texts' hashes; a null doc_id sorts first. An empty input writes an empty table.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, bpe = TaskContext.get().partitionId(), 0, WordBpe(tokenizer, end_id)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in pieces([len(t) for t in texts], 1 << 21):
                ids, counts = bpe.encode(texts[lo:hi])
                upto = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.full(hi - lo, part, np.int32)), pa.array(start + upto - counts), pa.array(counts), list_of(ids, counts)], names=_ROWS.fieldNames())
                start += int(upto[-1])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = picked.repartitionByRange(partitions or ranges(picked), *order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(encode, _ROWS).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens wrote, with start, the number of ids of all documents before a row's. Column pruning and
    filters on doc_id reach the files; the starts of parts come from the metadata columns alone."""
    rows = spark.read.schema(_ROWS).parquet(path)
    per_part = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row per written part: this small table is all that the unpartitioned order sees.
    before = per_part.selectExpr("part AS of_part", "sum(size) OVER (ORDER BY part) - size AS before")
    return rows.join(F.broadcast(before), F.col("part") == F.col("of_part")).select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def crc32_of(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) with ids_crc32 in place of ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return ids.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return crc32_of(read_tokens(spark, path))


QUERIES = {"op10_token_file": token_file}
SQL: dict[str, str] = {}
