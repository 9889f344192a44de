"""Tables that several jobs share, in the folder that the cluster names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.wordkit import pieces


def lean() -> None:
    """For the start of a function on executors: Python workers live on between tasks, so what an earlier task freed is
    given back to the system now."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another system's allocator
    pa.default_memory_pool().release_unused()


def shares(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in runs of about `limit` bytes of a text column, so that what is worked out for a run stays
    small however many rows a batch has. A longer text is a run of its own, whole."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        for lo, hi in pieces(sizes, limit):
            yield b.slice(lo, hi - lo)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a folder of our own only where that is unset, which one
    machine alone can share. remove() deletes what an application left there."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/vecloom-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not (own := spark.conf.get("spark.vecloom.sharedDir", None)):
        own = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.vecloom.sharedDir", own)
    return own


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: this cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote. Results that still read them fail from then on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
