"""Shard lists and tar shards."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "shard string, key string, ext string, data binary, order int, error string"


def expand(pattern: str) -> list[str]:
    """Braces: number ranges (with leading zeros kept), lists, nested ones. A lone or empty brace stands for itself."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                head, body, tail = pattern[:start], pattern[start + 1 : i], pattern[i + 1 :]
                if m := re.fullmatch(r"(-?\d+)\.\.(-?\d+)", body):
                    a, b = int(m[1]), int(m[2])
                    width = max(len(m[1]), len(m[2])) if m[1].startswith("0") or m[2].startswith("0") else 0
                    options = [str(v).zfill(width) for v in range(a, b + (1 if a <= b else -1), 1 if a <= b else -1)]
                else:
                    options = [x for part in _top_level(body) for x in expand(part)]
                    if len(options) < 2 and "," not in body:
                        options = ["{" + x + "}" for x in options]
                return [head + o + t for o in options for t in expand(tail)]
    return [pattern]


def _top_level(body: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out.append(body[last:i])
            last = i + 1
    return [*out, body[last:]]


def split_name(name: str) -> tuple[str, str]:
    """A member's key (with its folder) and its extensions, from the first point of the file's name on."""
    folder, _, file = name.rpartition("/")
    base, _, ext = file.partition(".")
    return (f"{folder}/{base}" if folder else base), ext


def read_tars(spark: SparkSession, paths: list[str], suffixes: list[str] | None = None) -> DataFrame:
    """Members of the tar shards under paths (braces are expanded)."""
    return tar_members(spark.read.format("binaryFile").load([p for x in paths for p in expand(x)]), suffixes)


def tar_members(files: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Members of tar shards (path, content), one row each, sent on as they are read. A shard that cannot be read gives
    the members before the fault and a row with its error; a null content is such a one. suffixes limits members inside
    the reader, before their bytes are copied."""
    columns, most = ["shard", "key", "ext", "data", "order", "error"], 16 << 20

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, size, error = [], 0, None
                try:
                    with tarfile.open(fileobj=io.BytesIO(content or b""), mode="r:*") as tar:
                        for i, m in enumerate(tar):
                            key, ext = split_name(m.name)
                            if m.isfile() and (not suffixes or ext.lower() in suffixes):
                                rows.append((path, key, ext.lower(), tar.extractfile(m).read(), i, None))
                                size += m.size
                            if size > most:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, size = [], 0
                except (tarfile.TarError, EOFError, OSError) as e:
                    error = str(e)
                if error is not None:
                    rows.append((path, None, None, None, None, error))
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(members, MEMBERS)


def write_samples(samples: DataFrame, path: str) -> None:
    """Joined shards as Parquet, a folder a shard."""
    samples.write.partitionBy("shard").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def packed(pdf: pd.DataFrame, file: io.IOBase) -> int:
    """Writes samples (key, parts) as a tar; the number of its members."""
    n = 0
    with tarfile.open(fileobj=file, mode="w") as tar:
        for key, parts in sorted(zip(pdf["key"], pdf["parts"], strict=True)):
            for ext, data in sorted(dict(parts).items()):
                info = tarfile.TarInfo(f"{key}.{ext}")
                body = data if isinstance(data, bytes | bytearray) else str(data).encode()
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                n += 1
    return n


def tars(samples: DataFrame) -> DataFrame:
    """(path, content): each shard's parts as the bytes of one tar."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        packed(pdf, body := io.BytesIO())
        return pd.DataFrame([(f"{pdf['shard'].iloc[0]}.tar", body.getvalue())], columns=["path", "content"])

    return samples.groupBy("shard").applyInPandas(pack, "path string, content binary")


def write_tars(samples: DataFrame, folder: str) -> DataFrame:
    """(shard, path, members): each shard's parts as one tar under folder. For folders that executors can open."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = str(pdf["shard"].iloc[0])
        with open(path := f"{folder}/{shard}.tar", "wb") as f:
            n = packed(pdf, f)
        return pd.DataFrame([(shard, path, n)], columns=["shard", "path", "members"])

    return samples.groupBy("shard").applyInPandas(pack, "shard string, path string, members long")


def evaluation_source(task: str, root: str, split: str = "test", shards: int = 1) -> list[str]:
    """Paths of an evaluation task's shards."""
    slug = task.replace("/", "-")
    return [f"{root}/wds_{slug}_{split}/{split}/{i}.tar" for i in range(shards)]


def parsed(samples: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column with a typed schema; a row that does not parse has NULL and is told in _corrupt."""
    value = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    x = samples.withColumn("_parsed", value).withColumn("_corrupt", F.col(column).isNotNull() & F.coalesce(F.col("_parsed._bad").isNotNull(), F.lit(True)))
    return x.withColumn(column, F.when(~F.col("_corrupt"), F.col("_parsed").dropFields("_bad"))).drop("_parsed")
