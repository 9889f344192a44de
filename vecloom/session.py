"""Sessions and readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(name: str = "vecloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_in_bytes(df: DataFrame) -> int:
    """About how many bytes df's rows take: eight a number, also in arrays, and the bytes of texts."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            width = width + 8 * F.greatest(F.size(F.col(f.name)), F.lit(0))
        elif isinstance(f.dataType, T.StringType | T.BinaryType):
            width = width + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        else:
            width = width + 8
    return df.agg(F.sum(width)).first()[0] or 0


def range_of(rows: DataFrame, column: str, parts: int) -> Column:
    """Which of about `parts` ranges of a column a row lies in, from 0, in the column's order. The bounds are literals, so
    every job that uses the result deals rows alike. Texts go by their first six bytes; nulls lie in the first range."""
    kind = rows.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.StringType):
        value = F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        value = F.unix_micros(value.cast("timestamp"))
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx(value, shares, 10 * parts)).first()[0] if shares else None
    if not bounds:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, sorted({*bounds}))), F.lit(0), lambda n, b: n + F.when(value > b, 1).otherwise(0))
