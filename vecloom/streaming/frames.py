"""Live frames (P1-P10): keep the newest, take every nth, score, moving averages, rates.

Each operator has a batch form over a table; the streaming form gives the same rows over micro-batches. Event times must
be of type TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vecloom.operators.ranking import class_scores
from vecloom.session import range_of


def newest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; map-side aggregation, so a key may hold any share of the rows."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def every(rows: DataFrame, by: list[str], order: list[str], skip: int) -> DataFrame:
    """One row, then `skip` left out, and so on. Rows are numbered by counts per key and range of the order, so no task
    sorts all rows of a key."""
    x = _cut(rows, by, order)
    counts = x.groupBy(*by, "_p").agg(F.count("*").alias("_c"))  # at most one row a range for each key
    before = counts.withColumn("_b", F.sum("_c").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_c")).drop("_c")
    x = x.join(before, [*by, "_p"])
    return x.where((F.col("_b") + F.col("_n") - 1) % (skip + 1) == 0).select(*rows.columns)


def _cut(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with _p, the range of the order that they lie in, and _n, their number there from 1 for each key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.withColumn("_p", range_of(rows, order[0], parts))
    return x.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)))


def plausible(seconds: Column, most_ms: float = 500.0) -> Column:
    return seconds * 1000 < most_ms


def smooth(values: Column, window: int = 10) -> Column:
    """The last moving average of an ordered array: it starts with the first value; then a - a / n + x / n."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, 0).cast("double"), lambda a, x: a - a / window + x / window))


def moving_average(rows: DataFrame, by: str, value: str, order: list[str], window: int = 10) -> DataFrame:
    """(by, average, n) of each key, as smooth() gives it. A value that m others follow weighs (1 - 1 / window) ** m /
    window, the first one of all without the last division; so ranges of the order are summed by themselves, and a
    key's ranges, of which there are few, are folded."""
    keep = 1 - 1 / window
    x = _cut(rows.select(by, *order, F.col(value).cast("double").alias("_v")), [by], order)
    last = F.max("_n").over(Window.partitionBy(by, "_p"))
    x = x.withColumn("_w", F.col("_v") * F.pow(F.lit(keep), last - F.col("_n")))
    parts = x.groupBy(by, "_p").agg(F.count("*").alias("n"), F.sum("_w").alias("sum"), F.max(F.when(F.col("_n") == 1, F.col("_w"))).alias("first"))
    folded = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_p", "n", "sum", "first"))).alias("parts"), F.sum("n").alias("n"))
    own = lambda p: p["sum"] / window
    start = F.get("parts", 0)
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    average = F.aggregate(rest, own(start) + start["first"] * keep, lambda a, p: a * F.pow(F.lit(keep), p["n"]) + own(p))
    return folded.select(by, average.alias("average"), "n")


def moving_average_stream(rows: DataFrame, by: str, value: str, order: list[str], window: int = 10) -> DataFrame:
    """The streaming form, in update mode: a micro-batch is taken in order, and the average is the key's state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (None, 0)
        for x in pd.concat(list(batches)).sort_values(order)[value].astype(float):
            average = x if average is None else average - average / window + x / window
            n += 1
        state.update((average, n))
        yield pd.DataFrame({by: [key[0]], "average": [average], "n": [n]})

    kind = dict(rows.dtypes)[by]
    return rows.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, average double, n long", "average double, n long", "update", GroupStateTimeout.NoTimeout)


def every_stream(rows: DataFrame, by: str, order: list[str], skip: int) -> DataFrame:
    """The streaming form of every(): the state counts a key's rows."""
    names = rows.columns

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        x = pd.concat(list(batches)).sort_values(order)
        state.update((seen + len(x),))
        yield x[[(seen + i) % (skip + 1) == 0 for i in range(len(x))]][names]

    return rows.groupBy(by).applyInPandasWithState(take, rows.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def scored(frames: DataFrame, classes: DataFrame, keep: list[str]) -> DataFrame:
    """Cosine of each frame and each class; no classes give no rows."""
    return class_scores(frames, classes, keep)


def live(frames: DataFrame, sinks: list[Callable[[DataFrame, int], None]], by: list[str], order: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch, reduced to the newest frame of each key, goes to all sinks; a sink reads its static side (such
    as prompts) anew each time. stop() on the query ends them all."""

    def deliver(batch: DataFrame, number: int) -> None:
        kept = newest(batch, by, order).persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    return frames.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def frame_source(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Frames from files as they arrive; rows without a time or value are dropped, and local times become TIMESTAMP."""
    x = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return x.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL AND value IS NOT NULL")
