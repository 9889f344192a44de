"""Model and transform configurations, and result files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key string, dataset string, metrics map<string,double>"
#: Which metric stands for a task, where it is not acc1: fixed values, by key or by the start of a key.
MAIN_METRIC = {
    "vtab/caltech101": "mean_per_class_recall",
    "fgvc_aircraft": "mean_per_class_recall",
    "vtab/flowers": "mean_per_class_recall",
    "vtab/pets": "mean_per_class_recall",
    "misc/winogavil": "jaccard_score_10-12",
    "wilds/iwildcam": "F1-macro_all",
    "wilds/fmow": "acc_worst_region",
    "fairness/dollar_street": "acc_top5_wg",
    "fairness/geode": "acc_wg",
    "fairness/fairface": None,
    "fairness/utkface": None,
}
MAIN_METRIC_OF = {"retrieval/": "mean_recall@1", "longclip/": "mean_recall@1", "comp/sugarcrepe": "acc"}
NOT_CORE = ["comp/", "longclip/"]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(model, key, dataset, metrics): one JSON record a line; the file's name is the model's."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.jsonl$", 1)
    return parsed_results(spark.read.text(path).select(name.alias("model"), "value"))


def parsed_results(lines: DataFrame) -> DataFrame:
    """(model, key, dataset, metrics) of JSON records (model, value), "NaN" being a number; others are left out."""
    record = F.from_json("value", RECORD, {"allowNonNumericNumbers": "true"})
    return lines.select("model", record.alias("r")).select("model", "r.*").where("key IS NOT NULL")


def main_metrics(records: DataFrame) -> DataFrame:
    """The records with main_metric, by the rule of their key."""
    metric = F.lit("acc1")
    for start, name in MAIN_METRIC_OF.items():
        metric = F.when(F.col("key").startswith(start), F.lit(name)).otherwise(metric)
    for key, name in MAIN_METRIC.items():
        metric = F.when(F.col("key") == key, F.lit(name)).otherwise(metric)
    value = F.try_element_at("metrics", metric)
    return records.withColumn("main_metric", F.when(~F.isnan(value), value))


def leaderboard(records: DataFrame) -> DataFrame:
    """(model, average): the unweighted mean over core tasks in percent, rounded once."""
    core = main_metrics(records)
    for start in NOT_CORE:
        core = core.where(~F.col("key").startswith(start))
    return core.groupBy("model").agg(F.round(100 * F.avg("main_metric"), 1).alias("average"), F.count("main_metric").alias("tasks"))


def group_metrics(records: DataFrame) -> DataFrame:
    """(model, key, grouping, group, acc, count) of metrics "acc_<grouping>:<i>" and "count_<grouping>:<i>"."""
    x = records.select("model", "key", F.explode("metrics").alias("metric", "value"))
    name = lambda i: F.regexp_extract("metric", r"^(acc|count)_([^:]+):(\d+)$", i)
    x = x.select("model", "key", name(1).alias("what"), name(2).alias("grouping"), name(3).alias("group"), "value").where("what <> ''")
    pick = lambda w: F.max(F.when(F.col("what") == w, F.col("value")))
    return x.groupBy("model", "key", "grouping", F.col("group").cast("int").alias("group")).agg(pick("acc").alias("acc"), pick("count").alias("count"))


def worst_groups(records: DataFrame) -> DataFrame:
    """(model, key, grouping, worst, average): over groups that are not empty."""
    full = group_metrics(records).where("count > 0 AND NOT isnan(acc)")
    return full.groupBy("model", "key", "grouping").agg(F.min("acc").alias("worst"), (F.sum(F.col("acc") * F.col("count")) / F.sum("count")).alias("average"))


def load_config(folder: str, name: str) -> dict:
    path = Path(folder) / f"{name}.json"
    if not path.exists():
        known = sorted(p.stem for p in Path(folder).glob("*.json"))
        raise ValueError(f"unknown configuration {name!r}; known: {', '.join(known)}")
    return json.loads(path.read_text())


def as_metrics(row: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row table of numbers."""
    return row.select(F.explode(F.create_map(*(x for c in row.columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", "value"))
