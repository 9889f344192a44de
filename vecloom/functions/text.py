"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pattern of the pre-tokeniser: special tokens, contractions, letters, single digits, other marks.
PRETOKEN = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The preset prompts.
PRESETS = [
    ("Desk items", "A photo of", "", ["pen", "pencil", "paper", "mouse", "keyboard", "computer", "phone", "stapler", "cup"]),
    ("Expressions", "A person", "", ["smiling", "waving", "giving a thumbs up", "sticking out their tongue", "looking angry"]),
    ("Custom", "A photo of", "", []),
]
START_ID, END_ID, CONTEXT = 49406, 49407, 77


def prompt(prefix: Column, name: Column, suffix: Column) -> Column:
    """Both spaces stand even beside an empty prefix or suffix."""
    return F.format_string("%s %s %s", prefix, name, suffix)


def presets(spark) -> DataFrame:
    """The preset prompt sets: title, prefix, suffix, class_names."""
    return spark.createDataFrame(PRESETS, "title string, prefix string, suffix string, class_names array<string>")


def admit(names: DataFrame, name: str, order: str) -> DataFrame:
    """Trimmed, not empty, and the first of equal names (case counts)."""
    x = names.withColumn(name, F.regexp_replace(name, r"^\s+|\s+$", "")).where(F.col(name) != "")
    return x.groupBy(name).agg(F.min(order).alias(order))


def pretokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PRETOKEN), F.lit(0))


def adjacent_pairs(symbols: Column) -> Column:
    """The distinct pairs of neighbours, in order of their first place."""
    n = F.size(symbols)
    pairs = F.zip_with(F.slice(symbols, F.lit(1), n - 1), F.slice(symbols, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def frame(ids: Column, context: int = CONTEXT, start: int = START_ID, end: int = END_ID) -> Column:
    """Start, ids (cut to fit), end, then zeros up to context."""
    cut = F.slice(ids.cast("array<int>"), 1, context - 2)
    body = F.concat(F.array(F.lit(start)), cut, F.array(F.lit(end)))
    return F.concat(body, F.array_repeat(F.lit(0), F.lit(context) - F.size(body)))


def end_place(tokens: Column) -> Column:
    """Where the largest id first stands, from 0."""
    return (F.array_position(tokens, F.array_max(tokens)) - 1).cast("int")


def end_place_by_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x != 0)) - 1


def clean_caption(text: Column) -> Column:
    """Up to the end mark, behind the last start mark, the first sentence, without white space behind it."""
    head = F.get(F.split(text, "<end_of_text>"), F.lit(0))
    return F.rtrim(F.get(F.split(F.element_at(F.split(head, "<start_of_text>"), -1), "[.]"), F.lit(0)))


def add_prefix(key: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), key)


def strip_prefix(key: Column, prefix: str) -> Column:
    """Every occurrence goes."""
    return F.replace(key, F.lit(prefix), F.lit(""))


def task_slug(task: Column) -> Column:
    return F.replace(task, F.lit("/"), F.lit("-"))
