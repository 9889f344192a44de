"""Operator 2 (native): line-first cleaning. Lines are judged one by one, failing ones go, and a document that loses too
much of its text is rejected. Every figure comes from the row itself by column functions, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.shared import table

WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
#: Fixed phrases of boilerplate lines.
BOILERPLATE = ["all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript", "click here", "sign up for our newsletter", "powered by", "lorem ipsum", "licensed under", "spdx-license-identifier"]
NAVIGATION = "|»›•·"
SYMBOLS = "#*$%&<>{}[]~^_=\\"


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    body = F.btrim(text, F.lit(WS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS_RUN, -1))


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_passes(line: Column) -> Column:
    """The rules of a line: navigation (three separators or more), symbols (a tenth of it), punctuation (three words or
    more need the end of a sentence somewhere; exclamation and question marks are at most two or two fifths of the
    spaces), boilerplate phrases."""
    spaces = count_of(line, " ")
    shouts = count_of(line, "!?")
    navigation = count_of(line, NAVIGATION) >= 3
    symbols = count_of(line, SYMBOLS) * 10 > F.length(line)
    unended = (spaces >= 2) & (count_of(line, ".!?…。！？") == 0)
    shouted = (shouts >= 3) & (shouts * 5 > spaces * 2)
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    return ~(navigation | symbols | unended | shouted | boilerplate)


def judge(docs: DataFrame, text: str = "text", least_words: int = 10, most_repeated: int = 20, least_kept: int = 50) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept (boolean),
    n_lines, n_lines_kept, chars, chars_kept (long) and cleaned (the lines that pass, joined by \\n).

    kept is false if base_failed (fewer than least_words words, or more than most_repeated percent of them in repeated
    5-word windows), else whether the passing lines hold at least least_kept percent of the characters of all lines
    with a word. Null text counts as empty: no words, not kept. Ties and repeated rows are judged alike, each by
    itself. Columns of docs named like a result are replaced; others stay. 5-word windows are compared by 64-bit hash.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept", "chars", "chars_kept", "cleaned"]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c not in new]
    x = docs.select(*rest, body.alias("_text"))
    x = x.withColumn("_hashes", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)))
    x = x.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: F.btrim(line, F.lit(WS)) != ""))
    x = x.withColumn("n_words", F.size("_hashes").cast("long")).withColumn("_good", F.filter("_lines", line_passes))
    at = F.sequence(F.lit(0), F.size("_hashes") - 5)
    windows = F.transform(at, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(5))))
    x = x.withColumn("_windows", F.when(F.size("_hashes") >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    x = x.withColumn("_sorted", F.when(repeats, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda s, i: F.get("_sorted", i)["h"].eqNullSafe(s["h"])
    twice = F.filter("_sorted", lambda s, i: same(s, i - 1) | same(s, i + 1))
    places = F.array_sort(F.transform(twice, lambda s: s["i"]))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(5), p - s["last"])).alias("n")), lambda s: s["n"])
    size_of = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    x = x.select(
        *(F.col(c) for c in rest),
        "n_words",
        F.length(F.translate("_text", WS, "")).cast("long").alias("word_chars"),
        count_of(F.col("_text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_sorted") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_good").cast("long").alias("n_lines_kept"),
        size_of(F.col("_lines")).alias("chars"),
        size_of(F.col("_good")).alias("chars_kept"),
        F.array_join("_good", "\n").alias("cleaned"),
    )
    x = x.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    return x.withColumn("kept", ~F.col("base_failed") & (100 * F.col("chars_kept") >= least_kept * F.col("chars")))


def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept")


def _count(characters: str) -> str:
    return f"(length(l) - length(translate(l, '{characters}', '')))"


_SPACES, _SHOUTS = _count(" "), _count("!?")
_PASSES = f"""NOT ({_count(NAVIGATION)} >= 3 OR {_count(SYMBOLS)} * 10 > length(l)
  OR ({_SPACES} >= 2 AND {_count(".!?…。！？")} = 0) OR ({_SHOUTS} >= 3 AND {_SHOUTS} * 5 > {_SPACES} * 2)
  OR regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))"""
QUERIES = {"op2_quality_lines": quality_lines}
SQL = {
    "op2_quality_lines": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, gram HAVING count(*) > 1), (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, text, words, lines, list_filter(lines, lambda l: {_PASSES}) AS good FROM w),
a AS (SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(good) AS n_lines_kept,
  coalesce(length(array_to_string(lines, '')), 0) AS chars, coalesce(length(array_to_string(good, '')), 0) AS chars_kept
  FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * chars_kept >= 50 * chars AS kept, n_lines, n_lines_kept FROM a"""
}
