"""A corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. Stages
work on all rows of their predecessor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import jaccard, packing, secrets, shared, substring, toxicity

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic. It learns from the labelled rows of this input."""
    model = toxicity.train(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("NOT is_toxic").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies (5-word shingles, similarity 0.8 or more)."""
    groups = jaccard.join_groups(docs, n=5, percent=80)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.select(*COLUMNS).join(first, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 words or more that an earlier one holds; one with nothing left goes."""
    out = substring.remove_repeats(docs, n=13, carry=("lang", "source"), layout=True).where("n_removed = 0 OR n_removed < n_words")
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret that patterns or the randomness battery find."""
    out = secrets.with_spans(docs.select(*COLUMNS))
    text = F.when(F.size("spans") > 0, secrets.masked()).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, mixed by source in the proportions of the corpus."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", without_toxic), ("near_copies", without_near_copies), ("repeats", without_repeats), ("secrets", without_secrets), ("packing", packed)]
#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.written(docs, f"stage-{name}")
    return docs
