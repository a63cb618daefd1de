"""The corpus pipeline: five operators in turn, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds the ids
of its texts. Nulls in any column, empty tables and repeated rows have the results that the
operators define. Rows with a null id are scored, mixed and encoded like others and are never
near-duplicates of anything; rows that share an id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, line_dedup, minhash, mixing, quality_classifier
from loomline.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"
#: SQL can express neither a fitted model nor merges by rank; tests hold the stages against brute force.
ORACLE_SQL = None


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from labels outside the held-out fold."""
    ranking = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs.select(*COLUMNS), ranking).where("predicted = 1").select(*COLUMNS)


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay at their first occurrence only.

    A document that loses all its text so holds nothing of its own and goes; texts that were blank
    before stay. ``n_chars`` follows the text.
    """
    kept = line_dedup.dedup(docs.select(*COLUMNS), min_docs=10, min_chars=1, keep="first")
    emptied = (F.col("_n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~emptied).withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates_dropped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: partitions, and rows in them, follow the slots."""
    return mixing.in_order(mixing.mix(docs.select(*COLUMNS), F.length("text"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its text, checked by decoding them again."""
    tokenizer = public_tokenizers.path(TOKENIZER)
    coded = bpe.round_trip(docs.select(*COLUMNS), tokenizer)
    return coded.select("*", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")).drop("decoded")


STAGES = [
    ("quality classifier", classified),
    ("line dedup", lines_deduplicated),
    ("minhash near-dedup", near_duplicates_dropped),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, f"stage-{at}")
    return docs
