"""A training corpus from documents: quality, lines, near-duplicates, substrings, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last give rows with
the columns of ``documents``; further columns, of any name, pass through them.

Nulls, empty and very long texts, ties, repeated rows and empty tables are treated as the operators say: rows with a null
text or a null doc_id stay (without words there is nothing to repeat; the quality stage grades them as empty texts), rows that
share a doc_id are rows of one document, of equal documents the smallest doc_id stays, and each stage of an empty
table is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm import packing, quality, toxicity
from tidecue.llm._store import materialize
from tidecue.llm.line_dedup import drop_repeated_lines
from tidecue.llm.near_dedup import drop_near_duplicates
from tidecue.llm.substring_dedup import drop_repeated_substrings


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rated good with probability one half at least (operator 4), by the labels' training fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return quality.keep_documents(docs, quality.fit(spark, docs, quality.ratings(labels), grades=3))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat one of an earlier place, exactly (lines of any length) or nearly (operator 8).
    Documents more than half of whose words repeat are copies as a whole, and go to the next stage as they are: without
    most of their lines it could not tell."""
    return _recounted(drop_repeated_lines(spark, docs, min_words=1, most=0.5))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 (operator 6)."""
    return drop_near_duplicates(spark, docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that start in a document with a smaller doc_id (operator 10)."""
    return _recounted(drop_repeated_substrings(spark, docs))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the token-budget batches of optimal length buckets (operator 7)."""
    return packing.pack(spark, docs, packing.word_count("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("lines", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("substrings", distinct_passages),
    ("packing", batches),
]

#: SQL can't express the fitted classifier, groups of lines within an edit bound or the bucket programme.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
