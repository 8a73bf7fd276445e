"""A corpus pipeline over ``documents``: quality, near duplicates, benchmark leaks, secrets, pieces.

Each stage takes all rows that the one before kept, with the columns of ``documents``; the last one gives
the sampled pieces of each text that is left. ``run`` writes and rereads every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toposcope.llm import decontaminate, jaccard, pieces, quality, queries, secrets
from toposcope.settings import stored

ORACLE_SQL = None  # no SQL for the sampled pieces or the forest; tests compare each stage with plain code


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the current policy. Null and empty texts fail; repeated ids are judged by their own text."""
    return quality.keep(docs, quality.CURRENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group: 5-word shingles, Jaccard similarity of 0.8 or more.

    Rows with a null id stay. Rows that repeat an id and its text leave one row; so do those of one id whose texts
    are alike. Unlike texts of one id are judged each for itself.
    """
    return jaccard.first_of_groups(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark item in them, verbatim or re-parameterised."""
    return decontaminate.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; every document stays."""
    return secrets.redact(docs, secrets.find_secrets(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each text."""
    return pieces.encode(docs, queries.PIECE_MODEL)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
