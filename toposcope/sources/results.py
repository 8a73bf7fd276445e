"""Readers of the result tables written by ``toposcope.sinks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toposcope.operators.report import long_topic_map, long_topic_words

MEASURES = {
    "lda": ["logLikelihood", "logPerplexity", "wsse", "word2vec", "umass"],
    "lsa": ["word2vec", "umass"],
    "embedding": ["wsse", "word2vec", "umass"],
}


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_measures(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Measures of a sweep in long form ``(model, k, metric, value)``."""
    names = MEASURES[model]
    wide = _tsv(spark, path, "topic int, " + ", ".join(f"{n} double" for n in names))
    return wide.unpivot("topic", names, "metric", "value").selectExpr(
        f"'{model}' AS model", "topic AS k", "metric", "value"
    )


def read_topic_map(spark: SparkSession, path: str, n: int, key_type: str = "string") -> DataFrame:
    """``(id, rank, topic, weight)`` from the wide table with ``n`` ranks."""
    columns = ", ".join(f"topic_index_{i} int, topic_weight_{i} double" for i in range(1, n + 1))
    return long_topic_map(_tsv(spark, path, f"id {key_type}, {columns}"), n)


def read_topic_words(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``(topic, rank, term, weight)`` from the wide table with ``n`` ranks."""
    columns = ", ".join(f"term_name_{i} string, term_weight_{i} double" for i in range(1, n + 1))
    return long_topic_words(_tsv(spark, path, f"topic_id int, {columns}"), n)


def read_document_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "word string, freq long")


def read_singular_values(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "concept int, eigenvalue double")
