"""Writers of result tables (tab-separated, with header). Intermediate data belongs in parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.operators.embeddings import embedding_lines
from toposcope.operators.lemma import lemma_text, removed_tokens
from toposcope.operators.report import wide_measures, wide_topic_map, wide_topic_words
from toposcope.sources.results import MEASURES


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False, **options: str) -> None:
    """``one_file`` is for tables bounded by a parameter (topics, values of k, singular values)."""
    out = df.coalesce(1) if one_file else df
    out.write.mode(mode).options(sep="\t", header="true", **options).csv(path)


def save_topic_map(doc_topics: DataFrame, path: str, n: int, key: str = "doc_id") -> None:
    """``id``, then topic and weight per rank. ``doc_topics`` has one key column (see ``single_key``)."""
    write_tsv(wide_topic_map(doc_topics, n, key), path)


def single_key(df: DataFrame, key: tuple[str, ...], name: str = "doc_id", sep: str = ":") -> DataFrame:
    """Join the parts of a document key into one text column."""
    rest = [c for c in df.columns if c not in key]
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in key]).alias(name), *rest)


def save_topic_words(topics: DataFrame, path: str, n: int = 10) -> None:
    write_tsv(wide_topic_words(topics, n).orderBy("topic_id"), path, one_file=True, quoteAll="true")


def save_measures(measures: DataFrame, path: str, model: str) -> None:
    """One row per k of one model."""
    wide = wide_measures(measures.where(F.col("model") == model), MEASURES[model])
    write_tsv(wide.orderBy("topic"), path, one_file=True)


def save_document_frequencies(doc_freq: DataFrame, path: str) -> None:
    write_tsv(doc_freq.select(F.col("term").alias("word"), F.col("df").alias("freq")), path)


def save_singular_values(values: DataFrame, path: str) -> None:
    write_tsv(values.select("concept", F.col("sigma").alias("eigenvalue")).orderBy("concept"), path, one_file=True)


def save_word_vectors(word_vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    embedding_lines(word_vectors).write.mode(mode).text(path)


def save_removed_tokens(looked_up: DataFrame, path: str, mode: str = "overwrite") -> None:
    removed_tokens(looked_up).write.mode(mode).csv(path, header=True)


def save_lemma_text(looked_up: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text lines in document, line and sentence order (sorted by range, not in one task)."""
    text = lemma_text(looked_up).orderBy("doc_id", "line_no", "sentence_no")
    text.select("text").write.mode(mode).text(path)
