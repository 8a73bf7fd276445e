"""Stop words, known words and word vectors."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "[\t,]"


def default_stop_words(spark: SparkSession, language: str = "french") -> DataFrame:
    """Spark's own stop list of a language as ``(word)``."""
    words = StopWordsRemover.loadDefaultStopWords(language)
    return spark.createDataFrame([(w,) for w in words], "word string")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, trailing white space removed, empty lines left out."""
    return (
        spark.read.text(path)
        .select(F.rtrim(F.regexp_replace("value", "[\r\n]+$", "")).alias("word"))
        .where("word <> ''")
    )


def stop_words(spark: SparkSession, language: str | None = "french", *paths: str) -> DataFrame:
    """A language's stop list together with the words of further files, each word once."""
    parts = [default_stop_words(spark, language)] if language else []
    parts += [read_word_list(spark, p) for p in paths]
    if not parts:
        raise ValueError("name a language or at least one file")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.distinct()


def read_known_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a vector file (first tab-separated field), each once."""
    return spark.read.text(path).select(F.split("value", "\t")[0].alias("word")).distinct()


def parse_word_vectors(lines: DataFrame) -> DataFrame:
    """``(word, vec array<double>)`` from text lines ``word TAB v1,v2,...`` in column ``value``.

    Of several lines for a word the greatest vector (compared number by number) is kept, whatever
    order the files are read in.
    """
    parts = F.split("value", FIELD)
    numbers = F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<double>")
    return lines.select(parts[0].alias("word"), numbers.alias("vec")).groupBy("word").agg(F.max("vec").alias("vec"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors of a text file, one per word."""
    return parse_word_vectors(spark.read.text(path))
