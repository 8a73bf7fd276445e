"""Report tables: wide and long topic maps, merged topics, shares, counts, histograms, best k.

A topic map holds at most one row per document and topic, so groups by document are bounded by the
number of topics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.settings import small

UNKNOWN = -1

# Fixed values: (merged topic, label) of raw topics 0, 1, 2, ...; -1 is "no topic".
TOPIC_LABELS = [
    (0, "Liens familiaux"),
    (-1, "Unknown"),
    (1, "Divin"),
    (2, "Pouvoir"),
    (3, "Victoire"),
    (-1, "Unknown"),
    (-1, "Unknown"),
    (4, "Bonheur"),
    (5, "Malheur"),
    (6, "Jugement"),
    (-1, "Unknown"),
    (5, "Malheur"),
    (7, "Trahison"),
    (-1, "Inconnu"),
    (-1, "Inconnu"),
    (8, "Vengeance"),
    (-1, "Unknown"),
]


def topic_labels(spark: SparkSession, labels: list[tuple[int, str]] = TOPIC_LABELS) -> DataFrame:
    """``(raw_topic, topic, label)``; the raw topic is the position in the list."""
    rows = [(i, topic, label) for i, (topic, label) in enumerate(labels)]
    return spark.createDataFrame(rows, "raw_topic int, topic int, label string")


def wide_topic_map(doc_topics: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """``id, topic_index_1, topic_weight_1, ...`` from ``(key, rank, topic, weight)``."""
    columns = [
        F.max(F.when(F.col("rank") == i, F.col(source))).alias(f"topic_{name}_{i}")
        for i in range(1, n + 1)
        for source, name in (("topic", "index"), ("weight", "weight"))
    ]
    return doc_topics.groupBy(F.col(key).alias("id")).agg(*columns)


def wide_topic_words(topics: DataFrame, n: int) -> DataFrame:
    """``topic_id, term_name_1, term_weight_1, ...`` from ``(topic, rank, term, weight)``."""
    columns = [
        F.max(F.when(F.col("rank") == i, F.col(source))).alias(f"term_{name}_{i}")
        for i in range(1, n + 1)
        for source, name in (("term", "name"), ("weight", "weight"))
    ]
    return topics.groupBy(F.col("topic").alias("topic_id")).agg(*columns)


def _long(wide: DataFrame, n: int, key: str, first: str, second: str, names: tuple[str, str]) -> DataFrame:
    ranks = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.col(f"{first}_{i}").alias(names[0]), F.col(f"{second}_{i}").alias(names[1])
            )
            for i in range(1, n + 1)
        ]
    )
    return wide.select(key, F.inline(ranks)).where(F.col(names[0]).isNotNull())


def long_topic_map(wide: DataFrame, n: int) -> DataFrame:
    """``(id, rank, topic, weight)`` of a wide topic map."""
    return _long(wide, n, "id", "topic_index", "topic_weight", ("topic", "weight"))


def long_topic_words(wide: DataFrame, n: int) -> DataFrame:
    """``(topic, rank, term, weight)`` of a wide topic word table."""
    long = _long(wide, n, "topic_id", "term_name", "term_weight", ("term", "weight"))
    return long.withColumnRenamed("topic_id", "topic")


def merge_topics(doc_topics: DataFrame, labels: DataFrame, key: str = "doc_id", n: int = 2) -> DataFrame:
    """First ``n`` different merged topics per document, at their best rank.

    ``(key, rank, topic, label, weight, top_weight)``: ``rank`` is the raw rank of the first
    occurrence, ``top_weight`` the weight of the document's first raw topic. Topics without a label
    count as the unknown topic.
    """
    best = Window.partitionBy(key).orderBy("rank")
    top = doc_topics.withColumnRenamed("topic", "raw_topic").withColumn("top_weight", F.first("weight").over(best))
    relabelled = top.join(small(labels), "raw_topic", "left").withColumn("topic", F.coalesce("topic", F.lit(UNKNOWN)))
    first = F.struct("rank", "label", "weight", "top_weight")
    return (
        relabelled.groupBy(key, "topic")
        .agg(F.min_by(first, "rank").alias("first"))
        .select(key, "topic", "first.*")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= n)
        .drop("place")
    )


def topic_shares(merged: DataFrame, key: str = "doc_id", width: int = 40) -> DataFrame:
    """Add ``share``: whole part of ``width * top_weight * weight / sum(weight)``; no row if the sum is 0."""
    total = F.sum("weight").over(Window.partitionBy(key))
    share = (F.lit(width) * F.col("top_weight")) * (F.col("weight") / F.col("total"))
    return (
        merged.withColumn("total", total)
        .where(F.col("total") != 0)
        .withColumn("share", share.cast("int"))
        .drop("total")
    )


def topic_positions(shares: DataFrame, key: str = "doc_id", unknown: int = 10) -> DataFrame:
    """Start and end of each topic's bar, topics in ascending order; the unknown topic gets its own code."""
    to_here = Window.partitionBy(key).orderBy("topic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum("share").over(to_here)
    return shares.select(
        key,
        F.when(F.col("topic") == UNKNOWN, unknown).otherwise(F.col("topic")).alias("topic"),
        "label",
        (stop - F.col("share")).alias("start"),
        stop.alias("stop"),
    )


def topic_counts(doc_topics: DataFrame, key: str = "doc_id", ranks: int = 4, fraction: float = 0.1) -> DataFrame:
    """Documents per topic, over each document's leading ranks with a weight of at least ``fraction`` of the first."""
    by_rank = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passes = F.col("weight") >= F.first("weight").over(by_rank) * fraction
    return (
        doc_topics.where(F.col("rank") <= ranks)
        .withColumn("passes", passes)
        .withColumn("passes", F.min("passes").over(by_rank))
        .where("passes")
        .groupBy("topic")
        .agg(F.count("*").alias("n_docs"))
    )


def frequency_histogram(doc_freq: DataFrame, low: float = 0, high: float = 25, bins: int = 20) -> DataFrame:
    """Terms per bin of document frequency; the last bin is closed, values outside are left out."""
    bin_no = F.least(F.floor((F.col("df") - low) * bins / (high - low)) + 1, F.lit(bins))
    return (
        doc_freq.where(F.col("df").between(low, high))
        .groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count("*").alias("n_terms"))
        .withColumn("low", F.lit(low) + (F.col("bin") - 1) * ((high - low) / bins))
    )


def topic_captions(topics: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """``(topic, caption)``: label and first ``n`` terms of each merged topic's first raw topic."""
    first = Window.partitionBy("topic").orderBy("raw_topic")
    named = (
        labels.where(F.col("topic") != UNKNOWN)
        .withColumn("_place", F.row_number().over(first))
        .where("_place = 1")
        .drop("_place")
    )
    words = (
        topics.where(F.col("rank") <= n)
        .groupBy(F.col("topic").alias("raw_topic"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("words"))
    )
    return words.join(small(named), "raw_topic").select(
        "topic", F.concat_ws(" ", F.format_string("[%s]", F.col("label")), F.col("words.term")).alias("caption")
    )


def singular_value_curve(values: DataFrame) -> DataFrame:
    """``(concept, sigma, cumulative)``: share of the squared values kept up to each concept (one row per concept)."""
    squares = F.col("sigma") * F.col("sigma")
    to_here = Window.orderBy("concept").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return values.select(
        "concept", "sigma", (F.sum(squares).over(to_here) / F.sum(squares).over(Window.partitionBy())).alias("cumulative")
    )


def best_k(measures: DataFrame, lowest: tuple[str, ...] = ("logPerplexity", "wsse")) -> DataFrame:
    """``(model, metric, k, value)``: best number of topics per metric; ties go to the smaller k."""
    score = F.when(F.col("metric").isin(*lowest), -F.col("value")).otherwise(F.col("value"))
    order = F.struct(score, -F.col("k"))
    return measures.where("value IS NOT NULL").groupBy("model", "metric").agg(
        F.max_by("k", order).alias("k"), F.max_by("value", order).alias("value")
    )


def wide_measures(measures: DataFrame, names: list[str]) -> DataFrame:
    """``topic`` (the k) and one column per metric."""
    return measures.groupBy(F.col("k").alias("topic")).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]
    )
