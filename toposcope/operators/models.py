"""Topic models on Spark ML, and their results as tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.ml.clustering import LDA, KMeans, KMeansModel, LDAModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.functions.vectors import centre_scores, top_of
from toposcope.operators.nearest import top_rows
from toposcope.operators.terms import KEY
from toposcope.settings import term_table


def fit_lda(
    rows: DataFrame,
    k: int,
    max_iter: int = 500,
    optimizer: str = "online",
    doc_concentration: float | list[float] | None = None,
    topic_concentration: float | None = None,
    seed: int = 1,
    **online: float,
) -> LDAModel:
    """LDA on ``tf``. A list of ``doc_concentration`` values (one per topic) gives an asymmetric prior.

    ``online`` passes on ``learningOffset``, ``learningDecay``, ``subsamplingRate`` and the like.
    """
    lda = LDA(featuresCol="tf", k=k, maxIter=max_iter, optimizer=optimizer, seed=seed, **online)
    if doc_concentration is not None:
        values = doc_concentration if isinstance(doc_concentration, list) else [doc_concentration]
        lda = lda.setDocConcentration(values)
    if topic_concentration is not None:
        lda = lda.setTopicConcentration(topic_concentration)
    return lda.fit(rows)


def asymmetric_prior(k: int) -> list[float]:
    """Falling document concentrations 1/(i + sqrt k), scaled to sum 1."""
    raw = 1.0 / (np.arange(k) + np.sqrt(k))
    return (raw / raw.sum()).tolist()


def lda_topics(model: LDAModel, terms: list[str], n: int = 10) -> DataFrame:
    """``(topic, rank, term_id, term, weight)``: the ``n`` heaviest terms of each topic.

    The k x n rows and the terms are on the driver already, so the names are put in there.
    """
    described = model.describeTopics(n)
    return topic_table(
        described.sparkSession,
        {r["topic"]: zip(r["termIndices"], r["termWeights"], strict=True) for r in described.collect()},
        terms,
    )


def topic_table(spark: SparkSession, topics: dict[int, Iterable[tuple[int, float]]], terms: list[str]) -> DataFrame:
    """``(topic, rank, term_id, term, weight)`` of a few ranked ``(term_id, weight)`` per topic."""
    rows = [
        (int(topic), rank, int(i), terms[i], float(weight))
        for topic, best in topics.items()
        for rank, (i, weight) in enumerate(best, 1)
    ]
    return spark.createDataFrame(rows, "topic int, rank int, term_id int, term string, weight double")


def lda_documents(model: LDAModel, rows: DataFrame, key: tuple[str, ...] = KEY, n: int = 5) -> DataFrame:
    """``(key, rank, topic, weight)``: the ``n`` largest topic shares of each document, ranked in the row."""
    mixed = model.transform(rows)
    return mixed.select(*key, F.inline(top_of(vector_to_array("topicDistribution"), n)))


def lda_term_profiles(model: LDAModel, terms: list[str]) -> DataFrame:
    """``(term_id, term, profile)``: each term's probability in every topic."""
    columns = model.topicsMatrix().toArray()
    columns = columns / columns.sum(axis=0)
    return term_table(SparkSession.active(), terms, columns, "profile")


def fit_kmeans(
    rows: DataFrame, k: int, features: str, max_iter: int = 1000, init_steps: int = 2, seed: int | None = None,
    prediction: str = "cluster",
) -> KMeansModel:
    """k-means with k-means|| initialisation."""
    kmeans = KMeans(
        featuresCol=features, predictionCol=prediction, k=k, maxIter=max_iter, initSteps=init_steps, initMode="k-means||"
    )
    return (kmeans if seed is None else kmeans.setSeed(seed)).fit(rows)


def standardise(rows: DataFrame, vector: str, name: str) -> tuple[DataFrame, StandardScalerModel]:
    """Add ``name``: the vector with mean 0 and deviation 1 per component."""
    scaler = StandardScaler(inputCol=vector, outputCol=name, withMean=True, withStd=True).fit(rows)
    return scaler.transform(rows), scaler


def centre_matrix(model: KMeansModel, scaler: StandardScalerModel | None = None) -> np.ndarray:
    """Centres (k x dim), put back into the unscaled space if they were fitted on scaled vectors."""
    centres = np.array(model.clusterCenters())
    if scaler is None:
        return centres
    return centres * scaler.std.toArray()[None, :] + scaler.mean.toArray()[None, :]


def centre_terms(spark: SparkSession, centres: np.ndarray, terms: list[str], n: int = 10) -> DataFrame:
    """``(topic, rank, term_id, term, weight)``: the ``n`` largest components of each centre."""
    best = {topic: [(i, c[i]) for i in np.argsort(-c, kind="stable")[:n]] for topic, c in enumerate(centres)}
    return topic_table(spark, best, terms)


def divergent_terms(profiles: DataFrame, centres: np.ndarray, n: int = 10) -> DataFrame:
    """``(topic, rank, term_id, term, weight)``: the ``n`` terms with the smallest symmetric divergence."""
    scores = centre_scores(profiles.sparkSession, F.col("profile"), centres, "divergence")
    long = profiles.withColumn("_s", scores).select("term_id", "term", F.posexplode_outer("_s").alias("topic", "weight"))
    return top_rows(long, "topic", [F.asc("weight"), F.asc("term")], n).select(
        "topic", "rank", "term_id", "term", "weight"
    )


def with_vector(rows: DataFrame, array: str, name: str) -> DataFrame:
    """Add ``name``: the dense ML vector of an array column."""
    return rows.withColumn(name, array_to_vector(array))
