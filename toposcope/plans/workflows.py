"""User-level runs: ``prepare`` a corpus once, then ``sweep`` or ``analyse`` with a model."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import Normalizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.operators import models
from toposcope.operators.coherence import embedding_coherence, umass
from toposcope.operators.embeddings import document_vectors, unknown_words, vector_width, vocabulary_vectors
from toposcope.operators.lemma import lemma_statistics, lemma_text, look_up, removed_tokens, unknown_forms, with_fate
from toposcope.operators.nearest import nearest_centres, nearest_rows
from toposcope.operators.paragraphs import remove_stop_words, segment_documents
from toposcope.operators.split import train_held_out
from toposcope.operators.svd import Decomposition
from toposcope.operators.terms import KEY, MAX_TERMS, count_terms, document_frequency, listed_terms, vocabulary
from toposcope.operators.tfidf import TermVectors
from toposcope.settings import checkpointed, collected, discard_stored, spread, stored

DISTANCES = {"cosine": "cosine", "euclidean": "sqeuclidean"}


@dataclass
class Corpus:
    """A prepared corpus: ``rows`` ``(key, ids, counts, idfs)``, stored, and the vocabulary."""

    rows: DataFrame
    vocab: DataFrame
    vectors: TermVectors
    key: tuple[str, ...] = KEY
    _kept: list[DataFrame] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return self.vectors.terms

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def document_terms(self) -> DataFrame:
        """``(key, term)``: the different vocabulary terms of each document, by id."""
        return self.rows.select(*self.key, F.explode("ids").alias("term"))

    def weighted(self, weighting: str) -> DataFrame:
        """``rows`` with ``weights``."""
        return self.vectors.weights(self.rows, weighting)

    def vector(self, weighting: str, name: str) -> DataFrame:
        """``(key, name)``: sparse vectors, stored because a fit reads them once per iteration."""
        return self.vectors.vectors(self.rows, weighting, name, self.key)

    def sizes(self) -> dict[str, int]:
        return {"documents": self.rows.count(), "terms": len(self.terms), "documents_read": self.vectors.n_docs}

    def keep(self, df: DataFrame) -> DataFrame:
        """Keep a table that several fits read; released by ``close``. Lost blocks are computed again."""
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(kept)
        return kept

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()


def prepare_paragraphs(
    paragraphs: DataFrame,
    stop_words: list[str],
    min_df: int = 2,
    max_terms: int | None = MAX_TERMS,
    min_nonzeros: int = 0,
    case_sensitive: bool = False,
    key: tuple[str, ...] = KEY,
) -> Corpus:
    """Stop words out, terms counted and stored, vocabulary. Only the vocabulary counts are shuffled."""
    words = remove_stop_words(paragraphs.select(*key, "words"), stop_words, case_sensitive)
    counted = stored(count_terms(words))
    n_docs = counted.count()
    vocab = checkpointed(vocabulary(document_frequency(listed_terms(counted, key), min_df), max_terms))
    vectors = TermVectors.of(vocab, n_docs, max_terms)
    rows = stored(vectors.rows(counted, key, min_nonzeros))
    discard_stored(counted)
    return Corpus(rows, vocab, vectors, key)


def prepare(docs: DataFrame, stop_words: list[str], keep_trailing: bool = False, **options) -> Corpus:
    """Corpus of the paragraphs of ``(doc_id, text)`` rows; ``options`` as in ``prepare_paragraphs``."""
    docs = spread(docs.select("doc_id", "text"), "doc_id")
    return prepare_paragraphs(segment_documents(docs, keep_trailing=keep_trailing), stop_words, **options)


def measures_table(spark: SparkSession, model: str, k: int, values: dict[str, float]) -> DataFrame:
    """``(model, k, metric, value)``."""
    rows = [(model, k, name, None if value is None else float(value)) for name, value in values.items()]
    return spark.createDataFrame(rows, "model string, k int, metric string, value double")


def coherence_measures(corpus: Corpus, topics: DataFrame, word_vectors: DataFrame | None, k: int, n: int, eta: float) -> dict:
    """Mean UMass and, with word vectors, mean embedding coherence of a topic table."""
    topics = checkpointed(topics)
    by_id = topics.select("topic", "rank", F.col("term_id").alias("term"))
    sets = corpus.rows.select(*corpus.key, F.col("ids").alias("term"))
    out = {"umass": umass(by_id, sets, corpus.key, eta).agg(F.sum("umass") / k).first()[0]}
    if word_vectors is not None:
        out["word2vec"] = embedding_coherence(topics, word_vectors).agg(F.sum("coherence") / k).first()[0]
    return out


@dataclass
class EmbeddingFit:
    documents: DataFrame
    model: KMeansModel
    centres: np.ndarray


def embed_documents(corpus: Corpus, word_vectors: DataFrame, weighting: str = "tf2idf") -> tuple[DataFrame, DataFrame]:
    """``(key, vec, vector)`` of the documents and ``(term_id, term, vec)`` of the known terms."""
    term_vectors = corpus.keep(vocabulary_vectors(corpus.vocab, word_vectors))
    weights = {"tf2idf": "product", "tfidf": "tfidf"}[weighting]
    width = vector_width(word_vectors)
    vectors = document_vectors(corpus.weighted(weights), term_vectors, len(corpus.terms), corpus.key, width=width)
    return corpus.keep(models.with_vector(vectors, "vec", "vector")), term_vectors


def cluster_embeddings(documents: DataFrame, k: int, scaling: bool = False, **kmeans) -> EmbeddingFit:
    """k-means on document vectors; with ``scaling`` the centres are put back into the unscaled space."""
    if scaling:
        scaled, scaler = models.standardise(documents, "vector", "scaled")
        model = models.fit_kmeans(scaled, k, "scaled", **kmeans)
        return EmbeddingFit(documents, model, models.centre_matrix(model, scaler))
    model = models.fit_kmeans(documents, k, "vector", **kmeans)
    return EmbeddingFit(documents, model, models.centre_matrix(model))


def held_out_tokens(corpus: Corpus, fraction: float, seed: int) -> float:
    """Counted words of the held-out documents."""
    counts = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x)
    return train_held_out(corpus.rows, fraction, corpus.key, seed)[1].agg(F.sum(counts)).first()[0] or 0.0


def sweep_lda(
    corpus: Corpus,
    ks: Iterable[int],
    word_vectors: DataFrame | None = None,
    fit_on: str = "train",
    n: int = 10,
    eta: float = 1.0,
    fraction: float = 0.8,
    seed: int = 1,
    prior: str | None = None,
    kmeans: dict | None = None,
    **lda,
) -> DataFrame:
    """Per k: held-out likelihood and perplexity, k-means cost on the mixtures, both coherences.

    ``fit_on='all'`` fits on every document although a part of them is scored; ``prior='asymmetric'``
    uses falling document concentrations.
    """
    rows = corpus.vector("tf", "tf")
    train, held_out = train_held_out(rows, fraction, corpus.key, seed)
    # The split hashes the key, so the counts fall into the same parts as their vectors.
    tokens = held_out_tokens(corpus, fraction, seed)
    parts = []
    for k in ks:
        if prior == "asymmetric":
            # A fixed prior: the estimate would replace it.
            lda |= {"doc_concentration": models.asymmetric_prior(k), "optimizeDocConcentration": False}
        model = models.fit_lda(train if fit_on == "train" else rows, k, seed=seed, **lda)
        mixed = model.transform(rows).select("topicDistribution").persist(StorageLevel.MEMORY_AND_DISK)
        clusters = models.fit_kmeans(mixed, k, "topicDistribution", prediction="featureTopic", **(kmeans or {}))
        likelihood = model.logLikelihood(held_out)
        values = {
            "logLikelihood": likelihood,
            "logPerplexity": -likelihood / tokens if tokens else float("nan"),  # as Spark's, without a second pass
            "wsse": clusters.summary.trainingCost,
        }
        mixed.unpersist()
        topics = models.lda_topics(model, corpus.terms, n)
        values |= coherence_measures(corpus, topics, word_vectors, k, n, eta)
        parts.append(measures_table(corpus.spark, "lda", k, values))
    return union_all(parts)


def decompose(corpus: Corpus, rank: int = 200) -> Decomposition:
    """Truncated SVD of the documents' idf-weighted term shares."""
    collected(corpus.spark)  # shuffles of the vocabulary, before the solver keeps its rows on disk
    return Decomposition.of(corpus.vectors.vectors(corpus.rows, "relative", "relative", corpus.key), "relative", corpus.terms, rank)


def sweep_lsa(
    corpus: Corpus, ks: Iterable[int], word_vectors: DataFrame | None = None, rank: int = 200, n: int = 10, eta: float = 1.0
) -> tuple[DataFrame, Decomposition]:
    """Per k: both coherences of the first k concepts. One decomposition serves every k."""
    svd = decompose(corpus, rank)
    parts = [
        measures_table(
            corpus.spark, "lsa", k, coherence_measures(corpus, svd.topics(corpus.spark, k, n), word_vectors, k, n, eta)
        )
        for k in ks
    ]
    return union_all(parts), svd


def sweep_embedding(
    corpus: Corpus,
    ks: Iterable[int],
    word_vectors: DataFrame,
    weighting: str = "tf2idf",
    distance: str = "cosine",
    scaling: bool = False,
    n: int = 10,
    eta: float = 1.0,
    **kmeans,
) -> DataFrame:
    """Per k: k-means cost and both coherences of the words nearest to the centres."""
    documents, term_vectors = embed_documents(corpus, word_vectors, weighting)
    parts = []
    for k in ks:
        fit = cluster_embeddings(documents, k, scaling, **kmeans)
        topics = nearest_rows(term_vectors, ("term", "term_id"), "vec", fit.centres, n, DISTANCES[distance])
        values = {"wsse": fit.model.summary.trainingCost}
        values |= coherence_measures(corpus, topics, word_vectors, k, n, eta)
        parts.append(measures_table(corpus.spark, "embedding", k, values))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def sweep(model: str, corpus: Corpus, ks: Iterable[int], **options) -> DataFrame:
    """Measures ``(model, k, metric, value)`` for ``model`` = ``lda``, ``lsa`` or ``embedding``."""
    if model == "lsa":
        return sweep_lsa(corpus, ks, **options)[0]
    return {"lda": sweep_lda, "embedding": sweep_embedding}[model](corpus, ks, **options)


def analyse_lda(corpus: Corpus, k: int, n: int = 10, top: int = 5, **lda) -> dict[str, DataFrame]:
    """Topic words and topic map of one LDA fit."""
    rows = corpus.vector("tf", "tf")
    model = models.fit_lda(rows, k, **lda)
    return {
        "topics": models.lda_topics(model, corpus.terms, n),
        "doc_topics": models.lda_documents(model, rows, corpus.key, top),
    }


def analyse_lda_clusters(
    corpus: Corpus, k: int, lda_k: int = 200, n: int = 10, kmeans: dict | None = None, **lda
) -> dict[str, DataFrame]:
    """Clusters of LDA mixtures, described by the terms with the least divergence from the centres."""
    rows = corpus.vector("tf", "tf")
    model = models.fit_lda(rows, lda_k, **lda)
    mixed = model.transform(rows).select(*corpus.key, "topicDistribution")
    mixed = corpus.keep(mixed)
    clusters = models.fit_kmeans(mixed, k, "topicDistribution", prediction="topic", **(kmeans or {}))
    profiles = models.lda_term_profiles(model, corpus.terms)
    return {
        "topics": models.divergent_terms(profiles, models.centre_matrix(clusters), n),
        "documents": clusters.transform(mixed).select(*corpus.key, "topic"),
    }


LSA_TABLES = ("raw_topics", "topics", "svd_topics", "doc_topics", "concept_documents", "singular_values")


def analyse_lsa(
    corpus: Corpus,
    k: int,
    rank: int = 200,
    n: int = 10,
    top: int = 10,
    ascending: bool = False,
    tables: tuple[str, ...] = LSA_TABLES,
    **kmeans,
) -> dict[str, DataFrame]:
    """Words of raw clusters, of concepts and of concept-space clusters; topic map; singular values.

    ``tables`` selects results, so that no model is fitted for a result that is not wanted.
    """
    spark, key = corpus.spark, corpus.key
    out: dict[str, DataFrame] = {}
    if "raw_topics" in tables:
        clusters = models.fit_kmeans(corpus.vector("ntc", "unit"), k, "unit", **kmeans)
        out["raw_topics"] = models.centre_terms(spark, models.centre_matrix(clusters), corpus.terms, n)
    if set(tables) == {"raw_topics"}:
        return out

    svd = decompose(corpus, rank)
    projected = svd.project(corpus.weighted("relative"), key)
    if {"svd_topics", "doc_topics", "concept_documents"} & set(tables):
        projected = corpus.keep(projected)
    if "svd_topics" in tables:
        points = models.with_vector(projected, "vec", "point")
        points = corpus.keep(Normalizer(inputCol="point", outputCol="unit", p=2.0).transform(points).select("unit"))
        centres = models.centre_matrix(models.fit_kmeans(points, k, "unit", **kmeans))
        out["svd_topics"] = nearest_rows(svd.term_vectors(spark, scaled=True), ("term", "term_id"), "vec", centres, n)
    out |= {
        "topics": svd.topics(spark, k, n),
        "doc_topics": svd.documents(projected, key, top, ascending),
        "concept_documents": svd.concept_documents(projected, key, n),
        "singular_values": svd.values(spark),
    }
    return {name: table for name, table in out.items() if name in tables}


def analyse_embedding(
    corpus: Corpus,
    k: int,
    word_vectors: DataFrame,
    weighting: str = "tf2idf",
    distance: str = "cosine",
    scaling: bool = False,
    n: int = 10,
    top: int = 5,
    **kmeans,
) -> dict[str, DataFrame]:
    """Words nearest to the clusters of document vectors, and the nearest clusters of each document."""
    documents, term_vectors = embed_documents(corpus, word_vectors, weighting)
    fit = cluster_embeddings(documents, k, scaling, **kmeans)
    metric = DISTANCES[distance]
    return {
        "topics": nearest_rows(term_vectors, ("term", "term_id"), "vec", fit.centres, n, metric),
        "doc_topics": nearest_centres(documents, corpus.key, "vec", fit.centres, top, metric),
        "unknown": corpus.vocab.join(term_vectors.select("term_id"), "term_id", "left_anti").select("term"),
    }


def analyse_tfidf_clusters(corpus: Corpus, k: int, n: int = 10, weighting: str = "tf2idf", **kmeans) -> dict[str, DataFrame]:
    """Clusters of length-normalised TF-IDF products, described by the centres' largest components."""
    rows = corpus.vector(weighting, "vector")
    model = models.fit_kmeans(rows, k, "vector", prediction="topic", **kmeans)
    return {
        "topics": models.centre_terms(corpus.spark, models.centre_matrix(model), corpus.terms, n),
        "documents": model.transform(rows).select(*corpus.key, "topic"),
    }


def analyse(model: str, corpus: Corpus, k: int, **options) -> dict[str, DataFrame]:
    """Tables describing k topics: ``lda``, ``lda_clusters``, ``lsa``, ``embedding`` or ``tfidf_clusters``."""
    runs = {
        "lda": analyse_lda,
        "lda_clusters": analyse_lda_clusters,
        "lsa": analyse_lsa,
        "embedding": analyse_embedding,
        "tfidf_clusters": analyse_tfidf_clusters,
    }
    return runs[model](corpus, k, **options)


def lemmatise(tagged_tokens: DataFrame, lexicon: DataFrame) -> dict[str, DataFrame]:
    """Lemma text, removed tokens, statistics and unknown forms of tagged tokens."""
    looked_up = look_up(tagged_tokens, lexicon)
    return {
        "text": lemma_text(looked_up),
        "removed": removed_tokens(with_fate(tagged_tokens)),
        "statistics": lemma_statistics(looked_up),
        "unknown": unknown_forms(looked_up),
    }


def oov_report(words: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words outside a known vocabulary, and their number."""
    found = unknown_words(words, known)
    return found, found.agg(F.count("*").alias("n_unknown"))
