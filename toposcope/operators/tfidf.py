"""TF-IDF weightings, as long tables and as vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toposcope.functions.text import let
from toposcope.functions.vectors import known_entries, norm, sparse_entries
from toposcope.functions.weights import idf, relative_tfidf, tf2idf
from toposcope.operators.terms import KEY, MAX_TERMS
from toposcope.settings import computed_once, stored


def inverse_document_frequency(doc_freq: DataFrame, n_docs: int | Column) -> DataFrame:
    """Add ``idf`` = ln((N+1)/(df+1))."""
    return doc_freq.withColumn("idf", idf(F.lit(n_docs), F.col("df")))


def weigh_terms(
    doc_term: DataFrame, doc_freq: DataFrame, n_docs: int | Column, weighting: str, key: tuple[str, ...] = KEY
) -> DataFrame:
    """``(key, term, weight)`` for a vocabulary of any size.

    ``weighting``: ``relative`` (idf times the term's share of the document), ``tfidf``, ``tf2idf``
    (tf enters twice, divided by the document's count) or ``ntc`` (tf idf at unit length).
    The vocabulary is stored first: AQE broadcasts it if it turns out small, otherwise both sides come
    straight from a shuffle, which lets AQE split frequent terms (it splits no join with an aggregate).
    Sums per document are bounded by one document's terms.
    """
    frequencies = stored(inverse_document_frequency(doc_freq, n_docs).select("term", "idf"))
    rows = doc_term.join(frequencies, "term")
    of_doc = Window.partitionBy(*key)
    tf, value = F.col("tf"), F.col("idf")
    if weighting == "relative":
        weight = relative_tfidf(tf, value, F.sum("tf").over(of_doc))
    elif weighting == "tf2idf":
        weight = tf2idf(tf, value, F.sum("tf").over(of_doc))
    elif weighting == "tfidf":
        weight = tf * value
    elif weighting == "ntc":
        length = F.sqrt(F.sum((tf * value) * (tf * value)).over(of_doc))
        weight = F.when(length > 0, tf * value / length).otherwise(F.lit(0.0))
    else:
        raise ValueError(f"unknown weighting {weighting!r}")
    return rows.select(*key, "term", weight.alias("weight"))


@dataclass(frozen=True)
class TermVectors:
    """A bounded vocabulary that turns documents into (id, count, idf) arrays and sparse vectors.

    Works row by row without a shuffle: the vocabulary, limited by ``vocabulary(max_terms=...)``, is
    shared with the tasks and looked up in Arrow batches.
    """

    terms: list[str]
    idf: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, vocab: DataFrame, n_docs: int, max_terms: int | None = MAX_TERMS) -> TermVectors:
        """With ``max_terms=None`` every term of ``vocab`` is read: the vocabulary's own size is the bound."""
        table = inverse_document_frequency(vocab, n_docs).select("term_id", "term", "idf")
        table = (table if max_terms is None else table.limit(max_terms + 1)).toArrow()
        if max_terms is not None and table.num_rows > max_terms:
            raise ValueError(f"vocabulary has more than {max_terms} terms; cut it with vocabulary(max_terms=...)")
        table = table.sort_by("term_id")
        return cls(table["term"].to_pylist(), table["idf"].to_numpy(), n_docs)

    def rows(self, counted: DataFrame, key: tuple[str, ...] = KEY, min_nonzeros: int = 0) -> DataFrame:
        """``(key, ids, counts, idfs)`` of the documents with more than ``min_nonzeros`` vocabulary terms.

        ``counted`` comes from ``terms.count_terms``.
        """
        counted = counted.select(*key, "terms")
        found = known_entries(counted.sparkSession, F.col("terms.term"), F.col("terms.tf"), self.terms, self.idf)
        kept = computed_once(counted, found, "found").where(F.size("found.ids") > min_nonzeros)
        return kept.select(*key, "found.ids", "found.counts", "found.idfs")

    def weights(self, rows: DataFrame, weighting: str) -> DataFrame:
        """Add ``weights``, one per id.

        ``tf``, ``tfidf``, ``relative``, ``tf2idf`` and ``ntc`` as in ``weigh_terms``; ``product`` is
        tf times tf idf without a division.
        """
        tf, idfs = F.col("counts"), F.col("idfs")
        tfidf = F.zip_with(tf, idfs, lambda a, b: a * b)
        product = F.zip_with(tf, idfs, lambda a, b: a * (a * b))

        def divided(values: Column, size: Column) -> Column:
            return let(size, lambda s: F.transform(values, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0))))

        total = F.aggregate(tf, F.lit(0.0), lambda s, x: s + x)
        choices = {
            "tf": tf,
            "tfidf": tfidf,
            "product": product,
            "relative": divided(tfidf, total),
            "tf2idf": divided(product, total),
            "ntc": let(tfidf, lambda v: divided(v, norm(v))),
        }
        return computed_once(rows, choices[weighting], "weights")

    def vectors(self, rows: DataFrame, weighting: str, name: str, key: tuple[str, ...] = KEY) -> DataFrame:
        """``(key, name)`` with the weights as a sparse ML vector, stored: a fit reads them once per iteration."""
        weighted = self.weights(rows, weighting)
        entries = sparse_entries(F.col("ids"), F.col("weights"), len(self.terms))
        return stored(weighted.select(*key, entries.alias(name)), vectors=(name,))

    def long(self, rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
        """``(key, term_id, weight)`` of weighted rows."""
        return rows.select(*key, F.inline(F.arrays_zip(F.col("ids").alias("term_id"), F.col("weights").alias("weight"))))
