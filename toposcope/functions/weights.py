"""Term weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1))


def relative_tfidf(tf: Column, idf_value: Column, total_tf: Column) -> Column:
    """Inverse document frequency times the term's share of the document's counted terms."""
    return idf_value * tf / total_tf


def tf2idf(tf: Column, idf_value: Column, total_tf: Column) -> Column:
    """Term frequency enters twice: tf times (tf idf), divided by the document's counted terms."""
    return tf * (tf * idf_value) / total_tf
