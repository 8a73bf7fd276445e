"""Latent semantic analysis by a truncated singular value decomposition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.functions.vectors import norm, top_of, weighted_rows
from toposcope.operators.embeddings import MATRIX_BYTES, joined_means
from toposcope.operators.models import topic_table
from toposcope.operators.nearest import top_rows
from toposcope.operators.terms import KEY
from toposcope.settings import computed_once, term_table


@dataclass(frozen=True)
class Decomposition:
    """Singular values and right vectors of documents x terms.

    Spark returns both on the driver (terms x rank); the vocabulary's bound is their bound. Left
    vectors are never fetched: they are row products with V, computed where the documents are.
    """

    sigma: np.ndarray
    v: np.ndarray
    terms: list[str]

    @classmethod
    def of(cls, rows: DataFrame, vector: str, terms: list[str], rank: int = 200) -> Decomposition:
        # The solver multiplies by the matrix many times, once per iteration. Its rows stay on the executors' disks: those
        # that memory can't hold would each be read whole into buffers, to be put back there, and push others out.
        matrix = MLUtils.convertVectorColumnsFromML(rows.select(vector), vector).persist(StorageLevel.DISK_ONLY)
        svd = RowMatrix(matrix).computeSVD(rank, computeU=False)
        v = svd.V.toArray()
        matrix.unpersist()
        # Vectors are defined up to sign: make each one's largest component positive.
        signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        return cls(svd.s.toArray(), v * np.where(signs == 0, 1.0, signs)[None, :], terms)

    @property
    def rank(self) -> int:
        return len(self.sigma)

    def values(self, spark: SparkSession) -> DataFrame:
        """``(concept, sigma)`` in falling order."""
        return spark.createDataFrame([(i, float(s)) for i, s in enumerate(self.sigma)], "concept int, sigma double")

    def term_vectors(self, spark: SparkSession, scaled: bool = False, concepts: int | None = None) -> DataFrame:
        """``(term_id, term, vec)``: rows of V, or of V diag(sigma)."""
        m = (self.v * self.sigma[None, :] if scaled else self.v)[:, : concepts or self.rank]
        return term_table(spark, self.terms, m)

    def topics(self, spark: SparkSession, concepts: int, n: int = 10) -> DataFrame:
        """``(topic, rank, term_id, term, weight)``: terms with the largest absolute component of a concept.

        Read off V where it is, on the driver; ties by term.
        """
        n, best = min(n, len(self.terms)), {}
        for topic, column in enumerate(np.abs(self.v[:, :concepts]).T):
            near = np.flatnonzero(column >= np.partition(column, -n)[-n]) if n else []
            ranked = sorted(near, key=lambda i: (-column[i], self.terms[i]))[:n]
            best[topic] = [(i, column[i]) for i in ranked]
        return topic_table(spark, best, self.terms)

    def project(self, rows: DataFrame, key: tuple[str, ...] = KEY, max_bytes: int = MATRIX_BYTES) -> DataFrame:
        """``(key, vec, size)``: document times V (which is U diag(sigma)) and the document's length.

        ``rows`` has ``ids`` and ``weights``. V is shared with the tasks if it fits ``max_bytes``,
        otherwise joined.
        """
        size = norm(F.col("weights")).alias("size")
        if self.v.nbytes <= max_bytes:
            product = weighted_rows(rows.sparkSession, F.col("ids"), F.col("weights"), self.v)
            return computed_once(rows.select(*key, "ids", "weights", size), product, "vec").select(*key, "vec", "size")
        means = joined_means(rows, self.term_vectors(rows.sparkSession), len(self.terms), key)
        sums = means.select(*key, F.transform("vec", lambda x: x * F.col("total")).alias("vec"))
        return sums.join(rows.select(*key, size), list(key))

    def documents(self, projected: DataFrame, key: tuple[str, ...] = KEY, n: int = 10, ascending: bool = False) -> DataFrame:
        """``(key, rank, topic, weight)``: concept weights of a document divided by its length, best ``n``."""
        scaled = F.transform("vec", lambda x: F.when(F.col("size") > 0, x / F.col("size")))
        return projected.withColumn("_w", scaled).select(*key, F.inline(top_of(F.col("_w"), n, ascending)))

    def left_vectors(self, projected: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
        """``(key, concept, u)``: rows of U."""
        sigma = F.array(*[F.lit(float(s)) for s in self.sigma])
        return projected.select(
            *key, F.posexplode(F.zip_with("vec", sigma, lambda x, s: F.when(s > 0, x / s))).alias("concept", "u")
        )

    def concept_documents(self, projected: DataFrame, key: tuple[str, ...] = KEY, n: int = 10) -> DataFrame:
        """``(concept, rank, key, u)``: documents with the largest (signed) component of each concept."""
        long = self.left_vectors(projected, key)
        return top_rows(long, "concept", [F.desc("u"), *key], n).select("concept", "rank", *key, "u")
