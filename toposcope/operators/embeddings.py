"""Document vectors from word vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.functions.vectors import weighted_rows
from toposcope.operators.terms import KEY
from toposcope.settings import computed_once, small

MATRIX_BYTES = 128 << 20  # per Python worker
JOIN_BYTES = 512 << 20  # per executor; a broadcast passes the driver, whose default limit is 1 GiB


def vocabulary_vectors(vocab: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """``(term_id, term, vec)`` of the vocabulary's terms that have a vector."""
    terms = vocab.select("term_id", "term")
    return word_vectors.join(small(terms), word_vectors["word"] == terms["term"]).select("term_id", "term", "vec")


def word_matrix(term_vectors: DataFrame, n_terms: int, max_bytes: int = MATRIX_BYTES) -> np.ndarray | None:
    """Rows by term id with a trailing 1 for known terms, zeros elsewhere; None if larger than ``max_bytes``.

    The size is computed from the vocabulary size and the vector width before anything is fetched.
    """
    first = term_vectors.select(F.size("vec")).first()
    if first is None or n_terms * (first[0] + 1) * 8 > max_bytes:
        return None
    matrix = np.zeros((n_terms, first[0] + 1))
    table = term_vectors.select("term_id", "vec").toArrow()
    ids = table["term_id"].to_numpy()
    matrix[ids, :-1] = np.stack(table["vec"].to_numpy()) if len(ids) else 0.0
    matrix[ids, -1] = 1.0
    return matrix


def document_vectors(
    rows: DataFrame, term_vectors: DataFrame, n_terms: int, key: tuple[str, ...] = KEY, max_bytes: int = MATRIX_BYTES,
    width: int = 0,
) -> DataFrame:
    """``(key, vec)``: weighted mean of the known terms' vectors; a zero vector where no term is known.

    ``rows`` has ``ids`` and ``weights`` (see ``TermVectors.weights``). If the vocabulary's vectors fit
    ``max_bytes`` they are shared with the tasks and no row moves; otherwise see ``joined_means``.
    Both give the same values. ``width`` is that of the zero vectors where ``term_vectors`` is empty.
    """
    matrix = word_matrix(term_vectors, n_terms, max_bytes)
    if matrix is None:
        return joined_means(rows, term_vectors, n_terms, key, width=width).select(*key, "vec")
    product = weighted_rows(rows.sparkSession, F.col("ids"), F.col("weights"), matrix)
    summed = computed_once(rows.select(*key, "ids", "weights"), product, "sums")
    total = F.element_at("sums", -1)
    parts = F.slice("sums", 1, matrix.shape[1] - 1)
    means = F.transform(parts, lambda x: F.when(total != 0, x / total).otherwise(F.lit(0.0)))
    return computed_once(summed, means, "vec").select(*key, "vec")


def joined_means(
    rows: DataFrame, term_vectors: DataFrame, n_terms: int, key: tuple[str, ...], join_bytes: int = JOIN_BYTES, width: int = 0
) -> DataFrame:
    """``(key, vec, total)``: weighted means by a join of (document, term) pairs with the terms' vectors.

    Up to ``join_bytes`` the vectors are a broadcast join's table (one copy per executor, not per
    Python worker); beyond that both sides are shuffled on the term. A document's pairs are next to
    each other, so summing per task leaves about one vector per document to shuffle. The sums are one
    plain column per component: those fit a hash table, while a vector aggregate falls back to sorting
    every pair with its vector, on disk.
    """
    pairs = rows.select(*key, F.inline(F.arrays_zip(F.col("ids").alias("term_id"), F.col("weights").alias("weight"))))
    width = term_vectors.agg(F.max(F.size("vec"))).first()[0] or width
    vectors = term_vectors.select("term_id", "vec")
    if n_terms * width * 8 <= join_bytes:
        vectors = F.broadcast(vectors)
    sums = [F.sum(F.col("weight") * F.col("vec")[i]).alias(f"_{i}") for i in range(width)]
    parts = [F.when(F.col("total") != 0, F.col(f"_{i}") / F.col("total")).otherwise(F.lit(0.0)) for i in range(width)]
    means = (
        pairs.where("weight <> 0")
        .join(vectors, "term_id")
        .groupBy(*key)
        .agg(*sums, F.sum("weight").alias("total"))
        .select(*key, F.array(*parts).cast("array<double>").alias("vec"), "total")
    )
    zero = F.array_repeat(F.lit(0.0), width)
    return (
        rows.select(*key)
        .join(means, list(key), "left")
        .select(*key, F.coalesce("vec", zero).alias("vec"), F.coalesce("total", F.lit(0.0)).alias("total"))
    )


def unknown_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """``(word)``: different lower-cased words, other than numbers, that are not in ``known``.

    Made distinct per task before the anti join, so frequent words do not pile up.
    """
    found = words.select(F.lower("word").alias("word")).where(~F.col("word").rlike("^[0-9]+$")).distinct()
    return found.join(known.select("word"), "word", "left_anti")


def vector_width(word_vectors: DataFrame) -> int:
    """Width of the first vector, 0 for an empty table."""
    first = word_vectors.select(F.size("vec")).first()
    return first[0] if first else 0


def embedding_lines(word_vectors: DataFrame) -> DataFrame:
    """``(value)``: ``word TAB v1,v2,...`` text lines."""
    numbers = F.concat_ws(",", F.col("vec").cast("array<string>"))
    return word_vectors.select(F.concat_ws("\t", "word", numbers).alias("value"))
