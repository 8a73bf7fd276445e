"""Vector expressions: plain columns for small vectors, Arrow batches for dense products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PIECE_WORDS = 1 << 19


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two ``array<double>`` columns; null when one of them has length zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def known_entries(spark: SparkSession, words: Column, counts: Column, terms: list[str], idf: np.ndarray) -> Column:
    """``struct<ids, counts, idfs>`` of a word array and its counts: the vocabulary's words only, by ascending id.

    ``terms`` is a vocabulary of bounded size. Rows are looked up by Arrow and sorted in pieces of about half a
    million words, one row at least, so the memory of a call follows its batch.
    """
    shared = spark.sparkContext.broadcast((pa.array(terms, pa.string()), np.asarray(idf, dtype=np.float64)))

    def entries(batch: pa.Array, numbers: pa.Array, sizes: np.ndarray) -> pa.Array:
        names, values = shared.value
        found = pc.index_in(batch.flatten(), value_set=names)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)[known]
        ids = found.drop_null().to_numpy()
        order = np.argsort((row << 32) | ids)
        ids, tf = ids[order], numbers.flatten().to_numpy(zero_copy_only=False)[known][order].astype(np.float64)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]), pa.int32())
        columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, tf, values[ids])]
        return pa.StructArray.from_arrays(columns, names=["ids", "counts", "idfs"])

    @F.arrow_udf("struct<ids:array<int>,counts:array<double>,idfs:array<double>>")
    def find(batch: pa.Array, numbers: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        ends, parts, low = np.cumsum(sizes), [], 0
        while low < len(sizes) or not parts:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE_WORDS, side="right")))
            parts.append(entries(batch[low:high], numbers[low:high], sizes[low:high]))
            low = high
        return pa.concat_arrays(parts)

    return find(words, counts)


def sparse_entries(ids: Column, values: Column, size: int) -> Column:
    """The fields of a sparse ML vector (``settings.stored`` reads them back as one); ids ascending."""
    return F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), ids.alias("indices"), values.alias("values"))


def top_of(scores: Column, n: int, ascending: bool = False) -> Column:
    """``array<struct<rank, topic, weight>>`` with the ``n`` best positions of a score array.

    Works inside the row, so ranking topics per document needs no shuffle. Ties go to the lower
    position; scores that are null or NaN come last.
    """

    def key(s: Column, i: Column) -> Column:
        missing = s.isNull() | F.isnan(s)
        return F.struct(
            missing.alias("missing"),
            F.when(~missing, s if ascending else -s).alias("order"),
            i.alias("topic"),
            F.when(~missing, s).alias("weight"),
        )

    best = F.slice(F.sort_array(F.transform(scores, key)), 1, n)
    return F.transform(
        best, lambda e, r: F.struct((r + 1).alias("rank"), e["topic"].alias("topic"), e["weight"].alias("weight"))
    )


def centre_scores(spark: SparkSession, vector: Column, centres: np.ndarray, metric: str) -> Column:
    """Score of an ``array<double>`` against each of k centres, as ``array<double>``.

    ``centres`` (k x dim) are model parameters: their number is chosen by the caller, not by the data.
    ``metric``: ``cosine``, ``sqeuclidean``, ``dot`` or ``divergence`` (see ``symmetric_divergence``).
    """
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(centres, dtype=np.float64))
    measure = METRICS[metric]

    @F.pandas_udf("array<double>")
    def score(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(measure(np.stack(vectors.to_list()).astype(np.float64), shared.value)))

    return score(vector)


def weighted_rows(spark: SparkSession, ids: Column, weights: Column, matrix: np.ndarray) -> Column:
    """``sum(weight * matrix[id])`` over one document's (id, weight) arrays, as ``array<double>``.

    The caller checks the size of ``matrix`` before it is shared with the tasks. Memory per call is
    one document's distinct terms times the width.
    """
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(matrix, dtype=np.float64))

    @F.pandas_udf("array<double>")
    def combine(rows: pd.Series, amounts: pd.Series) -> pd.Series:
        m, sizes = shared.value, np.array([len(i) for i in rows], dtype=np.int64)
        out, some = np.zeros((len(sizes), m.shape[1])), sizes > 0
        ends = np.cumsum(sizes)
        low = 0
        while low < len(sizes):  # some ten thousand terms at a time, one document at least
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 16_384, side="right")))
            own = low + np.flatnonzero(some[low:high])
            if len(own):
                ids = np.concatenate([np.asarray(rows.iloc[r], dtype=np.int64) for r in own])
                weight = np.concatenate([np.asarray(amounts.iloc[r], dtype=np.float64) for r in own])
                out[own] = np.add.reduceat(m[ids] * weight[:, None], np.cumsum(sizes[own]) - sizes[own], axis=0)
            low = high
        return pd.Series(list(out), dtype=object)

    return combine(ids, weights)


def _cosine(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
    return np.divide(x @ c.T, size, out=np.full(size.shape, np.nan), where=size > 0)


def _sqeuclidean(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _divergence(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    def half(p: np.ndarray, total: np.ndarray) -> np.ndarray:
        safe = np.where(p > 0, p, 1.0)
        return np.where(p > 0, p * (np.log(2 * safe) - np.log(np.where(p > 0, total, 1.0))), 0.0)

    return np.stack([(half(x, x + row) + half(np.broadcast_to(row, x.shape), x + row)).sum(axis=1) for row in c], axis=1)


METRICS = {
    "cosine": _cosine,
    "sqeuclidean": _sqeuclidean,
    "dot": lambda x, c: x @ c.T,
    "divergence": _divergence,
}


def symmetric_divergence(w: Column, c: Column) -> Column:
    """One feature's part of the symmetric divergence between a word and a centre; 0 ln 0 is 0."""

    def half(p: Column) -> Column:
        return F.when(p > 0, p * (F.log(2 * p) - F.log(w + c))).otherwise(F.lit(0.0))

    return half(w) + half(c)
