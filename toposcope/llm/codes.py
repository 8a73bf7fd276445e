"""Vector codes: integer product quantisation whose distances come from per-dimension value dictionaries.

Each component ``x`` becomes the integer ``floor(256 * x)``; a vector is cut into ``parts`` equal consecutive
parts, and each part position has a codebook of up to ``entries`` integer entries, refined by ``rounds`` of
integer k-means (assign to the nearest entry, replace each entry by the floor of its parts' mean).

Distances are never computed component by component. Per Arrow batch and dimension, the distinct integers of
that dimension form a dictionary; the squared difference of every dictionary value to every entry is tabulated
once, and a part's distance to all entries is the sum of one gather per dimension from those tables. The
tables have (distinct values × entries) cells, bounded by the batch, not by the table.

Spark does the rest: the integer vectors are written once to the shared folder (three passes read them), every
round sums (count, component sums) per (part, entry) within each task and adds those partial sums over one
small aggregate, and the driver only sees parts × entries × part-width numbers. Nothing groups by a key of the
data; a label shared by a third of the rows is one row of a partial aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposcope.settings import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


def usable(vector: Column) -> Column:
    """True for a vector with at least one component, none of them null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def integer_vectors(df: DataFrame, column: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:
    """``(vec_id, label, q)`` with ``q`` the components as ``floor(256 * x)`` (long), and the common width.

    Rows with a null vector, or with a null, NaN or infinite component, are left out. The width is that of the
    usable vector of the smallest id (then the least vector); usable rows of another width, or a width that is
    not a multiple of ``parts``, are left out as well. Other columns are not read, so their names never clash.
    """
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("int")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(column).alias("v")).where(usable(F.col("v")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).limit(1).collect()
    width = first[0][0] if first else 0
    if width % parts:
        width = 0
    ints = rows.where(F.size("v") == width).select("vec_id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))
    return ints, width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return values.reshape(len(column), width)


def nearest(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry index of every part (ties to the lower index) and the squared distance to it, by dictionary tables.

    ``q`` is (rows, width) integers, ``books`` is (parts, entries, part width).
    """
    n, (parts, entries, step) = len(q), books.shape
    codes = np.zeros((n, parts), np.int64)
    error = np.zeros((n, parts), np.int64)
    if not n or not entries:
        return codes, error
    rows = np.arange(n)
    for p in range(parts):
        distance = np.zeros((n, entries), np.int64)
        for j in range(step):
            values, index = np.unique(q[:, p * step + j], return_inverse=True)  # the dimension's dictionary
            table = (values[:, None] - books[p, :, j][None, :]) ** 2  # every distinct value to every entry
            distance += table[index]  # a gather per dimension, an add per part
        codes[:, p] = distance.argmin(axis=1)
        error[:, p] = distance[rows, codes[:, p]]
    return codes, error


def _partial_sums(books: np.ndarray, width: int):
    parts, entries, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, step), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(0), width)
            codes, _ = nearest(q, books)
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], q[:, p * step : (p + 1) * step])
        used = np.argwhere(count > 0)
        if len(used):
            p, e = used[:, 0], used[:, 1]
            yield pa.record_batch(
                {
                    "part": pa.array(np.repeat(p, step), pa.int32()),
                    "entry": pa.array(np.repeat(e, step), pa.int32()),
                    "pos": pa.array(np.tile(np.arange(step), len(used)), pa.int32()),
                    "n": pa.array(np.repeat(count[p, e], step), pa.int64()),
                    "total": pa.array(total[p, e].ravel(), pa.int64()),
                }
            )

    return run


def _assigned(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2), width)
            codes, error = nearest(q, books)
            offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * books.shape[0])
            yield pa.record_batch(
                {
                    "vec_id": batch.column(0),
                    "label": batch.column(1),
                    "codes": pa.ListArray.from_arrays(offsets, pa.array(codes.ravel(), pa.int32())),
                    "error": pa.array(error.sum(axis=1), pa.int64()),
                }
            )

    return run


def train(ints: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width / parts) after ``rounds`` of integer k-means over all rows of ``ints``.

    Start: the parts of the ``entries`` rows of smallest id, ascending (null ids last, equal ids by vector); with
    fewer rows, fewer entries. A round assigns every part to its nearest entry, then sets each entry to the
    componentwise ``floor(sum / count)`` of its parts; an entry without parts stays.
    """
    step = width // parts if width else 0
    start = ints.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    books = np.array([r[0] for r in start], np.int64).reshape(len(start), parts, step).transpose(1, 0, 2).copy() if start else np.zeros((parts, 0, step), np.int64)
    if not len(start):
        return books
    schema = "part int, entry int, pos int, n long, total long"
    for _ in range(rounds):
        sums = ints.select("q").mapInArrow(_partial_sums(books, width), schema).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in sums.collect():  # at most parts × entries × step rows
            books[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return books


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def encode(df: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, label, codes, code, error, label_error, codebooks_sha256)`` for every usable row.

    ``codes`` holds the entry index of each part, ``code`` the same as two lower-case hex digits each; ``error``
    is the squared distance summed over parts, ``label_error`` the sum of ``error`` over the rows of equal label
    (null labels together). Unusable rows (see ``integer_vectors``) are left out; an empty table gives no rows.
    Repeated rows are each encoded. The integer products stay exact while ``|x| < 2^20``.
    """
    ints, width = integer_vectors(df, column, parts)
    ints = stored(ints)
    books = train(ints, width, parts, entries, rounds)
    schema = "vec_id long, label int, codes array<int>, error long"
    rows = ints.mapInArrow(_assigned(books, width), schema)
    rows = stored(rows)
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same_label")
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    out = rows.join(by_label, rows["label"].eqNullSafe(by_label["same_label"]), "left")
    return out.select("vec_id", "label", "codes", hexed.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
