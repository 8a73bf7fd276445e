"""Audit of fitted k-means centres by sufficient sums.

Every row goes to its nearest returned centre; each task sums, per centre, the rows' count, their components
and their squared distances, and one small aggregate (k rows per task) adds those sums. A fit that has
converged is stationary: each centre is the mean of the rows that are nearest to it. A wrong or unfinished fit
shows a defect (the largest distance of a centre from its members' mean).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(centres: np.ndarray):
    k, width = centres.shape
    norms = (centres**2).sum(axis=1)

    def run(batches):
        count, total, cost = np.zeros(k), np.zeros((k, width)), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
            near = (norms[None, :] - 2 * x @ centres.T).argmin(axis=1)
            np.add.at(count, near, 1)
            np.add.at(total, near, x)
            np.add.at(cost, near, ((x - centres[near]) ** 2).sum(axis=1))
        offsets = pa.array(np.arange(k + 1, dtype=np.int32) * width)
        yield pa.record_batch({
            "cluster": pa.array(np.arange(k, dtype=np.int32)), "n": pa.array(count.astype(np.int64)),
            "total": pa.ListArray.from_arrays(offsets, pa.array(total.ravel())), "cost": pa.array(cost),
        })

    return run


def centre_audit(rows: DataFrame, column: str, centres: np.ndarray) -> DataFrame:
    """``(cluster, size, cost, defect, centre, mean)`` of ``centres`` (k × width) over the vectors ``column``.

    Rows whose vector is null or of another width are not counted. ``mean`` and ``defect`` are null for a centre
    without rows. Ties go to the lower cluster.
    """
    k, width = centres.shape
    vectors = rows.select(F.col(column).cast("array<double>").alias("v")).where(F.size("v") == width)
    parts = vectors.mapInArrow(_sums(centres), "cluster int, n long, total array<double>, cost double")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("size"), Summarizer.sum(array_to_vector("total")).alias("total"), F.sum("cost").alias("cost"))
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    mine = F.element_at(centre, F.col("cluster") + 1)
    mean = F.when(F.col("size") > 0, F.transform(vector_to_array("total"), lambda s: s / F.col("size")))
    defect = F.sqrt(F.aggregate(F.zip_with(mine, F.col("mean"), lambda c, m: (c - m) * (c - m)), F.lit(0.0), lambda a, x: a + x))
    return summed.select("cluster", "size", "cost", mine.alias("centre"), mean.alias("mean")).withColumn("defect", defect)
