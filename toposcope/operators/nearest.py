"""Nearest centres of a document and nearest rows of a centre."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toposcope.functions.vectors import centre_scores, top_of

CLOSER_IS_LESS = {"sqeuclidean", "divergence"}


def nearest_centres(
    rows: DataFrame, key: tuple[str, ...], vector: str, centres: np.ndarray, n: int, metric: str = "cosine"
) -> DataFrame:
    """``(key, rank, topic, weight)``: the ``n`` best centres of each row, scored and ranked in the row.

    A score against a zero vector is null and comes last.
    """
    scores = centre_scores(rows.sparkSession, F.col(vector), centres, metric)
    best = top_of(F.col("_scores"), n, metric in CLOSER_IS_LESS)
    return rows.withColumn("_scores", scores).select(*key, F.inline_outer(best))


def nearest_rows(
    rows: DataFrame, key: tuple[str, ...], vector: str, centres: np.ndarray, n: int, metric: str = "cosine"
) -> DataFrame:
    """``(topic, rank, key, weight)``: the ``n`` best rows of each centre, ties by key.

    (The outer generator keeps Spark from adding a filter that would score every row a second time.)
    Each task ranks its own rows first (window group limit), so only n rows per task and centre move.
    """
    scores = centre_scores(rows.sparkSession, F.col(vector), centres, metric)
    long = rows.withColumn("_scores", scores).select(*key, F.posexplode_outer("_scores").alias("topic", "weight"))
    long = long.withColumn("weight", F.nanvl("weight", F.lit(None).cast("double")))
    order = F.asc_nulls_last("weight") if metric in CLOSER_IS_LESS else F.desc_nulls_last("weight")
    return top_rows(long, "topic", [order, *key], n).select("topic", "rank", *key, "weight")


def top_rows(long: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank`` from 1."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return long.withColumn("rank", place).where(F.col("rank") <= n)
